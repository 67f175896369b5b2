"""Conversation repair against a search over all edits, the query against a plain version, and odd rows."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from threadlens.llm import conversations
from threadlens.llm import queries as registered

SF = "/root/testdata/sf0.001"
GAP = r"[\x20\x09-\x0D]"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = re.sub(rf"{GAP}+\Z", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired rows): the least of all edits, by a search in the order of (cost, audit)."""
    faults, heap, tick, done = faults_of(rows), [(0, "", 0, 0, "", ())], itertools.count(1), {}
    while heap:
        cost, audit, _, i, initials, out = heapq.heappop(heap)
        state = (i, initials[-1:])
        if (cost, audit) > done.get(state, (cost, audit)):
            continue
        done[state] = (cost, audit)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, out
        following = {"": "su", "s": "u", "u": "a", "a": "u"}[initials[-1:]]
        steps = [(3, "I", i, role, "") for role in ("user", "assistant")]
        if i < len(rows):
            (role, text), late = rows[i], 3 * (faults[i] == "truncated")
            steps.append((4, "D", i + 1, None, None))
            if faults[i] in ("", "truncated"):
                steps += [(late, "K", i + 1, role, text), (3 + late, "R", i + 1, "user", text), (3 + late, "R", i + 1, "assistant", text)]
        for price, letter, j, role, text in steps:
            if role is None:
                heapq.heappush(heap, (cost + price, audit + letter, next(tick), j, initials, out))
            elif role[:1] and role[0] in following:
                heapq.heappush(heap, (cost + price, audit + letter, next(tick), j, initials + role[0], (*out, (role, text))))
    raise AssertionError


def spoilt(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def want(all_rows, ids):
    convs = {c: [] for c in ids}
    for r in all_rows:
        convs[r[0]].append(r)
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns, pairs = {r[1] for r in rows if r[1] is not None}, [(r[2], r[3]) for r in rows]
        faults, initials = faults_of(pairs), [r[2][:1] for r in rows]
        cost, audit, left = cheapest(pairs)
        sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in left).encode()).hexdigest()
        yield conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha


def test_query_like_a_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = registered.op13_conversation_repair(spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want(spoilt(rows), {r[0] for r in rows}))


def test_cheapest_edits_of_all_short_conversations():
    roles, texts = ["system", "user", "assistant", "tool"], {0: "fine {}.", 1: " \n", 3: "cut off {}"}
    for n in range(1, 4):
        every = [list(zip(r, f)) for r in itertools.product(range(4), repeat=n) for f in itertools.product((0, 1, 3), repeat=n)]
        got = conversations.cheapest_edits([bytes(r for r, _ in x) for x in every], [bytes(f for _, f in x) for x in every])
        for x, (cost, audit) in zip(every, got):
            assert (cost, audit) == cheapest([(roles[r], texts[f].format(i)) for i, (r, f) in enumerate(x)])[:2], x


@pytest.mark.parametrize("chunk", [1 << 14, 7])
def test_long_conversations_like_a_search(chunk):
    rng = random.Random(3)
    codes = [bytes(rng.choice([0, 1, 1, 2, 2, 3]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    roles = ["system", "user", "assistant", ""]
    got = conversations.cheapest_edits(codes, [bytes(len(c)) for c in codes], chunk)
    for c, (cost, audit) in zip(codes, got):
        assert (cost, audit) == cheapest([(roles[r], f"text {i}!") for i, r in enumerate(c)])[:2]


@pytest.mark.parametrize("limits", [{}, {"hold": 40, "rows_at_once": 3}])
def test_odd_rows(spark, limits):
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", None, "", "tool", "u"], ["One.", "two", "", None, " \t\n", "Three! \n", "four?", "é😀.", "x" * 5000 + "."]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(70)]
    rows += [rows[0]] * 5 + [(77, 1, "user", "alone.")] + [(k, 0, "user", "only one.") for k in range(100, 150)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, present int")
    got = conversations.repaired(conversations.damaged(df), present=conversations.F.col("present"), **limits).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want(spoilt(rows), {r[0] for r in rows}), key=str)
    plain = conversations.repaired(df, **limits).collect()
    assert sorted(map(tuple, plain), key=str) == sorted(want([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], {r[0] for r in rows}), key=str)
    assert conversations.repaired(df.limit(0)).count() == 0 and conversations.repaired(conversations.damaged(df.limit(0)), present=conversations.F.col("present")).count() == 0
