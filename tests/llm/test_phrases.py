"""Collocations against plain counting, whatever the limits; odd rows; ranges that cut phrases; hashes that clash."""

import bisect
import collections
import random
import re

import duckdb
import numpy as np
import pytest

from threadlens.llm import phrases
from threadlens.llm import queries as registered

SF = "/root/testdata/sf0.01"


def want(rows, least, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                f.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    own = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = collections.defaultdict(int)
    for p, a in own.items():
        for m in range(2, len(p) - 1):
            for i in range(1, len(p) - m + 1):
                inside[p[0], *p[i : i + m]] = max(inside[p[0], *p[i : i + m]], a)
    out = collections.defaultdict(list)
    for p, a in own.items():
        if inside[p] < a:
            score, _, left, right = min((1000 * a * n[p[0]] // (f[p[: k + 1]] * f[p[0], *p[k + 1 :]]), k, f[p[: k + 1]], f[p[0], *p[k + 1 :]]) for k in range(1, len(p) - 1))
            out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -score) for lang, found in out.items() for i, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("limits", [{}, {"slice_bytes": 700, "range_size": 90, "fan": 7, "bits": 8}])
def test_like_counting(spark, limits):
    rng = random.Random(4)
    letters = ["The", "of", "É", "é", "a" * 70, "日本", "x\x00y", "und"] + [f"w{i}" for i in range(30)]
    say = lambda m: " ".join(rng.choice(letters[: rng.randint(2, 38)]) + rng.choice(["", "", "", ",", "\t", ".\n"]) for _ in range(m))
    rows = [(rng.choice(["en", None, "", "und"]), rng.choice([None, "", " \t\n", say(3), say(60), say(500)])) for _ in range(60)]
    rows += [("en", "of the of the of the of the " * 300), ("en", "b" * 5000)] + [rows[3]] * 40
    df = spark.createDataFrame([(*r, 1, "x", 5) for r in rows], "lang string, text string, n int, name string, rank int").repartition(3)
    for least, top in ((5, 2000), (9, 7)):
        assert rows_of(phrases.collocations(df, least=least, top=top, **limits)) == want(rows, least, top)
    assert phrases.collocations(df.limit(0)).count() == 0 and phrases.collocations(df.where("text is null"), least=1).count() == 0


def test_query_like_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    table, docs = con.sql(registered.OP11_SQL), spark.read.parquet(f"{SF}/documents.parquet")
    found = sorted(table.fetchall())
    got = registered.op11_phrases(spark, SF)
    assert got.columns == table.columns and rows_of(got) == found and len(found) > 50
    assert rows_of(phrases.collocations(docs, slice_bytes=30000, range_size=3000, fan=16)) == found


def test_ranges_cut_phrases():
    rng = np.random.default_rng(1)
    keys = [rng.integers(1, 3, 4000).astype(np.uint64)] + [rng.choice(np.array([1, 2, 3, 15], np.uint64) << np.uint64(60), 4000) for _ in range(5)]
    for k in range(3, 6):
        stop = rng.random(4000) < 0.2
        for j in range(k, 6):
            keys[j] = np.where(stop, np.uint64(0), keys[j])
    count, got = collections.Counter(), collections.Counter()
    for row in zip(*(k.tolist() for k in keys)):
        count.update(row[:d] for d in range(3, 7) if row[d - 1])
    rows = list(zip(*(k.tolist() for k in keys)))
    edges = sorted(set(sorted(rows)[100::100]))
    place = np.array([bisect.bisect_right(edges, r) for r in rows])
    for at in range(len(edges) + 1):
        own = place == at
        around = [edges[i] for i in (at - 1, at) if 0 <= i < len(edges)]
        whole, n, part, m = phrases.mined([k[own] for k in keys], np.ones(int(own.sum()), np.int64), 3, around)
        got.update(dict(zip(whole, n)))
        got.update(dict(zip(part, m)))
    assert all(got[p] == n for p, n in count.items() if n >= 3)


def test_packed_suffixes_come_back():
    words = phrases.words_of([b"a b a b\na b a b c", b"", b"zz " * 70], 5)
    found = phrases._suffixes(words, words.text.astype(np.uint64) + np.uint64(9), np.arange(len(words.name)) % 3 != 1)
    keys = [found.key(i) for i in range(len(found.weight))]
    assert keys == sorted(set(keys)) and found.weight.sum() == (np.arange(len(words.name)) % 3 != 1).sum()
    parts = [phrases.unpack(phrases.pack(found, a, b)) for a, b in ((0, 3), (3, 5), (5, len(keys)))]
    both = phrases._together(parts)
    assert [both.key(i) for i in range(len(keys))] == keys and (both.weight == found.weight).all()


def test_words_with_one_hash_are_noticed(spark, monkeypatch):
    rows = [("en", "one two three. " * 9)]
    df = spark.createDataFrame(rows, "lang string, text string")
    seen = []
    right = phrases.words_of

    def wrong(parts, seed, bits):
        words = right(parts, seed, bits)
        words.name = np.full_like(words.name, 7)
        return words

    batch = [phrases.pa.RecordBatch.from_arrays([phrases.pa.array([1]), phrases.pa.array(["one two one"])], ["lang", "text"])]
    monkeypatch.setattr(phrases, "words_of", wrong)
    for words, lang, own in phrases._slices(batch, (5, 64), 1000):
        seen = [word for _, word in phrases._spellings(words, lang, np.arange(3))]
    assert sorted(seen) == [b"one", b"two"]
    monkeypatch.undo()
    real, calls = phrases._phrases, []

    def clashing(*args):
        calls.append(args[2])
        if len(calls) == 1:
            raise phrases._Clash
        return real(*args)

    monkeypatch.setattr(phrases, "_phrases", clashing)
    assert rows_of(phrases.collocations(df, least=2)) == want(rows, 2) and calls == list(phrases.SEEDS[:2])
