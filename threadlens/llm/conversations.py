"""Repair of conversations at least cost, the least audit among equals found by prefix doubling.

A conversation is to give role initials `(s?(ua)+)?`. Rows are kept, given another role, deleted, or rows are inserted; the edits' initials in order are the audit.
Costs to the end are worked out backwards, for many conversations at once. What is left are the arcs of least cost between nodes (rows done, state). An arc's rank is that of the audit that begins with it:
by its letter at first, then by audits of two, four, eight letters, each from the ranks of the two halves, as the pointer of an arc leads to the best arc where its own half ends. A letter leads from a node to
one other only, so a prefix of an audit has one end. Read along the doubled pointers, the best arcs are the audit.

Spark deals conversations out and sorts their rows; a task goes through them as a stream and holds some bytes for each row of a conversation. Texts are held up to HOLD bytes: a longer conversation's hash is made in a second
pass over its sorted rows, which holds no text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.shared import materialise

#: Fixed: the characters that do not count as text, the prices of edits.
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, LATE = 0, 3, 4, 3, 3
#: Rows whose conversations are worked on at once; bytes of text that are held for them.
ROWS, HOLD = 20000, 32 << 20
#: Rows of a long conversation that are ranked together.
CHUNK = 1 << 14
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a row of initial s, u, a or another; -1 where the row cannot stand.
AFTER = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
#: The state after a row that is inserted or given another role, and that row's role.
MADE = np.array([USER, USER, ASSISTANT, USER])
ROLE = {USER: "user", ASSISTANT: "assistant"}
LETTERS = "DIKR"
FAR = np.int64(1) << 40


def costs(codes: np.ndarray, faults: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Least costs to the end from each node: row r of conversation c at begin[c] + c + r, its end after its last row; by state."""
    out = np.full((len(codes) + len(size), 4), FAR)
    base = begin + np.arange(len(size))
    out[base + size] = [0, 2 * INSERT, INSERT, 0]
    longest_first = np.argsort(-size, kind="stable")
    alive = np.searchsorted(-size[longest_first], -np.arange(1, int(size.max(initial=0)) + 1), side="right")
    for step, n in enumerate(alive.tolist(), 1):  # the row that is `step` before the end, of all conversations that have one
        c = longest_first[:n]
        row, node = begin[c] + size[c] - step, base[c] + size[c] - step
        ahead, stays, late = out[node + 1], (faults[row] == 0) | (faults[row] == 3), np.where(faults[row] == 3, LATE, 0)[:, None]
        after = AFTER[:, codes[row]].T
        kept = np.where(after >= 0, np.take_along_axis(ahead, np.maximum(after, 0), 1), FAR) + KEEP + late
        other = ahead[:, MADE] + REROLE + late
        best = np.minimum(ahead + DELETE, np.where(stays[:, None], np.minimum(kept, other), FAR))
        for _ in range(2):  # an inserted row, and one more
            best = np.minimum(best, best[:, MADE] + INSERT)
        out[node] = best
    return out


def arcs(codes: np.ndarray, faults: np.ndarray, begin: np.ndarray, size: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The arcs of least cost: (node it leaves, letter, node it reaches), nodes numbered 4 * row of `cost` + state."""
    base = begin + np.arange(len(size))
    conv = np.repeat(np.arange(len(size)), size)
    node = np.arange(len(codes)) + conv  # of each row
    found = []

    def tight(rows, states, letter, to_rows, to_states, price):
        there = (to_states >= 0) & (cost[to_rows, np.maximum(to_states, 0)] + price == cost[rows, states])
        found.append(np.stack([4 * rows[there] + states[there], np.full(int(there.sum()), letter), 4 * to_rows[there] + to_states[there]]))

    every = np.concatenate([node, base + size])
    stays, late = (faults == 0) | (faults == 3), np.where(faults == 3, LATE, 0)
    for q in range(4):
        of = np.full(len(every), q)
        tight(every, of, 1, every, np.full(len(every), MADE[q]), INSERT)
        tight(node, of[: len(node)], 0, node + 1, of[: len(node)], DELETE)
        n = node[stays]
        tight(n, of[: len(n)], 2, n + 1, AFTER[q][codes[stays]], KEEP + late[stays])
        tight(n, of[: len(n)], 3, n + 1, np.full(len(n), MADE[q]), REROLE + late[stays])
    source, letter, target = np.concatenate(found, axis=1)
    order = np.lexsort((letter, source))
    return source[order], letter[order], target[order]


def least_paths(source: np.ndarray, letter: np.ndarray, target: np.ndarray, starts: np.ndarray, nodes: int, longest: int) -> np.ndarray:
    """One row of arcs for each start node, the number of arcs beyond its end. `source` is sorted; paths have up to `longest` arcs."""
    end = len(source)  # an arc past the last one: audits that are over. It is smaller than every letter and leads to itself
    first = np.searchsorted(source, np.arange(nodes + 1))

    def best(rank: np.ndarray) -> np.ndarray:
        """For each node the arc with the least rank."""
        out = np.full(nodes, end, np.int32)
        some = first[:-1] < first[1:]
        if end:
            low = np.minimum.reduceat(rank[:end], first[:-1][some])
            least = np.flatnonzero(rank[:end] == np.repeat(low, np.diff(first)[some]))
            out[source[least][::-1]] = least[::-1]
        return out

    rank = np.append(letter + 1, 0)
    pointers, reach = [np.append(best(rank)[target], np.int32(end))], 1
    while reach < longest:
        behind = pointers[-1]
        _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[behind], return_inverse=True)
        pointers.append(behind[behind])
        reach *= 2
    path = best(rank)[starts][:, None]
    for pointer in reversed(pointers):  # arcs at every 2 ** k-th letter, then those half way between
        path = np.stack([path, pointer[path]], axis=2).reshape(len(path), -1)
    return path


def _longest(rows: int) -> int:
    """Letters of an audit, at most: no row costs more than its deletion, so there are four inserted rows for three rows at most, and two at the end."""
    return 7 * rows // 3 + 4


def _by_chunks(code: np.ndarray, fault: np.ndarray, cost: np.ndarray, chunk: int) -> str:
    """The audit of one long conversation, `chunk` rows after `chunk` rows: where it leaves one is where it enters the next."""
    out, state, none = [], START, np.zeros(1, np.int64)
    for lo in range(0, len(code), chunk):
        own = slice(lo, lo + chunk)
        rows = len(code[own])
        source, letter, target = arcs(code[own], fault[own], none, np.array([rows]), cost[lo : lo + rows + 1])
        if lo + chunk < len(code):  # the next one goes on from the last nodes
            inside = source < 4 * rows
            source, letter, target = source[inside], letter[inside], target[inside]
        path = least_paths(source, letter, target, np.array([state]), 4 * (rows + 1), _longest(rows))[0]
        path = path[path < len(source)]
        out.append("".join(LETTERS[k] for k in letter[path].tolist()))
        state = int(target[path[-1]]) % 4
    return "".join(out)


def cheapest_edits(codes: list[bytes], faults: list[bytes], chunk: int = CHUNK) -> list[tuple[int, str]]:
    """(cost, audit) for each conversation, given its rows' initials (0 to 3 for s, u, a, others) and faults (0 none, 1 blank, 2 duplicate, 3 truncated)."""
    out: list[tuple[int, str]] = [(0, "")] * len(codes)
    kinds: dict[int, list[int]] = {}
    for i, c in enumerate(codes):
        if c:
            kinds.setdefault(len(c).bit_length(), []).append(i)
    for own in kinds.values():  # of like lengths
        size = np.array([len(codes[i]) for i in own])
        begin = np.cumsum(size) - size
        code, fault = (np.frombuffer(b"".join(x[i] for i in own), np.uint8).astype(np.int64) for x in (codes, faults))
        cost = costs(code, fault, begin, size)
        rows = begin + np.arange(len(size))
        if size.max() > chunk:
            for i, b, r, n in zip(own, begin, rows, size):
                out[i] = int(cost[r, 0]), _by_chunks(code[b : b + n], fault[b : b + n], cost[r : r + n + 1], chunk)
            continue
        source, letter, target = arcs(code, fault, begin, size, cost)
        paths = least_paths(source, letter, target, 4 * rows, 4 * len(cost), _longest(int(size.max())))
        for i, r, path in zip(own, rows, paths):
            out[i] = int(cost[r, 0]), "".join(LETTERS[k] for k in letter[path[path < len(source)]].tolist())
    return out


def repaired_rows(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation, from its rows as they were."""
    state = START
    for edit in audit:
        role, text = (None, "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = AFTER[state, initial(role)]
        else:
            state = MADE[state]
            role = ROLE[int(state)]
        yield role, text


def initial(role: str) -> int:
    """0 to 2 for roles that begin with s, u or a; 3 for all others."""
    return "sua".find(role[0]) % 4 if role else 3


def digest(audit: str, rows: Iterator[tuple[str, str]]) -> str:
    h = hashlib.sha256()
    for n, (role, text) in enumerate(repaired_rows(audit, rows)):
        h.update(f"{chr(10) if n else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
    return h.hexdigest()


@dataclass
class _Conversation:
    """What is held of one conversation while its rows pass."""

    ident: object
    codes: bytearray = field(default_factory=bytearray)
    faults: bytearray = field(default_factory=bytearray)
    seen: set = field(default_factory=set)
    rows: list | None = field(default_factory=list)
    held: int = 0
    low: int | None = None
    high: int | None = None
    turns: int = 0
    illegal: int = 0

    def add(self, turn: int | None, role: str, text: str, hold: int) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        name = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        bare = text.rstrip(BLANKS)
        self.faults.append(1 if not bare else 2 if name in self.seen else 3 if bare[-1] not in ".!?" else 0)
        self.seen.add(name)
        code = initial(role)
        if self.codes:
            self.illegal += (self.codes[-1], code) not in ((0, 1), (1, 2), (2, 1))
        self.codes.append(code)
        if self.rows is not None:
            self.held += len(text) + len(role)
            self.rows.append((role, text))
            if self.held > hold:
                self.rows = None

    def result(self, cost: int, audit: str) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        counts = [self.faults.count(k) for k in (1, 2, 3)]
        return (self.ident, gaps, *counts, self.illegal, cost, audit, None if self.rows is None else digest(audit, iter(self.rows)))


FOUND = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
FOUND_SQL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _record(rows: list[tuple], first: pa.DataType, schema: list) -> pa.RecordBatch:
    names = [("conv", first), *schema]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(names)], names=[n for n, _ in names])


def _repair(hold: int, rows_at_once: int):
    def solved(done: list[_Conversation], kind: pa.DataType) -> pa.RecordBatch:
        edits = cheapest_edits([bytes(c.codes) for c in done], [bytes(c.faults) for c in done])
        return _record([c.result(*e) for c, e in zip(done, edits)], kind, FOUND)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (conv, turn, role, text, present), sorted -> a row for each conversation."""
        done: list[_Conversation] = []
        rows, held, kind = 0, 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, turn, role, text, present in zip(*(c.to_pylist() for c in batch.columns)):
                if not done or done[-1].ident != conv:
                    if rows >= rows_at_once or held >= hold:
                        yield solved(done, kind)
                        done, rows, held = [], 0, 0
                    done.append(_Conversation(conv))
                if present:
                    done[-1].add(turn, role, text, hold)
                    held += len(text)
                rows += 1
        if done:
            yield solved(done, kind)

    return repair


def _hash_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, first, turn, role, text), sorted: the audit as the text of a conversation's first row, then its rows -> (conv, hash). Rows pass one by one."""
    kind = None

    def rows() -> Iterator[tuple]:
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field(0).type
            yield from zip(*(c.to_pylist() for c in batch.columns))

    ahead = rows()
    head = next(ahead, None)
    while head:
        conv, audit, following = head[0], head[4], None

        def own() -> Iterator[tuple[str, str]]:
            nonlocal following
            for row in ahead:
                if not row[1]:
                    following = row
                    return
                yield row[3], row[4]

        passing = own()
        sha = digest(audit, passing)
        for _ in passing:  # none are left of a right audit, but for the next conversation's first row
            pass
        yield _record([(conv, sha)], kind, [("sha", pa.string())])
        head = following


def repaired(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None, hold: int = HOLD, rows_at_once: int = ROWS) -> DataFrame:
    """One row for each conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Rows are taken by turn (null first), those of one turn by role and text. A null role or text is one space; a null id is a conversation of its own. Rows for which `present` is not true only name
    their conversation. An empty table gives an empty result; other columns are not read. `hold` and `rows_at_once` are limits on which no result depends.
    """
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = df.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"), there.alias("present"))
    kind = rows.schema["conv"].dataType.simpleString()
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    found = rows.repartition("conv").sortWithinPartitions(*order).mapInArrow(_repair(hold, rows_at_once), f"conv {kind}, {FOUND_SQL}")
    found = materialise(found)
    out = [F.col("conv").alias(id_col), *(F.col(n) for n, _ in FOUND)]
    long = found.where("repaired_sha256 is null")
    if long.isEmpty():
        return found.select(out)
    audits = long.select("conv", F.lit(False).alias("row"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    again = rows.where("present").join(long.select(F.col("conv").alias("long_conv")), F.col("conv").eqNullSafe(F.col("long_conv")), "left_semi")
    both = audits.union(again.select("conv", F.lit(True), "turn", "role", "text")).repartition("conv").sortWithinPartitions("conv", "row", *order[1:])
    hashes = both.mapInArrow(_hash_again, f"conv {kind}, sha string").withColumnRenamed("conv", "hash_conv")
    joined = long.drop("repaired_sha256").join(hashes, F.col("conv").eqNullSafe(F.col("hash_conv"))).withColumnRenamed("sha", "repaired_sha256")
    return found.where("repaired_sha256 is not null").select(out).union(joined.select(out))


def damaged(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows of `df` (those four columns), spoilt by the CRC of `id:turn`, and `present`: false for rows that are dropped. Nulls are one space, in the CRC too."""
    kind = F.pmod(F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (id_col, turn_col)))), F.lit(20))
    text = F.coalesce(text_col, F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce(role_col, F.lit(" ")))
    rows = df.select(id_col, turn_col, role.alias(role_col), text.alias(text_col), (kind != 0).alias("present"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")
