"""Collocations by multikey three-way quicksort of suffix pointers.

A suffix is the language and up to DEPTH words from a place on, within its piece. Spark deals suffixes into ranges of their leading words, and a task sorts pointers to its own: they are split by one word into
smaller, equal and larger ones; the equal part, whose size is a phrase's count, goes on with the next word until DEPTH, and any part with fewer than `least` suffixes is abandoned unsorted. Three jobs:

1. Suffixes, equal ones of a slice as one with a count, are sorted, packed and dealt by range. The ranges come from a bounded sample of suffixes; they decide where rows meet, not what is counted. A phrase that reaches over the edge of
   a range is counted in parts that are summed up. Beyond FAN ranges suffixes are dealt twice, coarsely and then finely, so that a slice sends FAN rows at most. What is dealt grows as the text does.
2. Words are told apart by hashes of 56 bits (64 from a terabyte on), which are proven to be different: the spellings of all words in frequent phrases are gathered, and if two of them have one hash, the work is done again with another seed.
3. Phrases are scored with the counts of their parts by joins.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.llm.shared import fresh_name, materialise, sized

#: Fixed: what ends a piece, and what parts words.
PIECE_ENDS, WORD_GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
DEPTH = 5
#: Bytes of text whose suffixes are packed together (a longer text is cut between words), and whose words are found at once.
SLICE, BUFFER = 8 << 20, 1 << 20
#: Suffixes that a range has, about; most ranges that one slice is dealt to, and most ranges in all.
RANGE, FAN, MOST_RANGES = 3_000_000, 4096, 1 << 18
#: Suffixes of the sample from which ranges come: so many for each range, and so many at most, about; bytes of text for each.
SAMPLE, MOST_SAMPLE, SPARSE = 64, 1 << 20, 500
#: Bits of a word's name in inputs of less than a terabyte; larger ones have names of 64 bits.
NAME_BITS = 56
#: Bits of the filter of words whose spellings are gathered.
FILTER_BITS = 26
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)

_FOLD = bytes(10 if b in PIECE_ENDS else 32 if b in WORD_GAPS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """The words of a buffer of folded bytes, as columns. `piece` numbers the pieces of the buffer, `last` is how many words of its piece follow a word."""

    data: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    text: np.ndarray
    name: np.ndarray
    piece: np.ndarray


def words_of(parts: list[bytes], seed: int, bits: int = 64) -> Words:
    """Words of texts, folded bytes with the same ends as pieces. A word's name is a hash of its bytes of so many bits, never 0."""
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    ends = data == 10
    gap = ends | (data == 32)
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    begin, end = edge[0::2], edge[1::2]
    # a polynomial of the bytes in an odd base modulo 2 ** 64: differences of running sums, moved down by the inverse base's powers
    base = np.uint64(seed | 1)
    steps = np.cumprod(np.full(len(data), base, np.uint64), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * steps, dtype=np.uint64)])
    back = np.uint64(pow(seed | 1, -1, 1 << 64))
    inverse = np.cumprod(np.full(len(data), back, np.uint64), dtype=np.uint64)
    name = _mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64) * np.uint64(seed))
    name = np.maximum(name >> np.uint64(64 - bits), np.uint64(1))
    lengths = np.array([len(p) + 1 for p in parts])
    text = np.searchsorted(np.cumsum(lengths), begin, side="right")
    piece = np.cumsum(ends)[begin] if len(begin) else begin
    return Words(data, begin, end - begin, text, name, piece)


def _segments(raw: bytes, most: int) -> Iterator[tuple[bytes, int]]:
    """A long text in parts, cut between words: (part with the DEPTH - 1 words that follow it, bytes of it where suffixes begin)."""
    at = 0
    while len(raw) - at > most:
        cut = min((x for x in (raw.find(b" ", at + most), raw.find(b"\n", at + most)) if x >= 0), default=-1)
        if cut < 0:
            break
        stop = cut
        for _ in range(DEPTH - 1):  # words beyond the cut; more of them do no harm, as no suffix begins there
            while stop < len(raw) and raw[stop] == 32:
                stop += 1
            ahead = min((x for x in (raw.find(b" ", stop), raw.find(b"\n", stop)) if x >= 0), default=len(raw))
            stop = ahead
            if stop < len(raw) and raw[stop] == 10:
                break
        yield raw[at:stop], cut - at
        at = cut
    yield raw[at:], len(raw) - at


def _slices(batches: Iterator[pa.RecordBatch], naming: tuple[int, int], slice_bytes: int) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    """(words, language of each, whether a suffix begins there) of texts of about `slice_bytes` each. Batches are (language, text)."""
    held: list[tuple[Words, np.ndarray, np.ndarray]] = []
    parts, langs, owned, size, taken = [], [], [], 0, 0

    def settle() -> None:
        words = words_of(parts, *naming)
        starts = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
        held.append((words, np.array(langs, np.int64).view(np.uint64)[words.text], words.begin < (starts + np.array(owned))[words.text]))
        parts.clear(), langs.clear(), owned.clear()

    def together() -> tuple[Words, np.ndarray, np.ndarray]:
        all_words, lang, own = zip(*held)
        held.clear()
        bytes_before = np.cumsum([0, *(len(w.data) for w in all_words)])
        join = lambda of: np.concatenate([of(w, n) for w, n in zip(all_words, bytes_before.tolist())])
        # a buffer has no more pieces than bytes, so its first byte's place keeps its pieces apart from those before
        words = Words(join(lambda w, n: w.data), join(lambda w, n: w.begin + n), join(lambda w, n: w.size), join(lambda w, n: w.text), join(lambda w, n: w.name), join(lambda w, n: w.piece + n))
        return words, np.concatenate(lang), np.concatenate(own)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(_FOLD)
            for part, own in _segments(raw, slice_bytes) if len(raw) > slice_bytes else [(raw, len(raw))]:
                parts.append(part)
                langs.append(lang)
                owned.append(own)
                size += len(part) + 1
                if size >= min(BUFFER, slice_bytes):
                    settle()
                    taken, size = taken + size, 0
                if taken >= slice_bytes:
                    yield together()
                    taken = 0
    if parts:
        settle()
    if held:
        yield together()


@dataclass
class Suffixes:
    """Different suffixes in order, with counts: columns are numbers of `names`, of which 0 is what lies beyond the end."""

    names: np.ndarray
    columns: list[np.ndarray]
    weight: np.ndarray

    def key(self, i: int) -> tuple[int, ...]:
        return tuple(int(self.names[c[i]]) for c in self.columns)


def _ordered(columns: list[np.ndarray], names: np.ndarray, weight: np.ndarray) -> Suffixes:
    """Rows of numbers sorted, equal ones as one."""
    width = max(1, int(len(names)).bit_length())
    each = max(1, 63 // width)
    # as many columns in one number as there is room for
    wide = []
    for k in range(0, len(columns), each):
        number = np.zeros(len(weight), np.int64)
        for c in columns[k : k + each]:
            number = (number << width) | c
        wide.append(number)
    order = np.lexsort(wide[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in wide:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return Suffixes(names, [c[order[first]] for c in columns], np.add.reduceat(weight[order], first) if len(first) else weight)


def _suffixes(words: Words, lang: np.ndarray, own: np.ndarray) -> Suffixes:
    """The suffixes (lang, word, ..., word) that begin in the texts."""
    n = len(lang)
    names, number = np.unique(np.concatenate([np.zeros(1, np.uint64), words.name, lang]), return_inverse=True)
    number = number.astype(np.int32)
    word = number[1 : n + 1]
    columns = [number[n + 1 :][own], word[own]]
    for k in range(1, DEPTH):
        following = np.zeros(n, np.int32)
        if n > k:
            following[:-k] = np.where(words.piece[k:] == words.piece[:-k], word[k:], 0)
        columns.append(following[own])
    return _ordered(columns, names, np.ones(int(own.sum()), np.int64))


def _bit(lang: np.ndarray, name: np.ndarray, bits: int) -> np.ndarray:
    return _mix(lang * np.uint64(SEEDS[2]) + name) >> np.uint64(64 - bits)


def _bits(bits: int):
    """(lang, name) -> (which 64 bits of the filter, the bits set)."""

    def bit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, name = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            at = _bit(lang, name, bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bits"])

    return bit


def _planes(a: np.ndarray, kind: str) -> bytes:
    return a.astype(kind).view(np.uint8).reshape(len(a), np.dtype(kind).itemsize).T.tobytes()


def pack(found: Suffixes, lo: int, hi: int) -> bytes:
    """Rows lo to hi, by planes of bytes, compressed. Languages and first words, which are in order, are numbers of a sorted dictionary; further words are numbers of one by frequency, or, where they come once, stand in a row of their own."""
    head, rest = np.concatenate([c[lo:hi] for c in found.columns[:2]]), np.concatenate([c[lo:hi] for c in found.columns[2:]])
    used = np.zeros(len(found.names), bool)
    used[head] = True
    sorted_names, numbers = found.names[used], (np.cumsum(used) - 1)[head]
    count = np.bincount(rest, minlength=len(found.names))
    often = np.flatnonzero(count > 1)
    often = often[np.argsort(-count[often], kind="stable")]
    rank = np.zeros(len(found.names), np.int64)
    rank[often] = np.arange(len(often))
    once = count[rest] == 1
    places = np.where(once, len(often), rank[rest])
    wide = 2 if max(len(sorted_names), len(often) + 1) < 1 << 16 else 4
    alone = found.names[rest[once]]
    sizes = np.array([hi - lo, len(sorted_names), len(often), len(alone), wide], "<i8").tobytes()
    body = b"".join([_planes(np.diff(sorted_names, prepend=np.uint64(0)), "<u8"), _planes(found.names[often], "<u8"), _planes(alone, "<u8"), _planes(numbers, f"<u{wide}"), _planes(places, f"<u{wide}"), _planes(found.weight[lo:hi], "<i8")])
    return zstandard.compress(sizes + body, 3)


def unpack(blob: bytes) -> Suffixes:
    raw = zstandard.decompress(blob)
    rows, n_sorted, n_often, n_alone, wide = np.frombuffer(raw, "<i8", 5).tolist()
    at = 40

    def take(n: int, kind: str) -> np.ndarray:
        nonlocal at
        width = np.dtype(kind).itemsize
        out = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).reshape(-1).view(kind)
        at += n * width
        return out

    names = np.concatenate([np.cumsum(take(n_sorted, "<u8"), dtype=np.uint64), take(n_often, "<u8"), take(n_alone, "<u8")]).astype(np.uint64)
    head, rest, weight = take(2 * rows, f"<u{wide}").astype(np.int32), take((DEPTH - 1) * rows, f"<u{wide}").astype(np.int32), take(rows, "<i8").astype(np.int64)
    once = rest == n_often
    rest += n_sorted
    rest[once] = n_sorted + n_often + np.arange(n_alone)
    return Suffixes(names, [*head.reshape(2, rows), *rest.reshape(DEPTH - 1, rows)], weight)


def _together(parts: list[Suffixes]) -> Suffixes:
    """Several parts as one, with one dictionary; rows are neither sorted nor summed up."""
    names = np.unique(np.concatenate([np.zeros(1, np.uint64), *(p.names for p in parts)]))  # 0 stays the end, whether a suffix here has one or not
    places = [np.searchsorted(names, p.names).astype(np.int32) for p in parts]
    columns = [np.concatenate([at[p.columns[k]] for at, p in zip(places, parts)]) for k in range(DEPTH + 1)]
    return Suffixes(names, columns, np.concatenate([p.weight for p in parts]))


def _frames(found: Suffixes, edges: list[tuple[int, ...]], shift: int) -> pa.RecordBatch:
    """A packed row for each range that suffixes go to. A range has what is not smaller than the edge before it."""
    cuts, rows = [0], range(len(found.weight))
    inner = [*range((1 << shift) - 1, len(edges), 1 << shift)]
    for i in inner:
        cuts.append(bisect_left(rows, edges[i], lo=cuts[-1], key=found.key))
    cuts.append(len(rows))
    sent = [(place, pack(found, lo, hi)) for place, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if lo < hi]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in sent], pa.int32()), pa.array([r[1] for r in sent], pa.binary())], ["range", "blob"])


def _send(naming: tuple[int, int], slice_bytes: int, edges, shift: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, lang, own in _slices(batches, naming, slice_bytes):
            yield _frames(_suffixes(words, lang, own), edges.value, shift)

    return send


def _redeal(edges, most: int):
    """Packed suffixes of coarse ranges -> the same in fine ranges, `most` suffixes at a time."""

    def redeal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Suffixes] = []
        size = 0

        def settle() -> pa.RecordBatch:
            whole = _together(held)
            return _frames(_ordered(whole.columns, whole.names, whole.weight), edges.value, 0)

        for batch in batches:
            for blob in batch.column(1).to_pylist():
                held.append(unpack(blob))
                size += len(held[-1].weight)
                if size >= most:
                    yield settle()
                    held, size = [], 0
        if held:
            yield settle()

    return redeal


def _spell(naming: tuple[int, int], slice_bytes: int, wanted, bits: int):
    """(lang, name, word) of the words that pass the filter, each spelling once for each task."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], bytes] = {}
        for words, lang, own in _slices(batches, naming, slice_bytes):
            at = _bit(lang, words.name, bits)
            passes = np.flatnonzero((wanted.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1)
            rows = [(*key, word) for key, word in _spellings(words, lang, passes) if seen.setdefault(key, word) is word or seen[key] != word]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["lang", "name", "word"])

    return spell


def _spellings(words: Words, lang: np.ndarray, at: np.ndarray) -> Iterator[tuple[tuple[int, int], bytes]]:
    """((language, name), word) of the words at `at`: one for each name, and every other spelling of it: the bytes of all its places are held against the first one's."""
    order = at[np.lexsort((words.size[at], words.name[at], lang[at]))]
    if not len(order):
        return
    l, n, size, begin = lang[order], words.name[order], words.size[order], words.begin[order]
    first = np.append(True, (l[1:] != l[:-1]) | (n[1:] != n[:-1]))
    head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    other = size != size[head]
    rows, k = np.flatnonzero(~first & ~other), 0
    while len(rows := rows[size[rows] > k]):
        unlike = words.data[begin[rows] + k] != words.data[begin[head[rows]] + k]
        other[rows[unlike]] = True
        rows, k = rows[~unlike], k + 1
    for i in np.flatnonzero(first | other).tolist():
        yield (int(l[i].view(np.int64)), int(n[i].view(np.int64))), words.data[begin[i] : begin[i] + size[i]].tobytes()


def _sampled(naming: tuple[int, int], slice_bytes: int, share: int):
    """Of the suffixes of a slice every `share`-th in order, and how many there are of each in all."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, lang, own in _slices(batches, naming, slice_bytes):
            found = _suffixes(words, lang, own)
            yield pa.RecordBatch.from_arrays([pa.array([list(np.array(found.key(i), np.uint64).view(np.int64)) for i in range(share // 2, len(found.weight), share)], pa.list_(pa.int64()))], ["key"])

    return sample


def mined(keys: list[np.ndarray], weight: np.ndarray, least: int, edges: list[tuple[int, ...]]) -> tuple[list[tuple[int, ...]], list[int], list[tuple[int, ...]], list[int]]:
    """Counts of phrases: (whole phrases with `least` or more, their counts, phrases that reach over one of `edges`, what is counted of them here).

    Multikey quicksort of pointers: a part with fewer than `least` suffixes is abandoned. keys[0] is the language; a word of 0 is the end."""
    open_ones = {e[:k] for e in edges for k in range(2, DEPTH + 2) if e[k - 1]}
    partial, parts = sorted(open_ones), []
    for phrase in partial:
        same = np.ones(len(weight), bool)
        for k, word in zip(keys, phrase):
            same &= k == np.uint64(word)
        parts.append(int(weight[same].sum()))
    found, counts = [], []
    waiting = [(np.arange(len(weight), dtype=np.int32), 0, ())]
    while waiting:
        pointers, depth, prefix = waiting.pop()
        own = weight[pointers]
        if int(own.sum()) < least:
            continue
        column = keys[depth][pointers]
        middle = len(column) // 2
        pivot = sorted((column[0], column[middle], column[-1]))[1]
        less, more = column < pivot, column > pivot
        equal = ~(less | more)
        if less.any():
            waiting.append((pointers[less], depth, prefix))
        if more.any():
            waiting.append((pointers[more], depth, prefix))
        if pivot == 0 and depth:
            continue
        n, phrase = int(own[equal].sum()), (*prefix, int(pivot))
        if n < least:
            continue
        if depth and phrase not in open_ones:
            found.append(phrase)
            counts.append(n)
        if depth < DEPTH:
            waiting.append((pointers[equal], depth + 1, phrase))
    return found, counts, partial, parts


def _mine(edges, least: int):
    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed suffixes, sorted by range -> (lang, words, n, whole). Without words: how many words of a language there are in a range."""
        current, held = None, []

        def settle() -> pa.RecordBatch:
            part = _together(held)
            held.clear()
            # an edge as numbers of the dictionary; one that has a word not in it is no prefix of anything here from that word on
            around = []
            for i in (current - 1, current):
                if 0 <= i < len(edges.value):
                    at = np.searchsorted(part.names, np.array(edges.value[i], np.uint64))
                    at = np.where(part.names[np.minimum(at, len(part.names) - 1)] == np.array(edges.value[i], np.uint64), at, -1).tolist()
                    around.append(tuple(at[: at.index(-1)] + [0] * (len(at) - at.index(-1)) if -1 in at else at))
            whole, n, partial, parts = mined(part.columns, part.weight, least, around)
            totals = np.bincount(part.columns[0], part.weight).astype(np.int64)
            rows = [*zip(whole, n, [True] * len(n)), *((p, m, False) for p, m in zip(partial, parts) if m), *(((int(x),), int(totals[x]), False) for x in np.flatnonzero(totals))]
            names = part.names.view(np.int64).tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array([names[r[0][0]] for r in rows], pa.int64()), pa.array([[names[x] for x in r[0][1:]] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_())], ["lang", "words", "n", "whole"]
            )

        for batch in batches:
            for place, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and place != current:
                    yield settle()
                current = place
                held.append(unpack(blob))
        if held:
            yield settle()

    return mine


class _Clash(Exception):
    """Two words have one hash."""


def _phrases(texts: DataFrame, least: int, seed: int, slice_bytes: int, range_size: int, fan: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (lang as a hash, text): (lang, words, a) of frequent phrases of one to DEPTH words, (lang, name, word) of the words in those of two at least, (lang, n) of all words."""
    spark = texts.sparkSession
    sc = spark.sparkContext
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    naming = (seed, NAME_BITS if total < 1 << 40 else 64)
    ranges = min(MOST_RANGES, -(-total // (6 * range_size)))  # a word and its gap have some six bytes
    chosen: list[tuple[int, ...]] = []
    if ranges > 1:
        size = min(MOST_SAMPLE, SAMPLE * ranges)
        some = max(1, total // (SPARSE * size))  # of the texts, one in so many
        share = max(1, total // some // (6 * size))
        sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(some)) == 0).mapInArrow(_sampled(naming, slice_bytes, share), "key array<bigint>").collect()
        ordered = sorted(tuple(x % (1 << 64) for x in r.key) for r in sample)
        chosen = sorted({ordered[i * len(ordered) // ranges] for i in range(1, ranges)}) if ordered else []
    edges, shift = sc.broadcast(chosen), 0
    while (len(chosen) >> shift) + 1 > fan:
        shift += 1
    frames = texts.mapInArrow(_send(naming, slice_bytes, edges, shift), "range int, blob binary")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if shift:
        frames = frames.repartition(min((len(chosen) >> shift) + 1, max(partitions, fan)), "range").mapInArrow(_redeal(edges, 4 * range_size), "range int, blob binary")
    dealt = frames.repartition(min(len(chosen) + 1, max(partitions, fan)), "range").sortWithinPartitions("range")
    counts = materialise(dealt.mapInArrow(_mine(edges, least), "lang long, words array<bigint>, n long, whole boolean"))
    over = counts.where("not whole and size(words) > 0").groupBy("lang", "words").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    phrases = materialise(counts.where("whole").select("lang", "words", F.col("n").alias("a")).union(over))
    sizes = materialise(counts.where("size(words) = 0").groupBy("lang").agg(F.sum("n").alias("n")))
    wanted = materialise(phrases.where("size(words) > 1").select("lang", F.explode("words").alias("name")).distinct())
    # at most 2 ** (bits - 6) rows, whatever the number of words
    rows = wanted.mapInArrow(_bits(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    spelt = texts.mapInArrow(_spell(naming, slice_bytes, sc.broadcast(table), bits), "lang long, name long, word binary")
    words = materialise(spelt.groupBy("lang", "name").agg(F.min("word").alias("word"), (F.min("word") != F.max("word")).alias("clash")).join(wanted, ["lang", "name"], "left_semi"))
    if not words.where("clash").isEmpty():
        raise _Clash
    return phrases, words.drop("clash"), sizes


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)) in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", (wide(a) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(20,0)") * wide(n), wide(left) * wide(right))


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, top: int = 2000, share: int = 100, slice_bytes: int = SLICE, range_size: int = RANGE, fan: int = FAN, bits: int = FILTER_BITS, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """Each language's `top` phrases of 2 to DEPTH words by score: lang, rank (from 1), phrase, a, l, r, n, score.

    A null text is empty, a null language `und`. A phrase counts with `least` occurrences or more, overlaps and rows that repeat included, within a piece; of its cuts in two the one with the lowest score counts, then the earliest. A phrase inside
    a longer one that has `share` % of its count goes. Ties go by count and by phrase (bytes). An empty table gives an empty result; other columns are not read. The further arguments are limits on which no result depends.
    """
    lang, name = F.coalesce(F.col(lang_col), F.lit("und")), fresh_name(df, "lang_name")
    texts = df.select(F.xxhash64(lang).alias("lang"), F.col(text_col).alias("text"))
    langs = materialise(df.select(lang.alias(name)).distinct().select(F.xxhash64(name).alias("lang"), F.col(name).alias("lang_name")))
    if not langs.groupBy("lang").count().where("count > 1").isEmpty():
        raise ValueError("two languages have one hash")
    for seed in seeds:
        try:
            phrases, words, sizes = _phrases(texts, least, seed, slice_bytes, range_size, fan, bits)
            break
        except _Clash:
            continue
    else:
        raise ValueError("words have equal hashes with every seed")
    own = phrases.where(F.size("words") > 1)
    cut = own.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    part = lambda side, words: phrases.select(F.col("lang"), F.col("words").alias(words), F.col("a").alias(side))
    cut = cut.withColumns({"head": F.slice("words", F.lit(1), F.col("k")), "tail": F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))})
    cut = cut.join(part("l", "head"), ["lang", "head"]).join(part("r", "tail"), ["lang", "tail"]).join(sized(sizes, 8 << 20, 48), "lang")
    cut = cut.withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    scored = cut.groupBy("lang", "words").agg(F.max("a").alias("a"), F.max("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    size = F.size("words")
    inner = own.where(size > 2).select("lang", F.col("a").alias("longer"), F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("words", i, m))))).alias("words"))
    longest = inner.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    left = scored.join(longest, ["lang", "words"], "left").where("longer is null or not 100 * longer >= a * " + str(int(share)))
    # the first of each language, those that tie with the last of them included, before words are looked up; in two steps, as a language may have most of all phrases
    by = [F.col("cut.score").desc(), F.col("a").desc()]
    left = left.withColumn("deal", F.pmod(F.xxhash64("words"), F.lit(64))).withColumn("place", F.rank().over(W.partitionBy("lang", "deal").orderBy(*by))).where(F.col("place") <= top)
    left = left.withColumn("place", F.rank().over(W.partitionBy("lang").orderBy(*by))).where(F.col("place") <= top).drop("deal", "place")
    spelt = left.select("lang", "words", F.posexplode("words").alias("i", "name")).join(words, ["lang", "name"])
    spelt = spelt.groupBy("lang", "words").agg(F.array_sort(F.collect_list(F.struct("i", F.col("word").cast("string").alias("word")))).alias("spelt"))
    spelt = spelt.select("lang", "words", F.array_join(F.transform("spelt", lambda x: x["word"]), " ").alias("phrase"))
    rows = left.join(spelt, ["lang", "words"]).join(sized(langs, 8 << 20, 64), "lang")
    rank = F.row_number().over(W.partitionBy("lang_name").orderBy(*by, "phrase"))
    out = rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return out.select(F.col("lang_name").alias("lang"), "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
