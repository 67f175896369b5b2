"""Removal of repeated passages by two-stage suffix sorting, shard by shard.

A byte goes if it is in a string of `LENGTH` bytes that also starts in a document with a smaller id. To bring equal strings
together without moving every suffix, each string has an anchor: the place in it of the least hash of GRAM bytes. Equal
strings have equal anchors, and neighbours mostly the same one, so an anchor stands for a run of strings: a fragment of
50 to 80 bytes. Shards are named by anchors' hashes. Three steps, each a distributed job:

1. Anchors, as (hash of the anchor, hash of the fragment, document, place), are packed and dealt by the first hash. A fragment that comes
   again is one entry of what is to be sorted, with its smallest document: all strings of its other documents repeat. Fragments are told
   apart by 48 bits of the anchor's hash and 64 of their own.
2. Where one anchor has several different fragments, some of their strings may be equal. These fragments' bytes are fetched and
   dealt by anchor, and a shard's suffix array is built in two stages: only suffixes smaller than their successors are sorted, the
   rest is induced by scanning the buckets of first bytes. Runs of neighbours with common prefixes of LENGTH
   bytes or more are the repeated strings.
3. The runs found are merged for each document and cut out of its text.

An anchor with more than HOT fragments is split: its fragments are dealt at random, suffix arrays of parts leave each different string once
for each part, with its smallest document there, and these strings are dealt by their own hashes as fragments are in step 1. Anchors that would make step 1 uneven are known from a sample of texts and dealt by fragment; the sample
decides where rows meet, not what is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.shared import materialise

LENGTH, GRAM = 50, 20
WINDOW = LENGTH - GRAM + 1
#: Most fragments of one anchor that are compared in one shard.
HOT = 2048
#: An anchor with so many occurrences, as a sample of SAMPLE bytes has it (and SEEN times there), is dealt by fragment.
CROWD, SAMPLE, SEEN = 1 << 17, 32 << 20, 8
SEGMENT = 1 << 20
#: Bytes of text whose anchors are packed together.
SLICE = 8 << 20
CHUNK = 2 << 20
#: Most tasks that shards are dealt to; beyond it a task works through several, one after another.
MOST_TASKS = 1 << 14
#: Most shards that one slice is dealt to at once. Where there are more, anchors are dealt twice: to FAN groups of shards, then from there to shards, REDEAL anchors at a time. So what a slice sends does not grow with the input.
FAN, REDEAL = 1280, 2 << 20
PLACE = np.uint64((1 << 22) - 1)
NO_ID = np.iinfo(np.int64).max
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def words_at(data: np.ndarray) -> np.ndarray:
    """For each position the 8 bytes from it as a big-endian number; zeros follow the end."""
    n = len(data)
    padded = np.zeros((n // 8 + 3) * 8, np.uint8)
    padded[:n] = data
    raw, out = padded.tobytes(), np.zeros(n, np.uint64)
    for k in range(min(8, n)):
        part = np.frombuffer(raw, ">u8", offset=k, count=len(range(k, n, 8)))
        out[k::8] = part
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M[3]
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For the texts that end at `ends` in `data`: (text, anchor hash, fragment hash, first start, number of starts) of every
    run of string starts with one anchor. Starts are positions in `data`."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    w = words_at(data)
    m = n - GRAM + 1
    h = _mix(_mix(_mix(w[:m] * _M[0]) + w[8 : m + 8] * _M[1]) + (w[16 : m + 16] >> np.uint64(32)) * _M[2])
    # hash and place in one number: the least of a window is then one comparison, the leftmost among equals
    value, width = (h & ~PLACE) | np.arange(m, dtype=np.uint64), 1
    while width < WINDOW:  # a window that doubles, then overlaps to its full width
        step = min(width, WINDOW - width)
        value = np.minimum(value[step:], value[: len(value) - step])
        width += step
    begins = np.concatenate([[0], ends[:-1]])
    text = np.repeat(np.arange(len(ends)), np.maximum(ends - begins - LENGTH + 1, 0))
    many = np.maximum(ends - begins - LENGTH + 1, 0)
    start = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begins, many)
    if not len(start):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    at = (value[start] & PLACE).astype(np.int64)
    first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    runs = np.diff(np.append(first, len(start)))
    lo, size = start[first], runs + LENGTH - 1
    c = size.astype(np.uint64)
    for k in range(6):
        c = _mix(c * _M[k % 3] + w[lo + 8 * k])
    for k in range(1, 5):
        c = _mix(c * _M[k % 3] + w[lo + size - 8 * k])
    return text[first], h[at[first]], c, lo, runs


def _planes(a: np.ndarray, width: int) -> bytes:
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplane(raw: bytes, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return out.reshape(-1).view("<u8").astype(np.uint64), at + n * width


def pack_anchors(h, c, doc, lo, runs) -> bytes:
    """Columns as byte planes, the anchors' hashes of 48 bits sorted, compressed. doc is a number within the batch."""
    order = np.argsort(h, kind="stable")
    h, c, doc, lo, runs = (x[order] for x in (h, c, doc, lo, runs))
    head = np.array([len(h)], "<u8").tobytes()
    return zstandard.compress(head + _planes(np.diff(h, prepend=np.uint64(0)), 6) + _planes(c, 8) + _planes(doc, 4) + _planes(lo, 5) + _planes(runs, 1), 1)


def unpack_anchors(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.decompress(blob)
    n, at, out = int(np.frombuffer(raw, "<u8", 1)[0]), 8, []
    for width in (6, 8, 4, 5, 1):
        x, at = _unplane(raw, at, n, width)
        out.append(x)
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return tuple(out)


def pack_runs(lo: np.ndarray, runs: np.ndarray) -> bytes:
    """Five bytes of place and one of length for each run."""
    return _planes(np.asarray(lo, np.uint64), 5) + np.asarray(runs, np.uint8).tobytes()


def unpack_runs(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lo, runs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for blob in blobs:
        n = len(blob) // 6
        place, at = _unplane(blob, 0, n, 5)
        lo.append(place.astype(np.int64))
        runs.append(np.frombuffer(blob, np.uint8, n, at).astype(np.int64))
    return np.concatenate(lo), np.concatenate(runs)


FOUND = "doc long, mark long, anchor long, hot boolean, runs binary"


def _cuts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    n = len(columns[0])
    new = np.arange(n) == 0
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _by_document(doc, mark, lo, runs, anchor=None, fragment=None, hot=None) -> Iterator[tuple]:
    """Rows of FOUND: with no anchor, runs that go, one row for each document; else one row for each fragment of a document to be compared,
    with all the places where the document has it. Rows that repeat count once."""
    if not len(doc):
        return
    keys = (lo, mark, doc) if anchor is None else (lo, mark, doc, fragment, anchor)
    order = np.lexsort(keys)
    doc, mark, lo, runs = doc[order], mark[order], lo[order], runs[order]
    if anchor is None:
        cuts = _cuts(doc, mark)
    else:
        anchor, fragment, hot = anchor[order], fragment[order], hot[order]
        cuts = _cuts(anchor, fragment, doc, mark)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(doc)]):
        fresh = lo[a:b]
        own = runs[a:b]
        if b - a > 1 and (fresh[1:] == fresh[:-1]).any():
            once = np.append(True, (fresh[1:] != fresh[:-1]) | (own[1:] != own[:-1]))
            fresh, own = fresh[once], own[once]
        yield int(doc[a]), int(mark[a]), None if anchor is None else int(anchor[a]), bool(hot[a]) if anchor is not None else False, pack_runs(fresh, own)


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(schema)], names=[n for n, _ in schema])


_FOUND = [("doc", pa.int64()), ("mark", pa.int64()), ("anchor", pa.int64()), ("hot", pa.bool_()), ("runs", pa.binary())]
SENT = "bucket int, docs binary, blob binary, " + FOUND
_SENT = [("bucket", pa.int32()), ("docs", pa.binary()), ("blob", pa.binary()), *_FOUND]


def _frames(h, c, doc, lo, runs, bucket, ids: np.ndarray, marks: np.ndarray) -> Iterator[tuple]:
    """Rows of SENT: what goes to a bucket as one packed row. doc numbers the documents of `ids` and `marks`."""
    bucket = bucket.astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    h, c, doc, lo, runs, bucket = (x[order] for x in (h, c, doc, lo, runs, bucket))
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(bucket))):
        own, number = np.unique(doc[a:b], return_inverse=True)
        names = np.stack([ids[own], marks[own]]).tobytes()
        yield int(bucket[a]), names, pack_anchors(h[a:b], c[a:b], number, lo[a:b], runs[a:b]), None, None, None, None, None


def _settle_and_frame(h, c, doc, lo, runs, ids: np.ndarray, marks: np.ndarray, shards: int, group: int, crowded: np.ndarray) -> pa.RecordBatch:
    """Rows of SENT for anchors that are together here: those whose fragment has a smaller document among them are settled, the others go to their shards, or to groups of `group` shards.

    So of a fragment that is everywhere each slice, and then each redeal, sends its smallest document on and no other."""
    order = np.lexsort((ids[doc], c, h))
    h, c, doc, lo, runs = (x[order] for x in (h, c, doc, lo, runs))
    new = (np.diff(h, prepend=h[0] + np.uint64(1)) != 0) | (np.diff(c, prepend=c[0]) != 0) if len(h) else np.zeros(0, bool)
    least = ids[doc][np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))] if len(h) else np.zeros(0, np.int64)
    late = ids[doc] > least
    rows = [(None, None, None, *r) for r in _by_document(ids[doc[late]], marks[doc[late]], lo[late], runs[late])]
    h, c, doc, lo, runs = (x[~late] for x in (h, c, doc, lo, runs))
    dealt = np.where(np.isin(h, crowded), _mix(h * _M[0] + c), h) if len(crowded) else h
    rows += _frames(h, c, doc, lo, runs, dealt % np.uint64(shards) // np.uint64(group), ids, marks)
    return _batch(rows, _SENT)


def _send(shards: int, segment: int, crowded: np.ndarray, fan: int = FAN):
    group = -(-shards // fan)

    def settle(parts: list[bytes], base: list[tuple[int, int]]) -> tuple:
        data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts])
        text, h, c, lo, runs = anchors(data, np.cumsum(sizes))
        doc, offset = np.array([b[0] for b in base]), np.array([b[1] for b in base])
        return h >> np.uint64(16), c, doc[text], lo - (np.cumsum(sizes) - sizes)[text] + offset[text], runs

    def packed(held: list[tuple], ids: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held)]
        held.clear()
        return _settle_and_frame(*columns, ids, marks, shards, group, crowded)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors packed for their shards, and the runs whose fragment has a smaller document in the same slice of a batch."""
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            marks = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            held, parts, base, size, taken = [], [], [], 0, 0
            once = set(np.unique(np.stack([ids, marks]), axis=1, return_index=True)[1].tolist())  # rows that repeat count once
            for i, value in enumerate(batch.column(2)):
                if i not in once:
                    continue
                raw = (value.as_py() or "").encode("utf-8", "surrogatepass")
                for at in range(0, max(len(raw) - LENGTH + 1, 0), segment):  # a long text in pieces that share LENGTH - 1 bytes
                    parts.append(raw[at : at + segment + LENGTH - 1])
                    base.append((i, at))
                    size += len(parts[-1])
                    if size >= segment:
                        held.append(settle(parts, base))
                        taken += size
                        parts, base, size = [], [], 0
                    if taken >= SLICE:
                        yield packed(held, ids, marks)
                        taken = 0
            if parts:
                held.append(settle(parts, base))
            if held:
                yield packed(held, ids, marks)

    return send


def _redeal(shards: int, crowded: np.ndarray, most: int = REDEAL):
    """Frames of groups of shards -> frames of shards, `most` anchors at a time; rows without a bucket pass through."""

    def settle(held: list[tuple]) -> pa.RecordBatch:
        h, c, number, lo, runs, ids, marks = (list(x) for x in zip(*held))
        held.clear()
        before = np.cumsum([0, *map(len, ids[:-1])])
        doc = np.concatenate([n.astype(np.int64) + b for n, b in zip(number, before)])
        return _settle_and_frame(np.concatenate(h), np.concatenate(c), doc, np.concatenate(lo), np.concatenate(runs), np.concatenate(ids), np.concatenate(marks), shards, 1, crowded)

    def redeal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            yield batch.filter(batch.column(0).is_null())
            packed = batch.filter(batch.column(0).is_valid())
            for docs, blob in zip(packed.column(1).to_pylist(), packed.column(2).to_pylist()):
                names = np.frombuffer(docs, np.int64).reshape(2, -1)
                held.append((*unpack_anchors(blob), *names))
                size += len(held[-1][0])
                if size >= most:
                    yield settle(held)
                    size = 0
        if held:
            yield settle(held)

    return redeal


def _collapse(batches: Iterator[pa.RecordBatch], hot: int | None, crowded: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A shard's anchors -> runs that go as their fragment is in a smaller document, and fragments to be compared byte by byte. Without `hot`, what is
    dealt are single strings, of which nothing is left to be compared."""

    def shard(kept: list[tuple]) -> Iterator[tuple]:
        h, c, doc, mark, lo, runs = (np.concatenate(x) for x in zip(*kept))
        kept.clear()
        order = np.lexsort((doc, c, h))
        h, c, doc, mark, lo, runs = (x[order] for x in (h, c, doc, mark, lo, runs))
        new_h = np.append(True, h[1:] != h[:-1])
        new_c = new_h | np.append(True, c[1:] != c[:-1])
        least = doc[np.maximum.accumulate(np.where(new_c, np.arange(len(h)), 0))]
        late = doc > least
        yield from _by_document(doc[late], mark[late], lo[late], runs[late])
        if hot is None:
            return
        # anchors with several fragments, not all of one document; of a crowded one only a part of the fragments is here
        group = np.cumsum(new_h) - 1
        first = np.flatnonzero(new_h)
        fragments = np.add.reduceat(new_c.astype(np.int64), first)
        low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
        apart = np.isin(h[first], crowded)
        compared = (~late) & (apart | ((fragments > 1) & (low < high)))[group]
        many = apart | (np.bincount(group[compared], minlength=len(first)) > hot)
        yield from _by_document(doc[compared], mark[compared], lo[compared], runs[compared], h[compared].astype(np.int64), c[compared].view(np.int64), many[group[compared]])

    def batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        while part := list(islice(rows, 20000)):
            yield _batch(part, _FOUND)

    current, kept = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        for bucket, docs, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if bucket != current and kept:
                yield from batched(shard(kept))
                kept = []
            current = bucket
            names = np.frombuffer(docs, np.int64).reshape(2, -1)
            h, c, number, lo, runs = unpack_anchors(blob)
            number = number.astype(np.int64)
            kept.append((h, c, names[0][number], names[1][number], lo.astype(np.int64), runs.astype(np.int64)))
    if kept:
        yield from batched(shard(kept))


def two_stage_suffix_array(data: np.ndarray, depth: int = LENGTH, wanted: np.ndarray | None = None) -> np.ndarray:
    """Positions of `data` in the order of the suffixes there, right in their first `depth` bytes at least (the end is smallest).

    A suffix is of type B if it is smaller than the one after it. Only those are sorted. The others are induced: buckets of first
    bytes are scanned from the smallest, and a suffix scanned puts the one before it, if that is of type A, at the next free place of its bucket.
    With `wanted`, a mask, only the wanted suffixes and those that they are induced from are worked on and returned.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    change = np.flatnonzero(np.diff(data.astype(np.int16)))
    # type B: the next byte that differs is larger; a run at the end is followed by the end, which is smaller
    ends = np.append(change, n - 1)
    rises = np.append(data[change + 1] > data[change], False)
    type_b = np.repeat(rises, np.diff(np.concatenate([[-1], ends])))
    needed = np.ones(n, bool) if wanted is None else wanted.copy()
    if wanted is not None:  # a wanted suffix of type A is induced from those after it, up to the first of type B
        of_b = np.append(np.flatnonzero(type_b), n - 1)
        last_wanted = np.flatnonzero(wanted & ~np.append(wanted[1:], False) & ~type_b)
        until = of_b[np.searchsorted(of_b, last_wanted)]
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, last_wanted, 1)
        np.add.at(edge, until + 1, -1)
        needed |= np.cumsum(edge[:-1]) > 0
    own = np.flatnonzero(type_b & needed)
    w = words_at(np.concatenate([data, np.zeros(depth + 8, np.uint8)]))
    keys = [w[own + 8 * k] for k in reversed(range(-(-depth // 8)))]
    if (data == 0).any():  # what lies beyond the end is smaller than a zero byte
        keys.insert(0, np.minimum(n - own, depth + 8))
    own = own[np.lexsort(keys)]
    induced = needed & ~type_b
    b_of = np.searchsorted(data[own], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if induced[n - 1]:
        waiting[int(data[-1])].append(np.array([n - 1]))
    out = []

    def induce(scanned: np.ndarray) -> None:
        before = scanned[scanned > 0] - 1
        before = before[induced[before]]
        if len(before):
            first = data[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(np.diff(first.astype(np.int16), prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(first))):
                waiting[first[a]].append(before[a:b])

    for byte in range(256):
        done = 0
        while done < len(waiting[byte]):
            part = waiting[byte][done]
            done += 1
            out.append(part)
            induce(part)
        part = own[b_of[byte] : b_of[byte + 1]]
        out.append(part)
        induce(part)
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For neighbours in `order`: whether they share `depth` bytes."""
    w = words_at(np.concatenate([data, np.zeros(depth + 8, np.uint8)]))
    a, b = order[:-1], order[1:]
    same = np.maximum(a, b) + depth <= len(data)
    for k in range(depth // 8):
        same &= w[a + 8 * k] == w[b + 8 * k]
    if depth % 8:
        same &= (w[a + depth - depth % 8] ^ w[b + depth - depth % 8]) >> np.uint64(64 - 8 * (depth % 8)) == 0
    return same


def _strings(doc: np.ndarray, fragments: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all strings of LENGTH bytes in the fragments, in the order of their suffixes: the fragment, the offset in it, and the smallest
    document that has the string; and the fragments' bytes with where each begins."""
    data = np.frombuffer(b"".join(fragments), np.uint8)
    size = np.fromiter(map(len, fragments), np.int64, len(fragments))
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    order = two_stage_suffix_array(data, wanted=np.arange(len(data)) + LENGTH <= (begin + size)[owner])
    inside = order + LENGTH <= (begin + size)[owner[order]]
    run = np.cumsum(np.append(True, ~common_prefixes(data, order))) - 1
    order, run = order[inside], run[inside]
    least = np.full(int(run[-1]) + 1 if len(run) else 0, NO_ID)
    np.minimum.at(least, run, doc[owner[order]])
    return owner[order], order - begin[owner[order]], least[run], data, begin


def _placed(which: np.ndarray, offset: np.ndarray, doc: np.ndarray, mark: np.ndarray, places: list[np.ndarray]) -> Iterator[tuple]:
    """Rows of FOUND for strings of fragments, at all places of each; neighbours are put together to runs."""
    if not len(which):
        return
    order = np.lexsort((offset, which))
    which, offset = which[order], offset[order]
    head = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (offset[1:] != offset[:-1] + 1)))
    runs = np.diff(np.append(head, len(which)))
    which, offset = which[head], offset[head]
    count = np.fromiter(map(len, places), np.int64, len(places))[which]
    at = np.repeat(np.arange(len(which)), count)
    lo = np.concatenate([places[w] for w in which.tolist()]) + offset[at]
    yield from _by_document(doc[which[at]], mark[which[at]], lo, runs[at])


def _columns(kept: list[tuple]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[bytes]]:
    doc, mark = (np.array([k[i] for k in kept], np.int64) for i in (1, 2))
    return doc, mark, [unpack_runs([k[3]])[0] for k in kept], [k[4] for k in kept]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments sorted by anchor -> runs that go. Anchors are taken together until there are CHUNK bytes."""

    def found(kept: list[tuple]) -> pa.RecordBatch:
        doc, mark, places, fragments = _columns(kept)
        which, offset, least, _, _ = _strings(doc, fragments)
        late = doc[which] > least
        return _batch([*_placed(which[late], offset[late], doc, mark, places)], _FOUND)

    kept, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if kept and row[0] != kept[-1][0] and size >= CHUNK:
                yield found(kept)
                kept, size = [], 0
            if kept and row[:4] == kept[-1][:4]:
                continue
            kept.append(row)
            size += len(row[4])
    if kept:
        yield found(kept)


def _reduce(buckets: int):
    """Fragments in any order -> rows of SENT: runs that go as the same part of CHUNK bytes has them in a smaller document, and the other strings of the part,
    each with its own two hashes in place of an anchor's and a fragment's."""

    def found(kept: list[tuple]) -> pa.RecordBatch:
        doc, mark, places, fragments = _columns(kept)
        which, offset, least, data, begin = _strings(doc, fragments)
        late = doc[which] > least
        rows = [(None, None, None, *r) for r in _placed(which[late], offset[late], doc, mark, places)]
        which, offset = which[~late], offset[~late]
        w, at = words_at(data), begin[which] + offset
        one, two = np.zeros(len(at), np.uint64), np.ones(len(at), np.uint64)
        for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
            one, two = _mix(one * _M[0] + w[at + k]), _mix((two ^ w[at + k]) * _M[1] + _M[2])
        count = np.fromiter(map(len, places), np.int64, len(places))[which]
        each = np.repeat(np.arange(len(which)), count)
        lo = (np.concatenate([places[x] for x in which.tolist()]) if len(which) else np.zeros(0, np.int64)) + offset[each]
        h = one[each] >> np.uint64(16)
        rows += _frames(h, two[each], which[each], lo, np.ones(len(each), np.int64), h % np.uint64(buckets), doc, mark)
        return _batch(rows, _SENT)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                kept.append(row)
                size += len(row[4])
                if size >= CHUNK:
                    yield found(kept)
                    kept, size = [], 0
        if kept:
            yield found(kept)

    return reduce


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, mark, text, asked) -> (anchor, doc, mark, places, fragment, hot). Rows that repeat one after another count once."""
    schema = [("anchor", pa.int64()), ("doc", pa.int64()), ("mark", pa.int64()), ("places", pa.binary()), ("fragment", pa.binary()), ("hot", pa.bool_())]
    before = None
    for batch in batches:
        rows = []
        for doc, mark, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            if (doc, mark) == before:
                continue
            before, raw = (doc, mark), zstandard.decompress(text.as_py())
            for ask in asked.as_py():
                lo, runs = unpack_runs([ask["runs"]])
                rows.append((ask["anchor"], doc, mark, ask["runs"], raw[lo[0] : lo[0] + runs[0] + LENGTH - 1], ask["hot"]))
            if len(rows) > 50000:
                yield _batch(rows, schema)
                rows = []
        yield _batch(rows, schema)


def _census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often an anchor comes in the texts of a batch, where that is more than once. Of a text that is longer the first SEGMENT bytes count."""

    def settle(parts: list[bytes]) -> np.ndarray:
        return anchors(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]))[1] >> np.uint64(16)

    for batch in batches:
        counts, parts, size = [np.zeros(0, np.uint64)], [], 0
        for value in batch.column(0):
            parts.append((value.as_py() or "").encode("utf-8", "surrogatepass")[:SEGMENT])
            size += len(parts[-1])
            if size >= SEGMENT:
                counts.append(settle(parts))
                parts, size = [], 0
        if parts:
            counts.append(settle(parts))
        found, n = np.unique(np.concatenate(counts), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found[n > 1].astype(np.int64)), pa.array(n[n > 1])], ["h", "n"])


def crowded_anchors(docs: DataFrame, total: int, crowd: int = CROWD, sample: int = SAMPLE, seen: int = SEEN) -> np.ndarray:
    """Anchors that are to be dealt by fragment, as a sample of about `sample` bytes has them. Their number is bounded by the sample's size."""
    if total <= crowd * 8:  # all of it has fewer anchors than would make a crowd
        return np.zeros(0, np.uint64)
    share = max(1, total // sample)
    counted = docs.where(F.pmod(F.xxhash64("mark", F.lit("sample")), F.lit(share)) == 0).select("text").mapInArrow(_census, "h long, n long")
    rows = counted.groupBy("h").agg(F.sum("n").alias("n")).where((F.col("n") >= seen) & (F.col("n") * share >= crowd)).select("h").toPandas()
    return np.sort(rows["h"].to_numpy(np.int64).astype(np.uint64))


def _compress(texts: pd.Series) -> pd.Series:
    engine = zstandard.ZstdCompressor(level=3, write_content_size=True)
    return pd.Series([engine.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts])


def compressed(text: Column) -> Column:
    """UTF-8 bytes, compressed before they are dealt; null as empty."""
    return F.pandas_udf(_compress, "binary")(text)


def removed_runs(df: DataFrame, id_col: str, text_col: str, shard_bytes: int = 24 << 20, hot: int = HOT, segment: int = SEGMENT, crowd: int = CROWD, seen: int = SEEN, fan: int = FAN) -> DataFrame:
    """(doc, mark, runs): runs of starts of repeated strings. doc is the id, the largest long for null; mark is a hash of the text."""
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("mark"), F.col(text_col).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, -(-total // shard_bytes))
    crowded = crowded_anchors(docs, total, crowd, seen=seen)
    sent = docs.mapInArrow(_send(buckets, segment, crowded, fan), SENT)
    # rows without a bucket are runs settled within a slice; they pass through beside the shards
    by = F.coalesce("bucket", F.pmod("doc", F.lit(buckets)))
    if buckets > fan:
        sent = sent.repartition(max(partitions, fan), by).sortWithinPartitions("bucket").mapInArrow(_redeal(buckets, crowded), SENT)
    dealt = sent.repartition(min(buckets, max(partitions, MOST_TASKS)), by).sortWithinPartitions("bucket")
    first = materialise(dealt.mapInArrow(_settled_or_collapsed(hot, crowded), FOUND))
    asked = first.where("anchor is not null").groupBy("doc", "mark").agg(F.collect_list(F.struct("anchor", "hot", "runs")).alias("asked"))
    fragments = docs.select("doc", "mark", compressed(F.col("text")).alias("text")).join(asked, ["doc", "mark"]).select("doc", "mark", "text", "asked")
    fetched = fragments.mapInArrow(_fetch, "anchor long, doc long, mark long, places binary, fragment binary, hot boolean")
    alone = first.where("anchor is null").select("doc", "mark", "runs")
    if first.where("hot").isEmpty():
        compared = fetched.drop("hot").repartition("anchor").sortWithinPartitions("anchor", "doc", "mark").mapInArrow(_compare, FOUND)
        return alone.union(compared.select("doc", "mark", "runs"))
    fetched = materialise(fetched)
    compared = fetched.where("not hot").drop("hot").repartition("anchor").sortWithinPartitions("anchor", "doc", "mark").mapInArrow(_compare, FOUND)
    parts = fetched.where("hot").drop("hot").repartition("doc", "mark", "places").mapInArrow(_reduce(partitions), SENT)
    parts = parts.repartition(partitions, F.coalesce("bucket", F.pmod("doc", F.lit(partitions)))).sortWithinPartitions("bucket")
    late = parts.mapInArrow(_settled_or_collapsed(None, crowded), FOUND)
    return alone.union(compared.select("doc", "mark", "runs")).union(late.select("doc", "mark", "runs"))


def _settled_or_collapsed(hot: int | None, crowded: np.ndarray):
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        through: list[pa.RecordBatch] = []

        def packed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                settled = batch.filter(batch.column(0).is_null())
                if settled.num_rows:
                    through.append(pa.RecordBatch.from_arrays(settled.columns[3:], names=[n for n, _ in _FOUND]))
                yield batch.filter(batch.column(0).is_valid())

        for out in _collapse(packed(), hot, crowded):
            yield from through
            through.clear()
            yield out
        yield from through

    return both


def _cut(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
    rows = []
    for text, blobs in zip(texts, runs):
        raw = zstandard.decompress(text)
        edge = np.zeros(len(raw) + 1, np.int32)
        lo, n = unpack_runs(list(blobs) if blobs is not None else [])
        np.add.at(edge, lo, 1)
        np.add.at(edge, lo + n + LENGTH - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        rows.append((len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left))
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def cut(text: Column, runs: Column) -> Column:
    """From compressed texts a struct of n_bytes, n_removed, n_spans, kept_sha256 and kept, the bytes that are left."""
    return F.pandas_udf(_cut, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")(text, runs)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **layout: int) -> DataFrame:
    """One row for each row of `df`: its id, n_bytes, n_removed, n_spans, kept_sha256 and kept.

    A null text is empty. A null id is larger than every id, and neither ids that are equal nor two nulls are smaller than one another, so rows
    that repeat do not remove each other; they are looked at once and give a row each. Texts of fewer than LENGTH bytes stay whole. An empty table
    gives an empty result; other columns are not read. `layout` are the limits of `removed_runs`, on which no result depends.
    """
    runs = removed_runs(df, id_col, text_col, **layout).groupBy("doc", "mark").agg(F.collect_list("runs").alias("runs"))
    keyed = df.select(F.col(id_col).alias("id"), compressed(F.col(text_col)).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("mark"))
    out = keyed.join(runs, ["doc", "mark"], "left").select("id", cut(F.col("text"), F.col("runs")).alias("r"))
    return out.select(F.col("id").alias(id_col), "r.*")
