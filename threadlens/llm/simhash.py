"""SimHash near-duplicates: fingerprints, BK-tree search for links, and groups of linked documents.

Fingerprints are sharded so that every link lies inside some shard: of five bit blocks those at distance 2 or less agree on
three, and of any three two are both among the first two or both among the last three. So each fingerprint goes to the four
shards named by such a couple of blocks and its bits there, some 26 bits, which leaves a few hundred to a shard at ten billion. In each
shard a BK-tree is built, children keyed by their integer Hamming distance to the parent, and each of the shard's
fingerprints is searched in it by following only edges whose key is within the radius of its distance to the node.
The trees of a task's shards grow together, level by level, as arrays. A tree is sent to nobody: its queries are in its
own shard, which replaces broadcasting trees that would grow with the corpus.
A shard that holds more fingerprints than `shard_limit` is dealt anew, exactly: two fingerprints at distance 2 or less
share a fingerprint at distance 1 or less from both, so its members go to the 65 shards named by themselves with at most
one bit flipped, and none of those can hold over 65 members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.components import connected_components
from threadlens.llm.shared import fresh_name, materialise, sized

BITS = 64
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHUNK = 1 << 15
#: Of any three of the five blocks two are one of these couples.
COUPLES = ((0, 1), (2, 3), (2, 4), (3, 4))


def _majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of `sizes` hashes the integer whose bits are set in over half of the run's hashes."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    ends = np.cumsum(sizes)
    counts = np.zeros((len(sizes), BITS), np.int64)
    which = np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, int(ends[-1]), _CHUNK):
        part, own = hashes[at : at + _CHUNK], which[at : at + _CHUNK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.diff(own, prepend=-1))
        counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    set_bits = (2 * counts > sizes[:, None]).astype(np.uint64)
    out[some] = (set_bits << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)[some]
    return out


def _fingerprints(texts: pd.Series, width: int, seed: int) -> pd.Series:
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    out = np.zeros(len(texts), np.uint64)
    done = 0
    for i, text in enumerate(texts):
        parts = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
        if parts:
            grams = zip(*(parts[k:] for k in range(width))) if len(parts) > width else [parts]
            before = len(hashes)
            hashes.extend([digest(b" ".join(g), seed) for g in grams])
            sizes[i] = len(hashes) - before
        if len(hashes) > 1 << 18:
            out[done : i + 1] = _majority(np.array(hashes, np.uint64), sizes[done : i + 1])
            hashes, done = [], i + 1
    out[done:] = _majority(np.array(hashes, np.uint64), sizes[done:])
    return pd.Series(out.view(np.int64))


def simhash(text: Column, width: int = 3, seed: int = 42) -> Column:
    """The 64-bit fingerprint of a text column as a long: bit i is set if over half of the XXH64 hashes of the
    text's `width`-word shingles (A-Z lower-cased, repeats included) have it. Fewer words: one shingle of them all;
    null or no words: 0."""

    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield _fingerprints(texts, width, seed)

    return fingerprint(text)


def grow_forest(shard: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all shards at once. `shard` is sorted and (shard, fp) is unique. Returns parent (-1 for a root),
    edge (the distance to the parent), and each row's root."""
    n = len(fp)
    parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    first = np.flatnonzero(np.diff(shard, prepend=shard[0] - 1)) if n else np.zeros(0, np.int64)
    root = np.repeat(first, np.diff(np.append(first, n)))
    rest = np.flatnonzero(root != np.arange(n))
    at = root[rest]
    while len(rest):
        d = np.bitwise_count(fp[rest] ^ fp[at]).astype(np.int64)
        order = np.lexsort((rest, at * (BITS + 1) + d))
        rest, at, d = rest[order], at[order], d[order]
        key = at * (BITS + 1) + d
        heads = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        parent[rest[heads]], edge[rest[heads]] = at[heads], d[heads]
        child = np.repeat(rest[heads], np.diff(np.append(heads, len(key))))
        stay = child != rest
        rest, at = rest[stay], child[stay]
    return parent, edge, root


def search_forest(fp: np.ndarray, parent: np.ndarray, edge: np.ndarray, root: np.ndarray, radius: int, chunk: int = _CHUNK, asked: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields pairs (query row, row found) at `radius` or less in the same tree, itself excluded. A query follows an edge
    only if its key is within `radius` of the query's distance to the node. Queries are the rows `asked`, or all."""
    asked = np.arange(len(fp)) if asked is None else asked
    inner = np.flatnonzero(parent >= 0)
    order = inner[np.lexsort((edge[inner], parent[inner]))]
    keys = parent[order] * (BITS + 1) + edge[order]
    for at in range(0, len(asked), chunk):
        query = asked[at : at + chunk]
        node = root[query]
        while len(query):
            d = np.bitwise_count(fp[query] ^ fp[node]).astype(np.int64)
            hit = (d <= radius) & (query != node)
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(keys, node * (BITS + 1) + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(keys, node * (BITS + 1) + np.minimum(d + radius, BITS), "right")
            n = high - low
            if not (total := int(n.sum())):
                break
            query = np.repeat(query, n)
            node = order[np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]


def _stars(shard: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Within each shard: every fingerprint that has a link, with the smallest one it reaches there. Links are taken in as they are found."""
    order = np.lexsort((fp.view(np.int64), shard))
    shard, fp = shard[order], fp[order]
    label = np.arange(len(fp))
    for a, b in search_forest(fp, *grow_forest(shard, fp), radius, 1 << 12):
        while True:
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            apart = low < high
            if not apart.any():
                break
            np.minimum.at(label, high[apart], low[apart])
            while (label[label] != label).any():
                label = label[label]
    own = np.flatnonzero(label != np.arange(len(fp)))
    signed = fp.view(np.int64)
    return signed[own], signed[label[own]]


def _shard_links(radius: int, rows: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; whole shards are taken together until there are `rows` of them."""
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def emit(kind, value, fp):
            shard = np.cumsum((np.diff(kind, prepend=kind[0] - 1) != 0) | (np.diff(value, prepend=value[0]) != 0))
            a, b = _stars(shard, fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
            if sum(len(x[0]) for x in kept) >= rows:
                kind, value, fp = (np.concatenate(x) for x in zip(*kept))
                same = (kind == kind[-1]) & (value == value[-1])
                cut = int(np.argmax(same))
                if cut:
                    yield emit(kind[:cut], value[:cut], fp[:cut])
                kept = [(kind[cut:], value[cut:], fp[cut:])]
        if kept:
            yield emit(*(np.concatenate(x) for x in zip(*kept)))

    return links


def hamming_stars(fingerprints: DataFrame, radius: int = 2, shard_limit: int = 4096) -> DataFrame:
    """`fingerprints(fp)`, distinct longs -> `(a, b)`: links that join the same fingerprints as all pairs at Hamming distance
    `radius` or less do. radius is 2 or less."""
    if not 0 < radius <= 2:
        raise ValueError("radius is 1 or 2")
    at = [BITS * k // 5 for k in range(6)]
    bits = lambda k: F.shiftrightunsigned("fp", at[k]).bitwiseAND((1 << (at[k + 1] - at[k])) - 1)
    couple = lambda i, j: bits(i) + F.shiftleft(bits(j), 16)
    named = F.array(*(F.struct(F.lit(n).alias("kind"), couple(i, j).alias("value")) for n, (i, j) in enumerate(COUPLES)))
    coarse = fingerprints.select("fp", F.explode(named).alias("s")).select("s.kind", "s.value", "fp")
    size = coarse.groupBy("kind", "value").agg(F.count("*").alias("members")).where("members > 1")
    dealt = coarse.join(size, ["kind", "value"])
    flips = F.array(*(F.lit(0).cast("long") if b < 0 else F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long") for b in range(-1, BITS)))
    fine = (
        dealt.where(F.col("members") > shard_limit).select("fp").distinct()
        .select(F.lit(-1).alias("kind"), F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("value"), "fp")
    )
    shards = dealt.where(F.col("members") <= shard_limit).select("kind", "value", "fp").union(fine)
    shards = shards.repartition("kind", "value").sortWithinPartitions("kind", "value")
    return shards.mapInArrow(_shard_links(radius, 1 << 17), "a long, b long")


def near_duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, width: int = 3, shard_limit: int = 4096) -> DataFrame:
    """Each row's id, `fp` (long) and `component_id`, the smallest id reachable over links of `radius` or less.

    One row for each input row, repeated rows included. Rows with a null id get the id of their group, which is null
    if no member has one. Equal texts have equal fingerprints and need no link. Null and blank texts have fingerprint 0 and are linked
    like any other. Other columns are not read, so their names cannot clash. An empty table gives an empty result.
    """
    docs = materialise(df.select(F.col(id_col).alias("id"), simhash(F.col(text_col), width).alias("fp")))
    reps = docs.groupBy("fp").agg(F.min("id").alias("low"))
    found = connected_components(hamming_stars(reps.select("fp"), radius, shard_limit))
    rooted = reps.join(found, reps.fp == found.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return docs.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _shingle_sets(texts: pd.Series, width: int, seed: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct XXH64 hashes of its `width`-word shingles, as `simhash` takes them; none without words."""
    digest = xxhash.xxh64_intdigest
    for text in texts:
        parts = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
        grams = zip(*(parts[k:] for k in range(width))) if len(parts) > width else [parts] if parts else []
        yield np.unique(np.array([digest(b" ".join(g), seed) for g in grams], np.uint64))


def _gram_rows(width: int, seed: int, most: int = 1 << 16):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text's key and shingle set for each text; passed on whenever there are `most` shingles, so that sets of few texts are held at once."""

        def emit(keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), grams], ["key", "grams"])

        for batch in batches:
            keys, sets, total = [], [], 0
            for found in _shingle_sets((x.as_py() for x in batch.column(0)), width, seed):
                keys.append(xxhash.xxh64_intdigest(found.tobytes(), seed))
                sets.append(found)
                total += len(found)
                if total >= most:
                    yield emit(keys, sets)
                    keys, sets, total = [], [], 0
            if keys:
                yield emit(keys, sets)

    return rows


def _sketches(texts: pd.Series, width: int, bands: int, rows: int, seed: int) -> pd.DataFrame:
    """For each text a key of its shingle set, the set's size and fingerprint, and `bands` hashes of `rows` least permuted shingles each."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    keys, lengths, prints, named = [], [], [], []

    def flush(sets: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in sets], np.int64)
        flat, some = np.concatenate(sets), np.flatnonzero(sizes)
        prints.append(_majority(flat, sizes).view(np.int64))
        least = np.zeros((len(sets), bands * rows), np.uint64)
        if len(some):
            first = (np.cumsum(sizes) - sizes)[some]
            for i, factor in enumerate(factors):
                least[some, i] = np.minimum.reduceat(flat * factor, first)
        named.extend(np.array([xxhash.xxh64_intdigest(r[b * rows : (b + 1) * rows].tobytes(), b) for b in range(bands)], np.uint64).view(np.int64) for r in least)

    held: list[np.ndarray] = []
    total = 0
    for found in _shingle_sets(texts, width, seed):
        keys.append(xxhash.xxh64_intdigest(found.tobytes(), seed))
        held.append(found)
        lengths.append(len(found))
        total += len(found)
        if total > 1 << 18:
            flush(held)
            held, total = [], 0
    if held:
        flush(held)
    return pd.DataFrame({"key": np.array(keys, np.uint64).view(np.int64), "n": np.array(lengths, np.int64), "fp": np.concatenate(prints) if prints else np.zeros(0, np.int64), "bands": named})


def _linked(key: np.ndarray, fp: np.ndarray, comp: np.ndarray, sizes: np.ndarray, grams: np.ndarray, radius: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets of one shard that join its groups `comp` as all pairs at `radius` or less whose Jaccard similarity is `least` or more do;
    less links than groups. `grams` holds the sets one after the other. Of two groups one is not the largest, so only sets outside of that are searched."""
    group = np.unique(comp, return_inverse=True)[1]
    asked = np.flatnonzero(group != np.bincount(group).argmax())
    made: list[tuple[int, int]] = []
    if len(asked):
        forest = grow_forest(np.zeros(len(key), np.int64), fp)
        # an index from each shingle to the sets that have it
        gram = np.unique(grams, return_inverse=True)[1]
        holders = np.repeat(np.arange(len(key)), sizes)[np.argsort(gram, kind="stable")]
        many = np.bincount(gram)
        first = np.cumsum(many) - many
        ends = np.cumsum(sizes)
        for at in range(0, len(asked), 1 << 8):
            hits = list(search_forest(fp, *forest, radius, asked=asked[at : at + (1 << 8)]))
            if not hits:
                continue
            a, b = (np.concatenate(x) for x in zip(*hits))
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            heads = np.flatnonzero(np.diff(a, prepend=-1))
            for one, near in zip(a[heads], np.split(b, heads[1:])):
                near = near[group[near] != group[one]]
                if not len(near):
                    continue
                own = gram[ends[one] - sizes[one] : ends[one]]
                n = many[own]
                common = np.bincount(holders[np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(key))[near]
                near = near[common >= least * (sizes[one] + sizes[near] - common)]
                for other in near[np.unique(group[near], return_index=True)[1]]:
                    made.append((one, other))
                    group[group == group[other]] = group[one]
    one, other = np.array(made, np.int64).reshape(-1, 2).T
    return key[one], key[other]


def _near_links(radius: int, least: float):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of kind, value, key, fp, comp and grams come sorted by shard; one shard is held at a time."""

        def emit(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            key, fp, comp = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in (2, 3, 4))
            sizes = np.concatenate([np.diff(p.column(5).offsets.to_numpy()) for p in parts]).astype(np.int64)
            grams = np.concatenate([p.column(5).flatten().to_numpy(zero_copy_only=False) for p in parts])
            a, b = _linked(key, fp.view(np.uint64), comp, sizes, grams, radius, least)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, value = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            cuts = [0, *(np.flatnonzero((np.diff(kind) != 0) | (np.diff(value) != 0)) + 1), batch.num_rows]
            for at, end in zip(cuts, cuts[1:]):
                if held and last != (kind[at], value[at]):
                    yield emit(held)
                    held = []
                held.append(batch.slice(at, end - at))
                last = kind[at], value[at]
        if held:
            yield emit(held)

    return links


def _similar_keys(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, width: int = 5, radius: int = 24, bands: int = 24, rows: int = 4, shard_limit: int = 4096, gram_limit: int = 1 << 21, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Two tables: the rows as `(id, row_mark, key)`, key naming a text's set of `width`-word shingles, and `(key, root)` for the keys that have links,
    root being the smallest key reachable over links of sets whose Jaccard similarity is `least` or more. Equal sets have one key and need no link.

    Sets of similarity 0.8 differ in some 10 of 64 bits, and as many bit blocks as that takes leave a few bits to each, whose shards grow
    with the table. So shards are named by `bands` hashes of `rows` min-hashes each: sets of similarity 0.8 share none with probability
    3e-6 and differ in over 24 bits with about 4e-6. A shard's members are first held against its least key. Where that leaves
    different groups in a shard of over two, the whole sets go to the shard: what its BK-tree finds is verified there, and only links that
    join groups come out, less than it has members. Every pair is verified on the whole sets before it is a link.
    A shard of over `shard_limit` sets or `gram_limit` shingles is dealt to shards of each two of its parts, so no task holds more and no pair is lost.
    Shingle sets are made anew only for texts that share a shard with another; of a set that many texts have, for one row.
    """

    @F.pandas_udf("key long, n long, fp long, bands array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield _sketches(texts, width, bands, rows, seed)

    docs = materialise(df.select(F.col(id_col).alias("id"), _row_mark(df).alias("row_mark"), sketch(F.col(text_col)).alias("s")).select("id", "row_mark", "s.*"))
    reps = docs.dropDuplicates(["key"]).select("key", "n", "fp", "bands")
    dealt = reps.select("key", "n", "fp", F.posexplode("bands").alias("kind", "value"))
    size = dealt.groupBy("kind", "value").agg(F.count("*").alias("members"), F.min("key").alias("hub"), F.min_by("fp", "key").alias("hub_fp")).where("members > 1")
    dealt = materialise(dealt.join(size, ["kind", "value"]))
    mark = fresh_name(df, "row_mark")
    met = dealt.select("key").distinct()
    read = materialise(docs.join(met, "key", "left_semi").groupBy("key").agg(F.min("row_mark").alias(mark)).select(mark).distinct())
    texts = df.withColumn(mark, _row_mark(df)).select(mark, F.col(f"`{text_col}`")).join(sized(read, 32 << 20, 16), mark, "left_semi")
    sets = materialise(texts.select(F.col(f"`{text_col}`")).mapInArrow(_gram_rows(width, seed), "key long, grams array<long>").dropDuplicates(["key"]))

    def verified(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("key").alias("a"), F.col("grams").alias("x"))
        two = sets.select(F.col("key").alias("b"), F.col("grams").alias("y"))
        counted = pairs.join(one, "a").join(two, "b").select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("common"))
        return materialise(counted.where(F.col("common") >= least * (F.col("nx") + F.col("ny") - F.col("common"))).select("a", "b"))

    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub_fp"))) <= radius
    tried = materialise(dealt.where((F.col("key") != F.col("hub")) & near).select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct())
    links = verified(tried)
    found = connected_components(links)
    open_ = dealt.where("members > 2").select("kind", "value", "key", "n", "fp").join(found, dealt.key == found.node, "left").select("kind", "value", "key", "n", "fp", F.coalesce("root", "key").alias("comp"))
    open_ = materialise(open_)
    mixed = open_.groupBy("kind", "value").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("kind", "value", "members", "shingles")
    open_ = open_.join(mixed, ["kind", "value"])
    parts = F.least(F.greatest(F.ceil(F.col("members") / (shard_limit // 2)), F.ceil(F.col("shingles") / (gram_limit // 2))), F.col("members")).cast("long")
    own = F.pmod(F.xxhash64("key"), parts)
    # a shard in one piece is tile 0; else a tile for each two parts
    others = F.filter(F.sequence(F.lit(0).cast("long"), parts - 1), lambda j: j != own)
    whole = (F.col("members") <= shard_limit) & (F.col("shingles") <= gram_limit)
    tiles = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.transform(others, lambda j: 1 + F.least(j, own) * parts + F.greatest(j, own)))
    shards = open_.withColumn("tile", F.explode(tiles)).select((F.col("kind") + F.col("tile") * bands).alias("kind"), "value", "key", "fp", "comp")
    shards = shards.join(sets, "key").select("kind", "value", "key", "fp", "comp", "grams").repartition("kind", "value").sortWithinPartitions("kind", "value")
    more = materialise(shards.mapInArrow(_near_links(radius, least), "a long, b long").distinct())
    if not more.isEmpty():
        found = connected_components(links.union(more))
    return docs.select("id", "row_mark", "key"), found


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, **plan: int) -> DataFrame:
    """Each row's id and `component_id`, the smallest id reachable over links of texts whose sets of 5-word shingles have a Jaccard
    similarity of `least` or more. Nulls, blanks and repeated rows are as in `near_duplicate_groups`."""
    docs, found = _similar_keys(df, id_col, text_col, least, **plan)
    lows = docs.groupBy("key").agg(F.min("id").alias("low"))
    rooted = lows.join(found, lows.key == found.node, "left").select("key", "low", F.coalesce("root", "key").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(smallest, "root").select("key", "component_id")
    return docs.join(named, "key").select(F.col("id").alias(id_col), "component_id")


def _row_mark(df: DataFrame) -> Column:
    """A hash of all columns: rows with one mark are taken as repeats of each other where their ids and groups agree too."""
    whole = [F.map_entries(F.col(f"`{c}`")) if kind.startswith("map") else F.col(f"`{c}`").cast("string") if kind in ("variant", "void") else F.col(f"`{c}`") for c, kind in df.dtypes]
    return F.xxhash64(*whole, *(F.col(f"`{c}`").isNull() for c in df.columns))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """The rows of `df` that stay: one of each group of `similar_groups`, that with the smallest id, nulls last; of several such rows the first by a
    hash of all columns, and of rows that are alike in all columns one. Ids are never taken for groups, so rows with a null or a repeated id
    stay if their texts are like no other. Columns are those of `df`; an empty table stays empty.
    """
    docs, found = _similar_keys(df, id_col, text_col, least)
    place = F.struct(F.col("id").isNull().alias("last"), "id", "row_mark")
    lows = docs.groupBy("key").agg(F.min(place).alias("at"))
    rooted = lows.join(found, lows.key == found.node, "left").select("at", F.coalesce("root", "key").alias("root"))
    first = rooted.groupBy("root").agg(F.min("at").alias("at"))
    keep_id, keep_mark, mark, many = (fresh_name(df, x) for x in ("kept_id", "kept_mark", "row_mark", "row_count"))
    # how often a row that stays comes, whole: what comes once needs no look at the others
    counts = docs.groupBy("id", "row_mark").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("c_id"), F.col("row_mark").alias("c_mark"), "n")
    kept = first.select(F.col("at.id").alias(keep_id), F.col("at.row_mark").alias(keep_mark)).distinct()
    kept = kept.join(counts, F.col(keep_id).eqNullSafe(F.col("c_id")) & (F.col(keep_mark) == F.col("c_mark")), "left").select(keep_id, keep_mark, F.coalesce("n", F.lit(1)).alias(many))
    kept = materialise(kept)
    marked = df.withColumn(mark, _row_mark(df))
    on = F.col(f"`{id_col}`").eqNullSafe(F.col(keep_id)) & (F.col(mark) == F.col(keep_mark))
    once = marked.join(kept.where(F.col(many) == 1), on, "left_semi").select(*(F.col(f"`{c}`") for c in df.columns))
    repeated = kept.where(F.col(many) > 1)
    if repeated.isEmpty():
        return once
    others = marked.join(repeated, on, "left_semi").dropDuplicates([mark, id_col])
    return once.union(others.select(*(F.col(f"`{c}`") for c in df.columns)))
