"""Conflict-constrained best-fit packing of documents into sequences of a fixed number of tokens.

Documents are dealt to shards of bounded size by their running number, and every shard is packed by itself, longest document first. Open
bins are ordered by what room they have left; each carries a bitmap of its sources and one of its duplicate clusters. A
document goes to the tightest bin that has room and neither its source nor its cluster: the search starts at the first bin
with room enough and goes from successor to successor until a bin is compatible; without one a bin is opened. A longer document
is cut into full bins of its own and a rest. Only ids and lengths move; a hot source or cluster is spread over all shards.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.shared import materialise, words

RESULT = "bin_id long, slot int, id {id}, chunk int, token_from long, n_tokens long, bin_tokens long, bin_documents int"


def best_fit(length: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The bin of each item, items taken in the order given, lengths `capacity` at most. source and cluster are small
    non-negative codes, or -1 for an item that conflicts with none."""
    bins = np.zeros(len(length), np.int64)
    order: list[tuple[int, int]] = []  # (room left, bin)
    sources: list[int] = []
    clusters: list[int] = []
    for i, (n, s, c) in enumerate(zip(length.tolist(), source.tolist(), cluster.tolist())):
        of_source, of_cluster = (1 << s if s >= 0 else 0), (1 << c if c >= 0 else 0)
        at = bisect_left(order, (n, -1))
        while at < len(order) and (sources[order[at][1]] & of_source or clusters[order[at][1]] & of_cluster):
            at += 1
        if at < len(order):
            room, b = order.pop(at)
        else:
            room, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= of_source
        clusters[b] |= of_cluster
        insort(order, (room - n, b))
        bins[i] = b
    return bins, len(sources)


def _codes(values: pd.Series, lone: bool) -> np.ndarray:
    """Codes from 0; null is -1 and, with `lone`, so is a value that occurs once, which no other item can conflict with."""
    codes = pd.factorize(values)[0]
    if lone:
        many = np.flatnonzero(np.bincount(codes[codes >= 0], minlength=1) > 1)
        place = np.full(max(int(codes.max(initial=-1)) + 2, 1), -1)
        place[many] = np.arange(len(many))
        codes = np.where(codes >= 0, place[codes], -1)
    return codes


def _pack_shard(capacity: int):
    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "id"], ascending=[False, True], kind="stable", na_position="last", ignore_index=True)
        length = shard["length"].to_numpy(np.int64)
        full, rest = length // capacity, length % capacity
        # a document of no tokens, and one with a rest, has a last piece to be placed; the others end with a full bin
        whole = np.repeat(np.arange(len(shard)), full)
        chunk = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        last = np.flatnonzero((rest > 0) | (length == 0))
        last = last[np.argsort(-rest[last], kind="stable")]
        placed, n = best_fit(rest[last], _codes(shard["source"], False)[last], _codes(shard["cluster"], True)[last], capacity)
        row, bins = np.concatenate([whole, last]), np.concatenate([n + np.arange(len(whole)), placed])
        out = pd.DataFrame({"bin": bins, "row": row, "chunk": np.concatenate([chunk, full[last]]), "n_tokens": np.concatenate([np.full(len(whole), capacity), rest[last]])})
        out["token_from"] = out["chunk"] * capacity
        group = out.groupby("bin")
        out["slot"], out["bin_tokens"], out["bin_documents"] = group.cumcount(), group["n_tokens"].transform("sum"), group["bin"].transform("size")
        out["bin_id"] = (int(shard["shard"].iloc[0]) << 32) + out["bin"] if len(shard) else 0
        out["id"] = shard["id"].to_numpy()[out["row"]] if not shard["id"].isna().any() else [None if pd.isna(x) else x for x in shard["id"].astype(object).to_numpy()[out["row"]]]
        return out[["bin_id", "slot", "id", "chunk", "token_from", "n_tokens", "bin_tokens", "bin_documents"]]

    return pack


def pack(df: DataFrame, id_col: str, length_col: str, source_col: str, cluster_col: str, capacity: int = 2048, shard_rows: int = 4096) -> DataFrame:
    """One row for each document and piece of at most `capacity` tokens: bin_id, slot (place in the bin), the id, chunk, token_from,
    n_tokens, and the bin's bin_tokens and bin_documents.

    In a bin no two rests share a source or a cluster. A null source or cluster conflicts with nothing; a null length is 0, and a document of
    no tokens gets a place of no tokens. Rows that repeat are packed each, in different bins if they have a cluster. Ties are broken by id, nulls last.
    Rows are dealt by their running number to shards of about `shard_rows`, so their number, not their size, grows with the table, whatever repeats in it;
    which rows meet depends on how the table is laid out in files. An empty table gives an empty result; other columns are not read.
    """
    lean = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(length_col).cast("long"), F.lit(0)).alias("length"), F.col(source_col).cast("string").alias("source"), F.col(cluster_col).cast("string").alias("cluster"))
    # written, so that running numbers stay what they are if a task is run again: rows that repeat are dealt like any others
    lean = materialise(lean)
    shards = max(1, -(-lean.count() // shard_rows))
    dealt = lean.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    schema = RESULT.format(id=dict(lean.dtypes)["id"])
    return dealt.groupBy("shard").applyInPandas(_pack_shard(capacity), schema).withColumnRenamed("id", id_col)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = 2048) -> DataFrame:
    """`pack` with words as tokens and equal lower-case words as duplicate clusters. A text without words is in no cluster."""
    parts = words(F.col(text_col))
    cluster = F.when(F.size("w") > 0, F.xxhash64(F.lower(F.array_join("w", " "))))
    lean = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), parts.alias("w"))
    lean = lean.select("id", "source", F.size("w").alias("length"), cluster.alias("cluster"))
    return pack(lean, "id", "length", "source", "cluster", capacity).withColumnRenamed("id", id_col)
