"""Similarity: sparse and dense vectors, top-k of a stated query set against all rows in blocks, hashed trigrams, leader clusters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.functions.text import characters, for_embedding
from threadlens.session import written

BLOCK = 1024


def sparse_weights(weighted: DataFrame, key: str, feature: str, weight: str, k: int = 24) -> DataFrame:
    """The k heaviest positive features of each key with log1p(w) / log1p(largest w)."""
    at = W.partitionBy(key).orderBy(F.desc(weight), feature)
    top = weighted.where(F.col(weight) > 0).withColumn("at", F.row_number().over(at)).where(F.col("at") <= k)
    return top.withColumn("w", F.log1p(weight) / F.log1p(F.max(weight).over(W.partitionBy(key)))).select(key, feature, "w")


def unit(vector: Column) -> Column:
    """The vector in doubles with length 1; zeros stay zeros."""
    v = F.transform(vector, lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    # through an array of one, so that the length is worked out once a row and not for every element
    both = F.transform(F.array(F.struct(v.alias("v"), n.alias("n"))), lambda y: F.transform(y["v"], lambda x: F.when(y["n"] > 0, x / y["n"]).otherwise(F.lit(0.0))))
    return F.get(both, F.lit(0))


def top_k(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 5, least: float = -1.0, block: int = BLOCK) -> DataFrame:
    """The k rows most similar to each query by cosine, itself excluded: (query_id, id, sim, rank), sim to 6 decimals, ties by id.

    Queries are a stated set, taken `block` at a time, so what the driver and a task hold is bounded; each block is multiplied with every batch of rows, a
    batch leaves k rows for each query before the shuffle, and a block's result is written before the next is taken. Null and empty vectors are left out.
    """
    keyed = lambda d: d.where(F.size(vector_col) > 0).select(F.col(id_col).cast("long").alias("id"), unit(F.col(vector_col)).alias("v"))
    asked = written(keyed(queries))
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    at = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    found = []
    for b in range(blocks):
        part = asked.where(F.col("block") == b).select("id", "v").toPandas()
        if not len(part):
            continue
        ids, matrix = part["id"].to_numpy(), np.stack(part["v"].to_numpy())

        def multiply(batches: Iterator[pd.DataFrame], ids=ids, matrix=matrix) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                sims = np.ascontiguousarray((np.round(np.stack(batch["v"].to_numpy()) @ matrix.T, 6) + 0.0).T)
                own = batch["id"].to_numpy()
                # the least of the k + 1 best of each query; only rows from there on are sorted, all that tie with it among them
                kept = min(k + 1, len(own))
                edge = np.partition(sims, len(own) - kept, axis=1)[:, len(own) - kept]
                rows_of, best = [], []
                for q in range(len(ids)):
                    some = np.flatnonzero(sims[q] >= edge[q])
                    order = some[np.lexsort((own[some], -sims[q, some]))][: k + 1]
                    order = order[(own[order] != ids[q]) & (sims[q, order] >= least)][:k]
                    rows_of.append(np.full(len(order), q))
                    best.append(order)
                # one frame for each batch, not for each query
                at_q, at_row = np.concatenate(rows_of), np.concatenate(best)
                yield pd.DataFrame({"query_id": ids[at_q], "id": own[at_row], "sim": sims[at_q, at_row]})

        near = keyed(rows).mapInPandas(multiply, "query_id long, id long, sim double")
        found.append(written(near.withColumn("rank", at).where(F.col("rank") <= k)))
    if not found:
        found = [keyed(rows).limit(0).select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("sim"), F.lit(1).alias("rank"))]
    return reduce(DataFrame.union, found)


def hashed_trigrams(df: DataFrame, id_col: str, text: Column, dims: int = 64) -> DataFrame:
    """(id, idx, value): signed counts of FNV-1a hashes of the trigrams of the normalised text, padded with two spaces; zeros are left out."""
    padded = characters(F.concat(F.lit("  "), for_embedding(text), F.lit("  ")))
    codes = df.select(F.col(id_col).alias("id"), F.transform(padded, lambda c: F.ascii(c).cast("long")).alias("c"))
    grams = codes.select("id", F.posexplode("c").alias("at", "a"), "c").where(F.col("at") + 3 <= F.size("c"))
    h = F.lit(0x811C9DC5).cast("long")
    for x in (F.col("a"), F.get("c", F.col("at") + 1), F.get("c", F.col("at") + 2)):
        h = ((h.bitwiseXOR(x)) * 0x01000193).bitwiseAND(0xFFFFFFFF)
    hashed = grams.select("id", h.alias("h"))
    sign = F.when(F.col("h") % 2 == 0, 1).otherwise(-1)
    return hashed.groupBy("id", (F.col("h") % dims).cast("int").alias("idx")).agg(F.sum(sign).alias("value")).where("value <> 0").withColumnRenamed("id", id_col)


def leader_clusters(items: DataFrame, least: float = 0.45, most: int = 500) -> DataFrame:
    """`items(grp, id, score, keys)` -> (grp, id, leader): by score, then id, each item joins the most similar leader before it in its group whose keys
    have a Jaccard similarity of `least` or more, the first of equals, else it leads.

    Only the first item of each key set can lead, or the items with no keys, which are like none. At most `most` of a group's sets that no leader takes
    meet in a task, best first; the sets that their leaders do not take are the next round's. At last each item is held against the leaders before it, in joins.
    """
    place = F.struct(F.col("score").alias("score"), F.bitwise_not("id").alias("turned"))
    placed = written(items.select("grp", "id", place.alias("place"), F.array_sort(F.array_distinct("keys")).alias("keys")))

    def alike(a: str, b: str) -> Column:
        common = F.size(F.array_intersect(a, b))
        return common / F.greatest(F.size(a) + F.size(b) - common, F.lit(1))

    def lead(group: pd.DataFrame) -> pd.DataFrame:
        leaders: list[tuple[set, int]] = []
        for row in group.sort_values("at").itertuples():
            keys = set(row.keys)
            if max((len(keys & k) / max(len(keys | k), 1) for k, _ in leaders), default=0.0) < least:
                leaders.append((keys, row.at))
        return pd.DataFrame({"grp": group["grp"].iloc[0], "at": [at for _, at in leaders]}, columns=["grp", "at"])

    at = F.row_number().over(W.partitionBy("grp").orderBy(F.desc("place")))
    open_ = written(placed.groupBy("grp", "keys").agg(F.max("place").alias("place")))
    found = []
    while not open_.isEmpty():
        front = written(open_.withColumn("at", at).where(F.col("at") <= most))
        led = front.groupBy("grp").applyInPandas(lead, "grp string, at int").select(F.col("grp").alias("l_grp"), F.col("at").alias("l_at"))
        led = front.join(led, F.col("grp").eqNullSafe(F.col("l_grp")) & (F.col("at") == F.col("l_at"))).select("l_grp", F.col("place").alias("l_place"), F.col("keys").alias("l_keys"))
        found.append(written(led))
        taken = F.col("grp").eqNullSafe(F.col("l_grp")) & ((alike("keys", "l_keys") >= least) | (F.col("keys") == F.col("l_keys")))
        open_ = written(open_.join(found[-1], taken, "left_anti"))
    if not found:
        return placed.select("grp", "id", F.col("id").alias("leader"))
    leaders = reduce(DataFrame.union, found)
    before = F.col("grp").eqNullSafe(F.col("l_grp")) & (F.col("l_place") >= F.col("place")) & (alike("keys", "l_keys") >= least)
    best = F.max(F.when(F.col("l_place").isNotNull(), F.struct(alike("keys", "l_keys").alias("sim"), "l_place"))).alias("best")
    joined = placed.join(leaders, before, "left").groupBy("grp", "id").agg(best)
    return joined.select("grp", "id", F.coalesce(F.bitwise_not("best.l_place.turned"), "id").alias("leader"))
