"""Vectors at scale: greedy clusters of dense vectors in order, and exact search among sparse vectors of any width."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.operators.similarity import unit
from threadlens.session import written

#: Vectors among which one task elects leaders, about; rows that are held against them at once.
FRONT, ROWS = 8192, 1024
#: Features of a block of sparse vectors, about.
ENTRIES = 1 << 18


def greedy_clusters(rows: DataFrame, id_col: str, vector_col: str, least: float = 0.86, front: int = FRONT) -> DataFrame:
    """(id, leader, sim): in the order of ids, each row joins the first leader before it whose cosine similarity is `least` or more (to 9 decimals), else it leads; sim is that with its leader.

    Rows that are still open are taken from the front, some `front` at a time: one task elects leaders among them, then all open rows are held against these and leave if they are like one. Later leaders come after all earlier ones, so
    the first that a row is like is found in the first round that has one. Of equal vectors only the first is looked at. There are as many rounds as `front` goes into the open rows that no leader takes. Vectors are of one length;
    a null, an empty vector and one of zeros is like none and leads itself, with sim 0. Rows without an id are left out.
    """
    keyed = written(rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), unit(F.coalesce(F.col(vector_col), F.array().cast("array<double>"))).alias("v")))
    some = F.exists("v", lambda x: x != 0)
    open_ = written(keyed.where(some).groupBy("v").agg(F.min("id").alias("first")))

    def elect(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("first")
        matrix = np.stack(group["v"].to_numpy())
        chosen = np.zeros(len(matrix), bool)
        held = np.empty_like(matrix)
        n = 0
        for i, v in enumerate(matrix):
            if not n or np.round(held[:n] @ v, 9).max() < least:
                held[n], chosen[i] = v, True
                n += 1
        return group[chosen][["first", "v"]]

    found = []
    while left := open_.count():
        head = open_
        if left > front:
            head = open_.where(F.col("first") <= open_.agg(F.percentile_approx("first", F.lit(front / left), F.lit(max(10000, 20 * left // front)))).first()[0])
        leaders = head.withColumn("one", F.lit(True)).groupBy("one").applyInPandas(elect, "first long, v array<double>").toPandas().sort_values("first")
        ids, matrix = leaders["first"].to_numpy(), np.stack(leaders["v"].to_numpy())

        def hold(batches: Iterator[pd.DataFrame], ids=ids, matrix=matrix) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), ROWS):
                    part = batch.iloc[at : at + ROWS]
                    sims = np.round(np.stack(part["v"].to_numpy()) @ matrix.T, 9)
                    sims[ids[None, :] > part["first"].to_numpy()[:, None]] = -2  # a leader takes none before it
                    like = sims >= least
                    which, taken = like.argmax(axis=1), like.any(axis=1)
                    own = ids[which] == part["first"].to_numpy()
                    yield pd.DataFrame({"first": part["first"], "v": part["v"], "taken": taken, "leader": ids[which], "sim": np.where(own, 1.0, sims[np.arange(len(part)), which])})

        held = written(open_.mapInPandas(hold, "first long, v array<double>, taken boolean, leader long, sim double"))
        found.append(held.where("taken"))
        open_ = held.where("not taken").select("v", "first")
    alone = keyed.where(~some).select("id", F.col("id").alias("leader"), F.lit(0.0).alias("sim"))
    if not found:
        return alone.withColumnRenamed("id", id_col)
    settled = reduce(DataFrame.union, found).select("v", "leader", "sim")
    return keyed.where(some).join(settled, "v").select("id", "leader", "sim").union(alone).withColumnRenamed("id", id_col)


def cluster_report(clusters: DataFrame) -> DataFrame:
    """From `greedy_clusters`: leader, size and the mean similarity with the leader, to 4 decimals."""
    return clusters.groupBy("leader").agg(F.count("*").alias("size"), F.round(F.avg("sim"), 4).alias("avg_sim"))


def sparse_cosine(a: str, b: str) -> Column:
    """Cosine of two columns of maps from features to weights; 0 where one has no length."""
    length = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(F.col(b), e["key"]), F.lit(0.0)))
    return F.coalesce(F.when(length(a) * length(b) > 0, dot / (length(a) * length(b))), F.lit(0.0))


def sparse_vectors(weighted: DataFrame, key: str, feature: str, weight: str) -> DataFrame:
    """(id, vec): the positive weights of each key at length 1, as an array of (f, u) by feature. A feature that a key has twice counts with the sum."""
    cells = weighted.where((F.col(weight) > 0) & F.col(key).isNotNull() & F.col(feature).isNotNull()).groupBy(F.col(key).alias("id"), F.col(feature).alias("f")).agg(F.sum(weight).alias("w"))
    vec = cells.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("vec"))
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    return vec.select("id", F.transform("vec", lambda x: F.struct(x["f"].alias("f"), (x["w"] / size).alias("u"))).alias("vec"))


def _first_members(vectors: DataFrame, k: int) -> DataFrame:
    """(vec, ids): the k smallest ids of equal vectors, in order; in two steps, as many rows may have one vector."""
    at = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy("id"))
    dealt = vectors.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(64)))
    near = dealt.withColumn("n", at("vec", "deal")).where(F.col("n") <= k)
    near = near.withColumn("n", at("vec")).where(F.col("n") <= k)
    return near.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _scored(k: int, least: float):
    """Of a block of classes (c, low, f, u) and one of queries (q, f, u): each query's k best classes with a cosine of `least` or more, to 6 decimals, ties by low."""

    def score(classes: pa.Table, queries: pa.Table) -> pa.Table:
        ids, asked = classes["c"].to_numpy(), queries["q"].to_numpy()
        low = np.unique(classes["low"].to_numpy(), return_inverse=True)[1]
        lists = [[t[name].combine_chunks() for name in ("f", "u")] for t in (classes, queries)]
        terms = pa.concat_arrays([f.flatten() for f, _ in lists]).dictionary_encode().indices.to_numpy()
        u, v = (x.flatten().to_numpy() for _, x in lists)
        sizes, reach = (np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())]) for _, x in lists)
        own, theirs = terms[: len(u)], terms[len(u) :]
        order = np.argsort(own, kind="stable")
        rows, weights = np.repeat(np.arange(len(ids)), np.diff(sizes))[order], u[order]
        ends = np.searchsorted(own[order], np.arange(terms.max(initial=-1) + 2))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n, q in enumerate(asked):
            sims = np.zeros(len(ids))
            for at in range(reach[n], reach[n + 1]):
                part = slice(ends[theirs[at]], ends[theirs[at] + 1])
                sims[rows[part]] += v[at] * weights[part]  # a class has a feature once
            near = np.flatnonzero(sims >= least - 1e-6)
            sim = np.round(sims[near], 6)
            near, sim = near[sim >= least], sim[sim >= least]
            best = np.lexsort((low[near], -sim))[:k]
            found.append((np.full(len(best), q), ids[near[best]], sim[best]))
        q, c, sim = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"q": pa.array(q, pa.int64()), "c": pa.array(c, pa.int64()), "sim": pa.array(sim, pa.float64())})

    return score


def sparse_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, least: float = 0.4, entries: int = ENTRIES) -> DataFrame:
    """(query_id, id, sim, rank): for each query the k rows with the largest cosine of `least` (above 0) or more, itself left out; sim to 6 decimals, ties by id. Both tables are of `sparse_vectors`.

    Classes of equal vectors and distinct queries are dealt to blocks of some `entries` features each, and each block of the ones meets each block of the others in a task, which adds up a query's cosines along an inverted index of its classes and passes on the k + 1 best. So
    memory is bounded, no pair leaves its task, and a pair costs as many steps as it has features in common. All queries meet all rows: with queries in proportion to the rows the work is quadratic, by nature. Equal vectors are one, so copies form no pairs; k + 1 of them are listed at most.
    """
    classes = written(_first_members(vectors, k + 1).select(F.monotonically_increasing_id().alias("c"), "vec", "ids"))
    asked = written(queries.select("vec").distinct().select(F.monotonically_increasing_id().alias("q"), "vec"))
    blocks = lambda df: 1 + (df.agg(F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()[0] - 1) // entries
    here, there = max(blocks(classes), 1), max(blocks(asked), 1)
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    row = F.pmod(F.xxhash64("c"), F.lit(here)).alias("row")
    column = F.pmod(F.xxhash64("q"), F.lit(there)).alias("column")
    parts = (F.col("vec")["f"].alias("f"), F.col("vec")["u"].alias("u"))
    met = classes.select(row, F.explode(every(there)).alias("column"), "c", F.get("ids", F.lit(0)).alias("low"), *parts).repartition(here * there, "row", "column")
    wanted = asked.select(column, F.explode(every(here)).alias("row"), "q", *parts).repartition(here * there, "row", "column")
    near = met.groupBy("row", "column").cogroup(wanted.groupBy("row", "column")).applyInArrow(_scored(k + 1, least), "q long, c long, sim double")
    listed = near.join(classes.select("c", "ids"), "c").select("q", "sim", F.explode("ids").alias("id"))
    best = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("sim"), "id"))
    listed = written(listed.withColumn("n", best("q")).where(F.col("n") <= k + 1).drop("n"))
    members = queries.join(asked, "vec").select(F.col("id").alias("query_id"), "q")
    each = members.join(listed, "q").where(F.col("query_id") != F.col("id"))
    return each.withColumn("rank", best("query_id")).where(F.col("rank") <= k).select("query_id", "id", "sim", "rank")
