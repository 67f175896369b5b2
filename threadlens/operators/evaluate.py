"""Evaluation: expected against got, confusion pairs, reasons, percentiles, summaries; and per-key rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion(df: DataFrame, expected: str, got: str) -> DataFrame:
    return df.groupBy(F.concat_ws("->", F.col(expected).cast("string"), F.col(got).cast("string")).alias("pair")).agg(F.count("*").alias("n"))


def reasons(checks: dict[str, Column]) -> Column:
    """The names of the checks that do not hold, sorted."""
    return F.array_sort(F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in checks.items()))))


def reason_combos(df: DataFrame, why: str, id_col: str, samples: int = 3) -> DataFrame:
    """For each combination of reasons its number and its first ids; the ids are picked from partial minima, not from whole groups."""
    failed = df.where(F.size(why) > 0).select(F.array_join(why, "+").alias("combo"), F.col(id_col).alias("id"))
    counts = failed.groupBy("combo").agg(F.count("*").alias("n"))
    parts = failed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    near = parts.withColumn("at", F.row_number().over(W.partitionBy("combo", "salt").orderBy("id"))).where(F.col("at") <= samples)
    first = near.withColumn("at", F.row_number().over(W.partitionBy("combo").orderBy("id"))).where(F.col("at") <= samples)
    listed = first.groupBy("combo").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("examples"))
    return counts.join(listed, "combo").select("combo", "n", "examples")


def summary(df: DataFrame, passed: Column, why: str, pair: Column) -> DataFrame:
    """The long table key, subkey, n: totals, reasons, pairs. One pass: every row is turned into its keys and these are counted."""
    entry = lambda k, s: F.struct(F.lit(k).alias("key"), s.alias("subkey"))
    entries = F.concat(F.array(entry("meta", F.lit("cases")), entry("meta", F.when(passed, "pass").otherwise("fail")), entry("pair", pair)), F.transform(why, lambda r: entry("reason", r)))
    return df.select(F.explode(entries).alias("e")).groupBy("e.key", "e.subkey").agg(F.count("*").alias("n"))


def floor_percentiles(df: DataFrame, keys: list[str], value: str, percents: tuple[int, ...] = (10, 50, 90)) -> DataFrame:
    """Values at floor(p / 100 * (n - 1)) of each group's order, with n, min, max and avg.

    Values are counted first, so a group with repeated values is small; ranks are running sums of the counts.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    own = W.partitionBy(*keys)
    upto = F.sum("c").over(own.orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(own))
    pick = [F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("n") - 1) / 100), F.col(value))).alias(f"p{p}") for p in percents]
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), *pick)


def signature_pack(df: DataFrame, signature: str, source: str, doc: str) -> DataFrame:
    """For each signature and source the documents, their share of the signature, and the signature's share of all, from counts alone."""
    cells = df.groupBy(F.col(signature).alias("signature"), F.col(source).alias("source")).agg(F.count(doc).alias("n_docs"))
    total = F.sum("n_docs").over(W.partitionBy("signature"))
    return cells.withColumn("signature_docs", total)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first by `order`; minima are aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def highest_stage(stages: Column, order: tuple[str, ...] = ("info", "verify", "install", "payment")) -> Column:
    """Of an array of stages the highest in `order`; the first of it without any."""
    names = F.array(*(F.lit(x) for x in order))
    best = F.array_max(F.transform(stages, lambda x: F.array_position(names, x).cast("int")))
    return F.get(names, F.greatest(F.coalesce(best, F.lit(1)), F.lit(1)) - 1)


def report_lines(hits: DataFrame, most: int = 8) -> DataFrame:
    """`hits(thread_id, ix, rule_id, weight)` -> a report of each thread: how many messages have hits, and its heaviest rules."""
    sums = hits.groupBy("thread_id", "rule_id").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    top = top_per_group(sums, ["thread_id"], [F.desc("w"), F.col("rule_id")], most)
    line = F.concat(F.lit("- "), "rule_id", F.lit(" (+"), F.col("w").cast("long").cast("string"), F.lit(", "), F.col("n").cast("string"), F.lit(" hits)"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    body = top.groupBy("thread_id").agg(F.array_join(lines, "\n").alias("body"))
    messages = hits.groupBy("thread_id").agg(F.countDistinct("ix").alias("m"))
    return body.join(messages, "thread_id").select("thread_id", F.concat(F.lit("[Report]\n- messages with hits: "), F.col("m").cast("string"), F.lit("\n"), "body").alias("report"))
