"""JSON-lines sources and sinks: lenient, strict and repairing reads, tagged unions, summaries and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.operators.evaluate import first_wins

#: Names under which a thread's text may come, first present first.
THREAD_NAMES = ("thread", "threadText", "rawThread", "rawThreadText", "text", "input")


def read_lenient(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Blank lines and lines that do not parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def repaired(line):
    """A line without byte-order mark, NULs, commas before closing brackets, and blanks inside escapes of line ends."""
    line = F.replace(F.regexp_replace(line, "^﻿", ""), F.lit("\u0000"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(line, r"\\ n", r"\\n"), r",\s*([}\]])", "$1")


def lint(lines: DataFrame, schema: str) -> DataFrame:
    """`lines(value)` -> line (repaired), ok, parsed. Blank lines and those that begin with # are left out."""
    kept = lines.select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")
    fixed = kept.select(repaired(F.col("value")).alias("line"))
    parsed = F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return fixed.select("line", parsed.alias("p")).select("line", (F.col("p").isNotNull() & F.col("p._bad").isNull()).alias("ok"), F.col("p").alias("parsed"))


def thread_text(df: DataFrame):
    have = [F.col(n) for n in THREAD_NAMES if n in df.columns]
    return F.coalesce(*have, F.lit(""))


def tagged_union(tables: list[tuple[str, DataFrame]], id_col: str) -> DataFrame:
    """Tables one after another with a tag; of rows with one id that of the first table stays."""
    parts = [df.withColumn("tag", F.lit(tag)).withColumn("place", F.lit(n)) for n, (tag, df) in enumerate(tables)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return first_wins(whole, [id_col], ["place", "tag"]).drop("place")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The items of a JSON index document, a row each."""
    return spark.read.option("multiLine", True).json(path).select("version", F.explode("items").alias("item")).select("version", "item.*")


def walk(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Files below a folder whose names match, with path, length and content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").csv(path)


def config_digest(values: dict[str, str]):
    """SHA-256 of the settings as JSON in the order of their names."""
    return F.sha2(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in sorted(values.items())))), 256)
