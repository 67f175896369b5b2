"""What several operators need: the shared folder, tables written there, marks of texts, column names that do not clash."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than these six (space and U+0009 to U+000D).
WORD_GAP = r"[\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. `spark.checkpoint.dir` is the cluster's; only where it is unset
    (a local test session) a folder of this machine is made."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is to name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="threadlens-checkpoint-"))
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, stem: str) -> str:
    """A new folder in the one that the cluster shares, as a URI."""
    top = ensure_checkpoint_dir(spark)
    return f"{top if ':' in top else 'file://' + top}/{stem}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Writes `df` to the shared checkpoint folder and cuts its lineage, so a lost executor costs nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders of tables that `written` made, in order.
_WRITTEN: list[str] = []


def tables_so_far() -> int:
    return len(_WRITTEN)


def remove_tables(spark: SparkSession, since: int) -> None:
    """Deletes the tables that were `written` after `tables_so_far` gave `since`; for use once what reads them is itself written."""
    while len(_WRITTEN) > since:
        remove_folder(spark, _WRITTEN.pop())


def written(df: DataFrame, stem: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder. Unlike a checkpoint it is read by columns, so a text that stands beside a
    few numbers is read only where it is asked for."""
    path = shared_folder(df.sparkSession, stem)
    _WRITTEN.append(path)
    empty = [c for c, kind in df.dtypes if kind == "void"]  # columns of nothing but nulls, which Parquet does not know
    stored = df.withColumns({c: F.col(f"`{c}`").cast("string") for c in empty})
    stored.write.parquet(path)
    return df.sparkSession.read.schema(stored.schema).parquet(path).withColumns({c: F.lit(None) for c in empty})


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_marks(text: Column) -> list[Column]:
    """Two longs that name a text, 128 bits together; null is as empty."""
    body = F.coalesce(text, F.lit(""))
    return [F.xxhash64(body), F.xxhash64(F.lit("second"), body)]


def sized(df: DataFrame, bound: int, row_bytes: int) -> DataFrame:
    """`df` with a hint to send it to all executors if its rows, counted here, take `bound` bytes at most; else as it is, to be shuffled."""
    return F.broadcast(df) if df.count() * row_bytes <= bound else df


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have (names are compared without case, as Spark does)."""
    taken, name, n = {c.lower() for c in df.columns}, stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def words(text):
    """The words of a text column as an array; null and blank texts have none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{WORD_GAP}|{WORD_GAP}\z", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))
