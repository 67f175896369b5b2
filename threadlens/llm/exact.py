"""Exact duplicates by deterministic block naming. Column expressions, joins and windows only.

A text without its blanks is cut into blocks of BLOCK bytes. Blocks are dealt by a hash and sorted, and a block's name is an integer: where it was dealt to and its rank there,
so equal blocks have one name and different blocks never share one. Names that stand side by side are then named as pairs, in the same way, and the pairs' names again, until
each document has a single name. With the number of rounds that it took, that name is the document's identity: by induction it names one sequence of blocks and no other. Hashes decide where
rows meet, never what is equal.

A key that comes often (a third of all rows may be copies of one text) is never gathered: its distinct values are found by partial aggregation, named, and
joined back in as many salted parts as its rows need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.llm.shared import fresh_name, materialise, remove_folder, shared_folder

#: Fixed: the characters that do not count.
BLANKS = " \t\n\x0b\x0c\r"
BLOCK = 1024
#: A key with more rows than this, or than one in HOT_KEYS of all rows, is named in parts; so there are HOT_KEYS such keys at most, whatever the input's size.
MOST, HOT_KEYS = 4096, 1 << 20
#: Rows that are sorted together, in the mean.
TOGETHER = 2048


def normalised(text: Column) -> Column:
    """The text without blanks; null is as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _ranked(rows: DataFrame, keys: list[str], total: int, side: int) -> DataFrame:
    """`rows` with `name`: equal keys have equal names. `side` (0 or 1) keeps the names of two calls apart."""
    places = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TOGETHER))
    placed = rows.withColumn("place", F.pmod("h", F.lit(places)))
    rank = F.dense_rank().over(W.partitionBy("place").orderBy(*keys))
    return placed.withColumn("name", F.shiftleft(F.col("place") * 2 + side, 31) + rank).drop("place")


def named(rows: DataFrame, keys: list[str], total: int, most: int = MOST) -> DataFrame:
    """`rows` (doc, at, left, h and `keys`, none null; h a hash of the keys; written somewhere, as they are read more than once) as (doc, at, left, name)."""
    out = ["doc", "at", "left", "name"]
    bound = max(most, total // HOT_KEYS)
    hot = materialise(rows.groupBy("h").count().where(F.col("count") > bound).select("h", F.ceil(F.col("count") / bound).cast("int").alias("parts")))
    if hot.isEmpty():
        return _ranked(rows, keys, total, 0).select(out)
    rows = rows.join(F.broadcast(hot), "h", "left")
    few = _ranked(rows.where("parts is null").drop("parts"), keys, total, 0).select(out)
    many = rows.where("parts is not null")
    names = _ranked(many.groupBy("h", *keys).agg(F.max("parts").alias("parts")), keys, 0, 1)
    names = names.select("h", *keys, "name", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = many.withColumn("part", F.pmod(F.xxhash64("doc", "at"), F.col("parts")).cast("int"))
    return few.union(dealt.join(names, ["h", "part", *keys]).select(out))


def identities(df: DataFrame, text: Column, others: dict[str, Column], block: int = BLOCK, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """((doc, rounds, name) of each row of `df`: rows have equal (rounds, name) if and only if their texts without blanks are equal; (doc, `others`)).
    `text` is already without blanks. doc is a number of the row, the same in both results. Nothing is left in the shared folder but the two results' checkpoints."""
    spark = df.sparkSession
    body = F.col("body").cast("binary")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block)).cast("int") - 1), lambda i: F.substring(body, i * block + 1, F.lit(block)))
    rows = df.select(F.monotonically_increasing_id().alias("doc"), text.alias("body"), F.struct(*(c.alias(n) for n, c in others.items())).alias("meta"))
    rows = rows.select("doc", "meta", F.posexplode(blocks).alias("at", "block"), F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block)).cast("int").alias("left"))
    folder = shared_folder(spark, "blocks")
    rows.select("doc", "at", "left", F.xxhash64("block").alias("h"), "block", F.when(F.col("at") == 0, F.col("meta")).alias("meta")).write.parquet(folder)
    stored = spark.read.parquet(folder)
    about = materialise(stored.where("at = 0").select("doc", "meta.*"))
    total = stored.count()
    level, rounds, done = materialise(named(stored.select("doc", "at", "left", "h", "block"), ["block"], total, most)), 0, None
    remove_folder(spark, folder)
    while True:
        ended = level.where("left = 1").select("doc", F.lit(rounds).alias("rounds"), "name")
        done = ended if done is None else done.union(ended)
        rest = level.where("left > 1")
        if rest.isEmpty():
            return done, about
        half = F.floor(F.col("at") / 2).cast("int")
        side = lambda k: F.max(F.when(F.col("at") % 2 == k, F.col("name")))
        pairs = rest.groupBy("doc", half.alias("at")).agg(F.ceil(F.max("left") / 2).cast("int").alias("left"), side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b"))
        total = -(-total // 2)
        level = materialise(named(materialise(pairs.withColumn("h", F.xxhash64("a", "b"))), ["a", "b"], total, most))
        rounds += 1


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, most: int = MOST) -> DataFrame:
    """One row for each row of `df`: its id, keep_id, group_size, kept and text_sha256 (of the text without blanks, lowercase hex).

    Texts are equal if they are the same without blanks; null is as empty. Of a group the row with the most code points stays, of those the one with the smallest id
    (null is larger than every id), of rows that repeat one. An empty table gives an empty result; other columns are not read.
    """
    ident = fresh_name(df, "id_of")
    text, raw = normalised(F.col(text_col)), F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias(ident), raw.alias("raw"), text.alias("bare"))
    found, about = identities(docs, F.col("bare"), {"id": F.col(ident), "n": F.length("raw"), "sha": F.sha2(F.col("bare").cast("binary"), 256)}, block, most)
    rows = materialise(found.join(about, "doc"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), "id", "doc"))
    groups = materialise(rows.groupBy("rounds", "name").agg(F.count("*").alias("group_size"), best.alias("best")).select("rounds", "name", "group_size", F.col("best.id").alias("keep_id"), F.col("best.doc").alias("keep_doc")))
    bound = max(most, rows.count() // HOT_KEYS)
    large, small = groups.where(F.col("group_size") > bound), groups.where(F.col("group_size") <= bound)
    out = [F.col("id").alias(id_col), "keep_id", "group_size", (F.col("doc") == F.col("keep_doc")).alias("kept"), F.col("sha").alias("text_sha256")]
    if large.isEmpty():
        return rows.join(small, ["rounds", "name"]).select(out)
    kinds = large.select("rounds", "name")
    of_large = rows.join(F.broadcast(large), ["rounds", "name"]).select(out)
    return of_large.union(rows.join(F.broadcast(kinds), ["rounds", "name"], "left_anti").join(small, ["rounds", "name"]).select(out))
