"""Corpus work: turn splitting, consecutive duplicates, context windows, phone scrubbing, placeholders, hash buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.functions.text import lines_of, trim_all

HEADER = r"^\s*(\[?(오전|오후)\s*\d{1,2}:\d{2}\]?|\d{4}[.\-]\d{1,2}[.\-]\d{1,2}|\d{1,2}:\d{2}\s)"
SPEAKER = r"(?i)^\s*(S|R|sender|receiver|발신|수신)\s*[:：]"
#: Entity patterns and telephone placeholders.
ENTITIES = {
    "url": r"https?://[^\s)]+",
    "domain": r"[a-zA-Z][a-zA-Z0-9-]{0,61}(?:\.[a-zA-Z0-9-]{1,63})+",
    "phone": r"0\d{1,2}-\d{3,4}-\d{4}",
    "money": r"\d{1,3}(?:,\d{3})+\s*원|\d+\s*(?:만원|원)",
}
PHONES = ((r"\+82[ -]?10[ -]?\d{4}[ -]?\d{4}", "<mobile>"), (r"01[016789][ -]?\d{3,4}[ -]?\d{4}", "<mobile>"), (r"070[ -]?\d{4}[ -]?\d{4}", "<voip>"), (r"(?:02|0[3-6]\d)[ -]?\d{3,4}[ -]?\d{4}", "<landline>"), (r"1[568]\d{2}[ -]?\d{4}", "<service>"))


def split_blocks(df: DataFrame, id_col: str, text_col: str, most: int = 200) -> DataFrame:
    """Blocks of a thread: a line with a speaker's mark or a header opens one, a blank line closes one. (id, block, speaker, n_lines, text)."""
    rows = df.select(F.col(id_col).alias("id"), F.posexplode(lines_of(F.col(text_col))).alias("at", "line"))
    blank = trim_all(F.col("line")) == ""
    mark = F.lower(F.regexp_extract("line", SPEAKER, 1))
    opens = ~blank & ((mark != "") | F.rlike("line", F.lit(HEADER)))
    own = W.partitionBy("id").orderBy("at")
    after_blank = F.lag(blank, 1, True).over(own)
    rows = rows.withColumns({"blank": blank, "mark": mark, "new": (opens | (~blank & after_blank)).cast("int")})
    rows = rows.withColumn("block", F.sum("new").over(own.rowsBetween(W.unboundedPreceding, 0))).where(~F.col("blank") & (F.col("block") <= most))
    speaker = F.when(F.col("mark").isin("s", "sender", "발신"), "S").when(F.col("mark").isin("r", "receiver", "수신"), "R").otherwise("U")
    out = rows.groupBy("id", "block").agg(F.min_by(speaker, "at").alias("speaker"), F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return out.withColumnRenamed("id", id_col)


def drop_consecutive_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_lines, n_kept): lines that differ from the one before, blank ones left out."""
    lines = F.filter(F.transform(lines_of(F.col(text_col)), trim_all), lambda x: x != "")
    t = df.select(F.col(id_col), lines.alias("l"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("l", 1, F.greatest(F.size("l") - 1, F.lit(0))))
    kept = F.zip_with("l", before, lambda a, b: F.when(a.eqNullSafe(b), 0).otherwise(1))
    return t.select(id_col, F.size("l").alias("n_lines"), F.aggregate(F.slice(kept, 1, F.size("l")), F.lit(0), lambda a, x: a + x).alias("n_kept"))


def context_window(turns: DataFrame, strong: Column, max_messages: int = 20, max_sticky: int = 160, backtrack: int = 4, max_days: int = 3) -> DataFrame:
    """The turns of each thread that are looked at. With a strong demand: from `backtrack` turns before the first one on, `max_sticky` at most;
    else the last `max_messages`, without those more than `max_days` before the last. `turns(thread_id, ix, ts)`; adds n (place from 1) and reason."""
    own = W.partitionBy("thread_id")
    t = turns.withColumn("n", F.row_number().over(own.orderBy("ix"))).withColumn("size", F.count("*").over(own)).withColumn("strong", strong)
    t = t.withColumn("first", F.min(F.when(F.col("strong"), F.col("n"))).over(own)).withColumn("last", F.max("ts").over(own))
    recent = (F.col("n") > F.col("size") - max_messages) & (F.col("ts") >= F.col("last") - F.expr(f"INTERVAL {max_days} DAYS"))
    begin = F.greatest(F.col("first") - backtrack, F.lit(1))
    sticky = (F.col("n") >= begin) & (F.col("n") < begin + max_sticky)
    kept = t.where(F.when(F.col("first").isNull(), recent).otherwise(sticky))
    return kept.withColumn("reason", F.when(F.col("first").isNull(), "rolling").otherwise("strong")).drop("size", "strong", "first", "last")


def answered_within(turns: DataFrame, asks: Column, answers: Column, steps: int = 2) -> DataFrame:
    """The turns that ask and are answered in one of the next `steps` turns of their thread: adds `answer_step`, the first such step."""
    own = W.partitionBy("thread_id").orderBy("ix")
    t = turns.withColumn("a", answers)
    step = F.lit(None).cast("int")
    for k in range(steps, 0, -1):
        step = F.when(F.lead("a", k).over(own), k).otherwise(step)
    return t.withColumn("answer_step", step).withColumn("asks", asks).where(F.col("asks") & F.col("answer_step").isNotNull()).drop("a", "asks")


def seen_before(df: DataFrame, key: str, order: list[str], flag: Column, name: str = "seen") -> DataFrame:
    return df.withColumn(name, F.max(flag).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def entity_counts(text: Column) -> dict[str, Column]:
    return {f"n_{k}": F.regexp_count(text, F.lit(p)) for k, p in ENTITIES.items()}


def scrub_phones(text: Column) -> Column:
    for pattern, mark in PHONES:
        text = F.regexp_replace(text, rf"(?<!\d){pattern}(?!\d)", mark)
    return text


def hash_bucket(value: Column, n: int) -> Column:
    """The first 32 bits of SHA-1 modulo n."""
    return F.pmod(F.conv(F.substring(F.sha1(value.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(n))


def parent_id(mutant: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(mutant, r"^MUT-(.+)-\d{4}$", 1), F.lit("")), mutant)


def frozen(text: Column, pattern: str, kind: str) -> Column:
    """The text with the distinct matches of a pattern replaced by numbered placeholders, first seen first. All in one pass, so a match that holds another, or a placeholder's own number, is never taken apart."""
    all_ = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.array_distinct(all_)
    marks = F.map_from_arrays(found, F.transform(found, lambda x, i: F.concat(F.lit(f"<{kind.upper()}_"), (i + 1).cast("string"), F.lit(">"))))
    pieces = F.zip_with(F.split(text, pattern, -1), all_, lambda between, x: F.concat(between, F.coalesce(F.element_at(marks, x), F.lit(""))))
    return F.array_join(pieces, "")


def missing_terms(text: Column, terms: tuple[str, ...]) -> Column:
    """The terms that the text does not contain, in their order."""
    return F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: ~F.contains(F.lower(text), t))
