"""Dataset engineering: prioritised joins, mutation gates, placeholders, splitting and rebuilding of threads, seeded orders, logs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.functions.text import lines_of, trim_all
from threadlens.plans.dialect import Spark, Steps


def joined_by_priority(left: DataFrame, right: DataFrame, key: str, order: list[str], name: str = "found") -> DataFrame:
    """Adds to each row of `left` the first row of `right` with its key, by `order`, as a struct; null without one. Firsts are found before the join."""
    best = right.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*(c for c in right.columns if c != key)), F.struct(*order)).alias(name))
    return left.join(best, F.col(key) == F.col("__key"), "left").drop("__key")


def seeded_order(df: DataFrame, seed: int, id_col: str, keys: list[str]) -> DataFrame:
    """Adds `place`, a permutation of each group's rows that the seed decides."""
    drawn = F.md5(F.encode(F.concat_ws("-", F.lit(str(seed)), F.col(id_col).cast("string")), "UTF-8"))
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(drawn, id_col)))


def log_ring(df: DataFrame, key: str, order: list[str], value: str, most: int = 240) -> DataFrame:
    """The last `most` entries of each key's log without those that equal the one before."""
    at = W.partitionBy(key).orderBy(*order)
    kept = df.withColumn("__before", F.lag(value).over(at)).where(~F.col(value).eqNullSafe(F.col("__before"))).drop("__before")
    return kept.withColumn("back", F.row_number().over(W.partitionBy(key).orderBy(*(F.desc(c) for c in order)))).where(F.col("back") <= most)


def mutation_gates(d: Spark, least: float = 0.15, most: float = 0.6, sim: float = 0.7) -> Steps:
    """drop_reason of a candidate, the first gate that it fails: anchors, lexical distance, similarity, the engine's risk, stage and score; empty if it is kept."""
    return [("drop_reason", f"""CASE WHEN trim(text) = '' THEN 'empty_after_restore' WHEN n_removed > 0 THEN 'anchor_removed' WHEN n_added > 0 THEN 'anchor_added' WHEN distance < {least} THEN 'lex_too_similar'
 WHEN distance > {most} THEN 'lex_too_far' WHEN similarity < {sim} THEN 'emb_sim_low' WHEN got_risk <> exp_risk THEN 'engine_gate_risk' WHEN got_stage <> exp_stage THEN 'engine_gate_stage' WHEN got_score < exp_score_min THEN 'engine_gate_score' ELSE '' END""")]  # fmt: skip


def first_kept(candidates: DataFrame, parent: str, attempt: str, target: int | None = None) -> DataFrame:
    """Of each parent's candidates with an empty drop_reason the first attempt; of all parents the first `target` by their order, if it is given."""
    kept = candidates.where("drop_reason = ''").withColumn("__at", F.row_number().over(W.partitionBy(parent).orderBy(attempt))).where("__at = 1").drop("__at")
    return kept if target is None else kept.orderBy(parent).limit(target)


#: Fixed patterns of what is kept as it is, in the order in which it is looked for.
FROZEN = (("url", r"https?://[^\s<>\"'()]+?(?=[)\].,!?:;]*(?:\s|$))"), ("phone", r"\b01[016789][- ]?\d{3,4}[- ]?\d{4}\b"), ("code", r"\b[A-Z0-9]{6,}\b"), ("num", r"\b\d{4,}\b"))


def freeze(text: Column, kinds: tuple[tuple[str, str], ...] = FROZEN) -> Column:
    """A struct of the text with numbered placeholders for what is kept, and `spans` of placeholder, raw and its SHA-256."""
    state = F.struct(text.alias("text"), F.array().cast("array<struct<mark:string,raw:string,digest:string>>").alias("spans"))
    for kind, pattern in kinds:
        found = F.array_distinct(F.filter(F.regexp_extract_all(state["text"], F.lit(pattern), F.lit(0)), lambda x: ~F.rlike(x, F.lit(r"^(URL|PHONE|CODE|NUM)_?\d*$"))))
        marks = F.transform(found, _numbered(kind))
        state = F.struct(F.aggregate(marks, state["text"], lambda t, m: F.replace(t, m["raw"], m["mark"])).alias("text"), F.concat(state["spans"], marks).alias("spans"))
    return state


def _numbered(kind: str):
    return lambda x, i: F.struct(F.concat(F.lit(f"<{kind.upper()}_"), (i + 1).cast("string"), F.lit(">")).alias("mark"), x.alias("raw"), F.sha2(F.encode(x, "UTF-8"), 256).alias("digest"))


def restored(text: Column, spans: Column) -> Column:
    """A struct of the text with its spans back in place, and the placeholders that it lacks."""
    missing = F.transform(F.filter(spans, lambda s: ~text.contains(s["mark"])), lambda s: s["mark"])
    return F.struct(F.aggregate(F.reverse(spans), text, lambda t, s: F.replace(t, s["mark"], s["raw"])).alias("text"), missing.alias("missing"))


def masked_tokens(text: Column, seed: Column, share: float = 0.3, mark: str = "<mask>") -> Column:
    """The text with some of its words masked, as the seed and each word's place say; placeholders, numbers and words of one character stay."""
    masked = lambda w, i: F.when((F.pmod(F.xxhash64(seed, i, w), F.lit(1000)) < int(share * 1000)) & ~F.rlike(w, F.lit(r"^<.*>$|\d|^.$|^[SR]:$")), F.lit(mark)).otherwise(w)
    return F.array_join(F.transform(F.split(text, " "), masked), " ")


def speaker_parts(text: Column) -> Column:
    """A struct of the sender's and the receiver's lines of a thread, each with its place."""
    lines = F.transform(lines_of(text), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    of = lambda who: F.transform(F.filter(lines, lambda x: F.ltrim(x["line"]).startswith(f"{who}:")), lambda x: F.struct(x["at"].alias("at"), F.regexp_replace(x["line"], rf"^\s*{who}:\s?", "").alias("text")))
    return F.struct(of("S").alias("sender"), of("R").alias("receiver"))


def rebuilt_thread(text: Column, changed: Column) -> Column:
    """The thread with its sender's lines in turn replaced by the lines `changed`; what is left over joins the last, and a line without a new one stays."""
    new = F.transform(F.split(changed, "\n"), lambda x: trim_all(x))
    held = F.struct(F.transform(speaker_parts(text)["sender"], lambda x: x["at"]).alias("at"), new.alias("new"), trim_all(F.regexp_replace(F.array_join(new, " "), r"\s+", " ")).alias("one"))

    def line(h: Column, x: Column, i: Column) -> Column:
        k, n = F.array_position(h["at"], i), F.size(h["at"])
        last = trim_all(F.regexp_replace(F.array_join(F.slice(h["new"], n, F.greatest(F.size(h["new"]), F.lit(1))), " "), r"\s+", " "))
        own = F.when(F.size(h["new"]) < n, F.when(k == 1, h["one"]).otherwise("")).when(k == n, last).otherwise(F.coalesce(F.get(h["new"], (k - 1).cast("int")), F.lit("")))
        return F.when(k == 0, x).when(own == "", x).otherwise(F.concat(F.lit("S: "), own))

    # an array of one, so that its parts are worked out once a thread, not once a line
    return F.transform(F.array(held), lambda h: F.array_join(F.transform(lines_of(text), lambda x, i: line(h, x, i)), "\n"))[0]


#: Endings of sentences and what they may become; drawn for each parent, variant and seed.
ENDINGS = (("세요", ("십시오", "시기 바랍니다", "시면 됩니다")), ("니다", ("니다만", "니다.")), ("해요", ("합니다", "하죠")))


def ending_variants(df: DataFrame, id_col: str, text_col: str, k: int, seed: int = 1234) -> DataFrame:
    """For each row `k` variants (id, variant, text) with other endings, alike in each run: what is drawn depends on seed, id and variant."""
    v = df.select(F.col(id_col), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("variant"), F.col(text_col).alias("text"))
    text = F.col("text")
    for ending, others in ENDINGS:
        pick = F.get(F.array(*(F.lit(o) for o in others)), F.pmod(F.xxhash64(F.lit(seed), id_col, "variant", F.lit(ending)), F.lit(len(others))).cast("int"))
        text = F.regexp_replace(text, F.lit(f"(?m){ending}\\.?$"), pick)
    return v.withColumn("text", text)


def markdown(df: DataFrame, title: Column, order: str, line: Column, keys: list[str]) -> DataFrame:
    """For each key a report: a heading and its lines in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"])
    return df.groupBy(*keys).agg(F.concat(F.lit("## "), F.first(title), F.lit("\n"), F.array_join(lines, "\n")).alias("report"))


def shared_keys(pairs: DataFrame, ids: list[str], feature: str, a: str, b: str, k: int = 3) -> DataFrame:
    """Of each pair's features in both the `k` with the largest summed weights."""
    both = pairs.where((F.col(a) > 0) & (F.col(b) > 0)).withColumn("w", F.col(a) + F.col(b))
    return both.withColumn("rank", F.row_number().over(W.partitionBy(*ids).orderBy(F.desc("w"), feature))).where(F.col("rank") <= k)
