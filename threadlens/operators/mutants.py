"""Mutants of threads as a loop: drawn, gated by wording and by the analysis itself, kept, and what is still open drawn again."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.functions.blocks import phone_turns
from threadlens.functions.text import trigrams
from threadlens.operators import engineering as en
from threadlens.operators.analyze import analyze, marked, marked_features
from threadlens.plans.dialect import SPARK
from threadlens.session import spread, written

#: The least score that a thread of a risk level is to have.
SCORE_MIN = {"high": 45, "medium": 25}


@dataclass(frozen=True)
class Preset:
    """How mutants are drawn and what they must meet. `target` is the number of mutants after which no further attempt is made, None for all."""

    n: int = 6
    rounds: int = 3
    topk: int = 30
    sim: float = 0.78
    least: float = 0.08
    most: float = 0.85
    tries: int = 3
    target: int | None = 200
    anchors: tuple[str, ...] = ("계좌", "송금", "이체", "입금", "인증번호", "비밀번호", "링크", "설치", "원격", "현금", "상품권", "대출", "수수료")


#: The presets by name; the strict one also keeps the words by which threads drift to other stages.
PRESETS = {"fast200_v2": Preset()}
PRESETS["fast200_v2_strict"] = Preset(anchors=(*Preset.anchors, "긴급", "급히", "즉시", "바로", "당장", "카톡", "카카오", "문자", "전화", "연락", "경찰", "검찰", "금감원", "수사", "고객센터", "센터", "담당자"))


def _words(text: Column) -> Column:
    return F.split(F.replace(text, F.lit("\n"), F.lit(" \n ")), " ", -1)


def followers(texts: DataFrame, text_col: str, topk: int) -> DataFrame:
    """(before, fills): the `topk` words that most often stand behind each word of all texts, most frequent first, ties by the word; at a line's begin the word before is empty. Pairs are counted before they are ranked, and ranks are cut before the shuffle."""
    w = texts.select(_words(F.col(text_col)).alias("w"))
    pairs = w.select(F.explode(F.transform("w", lambda x, i: F.struct(F.when(i == 0, "").otherwise(F.get("w", i - 1)).alias("before"), x.alias("word")))).alias("p")).select("p.*")
    pairs = pairs.withColumn("before", F.when(F.col("before") == "\n", "").otherwise(F.col("before"))).where(F.rlike("word", F.lit(r"^[^\s<>\d]{2,}$")))
    counted = pairs.groupBy("before", "word").agg(F.count("*").alias("n"))
    top = counted.withColumn("at", F.row_number().over(W.partitionBy("before").orderBy(F.desc("n"), "word"))).where(F.col("at") <= topk)
    return top.groupBy("before").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("fills"))


def drawn(open_: DataFrame, fills: DataFrame, preset: Preset, attempt: int, seed: int) -> DataFrame:
    """`open_(thread_id, variant, frozen)` with `mutated`: in as many words as there are rounds, picked by hash, one that often follows the word before. Words with anchors, placeholders, numbers and single characters stay."""
    at = F.transform("w", lambda x, i: F.struct(F.xxhash64(F.lit(seed), "thread_id", "variant", F.lit(attempt), i).alias("h"), i.alias("at"), x.alias("word"), F.when(i == 0, "").otherwise(F.get("w", i - 1)).alias("before")))
    may = lambda x: F.rlike(x["word"], F.lit(r"^[^\s<>\d]{2,}$")) & ~F.rlike(x["word"], F.lit("|".join(preset.anchors) or r"(?!)"))
    t = open_.withColumn("w", _words(F.col("frozen"))).withColumn("picked", F.slice(F.array_sort(F.filter(at, may)), 1, preset.rounds))
    each = t.select("thread_id", "variant", F.explode("picked").alias("p")).select("thread_id", "variant", "p.*").withColumn("before", F.when(F.col("before") == "\n", "").otherwise(F.col("before")))
    others = F.filter("fills", lambda x: x != F.col("word"))
    each = each.join(fills, "before", "left").withColumn("o", others).withColumn("fill", F.when(F.size("o") > 0, F.get("o", F.pmod("h", F.greatest(F.size("o"), F.lit(1))).cast("int"))))
    new = each.where("fill IS NOT NULL").groupBy("thread_id", "variant").agg(F.map_from_entries(F.collect_list(F.struct("at", "fill"))).alias("new"))
    changed = F.transform("w", lambda x, i: F.coalesce(F.try_element_at("new", i), x))
    return t.join(new, ["thread_id", "variant"], "left").withColumn("mutated", F.replace(F.array_join(changed, " "), F.lit(" \n "), F.lit("\n"))).drop("w", "picked", "new")


def _turns(threads: DataFrame) -> DataFrame:
    """turns(thread_id, ix, role, text) of `threads(thread_id, thread)`."""
    return threads.select("thread_id", F.posexplode(phone_turns(F.col("thread"))).alias("ix", "t")).select("thread_id", F.col("ix").cast("long").alias("ix"), F.col("t.who").alias("role"), F.col("t.text").alias("text"))


def gated(candidates: DataFrame, preset: Preset, known: DataFrame | None = None) -> DataFrame:
    """Candidates with distance (of trigrams), similarity (cosine of the sets of words), the analysis of their thread, and drop_reason, the first gate that they fail, empty for none. Only what passes the gates of wording is analysed; `known` is as in `analyze`."""
    back = en.restored(F.col("mutated"), F.col("spans"))
    c = candidates.withColumn("back", back).withColumn("text", F.col("back.text"))
    terms = lambda text: F.array_compact(F.array(*(F.when(F.contains(text, F.lit(a)), a) for a in preset.anchors)))
    c = c.withColumns({"a0": terms(F.col("sender")), "a1": terms(F.col("text")), "g0": trigrams(F.col("sender")), "g1": trigrams(F.col("text")), "w0": F.array_distinct(_words(F.col("sender"))), "w1": F.array_distinct(_words(F.col("text")))})
    common = F.size(F.array_intersect("g0", "g1"))
    c = c.withColumns({
        "n_removed": F.size(F.array_except("a0", "a1")) + F.size("back.missing"), "n_added": F.size(F.array_except("a1", "a0")),
        "distance": 1 - common / F.greatest(F.size("g0") + F.size("g1") - common, F.lit(1)), "similarity": F.size(F.array_intersect("w0", "w1")) / F.sqrt(F.greatest(F.size("w0") * F.size("w1"), F.lit(1)).cast("double")),
        "thread": en.rebuilt_thread(F.col("parent"), F.col("text")), "key": F.concat_ws("#", "thread_id", "variant"),
    }).drop("a0", "a1", "g0", "g1", "w0", "w1", "back")
    (name, step), = en.mutation_gates(SPARK, preset.least, preset.most, preset.sim)
    none = c.withColumns({"got_risk": F.col("exp_risk"), "got_stage": F.col("exp_stage"), "got_score": F.col("exp_score_min")}).withColumn(name, F.expr(step))
    c = written(none.drop("got_risk", "got_stage", "got_score"))
    got = analyze(_turns(c.where(f"{name} = ''").select(F.col("key").alias("thread_id"), "thread")), known=known).select(F.col("thread_id").alias("key"), F.col("risk_level").alias("got_risk"), F.col("stage_peak").alias("got_stage"), F.col("score_total").alias("got_score"))
    return c.withColumnRenamed(name, "worded").join(got, "key", "left").withColumn(name, F.when(F.col("worded") != "", F.col("worded")).otherwise(F.expr(step))).drop("worded", "key")


def mutants(threads: DataFrame, preset: Preset = PRESETS["fast200_v2"], seed: int = 1234) -> DataFrame:
    """`preset.n` mutants of each of `threads(thread_id, text)`, texts with S: and R: lines: (thread_id, variant, attempt, text, distance, similarity, got_risk, got_stage, got_score, drop_reason).

    A mutant is kept if it meets all gates; its analysis must have the risk and stage of its parent's and the least score of that risk. Variants that fail are drawn again, `preset.tries` times at most or until `preset.target` mutants are kept; those that never pass
    come with a null attempt and text and the reason of their last one. With a target the first ones by attempt, thread and variant are returned. Draws are hashes of seed, thread, variant and attempt, alike for any partitioning. Each attempt is written before the
    next, which holds what failed only. Rows are few and take long, so they are dealt over all cores; of a mutant's turns only those without a known text are tried anew. Threads without a sender's line are left out; ids must be unique.
    """
    parts = en.speaker_parts(F.col("parent"))["sender"]
    t = spread(threads, "thread_id").select("thread_id", F.coalesce("text", F.lit("")).alias("parent")).withColumn("sender", F.array_join(F.transform(parts, lambda x: x["text"]), "\n")).where("trim(sender) <> ''")
    t = written(t.withColumn("f", en.freeze(F.col("sender"))).select("thread_id", "parent", "sender", F.col("f.text").alias("frozen"), "f.spans"))
    fills = written(followers(t, "frozen", preset.topk))
    least = reduce(lambda c, x: c.when(F.col("risk_level") == x[0], float(x[1])), SCORE_MIN.items(), F).otherwise(0.0)
    turns = _turns(t.select("thread_id", F.col("parent").alias("thread")))
    known = marked_features(marked(turns))
    expected = analyze(turns, known=known).select("thread_id", F.col("risk_level").alias("exp_risk"), F.col("stage_peak").alias("exp_stage"), F.least(least, F.col("score_total")).alias("exp_score_min"))
    parents = written(t.join(expected, "thread_id"))
    open_ = parents.select("thread_id", F.explode(F.sequence(F.lit(1), F.lit(preset.n))).alias("variant"), F.lit("").alias("drop_reason"))
    kept, n = [], 0
    columns = ["thread_id", "variant", "attempt", "text", "distance", "similarity", "got_risk", "got_stage", "got_score", "drop_reason"]
    for attempt in range(1, preset.tries + 1):
        asked = spread(open_.select("thread_id", "variant").join(parents, "thread_id"), "thread_id", "variant")
        tried = written(gated(drawn(asked, fills, preset, attempt, seed), preset, known).select("thread_id", "variant", F.lit(attempt).alias("attempt"), F.col("thread").alias("text"), *columns[4:]))
        kept.append(tried.where("drop_reason = ''"))
        open_ = tried.where("drop_reason <> ''")
        n += kept[-1].count()
        if open_.isEmpty() or (preset.target is not None and n >= preset.target):
            break
    found = reduce(DataFrame.union, kept)
    if preset.target is not None:
        return found.orderBy("attempt", "thread_id", "variant").limit(preset.target)
    none = lambda c: F.lit(None).cast(found.schema[c].dataType).alias(c)
    return found.union(open_.select("thread_id", "variant", *(none(c) for c in columns[2:-1]), "drop_reason"))
