"""A data set of expected rows held against the engine: what analysis and prefilter say of each case, verdicts, rows that fail, labels anew, and the report of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.functions.blocks import phone_turns
from threadlens.functions.text import trigrams
from threadlens.operators import analyze as an
from threadlens.operators.evaluate import floor_percentiles, highest_stage
from threadlens.operators.prefilter import prefilter
from threadlens.operators.vectors import greedy_clusters
from threadlens.plans import catalog as cat
from threadlens.plans import decisions as de
from threadlens.plans.dialect import SPARK, Steps
from threadlens.session import written
from threadlens.sources.jsonl import thread_text

#: The rows of a data set of expected results, as JSON lines.
SCHEMA = """id string, label string, thread string, threadText string,
 expected struct<riskLevel:string,score_min:double,stagePeak:string,stage_peak:string,triggered:boolean,uiRiskLevel:string,threatRiskLevel:string>,
 should_trigger array<string>, callChecks struct<otpAsked:boolean,remoteAsked:boolean,urgentPressured:boolean,firstContact:boolean>"""
CALLS = ("otp_asked", "remote_asked", "urgent_pressured", "first_contact")


def cases_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of SCHEMA as `cases` and `turns`. The stage may come under either of its names; values are compared in lower case; a row without an id is left out."""
    word = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    known = rows.where(F.col("id").isNotNull()).withColumn("__thread", thread_text(rows))
    e, c = (lambda n: F.col(f"expected.{n}")), (lambda n: F.coalesce(F.col(f"callChecks.{n}"), F.lit(False)))
    cases = known.select(
        F.col("id").alias("case_id"), word(e("riskLevel")).alias("exp_risk"), e("score_min").alias("exp_score_min"), word(F.coalesce(e("stagePeak"), e("stage_peak"))).alias("exp_stage"), e("triggered").alias("exp_triggered"),
        F.coalesce(F.size("should_trigger"), F.lit(0)).alias("n_should"), word(e("uiRiskLevel")).alias("exp_ui"), word(e("threatRiskLevel")).alias("exp_threat"),
        c("otpAsked").alias("otp_asked"), c("remoteAsked").alias("remote_asked"), c("urgentPressured").alias("urgent_pressured"), c("firstContact").alias("first_contact"),
    )
    turns = known.select(F.col("id").alias("thread_id"), F.posexplode(phone_turns(F.col("__thread"))).alias("ix", "t"))
    return cases, turns.select("thread_id", F.col("ix").cast("long").alias("ix"), F.col("t.who").alias("role"), F.col("t.text").alias("text"))


def _with_calls(cases: DataFrame) -> DataFrame:
    return cases.withColumns({c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in cases.columns else F.lit(False) for c in CALLS})


def engine_results(cases: DataFrame, turns: DataFrame) -> DataFrame:
    """What the engine says of each case: score_total, risk_level, hard_high, stage_peak, n_hits, ids, top_weight, the prefilter's pf_score, pf_action and gate_pass, what the interface shows of it (ui_score, ui_level, gate_tag), got_triggered.

    `turns(thread_id, ix, role, text)` belong to `cases(case_id[, otp_asked, remote_asked, urgent_pressured, first_contact])` by id; turns of other threads are not looked at, and a case without turns is one of an empty text. The stage is the highest of the turns' and of the twelve heaviest signals'.
    All is joined by thread, so the exchanges are those of `analyze` and one for the texts of threads.
    """
    asked = _with_calls(cases).select(F.col("case_id").alias("thread_id"), *CALLS)
    own = turns.select("thread_id", F.col("ix").cast("long").alias("ix"), "role", "text").join(asked.select("thread_id"), "thread_id", "right")
    own = own.select("thread_id", F.coalesce("ix", F.lit(0)).alias("ix"), F.coalesce("role", F.lit("U")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = written(an.turn_table(own))
    hits = an.weighed_hits(t, asked)
    rolled = hits.groupBy("thread_id", "rule_id").agg((F.floor(F.sum("diminished") * 100 + 0.5) / 100).alias("weight_sum"), F.count("*").alias("count"), F.max_by("stage", F.struct("diminished", -F.col("ix"), -F.col("ord"))).alias("stage"))
    at = F.row_number().over(W.partitionBy("thread_id").orderBy(F.desc("weight_sum"), F.desc("count"), "rule_id"))
    found = rolled.withColumn("rank", at).groupBy("thread_id").agg(F.sort_array(F.collect_set("rule_id")).alias("ids"), F.max("weight_sum").alias("top_weight"), F.collect_set(F.when(F.col("rank") <= 12, F.col("stage"))).alias("hit_stages"))
    line = F.struct("ix", F.concat_ws(": ", F.when(F.col("role") != "U", F.col("role")), "text").alias("line"))
    joined = lambda rows, mark: F.array_join(F.transform(F.array_sort(rows), lambda x: x["line"]), mark)
    whole = t.groupBy("thread_id").agg(
        F.collect_set("stage").alias("turn_stages"), F.bool_or((F.col("role") == "S") & (F.size("urls") > 0)).alias("sender_url"), joined(F.collect_list(line), "\n").alias("text"),
        joined(F.collect_list(F.when(F.col("role") == "R", F.struct("ix", F.col("text").alias("line")))), " ").alias("r_text"), joined(F.collect_list(F.when(F.col("role") != "R", F.struct("ix", F.col("text").alias("line")))), "\n").alias("sender_text"),
    )
    whole = written(whole)
    # texts of short threads repeat: each is tried once
    marked = whole.select("thread_id", F.md5("text").alias("mark"), "text")
    pf = prefilter(marked.select(F.col("mark").alias("thread_id"), "text").distinct())
    pf = marked.select("thread_id", "mark").join(pf.select(F.col("thread_id").alias("mark"), F.col("score").alias("pf_score"), F.col("action").alias("pf_action"), "gate_pass"), "mark").drop("mark")
    all_ = an.judged(t, asked).drop("stage_peak").join(whole.drop("text"), "thread_id").join(pf, "thread_id").join(found, "thread_id", "left").join(asked, "thread_id")
    none = F.array().cast("array<string>")
    all_ = all_.withColumns({
        "ids": F.coalesce("ids", none), "top_weight": F.coalesce("top_weight", F.lit(0.0)), "stage_peak": highest_stage(F.concat("turn_stages", F.coalesce("hit_stages", none))), "soft": F.lit(cat.PREFILTER_SOFT), "auto": F.lit(cat.PREFILTER_AUTO),
        "flag": F.lit(None).cast("boolean"), "n_should": F.lit(0), "n_triggers": F.lit(0), "n_rules": F.lit(0), "has_prefilter": F.lit(True),
    })
    steps: Steps = [*de.evaluated_triggered(), *de.receiver_gate(SPARK), ("pf_triggered", de.prefilter_triggered()), *de.interface_score(SPARK)]
    out = ["thread_id AS case_id", "score_total", "risk_level", "hard_high", "stage_peak", "n_hits", "ids", "top_weight", "pf_score", "pf_action", "gate_pass", "gate_tag", "ui_score", "ui_level", "triggered", "got_triggered", "sender_text"]
    return all_.selectExpr("*", *(f"{e} AS {n}" for n, e in steps)).selectExpr(*out)


def verdicts(cases: DataFrame, results: DataFrame, risk: str = "threat") -> DataFrame:
    """`results` beside what `cases(case_id, exp_risk, exp_score_min, exp_stage, exp_triggered, n_should)` expect, with want_triggered, why (the checks that do not hold) and passed.

    `risk` names the level that is held against exp_risk: the engine's ("threat") or the one that is shown ("ui"). What a case does not expect (null) is not checked, but a null or unknown risk is never met. Other columns of `cases` stay, calls aside.
    """
    if risk not in ("threat", "ui"):
        raise ValueError(f"risk is to be threat or ui, not {risk}")
    got = results.withColumn("engine_risk", F.col("risk_level")).withColumn("risk_level", F.col("ui_level" if risk == "ui" else "risk_level"))
    both = cases.drop(*CALLS, *(c for c in results.columns if c != "case_id")).join(got, "case_id").withColumn("exp_risk", F.coalesce("exp_risk", F.lit("")))
    both = both.selectExpr("*", *(f"{e} AS {n}" for n, e in de.expected_against_got(SPARK)))
    return both.withColumn("passed", F.size("why") == 0)


def evaluate(cases: DataFrame, turns: DataFrame, risk: str = "threat") -> DataFrame:
    """The engine run over a data set: `verdicts` of `engine_results`. Ids of cases must be unique."""
    return verdicts(cases, engine_results(cases, turns), risk)


def exported_fails(cases: DataFrame, results: DataFrame) -> DataFrame:
    """(case_id, prefer_ui, why, got, exp) of the cases that fail by the row's own preference: where exp_ui is given the level and score that are shown count, else the engine's. Here a case counts as triggered by the interface's flag or a score of 35, an install is
    above a payment, and of what is expected only what is there is checked. `cases` may have exp_ui and exp_threat."""
    named = [c for c in ("exp_risk", "exp_score_min", "exp_stage", "exp_triggered", "exp_ui", "exp_threat") if c in cases.columns]
    c = cases.select("case_id", *named).withColumns({n: F.lit(None).cast("string") for n in ("exp_ui", "exp_threat") if n not in named})
    t = c.join(results, "case_id").withColumn("prefer_ui", F.col("exp_ui").isNotNull())
    pick = lambda ui, threat: F.when(F.col("prefer_ui"), ui).otherwise(threat)
    t = t.withColumns({"want_risk": pick(F.coalesce("exp_ui", "exp_risk"), F.coalesce("exp_threat", "exp_risk")), "got_risk": pick(F.col("ui_level"), F.col("risk_level")), "score": pick(F.col("ui_score").cast("double"), F.col("score_total").cast("double"))})
    t = t.withColumn("triggered", F.col("triggered") | (F.col("score") >= 35))
    number = lambda x: F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))
    why = F.array_compact(F.array(
        F.when(F.col("want_risk") != F.col("got_risk"), F.concat_ws(" ", F.lit("risk"), "want_risk", F.lit("->"), "got_risk")),
        F.when((F.col("exp_score_min") > 0) & (F.col("score") < F.col("exp_score_min")), F.concat_ws(" ", F.lit("score"), number(F.col("score")), F.lit("<"), number(F.col("exp_score_min").cast("double")))),
        F.when(F.col("exp_stage") != F.col("stage_peak"), F.concat_ws(" ", F.lit("stage"), "exp_stage", F.lit("->"), "stage_peak")),
        F.when(F.col("exp_triggered") != F.col("triggered"), F.concat_ws(" ", F.lit("triggered"), F.col("exp_triggered").cast("string"), F.lit("->"), F.col("triggered").cast("string"))),
    ))
    got = F.struct(F.col("score_total").alias("score"), F.col("ui_score").alias("ui_score"), F.col("got_risk").alias("risk"), F.col("stage_peak").alias("stage"), F.col("triggered").alias("triggered"), F.nullif(F.col("gate_tag"), F.lit("")).alias("gate_tag"))
    exp = F.struct(F.col("want_risk").alias("risk"), F.coalesce(F.col("exp_score_min"), F.lit(0)).cast("double").alias("score_min"), F.col("exp_stage").alias("stage"), F.col("exp_triggered").alias("triggered"))
    return t.withColumn("why", why).where(F.size("why") > 0).select("case_id", "prefer_ui", "why", got.alias("got"), exp.alias("exp"))


def relabelled_cases(cases: DataFrame, results: DataFrame, margin: int = 5) -> DataFrame:
    """`cases` whose expected risk, least score, stage and trigger are what the engine gives, and `changed`, whether one of them differs from before."""
    steps = de.relabelled(margin)
    new = results.selectExpr("*", *(f"{e} AS {n}" for n, e in steps)).select("case_id", F.col("policy_risk").alias("__risk"), F.col("new_score_min").cast("double").alias("__min"), F.col("stage_peak").alias("__stage"), F.col("got_triggered").alias("__trig"))
    pairs = (("exp_risk", "__risk"), ("exp_score_min", "__min"), ("exp_stage", "__stage"), ("exp_triggered", "__trig"))
    t = cases.join(new, "case_id")
    same = F.lit(True)
    for old, now in pairs:
        same = same & F.col(old).eqNullSafe(F.col(now))
    return t.withColumn("changed", ~same).withColumns({old: F.col(now) for old, now in pairs}).drop(*(now for _, now in pairs))


def dataset_summary(evaluated: DataFrame) -> DataFrame:
    """The long table key, subkey, n: cases, passed and failed, checks that hold (of all cases), levels expected and got, and of failed cases the reasons and the pairs of risk and stage. One pass: a case gives its keys, and these are counted."""
    entry = lambda k, s: F.struct(F.lit(k).alias("key"), F.coalesce(s, F.lit("none")).alias("subkey"))
    held = F.transform(F.array_except(F.array(*map(F.lit, ("risk_mismatch", "score_below_min", "stage_mismatch", "triggered_mismatch"))), "why"), lambda x: entry("holds", F.regexp_replace(x, "_(mismatch|below_min)$", "")))
    always = F.array(entry("meta", F.lit("cases")), entry("meta", F.when(F.col("passed"), "pass").otherwise("fail")), entry("expected", F.col("exp_risk")), entry("got", F.col("risk_level")))
    pairs = F.array(entry("risk_pair", F.concat_ws("->", "exp_risk", "risk_level")), entry("stage_pair", F.concat_ws("->", F.coalesce("exp_stage", F.lit("none")), "stage_peak")))
    failed = F.concat(F.transform("why", lambda x: entry("reason", x)), pairs)
    entries = F.concat(always, held, F.when(~F.col("passed"), failed).otherwise(F.slice(always, 1, 0)))
    return evaluated.select(F.explode(entries).alias("e")).groupBy("e.key", "e.subkey").agg(F.count("*").alias("n"))


def parent_of(case_id: Column) -> Column:
    """The parent's id in a mutant's."""
    by_code, by_form = F.regexp_extract(case_id, r"(KO-\d+[A-Za-z0-9_]*?)(?:-|$)", 1), F.regexp_extract(case_id, r"^MUT-(.+?)-\d+$", 1)
    return F.when(by_code != "", by_code).when(by_form != "", by_form).otherwise("unknown_parent")


def text_vectors(df: DataFrame, id_col: str, text_col: str, width: int = 256) -> DataFrame:
    """(id, v): how many distinct trigrams of each text fall to each of `width` places by their hash; zeros where there are none. In place of sentence embeddings, whose model is not at hand."""
    t = df.select(F.col(id_col), F.explode_outer(trigrams(F.coalesce(text_col, F.lit("")))).alias("g")).withColumn("place", F.pmod(F.xxhash64("g"), F.lit(width)).cast("int"))
    cells = t.groupBy(id_col, F.when(F.col("g").isNotNull(), F.col("place")).alias("place")).agg(F.count("*").alias("n"))
    counts = cells.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "n")))).alias("m"))
    return counts.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double")).alias("v"))


def _firsts(df: DataFrame, keys: list[str], order: list[Column], k: int, dealt_by: str = "seq") -> DataFrame:
    """The first k rows of each group with their place, `at`; by parts first, as one group may hold most rows."""
    near = df.withColumn("__salt", F.pmod(F.xxhash64(dealt_by), F.lit(64)))
    near = near.withColumn("at", F.row_number().over(W.partitionBy(*keys, "__salt").orderBy(*order))).where(F.col("at") <= k)
    return near.withColumn("at", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("at") <= k).drop("__salt")


def _most_frequent(counts: DataFrame, key: str, name: str, k: int, alias: str) -> DataFrame:
    top = _firsts(counts, [key], [F.desc("n"), F.col(name)], k, name)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat(F.col(name), F.lit("("), F.col("n").cast("string"), F.lit(")")).alias("x")))), lambda r: r["x"]).alias(alias))


def failure_clusters(fails: DataFrame, vectors: DataFrame, least: float = 0.86) -> DataFrame:
    """`fails(seq, ...)` with the leader of each one's greedy cluster among failures in the order of seq (a unique whole number), and sim with it. `vectors(seq, v)`."""
    return fails.join(greedy_clusters(fails.select("seq").join(vectors.select("seq", "v"), "seq"), "seq", "v", least), "seq", "left").withColumns({"leader": F.coalesce("leader", "seq"), "sim": F.coalesce("sim", F.lit(0.0))})


def failure_report(evaluated: DataFrame, vectors: DataFrame | None = None, least: float = 0.86, parents: int = 20) -> DataFrame:
    """(section, key, n, detail) of the failed rows of `verdicts`, which need `seq`, their order, and may have `parent`: reasons, pairs of risk and of stage, the distances to the least score (n, min, median, p90, max, mean), the `parents` parents with most failures with
    their first five and mean distance, and, with `vectors(seq, v)`, the clusters of failures: key is the leader's id, n the size, detail its mean similarity and most frequent reasons and parents. detail is JSON, null where there is none; without failures there are no rows.
    """
    named = F.col("parent") if "parent" in evaluated.columns else parent_of(F.col("case_id"))
    below = F.array_contains("why", "score_below_min")
    fails = written(evaluated.where("not passed").select("seq", "case_id", named.alias("parent"), "why", "exp_risk", "risk_level", "exp_stage", "stage_peak", F.when(below, F.col("exp_score_min") - F.col("score_total")).cast("double").alias("delta")))
    entry = lambda k, s: F.struct(F.lit(k).alias("section"), s.alias("key"))
    keys = F.concat(F.transform("why", lambda x: entry("reason", x)), F.array(entry("risk_pair", F.concat_ws("->", "exp_risk", "risk_level")), entry("stage_pair", F.concat_ws("->", F.coalesce("exp_stage", F.lit("none")), "stage_peak"))))
    counts = fails.select(F.explode(keys).alias("e")).groupBy("e.section", "e.key").agg(F.count("*").alias("n")).withColumn("detail", F.lit(None).cast("string"))

    far = fails.where(F.col("delta").isNotNull()).withColumn("all", F.lit(1))
    spread = floor_percentiles(far, ["all"], "delta", (50, 90)).join(far.groupBy("all").agg(F.round(F.avg("delta"), 3).alias("avg")), "all")
    spread = spread.select(F.lit("score_delta").alias("section"), F.lit("all").alias("key"), "n", F.to_json(F.struct("min", "p50", "p90", "max", "avg")).alias("detail"))

    sums = fails.groupBy("parent").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 2).alias("avg_delta"))
    top = sums.orderBy(F.desc("n"), "parent").limit(parents)
    first = _firsts(fails.join(F.broadcast(top.select("parent")), "parent", "left_semi"), ["parent"], [F.col("seq")], 5)
    first = first.groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "case_id"))), lambda x: x["case_id"]).alias("examples"))
    of_parents = top.join(first, "parent").select(F.lit("parent").alias("section"), F.col("parent").alias("key"), "n", F.to_json(F.struct("avg_delta", "examples")).alias("detail"))
    report = counts.unionByName(spread).unionByName(of_parents)
    if vectors is None:
        return report

    c = written(failure_clusters(fails, vectors, least))
    sizes = c.groupBy("leader").agg(F.count("*").alias("n"), F.round(F.avg("sim"), 4).alias("avg_sim"))
    reasons = _most_frequent(c.select("leader", F.explode("why").alias("reason")).groupBy("leader", "reason").agg(F.count("*").alias("n")), "leader", "reason", 5, "reasons")
    origins = _most_frequent(c.groupBy("leader", "parent").agg(F.count("*").alias("n")), "leader", "parent", 5, "parents")
    ids = c.where("leader = seq").select("leader", "case_id")
    of_clusters = sizes.join(ids, "leader").join(reasons, "leader", "left").join(origins, "leader")
    return report.unionByName(of_clusters.select(F.lit("cluster").alias("section"), F.col("case_id").alias("key"), "n", F.to_json(F.struct("avg_sim", "reasons", "parents")).alias("detail")))
