"""Queries of decisions, link and text checks, corpus rules and rollups. A decision's steps are one text for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.functions.urls import inline_urls
from threadlens.operators import analyze as an
from threadlens.operators.evaluate import highest_stage, report_lines, top_per_group
from threadlens.plans import catalog as cat
from threadlens.plans import decisions as de
from threadlens.plans.dialect import DUCK, SPARK, stepped
from threadlens.queries.tables import _raw_hits, _rule_hits_sql, query
from threadlens.queries.templates import threads, threads_sql
from threadlens.session import spread, table, written

IDS = sorted({i for ids in cat.RISK_FLAGS.values() for i in ids} | set(de.ACTION_ANCHORS))
RISK_CUES = sorted({"q_" + k for k in cat.THREAD_CUES})
_GATES = ["r:done:pay", "r:done:install", "r:will:pay", "r:will:install", "r:will:otp", "r:will:visit", "r:ask", "r:already", ""]
_RISKS, _STAGES = ["low", "medium", "high"], list(cat.STAGES)
_pick = lambda names, n: f"CASE {n} % {len(names)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(names)) + " END"


def _case_columns(duck: bool) -> str:
    """Cases made of a user's events, eight ids at a time: hits, cues and results as the ids say."""
    pick = f"([{', '.join(repr(i) for i in IDS)}])[(event_id * 7 + length(event_type)) % {len(IDS)} + 1]" if duck else f"get(array({', '.join(repr(i) for i in IDS)}), CAST((event_id * 7 + length(event_type)) % {len(IDS)} AS INT))"
    ids = f"list_sort(list(DISTINCT {pick}))" if duck else f"sort_array(collect_set({pick}))"
    any_of = "bool_or"
    first = "min(event_id)"
    cues = ", ".join(f"{any_of}((event_id * {k + 3} + length(event_type)) % {7 + k % 5} = 0) AS {n}" for k, n in enumerate(RISK_CUES))
    return f"""SELECT concat_ws('-', CAST(user_id AS {'VARCHAR' if duck else 'STRING'}), CAST(CAST(floor(event_id / 8{'.0' if duck else ''}) AS BIGINT) AS {'VARCHAR' if duck else 'STRING'})) AS case_id, {ids} AS ids, {first} AS n,
 CAST(sum(CAST(floor(abs(value)) AS BIGINT)) % 101 AS INT) AS score_total, CAST(count(*) AS INT) AS n_hits, CAST({first} % 40 AS INT) AS top_weight, {any_of}(event_id % 3 = 0) AS any_url, {any_of}(event_id % 5 = 0) AS internal_host, {cues}
 FROM events GROUP BY user_id, floor(event_id / 8{'.0' if duck else ''})"""


_MADE = f"""SELECT *, {_pick(_RISKS, 'n')} AS risk_level, n % 2 = 0 AS hard_high, {_pick(_STAGES, '(n // 3)')} AS stage_peak, {_pick(_GATES, 'n')} AS gate_tag,
 CASE n % 9 WHEN 0 THEN 80 WHEN 1 THEN 70 ELSE 0 END AS gate_floor, n % 4 = 0 AS sender_url, n % 7 < 5 AS has_prefilter, CASE n % 6 WHEN 0 THEN true WHEN 1 THEN false END AS flag, CASE WHEN n % 10 < 7 THEN n % 3 END AS n_should,
 CASE n % 5 WHEN 0 THEN 'auto' WHEN 1 THEN 'none' END AS pf_action, CASE WHEN n % 8 < 6 THEN CAST(n % 60 AS INT) END AS pf_score, CASE WHEN n % 11 < 8 THEN 28 END AS soft, 52 AS auto, CASE WHEN n % 13 = 0 THEN 1 END AS n_triggers, CASE WHEN n % 17 = 0 THEN 1 END AS n_rules,
 CASE WHEN n % 3 < 2 THEN n % 2 = 0 END AS gate_pass, n % 19 = 0 AS otp_asked, n % 23 = 0 AS remote_asked, n % 29 = 0 AS urgent_pressured, n % 31 = 0 AS first_contact,
 {_pick(_RISKS, '(n // 2)')} AS exp_risk, {_pick(_STAGES, '(n // 5)')} AS exp_stage, CASE WHEN n % 7 > 1 THEN CAST(n % 50 AS INT) END AS exp_score_min, CASE n % 12 WHEN 0 THEN true WHEN 1 THEN false END AS exp_triggered,
 80 + n % 20 AS sim_percent FROM"""


def _cases(spark, sf_dir) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("threadlens_events")
    made = _MADE.replace("(n // 3)", "(n div 3)").replace("(n // 2)", "(n div 2)").replace("(n // 5)", "(n div 5)")
    return spark.sql(f"{made} ({_case_columns(False).replace('FROM events', 'FROM threadlens_events')})")


_CASES = f"{_MADE} ({_case_columns(True)})"


def _stepped(df: DataFrame, steps, out: list[str]) -> DataFrame:
    return df.selectExpr("*", *(f"{e} AS {n}" for n, e in steps)).selectExpr(*out)


_RISK_OUT = ["case_id", "risk_level", "hard_high", "benign", "clues", "gate_b", "alert_only", "remote_only"]


@query(stepped(_case_columns(True), an.risk_steps(lambda *ids: DUCK.holds("ids", *ids)), _RISK_OUT))
def risk_ladder(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("threadlens_events")
    return an.with_risk(spark.sql(_case_columns(False).replace("FROM events", "FROM threadlens_events"))).select(*_RISK_OUT)


_R_TEXT = f"SELECT thread_id, string_agg(text, ' ' ORDER BY ix) AS r_text FROM ({threads_sql()}) WHERE role = 'R' GROUP BY thread_id, ix // 32"
_GATE_OUT = ["thread_id", "gate_tag", "gate_floor", "quick_tag", "quick_boost", "urgency"]


@query(stepped(_R_TEXT, de.receiver_gate(DUCK), _GATE_OUT))
def receiver_gate(spark, sf_dir):
    t = threads(table(spark, sf_dir, "events")).where("role = 'R'")
    said = F.array_sort(F.collect_list(F.struct("ix", "text")))
    t = t.groupBy("thread_id", F.expr("ix div 32").alias("part")).agg(F.array_join(F.transform(said, lambda x: x["text"]), " ").alias("r_text"))
    return _stepped(t, de.receiver_gate(SPARK), _GATE_OUT)


_UI_OUT = ["case_id", "anchored", "can_show", "can_raise", "soft_boost", "ui_score", "ui_level", "triggered", "band", "colour", "block_level"]


@query(stepped(f"SELECT *, {de.prefilter_triggered()} AS pf_triggered FROM ({_CASES})", de.interface_score(DUCK), _UI_OUT))
def interface_scores(spark, sf_dir):
    return _stepped(_cases(spark, sf_dir).selectExpr("*", f"{de.prefilter_triggered()} AS pf_triggered"), de.interface_score(SPARK), _UI_OUT)


_SIM_OUT = ["case_id", "sim_boost", "proto_boost", "call_boost", "trigger_score", "trigger_why"]
_SIM = "SELECT * EXCLUDE (pf_score, gate_pass), sim_percent / 100.0 AS top_sim, coalesce(pf_score, 0) AS pf_score, coalesce(gate_pass, false) AS gate_pass, CASE WHEN n % 3 = 0 THEN 4 ELSE 0 END AS quick_boost FROM"


@query(stepped(f"{_SIM} ({_CASES})", de.similar_boost(DUCK), _SIM_OUT))
def similar_boosts(spark, sf_dir):
    c = _cases(spark, sf_dir).selectExpr("*", "sim_percent / 100.0 AS top_sim", "CASE WHEN n % 3 = 0 THEN 4 ELSE 0 END AS quick_boost").withColumns({"pf_score": F.expr("coalesce(pf_score, 0)"), "gate_pass": F.expr("coalesce(gate_pass, false)")})
    return _stepped(c, de.similar_boost(SPARK), _SIM_OUT)


_EVAL = [*de.evaluated_triggered(), *de.expected_against_got(DUCK)]


@query(stepped(_CASES, _EVAL, ["case_id", "got_triggered", "want_triggered", "array_to_string(why, ',') AS why"]))
def eval_batch(spark, sf_dir):
    return _stepped(_cases(spark, sf_dir), [*de.evaluated_triggered(), *de.expected_against_got(SPARK)], ["case_id", "got_triggered", "want_triggered", "array_join(why, ',') AS why"])


_EVALUATED = stepped(_CASES, _EVAL, ["*"])


def _evaluated(spark, sf_dir) -> DataFrame:
    return _stepped(_cases(spark, sf_dir), [*de.evaluated_triggered(), *de.expected_against_got(SPARK)], ["*"])


_COUNTS = """CAST(count(*) AS BIGINT) AS cases, CAST(sum(CASE WHEN array_contains(why, 'risk_mismatch') THEN 0 ELSE 1 END) AS BIGINT) AS risk_ok, CAST(sum(CASE WHEN array_contains(why, 'score_below_min') THEN 0 ELSE 1 END) AS BIGINT) AS score_ok,
 CAST(sum(CASE WHEN array_contains(why, 'stage_mismatch') THEN 0 ELSE 1 END) AS BIGINT) AS stage_ok, CAST(sum(CASE WHEN array_contains(why, 'triggered_mismatch') THEN 0 ELSE 1 END) AS BIGINT) AS trigger_ok, CAST(sum(CASE WHEN {size}(why) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS passed,
 round(100.0 * sum(CASE WHEN {size}(why) = 0 THEN 1 ELSE 0 END) / count(*), 1) AS pass_rate"""


@query(f"SELECT exp_risk, {_COUNTS.format(size='len')} FROM ({_EVALUATED}) GROUP BY exp_risk")
def eval_counts(spark, sf_dir):
    e = _evaluated(spark, sf_dir)
    e.createOrReplaceTempView("threadlens_evaluated")
    return spark.sql(f"SELECT exp_risk, {_COUNTS.format(size='size')} FROM threadlens_evaluated GROUP BY exp_risk").withColumn("pass_rate", F.col("pass_rate").cast("double"))


@query(f"""SELECT kind, key, count(*) AS n FROM (SELECT unnest(['risk->shown', 'band', 'threat']) AS kind, unnest([risk_level || '->' || ui_level, band, block_level]) AS key FROM ({stepped(f"SELECT *, {de.prefilter_triggered()} AS pf_triggered FROM ({_CASES})", de.interface_score(DUCK), ["*"])})) GROUP BY kind, key""")
def eval_distributions(spark, sf_dir):
    u = _stepped(_cases(spark, sf_dir).selectExpr("*", f"{de.prefilter_triggered()} AS pf_triggered"), de.interface_score(SPARK), ["risk_level", "ui_level", "band", "block_level"])
    e = u.selectExpr("explode(array(struct('risk->shown' AS kind, concat(risk_level, '->', ui_level) AS key), struct('band' AS kind, band AS key), struct('threat' AS kind, block_level AS key))) AS e")
    return e.groupBy("e.kind", "e.key").agg(F.count("*").alias("n"))


@query(f"SELECT id, count(*) AS n, count(*) FILTER (len(why) > 0) AS n_failed FROM (SELECT unnest(ids) AS id, why FROM ({_EVALUATED})) GROUP BY id")
def eval_rule_frequency(spark, sf_dir):
    return _evaluated(spark, sf_dir).select(F.explode("ids").alias("id"), "why").groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.size("why") > 0).alias("n_failed"))


@query(f"""WITH f AS (SELECT split_part(case_id, '-', 1) AS parent, case_id, exp_score_min - score_total AS delta FROM ({_EVALUATED}) WHERE array_contains(why, 'score_below_min')),
r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY case_id) AS pos FROM f)
SELECT parent, count(*) AS n, round(avg(delta), 6) AS avg_delta, string_agg(case_id, ',' ORDER BY case_id) FILTER (pos <= 5) AS examples FROM r GROUP BY parent""")
def eval_parents(spark, sf_dir):
    f = _evaluated(spark, sf_dir).where("array_contains(why, 'score_below_min')").selectExpr("split_part(case_id, '-', 1) AS parent", "case_id", "exp_score_min - score_total AS delta")
    first = top_per_group(f.select("parent", "case_id"), ["parent"], [F.col("case_id")], 5).groupBy("parent").agg(F.array_join(F.array_sort(F.collect_list("case_id")), ",").alias("examples"))
    return f.groupBy("parent").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("avg_delta")).join(first, "parent")


_RELABEL_OUT = ["case_id", "policy_risk", "new_score_min", "ui_score_min", "consistent"]


@query(stepped(f"SELECT *, risk_level AS ui_level FROM ({_CASES})", de.relabelled(), _RELABEL_OUT))
def eval_relabel(spark, sf_dir):
    return _stepped(_cases(spark, sf_dir).withColumn("ui_level", F.col("risk_level")), de.relabelled(), _RELABEL_OUT)


#: Groups of ids of which a category's cases are to have one each.
CATALOGUE = {"institution": (("authority",), ("threat", "urgent", "link", "otp")), "family": (("ctx_family_scam", "transfer"),), "job": (("job_lure", "ctx_job_hook"), ("ctx_contact_move", "link", "personalinfo"))}


@query(" UNION ALL ".join(f"SELECT '{k}' AS category, count(*) AS cases, count(*) FILTER ({' AND '.join(DUCK.holds('ids', *g) for g in groups)}) AS covered FROM ({_case_columns(True)})" for k, groups in CATALOGUE.items()))
def eval_catalogue(spark, sf_dir):
    c = _cases(spark, sf_dir)
    tests = F.array(*(F.struct(F.lit(k).alias("category"), F.expr(" AND ".join(SPARK.holds("ids", *g) for g in groups)).alias("ok")) for k, groups in CATALOGUE.items()))
    return c.select(F.explode(tests).alias("t")).groupBy("t.category").agg(F.count("*").alias("cases"), F.count_if("t.ok").alias("covered"))


#: The engine's hits that stand for a prefilter's signal.
ALIASES = {"pf_otp": ("otp", "ctx_otp_relay", "ctx_otp_finance"), "pf_remote": ("remote", "ctx_install_mention"), "pf_transfer": ("transfer", "ctx_transfer_phrase", "ctx_payment_request"), "pf_authority": ("authority",), "pf_threat": ("threat",), "pf_urgency": ("urgent",), "pf_pii": ("personalinfo", "pii_request"), "pf_job_hook": ("job_lure", "ctx_job_hook")}


@query(" UNION ALL ".join(f"SELECT '{k}' AS pf_id, count(*) AS n_pf, count(*) FILTER ({DUCK.holds('ids', *ids)}) AS n_hit, min(case_id) FILTER ({DUCK.holds('ids', *ids)}) AS example FROM ({_case_columns(True)}) WHERE n % {i + 2} = 0" for i, (k, ids) in enumerate(ALIASES.items())))
def eval_coverage(spark, sf_dir):
    tests = F.array_compact(F.array(*(F.when(F.col("n") % (i + 2) == 0, F.struct(F.lit(k).alias("pf_id"), F.expr(SPARK.holds("ids", *ids)).alias("hit"))) for i, (k, ids) in enumerate(ALIASES.items()))))
    c = _cases(spark, sf_dir).select("case_id", F.explode(tests).alias("t"))
    return c.groupBy("t.pf_id").agg(F.count("*").alias("n_pf"), F.count_if("t.hit").alias("n_hit"), F.min(F.when(F.col("t.hit"), F.col("case_id"))).alias("example"))


@query(f"SELECT case_id, ['info', 'verify', 'install', 'payment'][greatest(list_position(['info', 'verify', 'install', 'payment'], stage_peak), list_position(['info', 'verify', 'install', 'payment'], exp_stage))] AS peak, CASE WHEN 'install' IN (stage_peak, exp_stage) THEN 'install' WHEN 'payment' IN (stage_peak, exp_stage) THEN 'payment' WHEN 'verify' IN (stage_peak, exp_stage) THEN 'verify' ELSE 'info' END AS peak_other FROM ({_CASES})")
def stage_peaks(spark, sf_dir):
    """The highest of several stages, in the engine's order and in that which puts an install above a payment."""
    stages = F.array("stage_peak", "exp_stage")
    return _cases(spark, sf_dir).select("case_id", highest_stage(stages).alias("peak"), highest_stage(stages, ("info", "verify", "payment", "install")).alias("peak_other"))


# --- hits, evidence, reports --------------------------------------------------------------------------------------------------


@query(f"SELECT thread_id, ix, ord, rule_id, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY weight DESC, ix, ord)::INT AS rank FROM ({_rule_hits_sql()})) WHERE rank <= 30")
def hits_top30(spark, sf_dir):
    return top_per_group(_raw_hits(spark, sf_dir).select("thread_id", "ix", "ord", "rule_id", "weight"), ["thread_id"], [F.desc("weight"), F.col("ix"), F.col("ord")], 30)


@query(f"""SELECT thread_id, string_agg(rule_id || ' · ' || CASE WHEN weight >= 25 THEN 'high' WHEN weight >= 15 THEN 'medium' ELSE 'low' END, chr(10) ORDER BY rank) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY weight DESC, ix, ord) AS rank FROM ({_rule_hits_sql()})) WHERE rank <= 3 GROUP BY thread_id""")
def evidence_top3(spark, sf_dir):
    top = top_per_group(_raw_hits(spark, sf_dir), ["thread_id"], [F.desc("weight"), F.col("ix"), F.col("ord")], 3)
    line = F.concat("rule_id", F.lit(" · "), F.when(F.col("weight") >= 25, "high").when(F.col("weight") >= 15, "medium").otherwise("low"))
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return top.groupBy("thread_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("evidence"))


@query(f"""WITH h AS ({_rule_hits_sql()}), s AS (SELECT thread_id, rule_id, sum(weight) AS w, count(*) AS n FROM h GROUP BY thread_id, rule_id), r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY w DESC, rule_id) AS rank FROM s)
SELECT thread_id, '[Report]' || chr(10) || '- messages with hits: ' || max(m)::VARCHAR || chr(10) || string_agg('- ' || rule_id || ' (+' || w::BIGINT::VARCHAR || ', ' || n::VARCHAR || ' hits)', chr(10) ORDER BY rank) AS report
FROM r JOIN (SELECT thread_id, count(DISTINCT ix) AS m FROM h GROUP BY thread_id) USING (thread_id) WHERE rank <= 8 GROUP BY thread_id""")
def report_text(spark, sf_dir):
    return report_lines(_raw_hits(spark, sf_dir))


# --- texts and links ----------------------------------------------------------------------------------------------------------

_T = f"SELECT thread_id, ix, text FROM ({threads_sql()})"


def _texts(spark, sf_dir) -> DataFrame:
    return threads(table(spark, sf_dir, "events")).select("thread_id", "ix", "text")


def _both(steps, out: list[str]):
    """SQL of the steps over the turns' texts, and the steps for Spark."""
    return stepped(_T, steps(DUCK), out), steps(SPARK), out


_CHIPS_SQL, _CHIPS, _CHIPS_OUT = _both(de.url_chips, ["thread_id", "ix", "chips"])


@query(_CHIPS_SQL)
def url_chips(spark, sf_dir):
    return _stepped(_texts(spark, sf_dir), _CHIPS, _CHIPS_OUT)


@query(stepped(rf"""SELECT thread_id, ix, unnest(regexp_extract_all(text, '(?i)\bhttps?://[^\s<>"'')]+')) AS url FROM ({threads_sql()})""", de.url_guard(DUCK), ["thread_id", "ix", "url", "flags", "guard_score", "blocked"]))
def url_guard(spark, sf_dir):
    t = _texts(spark, sf_dir).select("thread_id", "ix", F.explode(inline_urls(F.col("text"))).alias("url"))
    return _stepped(t, de.url_guard(SPARK), ["thread_id", "ix", "url", "flags", "guard_score", "blocked"])


_CTX_SQL, _CTX, _CTX_OUT = _both(de.context_score, ["conv_id", "turn", "ctx_score"])


@query(stepped("SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations", de.context_score(DUCK), _CTX_OUT))
def context_scores(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return _stepped(c, _CTX, _CTX_OUT)


_STUB_SQL, _STUB, _STUB_OUT = _both(de.stub_features, ["thread_id", "ix", "keywords", "case_type"])


@query(_STUB_SQL)
def stub_types(spark, sf_dir):
    return _stepped(_texts(spark, sf_dir), _STUB, _STUB_OUT)


_CTX_COND = " UNION ALL ".join(f"SELECT thread_id, ix, {n} AS ord, '{i}' AS rule_id FROM q WHERE {c}" for n, (i, _, _, _, _, c) in enumerate(an.CONTEXT))
_CUE_SQL = ", ".join(f"({' OR '.join(DUCK.found('text', p) for p in ps)}) AS q_{k}" for k, ps in cat.CUES.items())
_HAS_URL = r"""regexp_matches(text, '(?i)https?://[^\s<>"'')\]]|\bwww\.[^\s<>"'')\]]|\b[a-zA-Z0-9][a-zA-Z0-9-]{0,61}(?:\.[a-zA-Z0-9-]{1,63})+\b')"""
_COUNT = lambda ps: "(" + " + ".join(f"regexp_matches(lower(text), {DUCK.quoted(p)})::INT" for p in ps) + ")"
_HINT = f"CASE WHEN trim(text) = '' THEN 'neutral' WHEN q_otp_relay_demand THEN 'demand' WHEN {_COUNT(cat.DEMAND_PATTERNS)} >= 2 AND {_COUNT(cat.DEMAND_PATTERNS)} > {_COUNT(cat.COMPLY_PATTERNS)} THEN 'demand' WHEN {_COUNT(cat.COMPLY_PATTERNS)} >= 2 AND {_COUNT(cat.COMPLY_PATTERNS)} >= {_COUNT(cat.DEMAND_PATTERNS)} THEN 'comply' ELSE 'neutral' END"


@query(f"""WITH u AS (SELECT DISTINCT text FROM ({threads_sql()})), f AS (SELECT *, {_HINT} AS hint, {_HAS_URL} AS has_url FROM (SELECT text, {_CUE_SQL} FROM u)),
q AS (SELECT t.thread_id, t.ix, f.*, max(q_otp) OVER (PARTITION BY t.thread_id ORDER BY t.ix ROWS UNBOUNDED PRECEDING) AS seen FROM ({threads_sql()}) t JOIN f USING (text)), c AS ({_CTX_COND})
SELECT thread_id, ix, ord, rule_id FROM c""")
def context_rules(spark, sf_dir):
    """The context hits of every turn, whoever speaks."""
    t = threads(table(spark, sf_dir, "events")).select("thread_id", "ix", "text")
    t = t.join(an.text_features(t.select("text").distinct()).drop("own_hits"), "text")
    t = t.withColumns({"seen": F.max("q_otp").over(W.partitionBy("thread_id").orderBy("ix").rowsBetween(W.unboundedPreceding, 0)), "has_url": F.size("urls") > 0})
    rows = F.array_compact(F.array(*(F.when(F.expr(c), F.struct(F.lit(n).alias("ord"), F.lit(i).alias("rule_id"))) for n, (i, _, _, _, _, c) in enumerate(an.CONTEXT))))
    return t.select("thread_id", "ix", F.explode(rows).alias("r")).select("thread_id", "ix", "r.ord", "r.rule_id")


# --- corpus rules, sources ----------------------------------------------------------------------------------------------------

_BODY = f"SELECT thread_id, {de.without_boilerplate(DUCK, 'text')} AS body FROM (SELECT thread_id, string_agg(text, chr(10) ORDER BY ix) AS text FROM ({threads_sql()}) GROUP BY thread_id)"
_XR_OUT = ["thread_id", "signature", *(f"CAST(n_{i} AS INT) AS n_{i}" for i in range(len(de.CORPUS_RULES)))]
#: The same in Spark, where counts are INT. They keep their names from where the signature is made: it names them all, and what Spark infers from it doubles with each that is given a name anew, to millions of conditions in the driver.
_XR_SPARK = ["thread_id", "signature", *(f"n_{i}" for i in range(len(de.CORPUS_RULES)))]


def _body_counts(turns: DataFrame) -> DataFrame:
    """(thread_id, n_<i>, signature): the corpus rules on the threads' whole texts."""
    lines = F.array_sort(F.collect_list(F.struct("ix", "text")))
    t = turns.groupBy("thread_id").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))
    return _stepped(t.selectExpr("thread_id", f"{de.without_boilerplate(SPARK)} AS body"), de.corpus_counts(SPARK, "body"), _XR_SPARK)


def _counted(turns: DataFrame) -> DataFrame:
    """`_body_counts`, from counts of the lines. Lines repeat (messages do), so patterns are tried once on each distinct one and a thread's counts are sums. Where a
    match could go on over a line's end, by what stands on both sides of it (`de.seams`), or lines have no order, the thread's whole text is gone through."""
    counts = [f"n_{i}" for i in range(len(de.CORPUS_RULES))]
    t = turns.select("thread_id", "ix", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.md5("text"))
    texts, forms = spread(t.select("mark", "text").distinct(), "mark"), ["text"]
    for n, p in enumerate(de.BOILERPLATE):
        texts = texts.selectExpr("*", f"{SPARK.swap(forms[-1], p, ' ')} AS form_{n}")
        forms.append(f"form_{n}")
    steps = [*de.seam_masks(SPARK, forms), *de.corpus_counts(SPARK, forms[-1])[:-1]]
    found = written(texts.selectExpr("mark", *(f"{e} AS {n}" for n, e in steps)))
    few = found.limit((1 << 16) + 1).count() <= 1 << 16
    send = lambda df: F.broadcast(df) if few else df
    at = W.partitionBy("thread_id").orderBy("ix")
    masks = t.select("thread_id", "ix", "mark").join(send(found.select("mark", "tails", "heads")), "mark")
    seam = (F.col("tails").bitwiseAND(F.lead("heads").over(at)) != 0) | (F.col("ix") == F.lead("ix").over(at)) | F.col("ix").isNull()
    held = masks.select("thread_id", "mark", F.coalesce(seam, F.lit(False)).alias("seam")).join(send(found.select("mark", *counts)), "mark")
    # the id is a column of its own here: where both sides of a union have one column, Spark renames all of the other side's
    summed = written(held.groupBy(F.col("thread_id").alias("thread_id")).agg(F.max("seam").alias("seam"), *(F.sum(c).cast("int").alias(c) for c in counts)))
    whole = _body_counts(turns.join(summed.where("seam").select("thread_id"), "thread_id", "left_semi"))
    return _stepped(summed.where("NOT seam"), [de.corpus_signature()], _XR_SPARK).unionByName(whole)


def _corpus(spark, sf_dir) -> DataFrame:
    return _counted(threads(table(spark, sf_dir, "events")))


@query(stepped(_BODY, de.corpus_counts(DUCK, "body"), _XR_OUT))
def corpus_rules(spark, sf_dir):
    return _corpus(spark, sf_dir)


_KEYS = ", ".join(f"CASE WHEN n_{i} > 0 THEN '{k}' END" for i, (k, _, _) in enumerate(de.CORPUS_RULES))
_TOTALS = ", ".join(f"n_{i}" for i in range(len(de.CORPUS_RULES)))


@query(f"""WITH c AS ({stepped(_BODY, de.corpus_counts(DUCK, 'body'), ['*'])}), e AS (SELECT thread_id, signature, unnest([{', '.join(repr(k) for k, _, _ in de.CORPUS_RULES)}]) AS key, unnest([{_TOTALS}]) AS total FROM c),
s AS (SELECT signature, key, sum(total)::BIGINT AS total, count(*) AS doc_freq FROM e WHERE total > 0 GROUP BY signature, key), r AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY total DESC, key)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 12""")
def corpus_top_signals(spark, sf_dir):
    """Of each signature the rules that its documents have most, with their document frequency."""
    c = _corpus(spark, sf_dir)
    each = F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"n_{i}").alias("total")) for i, (k, _, _) in enumerate(de.CORPUS_RULES)))
    s = c.select("signature", F.explode(each).alias("e")).where("e.total > 0").groupBy("signature", "e.key").agg(F.sum("e.total").alias("total"), F.count("*").alias("doc_freq"))
    return top_per_group(s, ["signature"], [F.desc("total"), F.col("key")], 12)


@query(f"SELECT signature, count(*) AS n FROM (SELECT signature, list_filter([{_KEYS}], lambda x: x IS NOT NULL) AS keys FROM ({stepped(_BODY, de.corpus_counts(DUCK, 'body'), ['*'])})) WHERE len(keys) >= 3 AND len(list_filter(keys, lambda k: starts_with(k, 'action:') OR starts_with(k, 'imp:') OR starts_with(k, 'pressure:') OR starts_with(k, 'platform:'))) > 0 GROUP BY signature")
def corpus_cluster_filter(spark, sf_dir):
    """Documents with three rules at least, one of them an action, an impersonation, pressure or a platform."""
    c = _corpus(spark, sf_dir)
    keys = F.array_compact(F.array(*(F.when(F.col(f"n_{i}") > 0, F.lit(k)) for i, (k, _, _) in enumerate(de.CORPUS_RULES))))
    c = c.select("signature", keys.alias("keys")).where((F.size("keys") >= 3) & F.exists("keys", lambda k: F.rlike(k, F.lit("^(action|imp|pressure|platform):"))))
    return c.groupBy("signature").agg(F.count("*").alias("n"))


_PATH = "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/data/pages/src' || (page_id % 7)::VARCHAR || '/detail_pstSn_' || page_id::VARCHAR || '.html' WHEN 1 THEN '/data/board' || (page_id % 5)::VARCHAR || '/pstSn_' || page_id::VARCHAR || '.json' WHEN 2 THEN '/x/news_list pstSn' || page_id::VARCHAR ELSE url END AS path FROM pages"


@query(stepped(_PATH, de.source_of_path(DUCK), ["page_id", "source", "pst"]))
def source_paths(spark, sf_dir):
    n = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/data/pages/src"), (F.col("page_id") % 7).cast("string"), F.lit("/detail_pstSn_"), n, F.lit(".html"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("/data/board"), (F.col("page_id") % 5).cast("string"), F.lit("/pstSn_"), n, F.lit(".json"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("/x/news_list pstSn"), n)).otherwise(F.col("url"))
    return _stepped(table(spark, sf_dir, "pages").select("page_id", path.alias("path")), de.source_of_path(SPARK), ["page_id", "source", "pst"])


_NAMES = ("보이스피싱 사례.pdf", "이의신청서.hwp", "피해 신청서 작성예시.docx", "logo.png", "안내.txt", "")


@query(f"SELECT page_id, name, {de.attachment_skipped(DUCK)} AS skipped FROM (SELECT page_id, ([{', '.join(repr(n) for n in _NAMES)}])[page_id % {len(_NAMES)} + 1] AS name FROM pages)")
def attachment_names(spark, sf_dir):
    name = F.get(F.array(*(F.lit(n) for n in _NAMES)), (F.col("page_id") % len(_NAMES)).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name")).selectExpr("page_id", "name", f"{de.attachment_skipped(SPARK)} AS skipped")
