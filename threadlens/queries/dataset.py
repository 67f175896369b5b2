"""The engine held against labelled cases: templated threads whose sentences have a stage each, set by reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.operators import dataset as ds
from threadlens.operators.evaluate import highest_stage
from threadlens.queries.tables import query
from threadlens.queries.templates import SENTENCES, threads
from threadlens.session import table, written

#: The stage that a reader gives to each sentence, by its place; those that are not named are harmless.
STAGES = {
    "verify": (0, 4, 9, 12, 16, 17, 21, 23, 24, 25, 26, 28, 29, 30, 42, 45, 46, 47),
    "install": (3, 22, 44),
    "payment": (1, 7, 11, 13, 15, 18, 19, 20, 27),
}


def cases_and_turns(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases of one, two and three turns: of six events in a row the first, the next two, the last three. A case's stage is its sentences' highest, its risk high if money or an installation comes with something else, medium if something is asked for, else low; its
    parent is the user of its first event."""
    labels = F.array(*(F.lit(next((s for s, ids in STAGES.items() if i in ids), "info")) for i in range(len(SENTENCES))))
    at = F.pmod("event_id", F.lit(6))
    case_id = F.concat_ws("-", F.floor(F.col("event_id") / 6).cast("string"), F.when(at == 0, "1").when(at <= 2, "2").otherwise("3"))
    t = written(threads(events, case_id.alias("case_id"), F.get(labels, ((F.col("event_id") + F.length("event_type")) % len(SENTENCES)).cast("int")).alias("label"), F.col("user_id")))
    said = t.groupBy("case_id").agg(F.collect_set("label").alias("labels"), F.count_if(F.col("label") != "info").cast("int").alias("n_should"), F.min("ix").alias("seq"), F.min_by("user_id", "ix").cast("string").alias("parent"))
    hard = F.arrays_overlap("labels", F.array(F.lit("payment"), F.lit("install")))
    said = said.withColumn("exp_risk", F.when(hard & (F.col("n_should") > 1), "high").when(F.col("n_should") > 0, "medium").otherwise("low"))
    cases = said.select("case_id", "seq", "exp_risk", F.when(F.col("exp_risk") == "high", 45.0).when(F.col("exp_risk") == "medium", 25.0).otherwise(0.0).alias("exp_score_min"), highest_stage(F.col("labels")).alias("exp_stage"),
        F.lit(None).cast("boolean").alias("exp_triggered"), "n_should", "parent")
    return cases, t.select(F.col("case_id").alias("thread_id"), "ix", "role", "text")


def _evaluated(spark, sf_dir) -> DataFrame:
    return ds.evaluate(*cases_and_turns(table(spark, sf_dir, "events")))


@query()
def eval_engine(spark, sf_dir):
    columns = ["case_id", "exp_risk", "risk_level", "exp_score_min", "score_total", "exp_stage", "stage_peak", "want_triggered", "got_triggered", "n_hits", "top_weight", "pf_score", "pf_action", "ui_level", "ui_score"]
    return _evaluated(spark, sf_dir).select(*columns, F.array_join("why", ",").alias("why"))


@query()
def eval_engine_summary(spark, sf_dir):
    return ds.dataset_summary(_evaluated(spark, sf_dir))


@query()
def eval_failures(spark, sf_dir):
    """The report of failures, clusters of their senders' texts among it."""
    e = written(_evaluated(spark, sf_dir))
    return ds.failure_report(e, ds.text_vectors(e.where("not passed"), "seq", "sender_text"))


@query()
def eval_export(spark, sf_dir):
    cases, turns = cases_and_turns(table(spark, sf_dir, "events"))
    cases = cases.withColumn("exp_ui", F.when(F.col("seq") % 2 == 0, F.col("exp_risk"))).withColumn("exp_triggered", F.col("exp_risk") != "low")
    fails = ds.exported_fails(cases, ds.engine_results(cases, turns))
    return fails.select("case_id", "prefer_ui", F.array_join("why", "; ").alias("why"), F.to_json("got").alias("got"), F.to_json("exp").alias("exp"))


@query()
def eval_engine_relabel(spark, sf_dir):
    cases, turns = cases_and_turns(table(spark, sf_dir, "events"))
    return ds.relabelled_cases(cases, ds.engine_results(cases, turns)).select("case_id", "exp_risk", "exp_score_min", "exp_stage", "exp_triggered", "changed")
