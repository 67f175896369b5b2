"""Queries of composed conversations and of mutants."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from threadlens.operators.mutants import PRESETS, mutants
from threadlens.operators.scenarios import scenarios
from threadlens.plans import decisions as de
from threadlens.plans.dialect import SPARK
from threadlens.queries.tables import query
from threadlens.queries.templates import threads
from threadlens.session import table


@query()
def gen_scenarios(spark, sf_dir):
    """A test conversation for each turn of the templated threads, its features taken from the turn's text."""
    stubs = threads(table(spark, sf_dir, "events")).select(F.concat_ws("/", "thread_id", "ix").alias("id"), "text")
    for name, step in de.stub_features(SPARK):
        stubs = stubs.withColumn(name, F.expr(step))
    made = scenarios(stubs, seed=7)
    return made.select("id", "case_type", "attempt", "caller", "url", F.array_join("anchors", ",").alias("anchors"), F.size("turns").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: F.concat_ws(": ", x["role"], x["text"])), "\n").alias("thread"), F.array_join("errors", ",").alias("errors"))


@query()
def mut_loop(spark, sf_dir):
    """Two mutants of every conversation, its users' turns taken as the sender's; all attempts are made."""
    mark = F.when(F.col("role") == "user", "S: ").when(F.col("role") == "assistant", "R: ").otherwise("")
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(mark, F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))).alias("line"))))
    t = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("thread_id")).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
    return mutants(t, replace(PRESETS["fast200_v2"], n=2, rounds=12, target=None))
