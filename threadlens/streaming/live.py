"""Live threads on Structured Streaming: a stateless prefilter, and a running score in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadlens.operators.analyze import FACTORS, rule_hits
from threadlens.operators.prefilter import action, text_signals

RESULT = "thread_id string, n_turns long, score double"
STATE = "n_turns long, score double, rules string"


def gate_turns(turns: DataFrame) -> DataFrame:
    """Adds gate_score and gate_action to each turn; works on batches and streams alike."""
    total = F.aggregate(text_signals(F.col("text")), F.lit(0), lambda a, s: a + s["points"])
    t = turns.withColumn("gate_score", F.least(F.lit(100), total))
    return t.withColumn("gate_action", action(F.col("gate_score")))


def running_scores(turns: DataFrame, idle_minutes: int = 60 * 24 * 3) -> DataFrame:
    """A stream of `turns(thread_id, ix, role, text)` -> a row for each thread and trigger: turns so far and its score.

    State is a counter for each rule, so it does not grow with a thread; it is dropped after `idle_minutes` without a turn.
    """
    hits = turns.where("role <> 'R'").select(F.col("thread_id").cast("string").alias("thread_id"), "ix", F.to_json(F.transform(rule_hits("text"), lambda h: F.struct(h["rule_id"].alias("r"), h["weight"].alias("w")))).alias("hits"))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        if state.hasTimedOut:
            state.remove()
            return
        n, total, rules = state.get if state.exists else (0, 0.0, "{}")
        counts = json.loads(rules)
        rows = pd.concat(list(batches)).sort_values("ix")
        for line in rows["hits"]:
            for hit in json.loads(line):
                seen = counts[hit["r"]] = counts.get(hit["r"], 0) + 1
                total += int(hit["w"] * FACTORS[min(seen, len(FACTORS)) - 1] * 100 + 0.5) / 100
        n += len(rows)
        state.update((n, total, json.dumps(counts)))
        state.setTimeoutDuration(idle_minutes * 60_000)
        yield pd.DataFrame({"thread_id": [key[0]], "n_turns": [n], "score": [min(100.0, round(total, 2))]})

    return hits.groupBy("thread_id").applyInPandasWithState(update, RESULT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "3 days") -> DataFrame:
    """Session windows of a key; on a stream with a watermark."""
    base = events.withWatermark(ts, late) if events.isStreaming else events
    return base.groupBy(F.col(key), F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def recent_turns(turns: DataFrame, n: int = 16, idle_minutes: int = 60 * 24 * 3) -> DataFrame:
    """A stream of `turns(thread_id, ix, role, text)` -> for each thread and trigger its last `n` turns as one text, in order. State is these turns alone."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, held = state.get if state.exists else (0, [])
        rows = pd.concat(list(batches)).sort_values("ix")
        held = [*held, *(f"{r}: {t}" for r, t in zip(rows["role"], rows["text"]))][-n:]
        seen += len(rows)
        state.update((seen, held))
        state.setTimeoutDuration(idle_minutes * 60_000)
        yield pd.DataFrame({"thread_id": [key[0]], "n_turns": [seen], "text": ["\n".join(held)]})

    lean = turns.select(F.col("thread_id").cast("string").alias("thread_id"), "ix", "role", F.coalesce("text", F.lit("")).alias("text"))
    return lean.groupBy("thread_id").applyInPandasWithState(update, "thread_id string, n_turns long, text string", "n_turns long, held array<string>", "update", GroupStateTimeout.ProcessingTimeTimeout)


#: What a reader does with links, as the prefilter's context counts it.
ACTIONS = ("copy_url", "open_url", "install_click")


def action_counts(actions: DataFrame) -> DataFrame:
    """`actions(thread_id, kind)` -> a row for each thread with the number of each of ACTIONS; on a stream in update mode."""
    return actions.groupBy("thread_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ACTIONS))


def gated(turns: DataFrame, least: int = 18) -> DataFrame:
    """The turns whose own prefilter score is enough for the analysis behind it: the first of two stages."""
    return gate_turns(turns).where(F.col("gate_score") >= least)


def within_days(turns: DataFrame, ts: str, days: int = 3) -> DataFrame:
    """On a stream: turns with a watermark of so many days, repeats of an entry within it left out. On a batch: those of each thread's last days."""
    if turns.isStreaming:
        return turns.withWatermark(ts, f"{days} days").dropDuplicatesWithinWatermark(["thread_id", "ix"])
    last = F.max(ts).over(W.partitionBy("thread_id"))
    return turns.withColumn("__last", last).where(F.col(ts) >= F.col("__last") - F.expr(f"INTERVAL {days} DAYS")).drop("__last").dropDuplicates(["thread_id", "ix"])
