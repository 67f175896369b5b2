"""Live threads with the whole analysis behind them: a store of turns' features that grows by what is new, debounced input, and a window of turns with retention."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadlens.operators.analyze import analyzed, featured, settled
from threadlens.operators.prefilter import prefilter

#: Folders that the store's turns are dealt to by thread, so that a trigger reads only those of its threads.
BUCKETS = 64


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def live_analysis(folder: str, gate: bool = False, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A function for `foreachBatch` on a stream of `turns(thread_id, ix, role, text)`: after each trigger `latest` gives for every thread what `analyze` gives for all its turns so far.

    The patterns, nearly all of the work, are tried on new texts alone. What they find is kept in `folder` (a shared one), dealt by thread; then only the threads that have new turns are settled and scored anew, from these features. So the result depends neither on how
    turns are cut into batches nor on their order, late turns and a role that comes late included. A batch that is run again after a failure replaces what it wrote, and reads no batch after itself. With `gate` a thread is analysed only once the prefilter passes what its sender said,
    or all it has where no turn names a sender; a thread that no longer passes keeps its last row.
    """

    def update(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        place = F.pmod(F.xxhash64("thread_id"), F.lit(buckets)).cast("int")
        turns = batch.select("thread_id", "ix", "role", "text").where("thread_id is not null")
        if turns.isEmpty():
            return
        featured(turns).withColumn("bucket", place).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/turns/batch={batch_id}")
        fresh = spark.read.parquet(f"{folder}/turns/batch={batch_id}")
        touched = fresh.select("bucket", "thread_id").distinct()
        own = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # `buckets` at most
        kept = spark.read.parquet(f"{folder}/turns").where((F.col("batch") <= batch_id) & F.col("bucket").isin(own)).join(touched, ["bucket", "thread_id"], "left_semi").drop("batch", "bucket")
        if gate:
            lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "S", F.struct("ix", "text")))), lambda x: x["text"])
            whole = F.transform(F.array_sort(F.collect_list(F.struct("ix", "text"))), lambda x: x["text"])
            said = kept.groupBy("thread_id").agg(lines.alias("s"), whole.alias("w")).select("thread_id", F.array_join(F.when(F.size("s") > 0, F.col("s")).otherwise(F.col("w")), "\n").alias("text"))
            kept = kept.join(prefilter(said).where("gate_pass").select("thread_id"), "thread_id", "left_semi")
        analyzed(settled(kept)).write.mode("overwrite").parquet(f"{folder}/results/batch={batch_id}")

    return update


def latest(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest row of each thread that `live_analysis` wrote; None before there is one."""
    rows = _read(spark, f"{folder}/results")
    if rows is None:
        return None
    newest = F.row_number().over(W.partitionBy("thread_id").orderBy(F.desc("batch")))
    return rows.withColumn("n", newest).where("n = 1").drop("n", "batch")


TURN = "struct<ix:bigint,role:string,text:string>"


def debounced(turns: DataFrame, pause_ms: int = 220, most: int = 500) -> DataFrame:
    """A stream of `turns(thread_id, ix, role, text)` -> a row for each pause of a thread: thread_id, n_turns, paused, and `turns`, in order, those since the row before.

    A new turn puts the row off, so input that keeps coming gives one row `pause_ms` of processing time after its last turn. State is the turns that wait; a thread that has `most` of them gives a row at once, with paused = false.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in state.get[0]] if state.exists else []
        paused = state.hasTimedOut
        if not paused:
            for batch in batches:
                held += zip(batch["ix"].astype(object).where(batch["ix"].notna(), None), batch["role"], batch["text"])
        if paused or len(held) >= most:
            state.remove()
            held.sort(key=lambda x: (x[0] is not None, x[0] or 0))
            rows = [{"ix": i, "role": r, "text": t} for i, r, t in held]
            yield pd.DataFrame({"thread_id": [key[0]], "n_turns": [len(held)], "paused": [paused], "turns": [rows]})
            return
        state.update((held,))
        state.setTimeoutDuration(pause_ms)

    lean = turns.select(F.col("thread_id").cast("string").alias("thread_id"), F.col("ix").cast("long").alias("ix"), "role", "text")
    return lean.groupBy("thread_id").applyInPandasWithState(update, f"thread_id string, n_turns long, paused boolean, turns array<{TURN}>", f"held array<{TURN}>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def retained_window(turns: DataFrame, strong: str, max_messages: int = 20, max_sticky: int = 160, backtrack: int = 4, max_days: int = 3, late: str = "3 days") -> DataFrame:
    """A stream of `turns(thread_id, ix, ts, ...)` -> for each thread and trigger its `context_window` as it is then: thread_id, n_turns, reason and `window`, the numbers ix in order. `strong` is SQL: whether a turn demands something.

    State holds max_sticky + backtrack turns of a thread at most, each as its number, its time and whether it is strong: the last ones, or from `backtrack` before the first strong one on. A late turn takes its place by ix, unless it comes before all that is held of a longer thread. A thread is
    forgotten by event time, `max_days` after its last turn as the watermark (`late` behind the newest) passes; turns older than the watermark's days are no longer taken. As long as no turn is later than that, the window is that of a batch of the same turns.
    """
    most, span = max_sticky + backtrack, max_days * 86_400_000_000

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before, seen, latest_at, held = state.get if state.exists else (0, 0, 0, [])
        turns = {int(i): (int(at), bool(s)) for i, at, s in held}
        cut = min(turns, default=None)
        for batch in batches:
            for i, at, s in zip(batch["ix"], batch["at"], batch["strong"]):
                latest_at = max(latest_at, int(at))
                if int(i) in turns:
                    continue
                seen += 1
                if before and cut is not None and int(i) < cut:
                    before += 1  # it belongs to those that have gone
                else:
                    turns[int(i)] = (int(at), bool(s))
        order = sorted(turns)
        first = next((n for n, i in enumerate(order) if turns[i][1]), None)
        begin = max(0, first - backtrack) if first is not None else max(0, len(order) - most)
        gone, order = order[:begin], order[begin:]
        before += len(gone)
        if first is not None:
            window, reason = order[:max_sticky], "strong"
            order = order[:most]  # what comes after it can only be looked at if an earlier turn takes its place before it
        else:
            window, reason = [i for i in order[-max_messages:] if turns[i][0] >= latest_at - span], "rolling"
        state.update((before, seen, latest_at, [(i, *turns[i]) for i in order]))
        state.setTimeoutTimestamp(max(latest_at // 1000 + span // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"thread_id": [key[0]], "n_turns": [seen], "reason": [reason], "window": [window]})

    lean = turns.withWatermark("ts", late).select(F.col("thread_id").cast("string").alias("thread_id"), F.col("ix").cast("long").alias("ix"), "ts", F.unix_micros("ts").alias("at"), F.coalesce(F.expr(strong), F.lit(False)).alias("strong"))
    state = "before long, seen long, latest_at long, held array<struct<ix:bigint,at:bigint,strong:boolean>>"
    return lean.groupBy("thread_id").applyInPandasWithState(update, "thread_id string, n_turns long, reason string, window array<bigint>", state, "update", GroupStateTimeout.EventTimeTimeout)
