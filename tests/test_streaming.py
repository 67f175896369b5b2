"""A stream gives what the batch gives."""

from pyspark.sql import functions as F

from threadlens.operators import analyze as an
from threadlens.streaming import live

SCHEMA = "thread_id string, ix long, role string, text string"
ROWS = [("a", 1, "S", "인증번호 알려 주세요"), ("a", 2, "S", "인증번호 다시 알려 주세요"), ("b", 1, "S", "점심 먹자"), ("a", 3, "R", "네")]


def test_running_scores(spark, tmp_path):
    batch = spark.createDataFrame(ROWS, SCHEMA)
    batch.where("ix < 2").coalesce(1).write.json(str(tmp_path / "in" / "1"))
    batch.where("ix >= 2").coalesce(1).write.json(str(tmp_path / "in" / "2"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = live.running_scores(stream).writeStream.outputMode("update").format("memory").queryName("scores").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("select thread_id, max(n_turns) n, max(score) s from scores group by 1").collect()
    hits = batch.where("role <> 'R'").select("thread_id", "ix", F.posexplode(an.rule_hits("text")).alias("ord", "h")).select("thread_id", "ix", "ord", "h.*")
    want = {r[0]: r[1] for r in an.diminished(hits).groupBy("thread_id").agg(F.least(F.lit(100.0), F.round(F.sum("diminished"), 2))).collect()}
    assert {r.thread_id: r.s for r in got} == {"a": want["a"], "b": want.get("b", 0.0)}
    assert {r.thread_id: r.n for r in got} == {"a": 2, "b": 1}


def test_recent_turns(spark, tmp_path):
    batch = spark.createDataFrame([("a", i, "S", f"t{i}") for i in range(5)], SCHEMA)
    batch.where("ix < 3").coalesce(1).write.json(str(tmp_path / "in" / "1"))
    batch.where("ix >= 3").coalesce(1).write.json(str(tmp_path / "in" / "2"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = live.recent_turns(stream, 3).writeStream.outputMode("update").format("memory").queryName("recent").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select max_by(text, n_turns) from recent").first()[0] == "S: t2\nS: t3\nS: t4"


def test_batch_twins(spark):
    acts = spark.createDataFrame([("a", "copy_url"), ("a", "copy_url"), ("b", "open_url")], "thread_id string, kind string")
    assert {tuple(r) for r in live.action_counts(acts).collect()} == {("a", 2, 0, 0), ("b", 0, 1, 0)}
    late = spark.sql("SELECT 'a' AS thread_id, 1 AS ix, timestamp'2024-01-01' AS ts UNION ALL SELECT 'a', 2, timestamp'2024-01-09' UNION ALL SELECT 'a', 2, timestamp'2024-01-09'")
    assert [r.ix for r in live.within_days(late, "ts").collect()] == [2]
    turns = spark.createDataFrame(ROWS, SCHEMA)
    assert {r.thread_id for r in live.gated(turns).collect()} == {"a"}
