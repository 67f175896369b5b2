"""Streams against batches: the analysis behind a stream, pauses, and windows with retention."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from threadlens.operators import analyze as an
from threadlens.operators import corpus
from threadlens.operators import prefilter as pf
from threadlens.streaming import threads as st

SCHEMA = "thread_id string, ix long, role string, text string"
SAID = ["인증번호 알려 주세요", "네 알겠습니다", "점심 먹자", "앱 설치하고 원격 연결해 주세요", "https://bit.ly/abc 눌러서 입금해 주세요", "지금 바로 안전계좌로 이체하세요", "저는 신청한 적 없어요", None, "검찰 수사관입니다. 계좌가 범죄에 연루되었습니다"]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def threads(rng, n=14):
    rows = []
    for t in range(n):
        roles = rng.choice([["U"], ["S", "R"], ["U", "S"], [None]])
        rows += [(f"t{t}", i, rng.choice(roles), rng.choice(SAID)) for i in range(rng.randint(1, 7))]
    return rows


@pytest.mark.parametrize("seed", [1])
def test_live_analysis_is_that_of_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = threads(rng)
    whole = spark.createDataFrame(rows, SCHEMA)
    rng.shuffle(rows)  # turns come in any order
    cut = rng.randrange(5, len(rows) - 5)
    for n, part in enumerate((rows[:cut], rows[cut:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    folder = f"file://{tmp_path}/store"
    assert st.latest(spark, folder) is None
    update = st.live_analysis(folder, buckets=4)
    q = stream.writeStream.foreachBatch(update).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    want = rows_of(an.analyze(whole))
    assert len(want) == 14 and any(r[1] > 20 for r in want)
    assert rows_of(st.latest(spark, folder).select(an.analyze(whole).columns)) == want
    if seed == 1:  # a batch that is run again changes nothing
        again = spark.read.schema(SCHEMA).json(str(tmp_path / "in" / "1"))
        last = spark.read.parquet(f"{folder}/turns").agg(F.max("batch")).first()[0]
        files = {r.batch: r.n for r in spark.read.parquet(f"{folder}/turns").groupBy("batch").agg(F.count("*").alias("n")).collect()}
        if files[last] == again.count():
            update(again, last)
            assert rows_of(st.latest(spark, folder).select(an.analyze(whole).columns)) == want


def test_gate_before_the_analysis(spark, tmp_path):
    whole = spark.createDataFrame([("a", 1, "S", SAID[0]), ("b", 1, "S", "점심 먹자"), ("c", 1, "U", SAID[4]), ("d", 1, "R", SAID[4]), ("d", 2, "S", "응")], SCHEMA)
    st.live_analysis(f"file://{tmp_path}", gate=True)(whole, 0)
    said = spark.createDataFrame([("a", SAID[0]), ("b", "점심 먹자"), ("c", SAID[4]), ("d", "응")], "thread_id string, text string")
    passed = {r.thread_id for r in pf.prefilter(said).where("gate_pass").collect()}
    assert {r.thread_id for r in st.latest(spark, f"file://{tmp_path}").collect()} == passed == {"a", "c"}


def test_one_row_for_each_pause(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def put(n, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(str(tmp_path / "part" / str(n)))
        (tmp_path / "part" / str(n)).rename(tmp_path / "in" / str(n))

    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
    q = st.debounced(stream, 5000, most=4).writeStream.outputMode("append").format("memory").queryName("pauses").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()

    def wait(ready):
        until = time.time() + 60
        while not ready() and time.time() < until:
            time.sleep(0.1)
        assert ready()

    taken = lambda: sum(p["numInputRows"] for p in q.recentProgress)
    found = lambda: spark.sql("select thread_id, n_turns, paused, transform(turns, x -> x.ix) ix from pauses").collect()
    try:
        put(1, [("a", 1, "S", "x")])
        wait(lambda: taken() == 1)
        put(2, [("a", 2, "S", None), ("b", 1, "R", "y")])  # within the pause: the first turn's row is put off
        wait(lambda: taken() == 3)
        assert not found()
        wait(lambda: len(found()) == 2)
        assert {(r.thread_id, r.n_turns, r.paused, *r.ix) for r in found()} == {("a", 2, True, 1, 2), ("b", 1, True, 1)}
        put(3, [("a", 3, "S", "z")])
        wait(lambda: len(found()) == 3)
        put(4, [("c", i, "S", "z") for i in (3, 1, 2, 0)])  # as many as may wait
        wait(lambda: len(found()) == 4)
        assert {(r.thread_id, r.n_turns, r.paused, *r.ix) for r in found()} >= {("a", 1, True, 3), ("c", 4, False, 0, 1, 2, 3)}
    finally:
        q.stop()


def test_retained_window_is_that_of_the_batch(spark, tmp_path):
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for t in range(12):
        at = start
        for i in range(rng.choice([3, 25, 60])):
            at += dt.timedelta(hours=rng.choice([1, 2, 5, 20]))
            rows.append((f"t{t}", i, at, "strong" if t % 3 == 0 and rng.random() < 0.05 else "weak"))
    schema = "thread_id string, ix long, ts timestamp, kind string"
    whole = spark.createDataFrame(rows, schema)
    parts = [[], [], []]
    for t in range(12):  # each thread's turns over three batches, some of them late
        own = [r for r in rows if r[0] == f"t{t}"]
        for k, r in enumerate(own):
            parts[min(2, max(0, 3 * k // len(own) + rng.choice([0, 0, 1])))].append(r)
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    limits = {"max_messages": 8, "max_sticky": 30, "backtrack": 4, "max_days": 3}
    window = st.retained_window(stream, "kind = 'strong'", **limits, late="400 days")
    q = window.writeStream.outputMode("update").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    last = spark.sql("select thread_id, max_by(struct(reason, window), n_turns) w, max(n_turns) n from windows group by 1").collect()
    want = {}
    for r in corpus.context_window(whole, F.col("kind") == "strong", **limits).orderBy("thread_id", "ix").collect():
        want.setdefault(r.thread_id, (r.reason, []))[1].append(r.ix)
    assert {r.thread_id: (r.w.reason, r.w.window) for r in last} == want and {w[0] for w in want.values()} == {"strong", "rolling"}
    assert {r.thread_id: r.n for r in last} == {r.thread_id: r.n for r in whole.groupBy("thread_id").agg(F.count("*").alias("n")).collect()}
