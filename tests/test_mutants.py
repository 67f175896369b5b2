"""Mutants of threads: gates, attempts, and the same result for any partitioning."""

from dataclasses import replace

from threadlens.operators import mutants as mu
from threadlens.operators.analyze import analyze
from threadlens.queries import queries

PRESET = replace(mu.PRESETS["fast200_v2"], n=2, tries=2, target=None)


def grams(text):
    t = " ".join(text.lower().split())
    return {t[i : i + 3] for i in range(len(t) - 2)}


def sender(text):
    return "\n".join(line[3:] for line in text.split("\n") if line.startswith("S: "))


def test_followers(spark):
    df = spark.createDataFrame([("aa bb aa cc",), ("aa bb\naa dd 12",)], "t string")
    assert {r.before: r.fills for r in mu.followers(df, "t", 2).collect()} == {"": ["aa"], "aa": ["bb", "cc"], "bb": ["aa"]}


def test_loop(spark):
    made = queries()["gen_scenarios"](spark, "/root/testdata/sf0.001").where("attempt IS NOT NULL AND crc32(CAST(id AS BINARY)) % 8 = 0")
    t = spark.createDataFrame([*made.select("id", "thread").collect(), ("none", None), ("only", "R: x")], "thread_id string, text string")
    got = [mu.mutants(t.repartition(p), PRESET, seed=5).collect() for p in (1, 6)]
    assert sorted(map(str, got[0])) == sorted(map(str, got[1]))
    parents = {r.thread_id: r.text for r in t.collect() if r.text and "S: " in r.text}
    assert sorted((r.thread_id, r.variant) for r in got[0]) == sorted((p, v) for p in parents for v in (1, 2))
    kept = [r for r in got[0] if r.attempt]
    assert len({r.drop_reason for r in got[0]}) > 2
    assert kept and {r.attempt for r in kept} == {1, 2} and all(r.text is None and r.drop_reason for r in got[0] if not r.attempt)
    for r in kept:
        a, b = sender(parents[r.thread_id]), sender(r.text)
        assert {w for w in PRESET.anchors if w in a} == {w for w in PRESET.anchors if w in b}
        distance = 1 - len(grams(a) & grams(b)) / len(grams(a) | grams(b))
        assert abs(distance - r.distance) < 0.05 and PRESET.least <= r.distance <= PRESET.most and r.similarity >= PRESET.sim
        assert [x for x in r.text.split("\n") if not x.startswith("S: ")] == [x for x in parents[r.thread_id].split("\n") if not x.startswith("S: ")]
    again = lambda rows: {r.thread_id: (r.risk_level, r.stage_peak, r.score_total) for r in analyze(mu._turns(spark.createDataFrame(rows, "thread_id string, thread string"))).collect()}
    before, after = again(list(parents.items())), again([(f"{r.thread_id}#{r.variant}", r.text) for r in kept])
    for r in kept:
        assert after[f"{r.thread_id}#{r.variant}"] == (r.got_risk, r.got_stage, r.got_score) and before[r.thread_id][:2] == (r.got_risk, r.got_stage)
    few = mu.mutants(t, replace(PRESET, target=3), seed=5).collect()
    assert [(r.attempt, r.thread_id, r.variant) for r in few] == sorted((r.attempt, r.thread_id, r.variant) for r in kept)[:3]


def test_nothing_to_do(spark):
    assert mu.mutants(spark.createDataFrame([("x", None)], "thread_id string, text string"), PRESET).count() == 0
