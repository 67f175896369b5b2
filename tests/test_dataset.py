"""The engine held against expected rows: by hand, and against plain Python on templated cases."""

import json
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.operators import analyze as an
from threadlens.operators import dataset as ds
from threadlens.operators.prefilter import prefilter
from threadlens.plans import catalog as cat
from threadlens.queries.dataset import cases_and_turns
from threadlens.session import table, written

SF = "/root/testdata/sf0.001"
RANK = ["info", "verify", "install", "payment"]


@pytest.fixture(scope="module")
def small(spark):
    cases, turns = (written(x) for x in cases_and_turns(table(spark, SF, "events")))
    return cases, turns, written(ds.engine_results(cases, turns))


def lines(spark, rows):
    return spark.read.schema(ds.SCHEMA).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


def test_rows_by_hand(spark):
    scam = "S: 지금 바로 500000원을 안전 계좌로 이체해 주세요\nR: 네"
    rows = [
        {"id": "scam", "thread": scam, "expected": {"riskLevel": "HIGH", "score_min": 20, "stage_peak": "payment", "triggered": True}},
        {"id": "alias", "threadText": scam, "expected": {"riskLevel": "low", "score_min": 1000, "stagePeak": "verify", "triggered": False}},
        {"id": "left-over", "thread": "S: 오늘 점심 같이 먹을래요\nR: 그래", "expected": {"riskLevel": "low", "score_min": 0, "stagePeak": "info"}, "should_trigger": ["old"]},
        {"id": "wanted", "thread": "S: 오늘 점심 같이 먹을래요", "expected": {"riskLevel": "low"}, "should_trigger": ["old"]},
        {"id": "called", "thread": "", "expected": {"riskLevel": "low", "triggered": True}, "callChecks": {"otpAsked": True}},
        {"id": "empty", "thread": None, "expected": {"riskLevel": "low", "triggered": False}},
        {"id": "nothing", "thread": scam}, {"thread": scam, "expected": {"riskLevel": "high"}},
    ]
    cases, turns = ds.cases_of(lines(spark, rows))
    got = {r.case_id: r for r in ds.evaluate(cases, turns.union(turns.limit(1).withColumn("thread_id", F.lit("other")))).collect()}
    assert set(got) == {r["id"] for r in rows if "id" in r}
    assert got["scam"].passed and got["scam"].why == [] and got["scam"].sender_text.startswith("지금")
    assert got["alias"].why == ["risk_mismatch", "score_below_min", "stage_mismatch", "triggered_mismatch"]
    assert got["left-over"].passed and got["left-over"].want_triggered is False and not got["left-over"].got_triggered
    assert got["wanted"].want_triggered and got["wanted"].why == ["triggered_mismatch"]
    assert got["called"].got_triggered and got["called"].score_total == 30 and got["called"].passed
    assert got["empty"].passed and got["empty"].score_total == 0 and got["empty"].stage_peak == "info" and got["empty"].ids == []
    assert got["nothing"].why == ["risk_mismatch"]
    with pytest.raises(ValueError):
        ds.evaluate(cases, turns, "both")


def test_shown_level(spark):
    done = "R: 인증번호 알려줬어요"
    rows = [{"id": "a", "thread": done, "expected": {"riskLevel": "high"}}, {"id": "b", "thread": done, "expected": {"riskLevel": "low", "uiRiskLevel": "high"}}, {"id": "c", "thread": done, "expected": {"riskLevel": "high", "threatRiskLevel": "low", "score_min": 1}}]
    cases, turns = ds.cases_of(lines(spark, rows))
    got = ds.engine_results(cases, turns)
    first = got.first()
    assert (first.risk_level, first.ui_level) == ("low", "high") and first.ui_score > first.score_total
    whys = lambda mode: {r.case_id: r.why for r in ds.verdicts(cases, got, mode).collect()}
    assert whys("ui")["a"] == [] and whys("threat")["a"] == ["risk_mismatch"]
    failed = {r.case_id: r for r in ds.exported_fails(cases, got).collect()}
    assert failed["a"].why == ["risk high -> low"] and not failed["a"].prefer_ui and "b" not in failed and failed["c"].why == ["score 0 < 1"]


def test_engine(spark, small):
    """Results are those of the parts, put together in Python."""
    cases, turns, results = small
    got = {r.case_id: r for r in results.collect()}
    assert set(got) == {r.case_id for r in cases.collect()}
    alone = {r.thread_id: r for r in an.analyze(turns).collect()}
    rows = defaultdict(list)
    for r in turns.collect():
        rows[r.thread_id].append(r)
    texts = [(k, "\n".join((f"{t.role}: " if t.role != "U" else "") + t.text for t in sorted(v, key=lambda t: t.ix))) for k, v in rows.items()]
    pf = {r.thread_id: r for r in prefilter(spark.createDataFrame(texts, "thread_id string, text string")).collect()}
    t = written(an.turn_table(turns))
    stages, sums, first = defaultdict(set), Counter(), {}
    for r in t.collect():
        stages[r.thread_id].add(r.stage)
    for r in an.weighed_hits(t).collect():
        sums[r.thread_id, r.rule_id] += r.diminished
        key = (-r.diminished, r.ix, r.ord)
        if (r.thread_id, r.rule_id) not in first or key < first[r.thread_id, r.rule_id][0]:
            first[r.thread_id, r.rule_id] = key, r.stage
    heaviest = defaultdict(list)
    for (k, rule), w in sums.items():
        heaviest[k].append((round(w, 2), rule))
    for k, r in got.items():
        assert (r.score_total, r.risk_level, r.hard_high, r.n_hits) == (alone[k].score_total, alone[k].risk_level, alone[k].hard_high, alone[k].n_hits)
        assert (r.pf_score, r.pf_action, r.gate_pass) == (pf[k].score, pf[k].action, pf[k].gate_pass)
        top = max((w for w, _ in heaviest[k]), default=0)
        assert abs(r.top_weight - top) < 0.01 and r.ids == sorted(i for _, i in heaviest[k])
        if len(heaviest[k]) <= 12:
            assert RANK.index(r.stage_peak) == max(map(RANK.index, stages[k] | {first[k, i][1] for _, i in heaviest[k]}))
        strong = r.n_hits > 0 and (r.score_total >= 15 and r.top_weight >= 20 if r.risk_level == "low" else r.score_total >= 58 and r.top_weight >= 20)
        assert r.got_triggered == (strong or r.pf_score >= cat.PREFILTER_SOFT or r.pf_action != "none" or r.score_total >= cat.PREFILTER_SOFT)
    assert len({r.got_triggered for r in got.values()}) == 2 and {r.risk_level for r in got.values()} == {"low", "medium", "high"}


def python_why(c, r):
    want = c.exp_triggered if c.exp_triggered is not None else None if not c.n_should else not (c.exp_risk == "low" and c.exp_stage == "info" and c.exp_score_min <= 0)
    tests = [("risk_mismatch", r.risk_level != c.exp_risk), ("score_below_min", r.score_total < c.exp_score_min), ("stage_mismatch", r.stage_peak != c.exp_stage), ("triggered_mismatch", want is not None and want != r.got_triggered)]
    return [n for n, wrong in tests if wrong]


def test_verdicts_summary_and_labels(small):
    cases, _, results = small
    want, got = {c.case_id: c for c in cases.collect()}, {r.case_id: r for r in results.collect()}
    e = {r.case_id: r for r in ds.verdicts(cases, results).collect()}
    why = {k: python_why(want[k], got[k]) for k in want}
    assert {k: r.why for k, r in e.items()} == why and any(why.values()) and not all(why.values())
    n = Counter()
    for k, w in why.items():
        n["meta", "cases"] += 1
        n["meta", "fail" if w else "pass"] += 1
        n["expected", want[k].exp_risk] += 1
        n["got", got[k].risk_level] += 1
        for name, wrong in (("risk", "risk_mismatch"), ("score", "score_below_min"), ("stage", "stage_mismatch"), ("triggered", "triggered_mismatch")):
            n["holds", name] += wrong not in w
        for x in w:
            n["reason", x] += 1
        if w:
            n["risk_pair", f"{want[k].exp_risk}->{got[k].risk_level}"] += 1
            n["stage_pair", f"{want[k].exp_stage}->{got[k].stage_peak}"] += 1
    assert {(r.key, r.subkey): r.n for r in ds.dataset_summary(ds.verdicts(cases, results)).collect()} == {k: v for k, v in n.items() if v}
    again = ds.relabelled_cases(cases, results)
    assert {k for k, r in ((r.case_id, r) for r in again.collect()) if (r.exp_stage, r.exp_triggered) != (got[k].stage_peak, got[k].got_triggered)} == set()
    assert ds.verdicts(again, results).where("not passed").count() == 0  # what the engine gives, it meets
    assert ds.relabelled_cases(again.drop("changed"), results).where("changed").count() == 0


def grams(text):
    t = " ".join(text.lower().split())
    return {t[i : i + 3] for i in range(len(t) - 2)}


def test_report(spark, small):
    cases, _, results = small
    # a raised least score, so that distances are there
    e = written(ds.verdicts(cases.withColumn("exp_score_min", F.col("exp_score_min") + 40), results))
    fails = sorted(e.where("not passed").collect(), key=lambda r: r.seq)
    vectors = written(ds.text_vectors(e.where("not passed"), "seq", "sender_text"))
    v = {r.seq: np.array(r.v) for r in vectors.collect()}
    assert all(v[r.seq].sum() == len(grams(r.sender_text)) for r in fails)
    got = {(r.section, r.key): (r.n, r.detail and json.loads(r.detail)) for r in ds.failure_report(e, vectors, 0.7).collect()}
    assert {k: n for (s, k), (n, _) in got.items() if s == "reason"} == Counter(w for r in fails for w in r.why)
    assert {k: n for (s, k), (n, _) in got.items() if s == "risk_pair"} == Counter(f"{r.exp_risk}->{r.risk_level}" for r in fails)
    delta = sorted(r.exp_score_min - r.score_total for r in fails if "score_below_min" in r.why)
    at = lambda p: delta[int(p / 100 * (len(delta) - 1))]
    n, d = got["score_delta", "all"]
    assert n == len(delta) > 5 and (d["min"], d["p50"], d["p90"], d["max"]) == (delta[0], at(50), at(90), delta[-1]) and abs(d["avg"] - sum(delta) / n) < 0.001
    by = defaultdict(list)
    for r in fails:
        by[r.parent].append(r)
    top = sorted(by, key=lambda p: (-len(by[p]), p))[:20]
    assert {k for s, k in got if s == "parent"} == set(top)
    assert all(got["parent", p][0] == len(by[p]) and got["parent", p][1]["examples"] == [r.case_id for r in by[p][:5]] for p in top)
    unit = lambda x: x / (np.linalg.norm(x) or 1)
    leaders = []
    for r in fails:
        like = next((g for g in leaders if v[r.seq].any() and round(float(unit(v[g[0].seq]) @ unit(v[r.seq])), 9) >= 0.7), None)
        leaders.append([r]) if like is None else like.append(r)
    assert {k: n for (s, k), (n, _) in got.items() if s == "cluster"} == {g[0].case_id: len(g) for g in leaders}
    big = max(leaders, key=len)
    assert len(big) > 1 and set(got["cluster", big[0].case_id][1]["parents"]) <= {f"{p}({n})" for p, n in Counter(r.parent for r in big).items()}
    assert {k: n for k, n in ((tuple(r)[:2], r.n) for r in ds.failure_report(e).collect())} == {k: n for k, (n, _) in got.items() if k[0] != "cluster"}


def test_parents(spark):
    ids = ["MUT-KO-2031_e3v1-0001", "MUT-KO-2031-0001", "MUT-x-y-12", "plain", "KO-7"]
    got = {r.id: r.p for r in spark.createDataFrame([(i,) for i in ids], "id string").select("id", ds.parent_of(F.col("id")).alias("p")).collect()}
    assert got == {"MUT-KO-2031_e3v1-0001": "KO-2031_e3v1", "MUT-KO-2031-0001": "KO-2031", "MUT-x-y-12": "x-y", "plain": "unknown_parent", "KO-7": "KO-7"}
    assert re.match(r"KO-\d+", got["KO-7"])


def test_nothing(spark):
    cases, turns = ds.cases_of(lines(spark, []))
    e = ds.evaluate(cases, turns)
    assert e.count() == 0 and ds.dataset_summary(e).count() == 0
    e = e.withColumn("seq", F.lit(1).cast("long"))
    assert ds.failure_report(e, e.select("seq", F.array(F.lit(1.0)).alias("v"))).where("section <> 'score_delta'").count() == 0


def test_every_rule_fires_and_not(spark, small):
    """All rules of the catalogue and of the context are found in the templated cases, but for one that has a text here; none in all."""
    _, turns, results = small
    n = Counter(i for r in results.collect() for i in r.ids)
    more = spark.createDataFrame([("m", 1, "S", "정부 지원금 대상자는 조회하고 신청하세요")], "thread_id string, ix long, role string, text string")
    found = set(n) | {h.rule_id for r in an.turn_table(more).collect() for h in r.hits}
    assert {r[0] for r in cat.RULES} | {r[0] for r in an.CONTEXT} <= found
    assert max(n.values()) < results.count()
    whole = turns.groupBy("thread_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    assert set(cat.PREFILTER) <= {i for r in prefilter(whole).collect() for i in r.signal_ids}
