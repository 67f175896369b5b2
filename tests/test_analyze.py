"""Threads of our own sentences, and properties that must hold."""

import pytest
from pyspark.sql import functions as F

from threadlens.functions import text as tx
from threadlens.functions import urls as ux
from threadlens.operators import analyze as an
from threadlens.operators import corpus as co
from threadlens.operators import prefilter as pf
from threadlens.operators import similarity as si

THREADS = {
    "otp": ["은행 보안팀입니다. 인증번호 6자리를 지금 알려 주세요"],
    "transfer": ["검찰입니다. 지금 바로 안전 계좌로 500,000원 이체해 주세요"],
    "install": ["보안 앱 설치 후 anydesk 실행해 주세요"],
    "gift": ["상품권 구매 후 핀 번호를 보내 주세요"],
    "lunch": ["오늘 점심 같이 먹을래?", "좋아"],
    "empty": [None],
}


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(t, i, "S", x) for t, lines in THREADS.items() for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "thread_id string, ix long, role string, text string")


@pytest.fixture(scope="module")
def result(turns):
    return {r.thread_id: r for r in an.analyze(turns).collect()}


def test_stages_and_risk(result):
    assert result["otp"].risk_level == "high" and result["otp"].stage_peak == "verify"
    assert result["transfer"].risk_level == "high" and result["transfer"].stage_peak == "payment"
    assert result["install"].stage_peak == "install"
    assert result["gift"].stage_peak == "payment"
    assert result["lunch"].risk_level == "low"
    assert result["empty"].score_total == 0 and result["empty"].n_turns == 1


def test_order_and_partitions_do_not_matter(turns, result):
    again = {r.thread_id: r for r in an.analyze(turns.repartition(7).orderBy(F.desc("ix"))).collect()}
    assert again == result


def test_prefilter(spark):
    rows = [("a", "안전 계좌로 이체 바랍니다 지금 즉시"), ("b", "http://1.2.3.4/x.apk 링크 클릭"), ("c", "점심 먹자"), ("d", None)]
    got = {r.thread_id: r for r in pf.prefilter(spark.createDataFrame(rows, "thread_id string, text string")).collect()}
    assert got["a"].action == "auto" and "pf_combo_safe_xfer" in got["a"].signal_ids
    assert {"pf_url_ip_host", "pf_url_download", "pf_url_http"} <= set(got["b"].signal_ids)
    assert not got["c"].gate_pass and got["d"].score == 0


def test_url_glued_to_hangul(spark):
    df = spark.createDataFrame([("링크https://a.example/x 끝",)], "t string")
    assert df.select(ux.extract_urls(F.col("t"))).first()[0][0] == "https://a.example/x"


def test_normalisation_is_stable(spark):
    df = spark.createDataFrame([("a\r\n\r\n\r\n\r\nb\t c ",), ("",), (None,)], "t string")
    once = [r[0] for r in df.select(tx.normalize_thread(F.col("t"))).collect()]
    twice = [r[0] for r in df.select(tx.normalize_thread(tx.normalize_thread(F.col("t")))).collect()]
    assert once == twice == ["a\n\nb c", "", ""]


def test_consecutive_lines(spark):
    df = spark.createDataFrame([(1, "a\na\n\nb\na"), (2, None)], "id long, t string")
    assert [tuple(r) for r in co.drop_consecutive_lines(df, "id", "t").orderBy("id").collect()] == [(1, 4, 3), (2, 0, 0)]


def test_leaders(spark):
    rows = [("g", 1, 3.0, ["a", "b", "c"]), ("g", 2, 2.0, ["a", "b"]), ("g", 3, 1.0, ["x"])]
    got = si.leader_clusters(spark.createDataFrame(rows, "grp string, id long, score double, keys array<string>")).collect()
    assert {r.id: r.leader for r in got} == {1: 1, 2: 1, 3: 3}


def test_top_k_in_blocks(spark):
    rows = [(i, [float((i * 7) % 11), float((i * 3) % 5), 1.0]) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    one = si.top_k(df, df.where("id % 20 = 0"), "id", "v", 4)
    many = si.top_k(df, df.where("id % 20 = 0"), "id", "v", 4, block=1)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
