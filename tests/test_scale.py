"""Work that must not grow faster than the input: where patterns are tried, how rows are dealt."""

from threadlens.queries import tables

SF = "/root/testdata/sf0.001"


def test_patterns_are_not_tried_on_turns(spark):
    plan = tables._raw_hits(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "regexp_extract" not in plan


def test_frozen_numbers_that_hold_each_other(spark):
    from pyspark.sql import functions as F

    from threadlens.operators import corpus as co

    many = " ".join(str(n) for n in range(100000, 101100)) + " 1000 1001"
    rows = [(1, "1234 and 12345, 1234"), (2, many), (3, None), (4, "77 none")]
    got = {r.i: r for r in spark.createDataFrame(rows, "i int, text string").select("i", co.frozen(F.col("text"), r"\d{4,}", "num").alias("t")).collect()}
    assert got[1].t == "<NUM_1> and <NUM_2>, <NUM_1>"
    assert got[2].t == " ".join(f"<NUM_{n}>" for n in range(1, 1103))
    assert got[3].t is None and got[4].t == "77 none"


def test_windows_of_threads_sort_no_features(spark, monkeypatch):
    from threadlens.operators import analyze as an

    seen, plain = [], an._around
    monkeypatch.setattr(an, "_around", lambda t: seen.append(t.columns) or plain(t))
    turns = spark.createDataFrame([("a", 0, "S", "call 1"), ("a", 1, "R", "call 1")], "thread_id string, ix long, role string, text string")
    assert [(r.ix, r.text) for r in an.turn_table(turns).orderBy("ix").collect()] == [(0, "call 1"), (1, "call 1")]
    assert [sorted(c) for c in seen] == [["hint", "ix", "mark", "q_otp", "role", "thread_id"]]


def test_words_near_a_bank(spark):
    from pyspark.sql import functions as F

    from threadlens.functions import urls as ux

    words = ["kbstar", "kbstarr", "kbsta", "kbst", "xbstar", "shinhan", "shinhna", "abc", "kakaobnk", ""]
    df = spark.createDataFrame([(f"{w}.com",) for w in words], "h string").withColumn("n", ux.named_host(F.col("h")))
    near = lambda a, b: df.select(F.min(F.levenshtein(F.lit(a), F.lit(b)))).first()[0]
    got = {r.h: r.b for r in df.select("h", ux.looks_like_brand(F.col("n"), F.lit(True)).alias("b")).collect()}
    assert got == {f"{w}.com": w != "" and any(1 <= near(w, t) <= 2 for t in ux.BANK_TOKENS if len(t) > 3) for w in words}


def test_length_of_a_vector_is_worked_out_once(spark):
    from pyspark.sql import functions as F

    from threadlens.operators import similarity as si

    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>").select(si.unit(F.col("v")).alias("u"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 1
    assert [r.u for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0], None]


def test_patterns_that_need_hangul(spark):
    from pyspark.sql import functions as F

    from threadlens.functions.text import needs_hangul
    from threadlens.operators import analyze as an
    from threadlens.queries.templates import SENTENCES

    assert [needs_hangul(p) for p in ("가나", "(가|나)b", "(가|b)", "x가?", "(가나)+", "[가b]", "a(?=가)", "(가.{0,3}|b나)\\s*c", "apk|앱")] == [True, True, False, False, True, False, False, True, False]
    texts = [*SENTENCES, *("".join(x if x < "가" else "" for x in s) for s in SENTENCES), "", "otp apk anydesk https://bit.ly/x KT VIP gov24 2fa", "가"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain, skip = an.matches, lambda patterns, text="text", prefix="(?i)", hangul=None: plain(patterns, text, prefix)
    got = [str(sorted(map(str, an.text_features(df).collect())))]
    try:
        an.matches = skip
        got.append(str(sorted(map(str, an.text_features(df).collect()))))
    finally:
        an.matches = plain
    assert got[0] == got[1] and got[0].count("rule_id") > 50
    assert "hangul" not in an.text_features(df).columns
    assert df.where(F.rlike("text", F.lit(an.HANGUL))).count() == sum(any("가" <= c <= "힣" for c in t) for t in texts)


def test_known_texts_are_not_tried_again(spark, monkeypatch):
    from threadlens.operators import analyze as an

    turns = lambda *texts: spark.createDataFrame([("a", i, "S", t) for i, t in enumerate(texts)], "thread_id string, ix long, role string, text string")
    known = an.marked_features(an.marked(turns("인증번호 알려 주세요", "call 1")))
    seen, plain = [], an.text_features
    monkeypatch.setattr(an, "text_features", lambda texts: seen.append(sorted(r.text for r in texts.collect())) or plain(texts))
    both = turns("인증번호 알려 주세요", "call 1", "anydesk 설치해 주세요")
    got = an.analyze(both, known=known).collect()
    assert seen == [["anydesk 설치해 주세요"]] and got == an.analyze(both).collect()


def test_rebuilt_thread_takes_its_parts_apart_once(spark):
    from pyspark.sql import functions as F

    from threadlens.operators import engineering as en

    df = spark.createDataFrame([("S: a\nR: b\nS: c", "x\ny"), ("S: a\nR: b\nS: c", "x y"), ("S: a\nS: c", "x\ny\nz w"), ("R: b", "x"), (None, "x"), ("S: a", None)], "p string, c string").select(en.rebuilt_thread(F.col("p"), F.col("c")).alias("t"))
    assert [r.t for r in df.collect()] == ["S: x\nR: b\nS: y", "S: x y\nR: b\nS: c", "S: x\nS: y z w", "R: b", "", ""]
    assert df._jdf.queryExecution().analyzed().toString().count("^\\s*S:") <= 1


def test_mutants_are_dealt_over_all_cores(spark, monkeypatch):
    from threadlens.operators import mutants as mu

    seen, plain = [], mu.gated
    monkeypatch.setattr(mu, "gated", lambda c, *more: seen.append(c.rdd.getNumPartitions()) or plain(c, *more))
    t = spark.createDataFrame([(f"t{i}", f"S: please call the office {i}\nR: ok\nS: call the office now") for i in range(20)], "thread_id string, text string")
    assert mu.mutants(t, mu.Preset(n=1, tries=1, target=None)).count() == 20
    assert seen and min(seen) >= 8


def test_corpus_rules_over_ends_of_lines(spark):
    import random

    from threadlens.plans import decisions as de
    from threadlens.queries import decisions as qd

    rng = random.Random(4)
    sides = sorted({x for pair in de.seams() for x in pair})
    pieces = [*sides, "통합 신고 대응 센터", "보이스 피싱", "계좌 이체", "otp", "plain", "", " ", "faq", "문자", "apk\n설치"]
    rows = [(f"t{t}", i if rng.random() < 0.97 else 0, "S", rng.choice([None, *(" ".join(rng.choices(pieces, k=rng.randint(1, 3))) for _ in range(8))])) for t in range(250) for i in range(rng.randint(1, 6))]
    rows += [(f"s{n}", i, "S", text) for n, (a, b) in enumerate(de.seams()) for i, text in enumerate((f"x {a} ", "", f" {b} y"))]
    rows += [("u", 0, "S", "통합 보이스피싱"), ("u", 1, "S", "신고 안내"), ("v", 0, "S", "로그인 인증"), ("v", 1, "S", "문자 확인")]
    turns = spark.createDataFrame(rows, "thread_id string, ix long, role string, text string")
    got, want = (sorted(map(tuple, f(turns).collect())) for f in (qd._counted, qd._body_counts))
    assert got == want and len(got) == len({r[0] for r in rows})


def test_corpus_rules_are_tried_once_on_each_line(spark, monkeypatch):
    from threadlens.queries import decisions as qd

    seen, plain = [], qd._body_counts
    monkeypatch.setattr(qd, "_body_counts", lambda turns: seen.append(turns.select("thread_id").distinct().count()) or plain(turns))
    texts = ("문자 로그인 인증", "은행 보안 점검", "지금 즉시", "계좌 이체 바랍니다")
    turns = spark.createDataFrame([(f"t{t}", i, "S", text) for t in range(9) for i, text in enumerate(texts)], "thread_id string, ix long, role string, text string")
    assert qd._counted(turns).count() == 9 and seen == [0]


def test_corpus_counts_keep_their_names(spark):
    import re

    from threadlens.queries import decisions as qd

    turns = spark.createDataFrame([("t", 0, "S", "통합 보이스피싱"), ("t", 1, "S", "신고 안내"), ("u", 0, "S", "계좌 이체")], "thread_id string, ix long, role string, text string")
    for made in (qd._counted(turns), qd._body_counts(turns)):
        plan = made._jdf.queryExecution().optimizedPlan()
        assert not re.search(r"n_\d+#\d+ AS n_\d+", plan.toString())  # each doubles what is inferred from the signature
        assert plan.constraints().size() < 200
