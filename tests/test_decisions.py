"""Sequences, risk, prefilter context, texts, links and files by hand."""

import io
import zipfile

from pyspark.sql import functions as F

from threadlens.functions import text as tx
from threadlens.functions import urls as ux
from threadlens.operators import analyze as an
from threadlens.operators import engineering as en
from threadlens.operators import prefilter as pf
from threadlens.sources import files

TURNS = "thread_id string, ix long, role string, text string, speaker string"


def test_denials_and_answers(spark):
    rows = [("a", 1, "U", "https://x.top/a 확인하세요", "가"), ("a", 2, "U", "그런 거 신청한 적 없는데요", "나"), ("b", 1, "U", "인증번호 6자리 알려 주세요", None), ("b", 2, "U", "네?", None), ("b", 3, "U", "제가 아닌데 왜 오죠", None), ("c", 1, "U", "https://x.top/a 확인하세요", "가"), ("c", 2, "U", "그래", "나")]
    got = {(r.thread_id, r.rule_id): r.weight for r in an.sequence_hits(an.turn_table(spark.createDataFrame(rows, TURNS))).collect()}
    assert got == {("a", "ctx_denial_after_link"): 14.0, ("b", "ctx_denial_after_otp"): 14.0}


def test_internal_notices_are_not_high(spark):
    rows = [("in", 1, "S", "사내 공지: 카톡 프로필 확인 https://intranet.example.com/notice", None), ("out", 1, "S", "인증번호 알려 줘 지금 바로 http://evil.top/a 링크 눌러 로그인", None)]
    got = {r.thread_id: (r.risk_level, r.hard_high) for r in an.analyze(spark.createDataFrame(rows, TURNS)).collect()}
    assert not got["in"][1] and got["out"] == ("high", True)


def test_prefilter_context(spark):
    base = "안녕 [kbstar.com](https://evil.top/x) 로그인"
    known = "named_struct('is_saved_contact', true, 'copy_url', 0, 'open_url', 0, 'install_click', 0, 'link_candidates', null, 'final_url', null, 'hops', 0, 'error', null)"
    clicked = "named_struct('is_saved_contact', false, 'copy_url', 1, 'open_url', 1, 'install_click', 0, 'link_candidates', null, 'final_url', 'https://xn--a.b', 'hops', 4, 'error', 'TIMEOUT')"
    t = spark.sql(f"SELECT 'k' AS thread_id, '{base}' AS text, CAST({known} AS {pf.CONTEXT}) AS context UNION ALL SELECT 'c', '{base}', CAST({clicked} AS {pf.CONTEXT}) UNION ALL SELECT 'n', null, null UNION ALL SELECT 'b', 'https://bare.example.org/x', null")
    got = {r.thread_id: r for r in pf.prefilter(t).collect()}
    assert "pf_url_display_mismatch" in got["k"].signal_ids and "pf_unknown_contact" not in got["k"].signal_ids
    assert got["c"].action == "auto" and {"pf_unknown_contact", "pf_combo_unknown_url", "pf_act_copy_url", "pf_combo_explicit_act", "pf_ctx_resolve_error", "pf_ctx_many_redirects", "pf_trigger_open_url"} <= set(got["c"].signal_ids)
    assert not got["n"].gate_pass and got["n"].score == 0 and "pf_url_bare_link" in got["b"].signal_ids


def test_links(spark):
    t = spark.createDataFrame([("hxxp://kbstaar.com/login, a[.]b.com/x 그리고 www.c.org.",)], "t string")
    assert {"http://kbstaar.com/login", "https://a.b.com/x", "https://www.c.org"} <= set(t.select(ux.loose_urls(F.col("t")).alias("u")).first().u)
    chain = ux.redirect_chain(spark.sql("SELECT 'https://x.com/?next=https%3A%2F%2Fy.com%2F%3Fu%3Dhttps%253A%252F%252Fx.com' AS u"), "u").first().chain
    assert chain[1].startswith("https://y.com/") and chain[-1] == "https://x.com" and len(chain) == 3
    hosts = spark.createDataFrame([("kbstaar.com", True), ("kbstar.com", False), ("kdstar.com", True), ("example.org", False), ("www.shinhan.com", False)], "h string, odd boolean")
    assert all(r.odd == r.got for r in hosts.select("odd", ux.looks_like_official(ux.named_host(F.col("h"))).alias("got")).collect())


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(tx.caller_number(F.lit("S: [ 발신 010 - 1234 - 5678 (지점)] 안녕"))) == "010-1234-5678"
    assert one(tx.without_caller(F.lit("S: [발신 1588-0000] 안녕\nR: 네"))) == "S: 안녕\nR: 네"
    assert one(tx.masked_replies(F.lit("S: 가\nR: 나\n다\nS: 라"))) == "S: 가\nR: (reply)\n(reply)\nS: 라"
    assert one(tx.portal_body(F.lit("로그인\n머리\n공지 게시글 보기\n본문\n본문\n둘째\n경찰청 누리집\n꼬리"))) == "본문\n둘째"
    assert one(tx.personal_phones(F.lit("+82 10-1234-5678 01012345678 02-123-4567 070-1234-5678"))) == ["010-1234-5678", "070-1234-5678"]
    r = one(tx.parsed_block(F.lit("[오전 10:21] 홍길동: 하이\n둘")))
    assert r.header == "[오전 10:21] 홍길동: 하이" and r.speaker == "홍" and r.content.endswith("둘")
    f = one(en.freeze(F.lit("https://a.b/c 010-1234-5678 ABC123 12345 끝")))
    assert "<URL_1>" in f.text and "12345" not in f.text and one(en.restored(F.lit(f.text), F.array(*(F.struct(F.lit(s.mark).alias("mark"), F.lit(s.raw).alias("raw")) for s in f.spans)))).text == "https://a.b/c 010-1234-5678 ABC123 12345 끝"
    assert one(en.rebuilt_thread(F.lit("S: a\nR: b\nS: c"), F.lit("x\ny\nz"))) == "S: x\nR: b\nS: y z"


def test_files(spark):
    page = '<meta charset="euc-kr"><p>보안 공지입니다</p>'
    assert files.decode(page.encode("cp949"))[0] == page and files.decode("한글".encode())[1] == "utf-8"
    assert files.repaired_name("한글".encode().decode("latin-1")) == "한글"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w:p>하나</w:p><w:p>둘</w:p>")
    df = spark.createDataFrame([("a.docx", out.getvalue()), ("b.pdf", b"x"), ("c.txt", "글".encode()), ("d.docx", b"no"), ("e.txt", None)], "name string, content binary")
    got = {r.name: (r.r.text, r.r.note) for r in df.select("name", files.attachment_texts(F.col("name"), F.col("content")).alias("r")).collect()}
    assert got == {"a.docx": ("하나\n둘", ""), "b.pdf": ("", "unsupported_ext"), "c.txt": ("글", ""), "d.docx": ("", "failed:BadZipFile"), "e.txt": ("", "missing")}
    lines = spark.createDataFrame([('{"a": 1}',), ("no json",)], "value string")
    assert [r.value for r in files.rewritten(lines, F.concat(F.lit("ok "), "value")).collect()] == ['ok {"a": 1}', "no json"]
