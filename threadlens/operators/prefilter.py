"""The prefilter: a cheap gate over the last lines of a thread, as stateless column expressions (batch or streaming alike)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.functions.text import java_pattern, recent_lines
from threadlens.functions.urls import (
    DOWNLOAD_ENDINGS, OFFICIAL_HOSTS, SHORTENERS, brand_token, host, is_under, looks_like_brand, looks_like_official, loose_urls, markdown_links, named_host, path_and_query, plain_url, protocol,
    redirect_target, registrable_domain,
)
from threadlens.plans import catalog as cat
from threadlens.session import spread, written


def _points(rows: list[tuple[str, Column | int, Column]]) -> Column:
    """(id, points) of the rows whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(c, F.struct(F.lit(i).alias("id"), (p if isinstance(p, Column) else F.lit(p)).cast("int").alias("points"))) for i, p, c in rows)))


def text_signals(text: Column) -> Column:
    t = F.lower(text)
    hit = {i: F.rlike(t, F.lit(java_pattern(p))) for i, (_, p) in cat.PREFILTER.items()}
    rows = [(i, cat.PREFILTER[i][0], hit[i]) for i in cat.PREFILTER]
    rows.append(("pf_benefit_link_mention", cat.PREFILTER_BENEFIT_LINK[0], hit["pf_benefit_hook"] & F.rlike(t, F.lit(cat.PREFILTER_BENEFIT_LINK[1]))))
    rows.append(("pf_benefit_pii", cat.PREFILTER_BENEFIT_PII[0], hit["pf_benefit_hook"] & F.rlike(t, F.lit(cat.PREFILTER_BENEFIT_PII[1]))))
    return _points(rows)


def url_signals(urls: str, hosts: str) -> Column:
    """Signals of the columns named: `urls`, an array of URLs with schemes, and `hosts`, their distinct hosts."""
    n = F.size(urls)
    any_host = lambda test: F.exists(hosts, test)
    any_url = lambda test: F.exists(urls, test)
    ending = lambda u: F.exists(F.array(*(F.lit(e) for e in DOWNLOAD_ENDINGS)), lambda e: F.regexp_extract(path_and_query(u), r"^([^?]*)", 1).endswith(e))
    return _points([
        ("pf_url_present", 8, n > 0),
        ("pf_url_many", F.when(n >= 8, 18).when(n >= 5, 14).otherwise(10), n >= 3),
        ("pf_url_many_hosts", F.when(F.size(hosts) >= 6, 18).otherwise(12), F.size(hosts) >= 3),
        ("pf_url_shortener", 22, any_host(lambda h: h.isin(*SHORTENERS))),
        ("pf_url_http", 20, any_url(lambda u: protocol(u) == "http")),
        ("pf_url_ip_host", 24, any_host(lambda h: F.rlike(h, F.lit(r"^\d{1,3}(\.\d{1,3}){3}\z")))),
        ("pf_url_punycode", 18, any_host(lambda h: h.contains("xn--"))),
        ("pf_url_deep_sub", 12, any_host(lambda h: F.size(F.split(h, r"\.")) >= 5)),
        ("pf_url_redirect_param", 16, any_url(lambda u: F.rlike(u, F.lit(r"(?i)[?&](url|u|redirect|redirect_url|redirect_uri|target|dest|destination|next|continue|return)=")))),
        ("pf_url_download", 35, any_url(ending)),
        ("pf_url_at_sign", 22, any_url(lambda u: F.rlike(u, F.lit(r"^[a-z]+://[^/]*@")))),
        ("pf_url_zero_width", 18, any_url(lambda u: F.rlike(u, F.lit(r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]")))),
        ("pf_url_double_slash", 10, any_url(lambda u: F.rlike(path_and_query(u), F.lit("//")))),
    ])


#: What claims to be a bank, and hints that let a whole thread pass.
BANK_CLAIM = (r"(은행|뱅크|bank|고객센터|인터넷\s*뱅킹|모바일\s*뱅킹|보안\s*카드|금융)", r"(로그인|인증|otp|오티피|보안|계좌|카드|이체|송금|결제)")
GLOBAL_HINTS = (
    r"(?:계\s*정|계정|아이\s*디|아이디|id|로그\s*인|로그인|비밀\s*번호|비밀번호).{0,48}(?:도\s*용|도용|해\s*킹|해킹|탈\s*취|탈취|잠\s*김|잠김|잠\s*금|잠금|정\s*지|정지|차\s*단|차단|복\s*구|복구|확\s*인|확인|인\s*증|인증|점\s*검|점검)",
    r"(?:이상\s*거래|비정상\s*거래|부정\s*사용|부정\s*결제|명의\s*도용|계\s*좌\s*도용|계좌\s*도용|계\s*정\s*도용|계정\s*도용|해외\s*결제|승인\s*내역|결제\s*내역)",
    r"(?:지원금|보조금|환급|환불|장려금|바우처|쿠폰|재난\s*지원|민생\s*지원|소상공인\s*지원|근로\s*장려금|자녀\s*장려금|청년\s*지원|대상자\s*(?:조회|확인)|정부\s*24|정부24|gov\s*24|gov24)",
    r"(?:카\s*톡|카톡|카카오\s*톡|카카오톡|카카오|kakao|오픈\s*채팅|오픈채팅|텔레그램|telegram|프로필|채팅방|톡방|dm|쪽지).{0,64}(?:링크|url|주소|접속|클릭|확인|초대)",
    r"(?:링크|url|주소)(?:\s*(?:로|에서|를|에|으로|으로써))?.{0,24}(?:클릭|접속|눌러|확인|들어가|진행|신청|조회|인증)",
)
#: What a client may know of a thread beside its text.
CONTEXT = "struct<is_saved_contact:boolean,copy_url:int,open_url:int,install_click:int,link_candidates:array<struct<text:string,href:string>>,final_url:string,hops:int,error:string>"


def named_hosts(hosts: str) -> Column:
    """The hosts of the column named as structs, with their bank word."""
    return F.transform(F.filter(hosts, lambda h: h != ""), lambda h: F.struct(named_host(h).alias("n"), brand_token(h).alias("brand")))


def bank_claims(text: Column) -> Column:
    """Whether a text claims to be a bank."""
    return F.rlike(F.lower(text), F.lit(BANK_CLAIM[0])) & F.rlike(F.lower(text), F.lit(BANK_CLAIM[1]))


def bank_signals(urls: str, hosts: str, claims_col: str) -> Column:
    """Signals of hosts that are like a bank's. `urls`, `hosts` (of `named_hosts`) and `claims_col` (of `bank_claims`) name columns, so that each is worked out once, not for every host and word."""
    claims = F.col(claims_col)
    foreign = lambda test: F.exists(hosts, lambda x: ~is_under(x["n"]["host"], OFFICIAL_HOSTS) & test(x))
    branded = foreign(lambda x: F.coalesce((F.length(x["brand"]) > 3) | claims & x["brand"].isNotNull(), F.lit(False)))
    onward = F.exists(urls, lambda u: ~is_under(host(u), OFFICIAL_HOSTS) & is_under(host(redirect_target(u)), OFFICIAL_HOSTS))
    return _points([
        ("pf_url_redirect_to_official", 24, onward), ("pf_url_bank_brand", 24, branded),
        ("pf_url_bank_typosquat", 30, foreign(lambda x: looks_like_official(x["n"]) | looks_like_brand(x["n"], claims))),
        ("pf_url_bank_claim_nonofficial", 18, claims & foreign(lambda x: F.lit(True))), ("pf_url_many_mix", 10, (F.size(urls) >= 3) & (F.size(hosts) >= 3)),
    ])


def display_mismatch(links: Column) -> Column:
    """Whether a link's text names another host than its address, or an official one where the address is none."""
    named = lambda x: F.slice(F.array_distinct(F.regexp_extract_all(F.lower(x["text"]), F.lit(r"(?:[a-z0-9-]+\.)+[a-z]{2,}"), F.lit(0))), 1, 4)

    def same(h: Column, t: Column) -> Column:
        return (h == t) | h.endswith(F.concat(F.lit("."), t)) | t.endswith(F.concat(F.lit("."), h)) | (registrable_domain(h) == registrable_domain(t))

    def odd(x: Column) -> Column:
        h = host(plain_url(x["href"]))
        official = F.exists(named(x), lambda t: is_under(t, OFFICIAL_HOSTS)) & ~is_under(h, OFFICIAL_HOSTS)
        return (h != "") & (F.size(named(x)) > 0) & (~F.exists(named(x), lambda t: same(h, t)) | official)

    return F.exists(F.slice(links, 1, 10), odd)


def bare_link(text: Column, urls: Column) -> Column:
    """Whether hardly anything is left of a short message without its links."""
    left = F.aggregate(F.slice(urls, 1, 6), text, lambda t, u: F.replace(F.replace(t, u, F.lit(" ")), F.regexp_replace(u, "^https://", ""), F.lit(" ")))
    words = F.length(F.regexp_replace(left, "[^0-9a-zA-Z가-힣]", ""))
    return (F.size(urls) > 0) & (words <= 4) & (F.size(F.filter(F.split(text, "\n"), lambda x: x != "")) <= 2)


def context_signals(c: str) -> Column:
    """Signals of what the client knows; `c` names a column of the type CONTEXT, which may be null."""
    get = lambda n: F.coalesce(F.col(f"{c}.{n}"), F.lit(0))
    final = host(plain_url(F.coalesce(F.col(f"{c}.final_url"), F.lit(""))))
    resolved = final != ""
    return _points([
        ("pf_unknown_contact", 14, F.coalesce(F.col(f"{c}.is_saved_contact") == F.lit(False), F.lit(False))), ("pf_act_copy_url", 16, get("copy_url") > 0), ("pf_act_open_url", 0, get("open_url") > 0),
        ("pf_act_install_click", 24, get("install_click") > 0), ("pf_ctx_final_host_susp", 12, resolved & (final.contains("xn--") | (F.size(F.split(final, r"\.")) >= 5))),
        ("pf_ctx_resolve_error", 8, resolved & F.coalesce(F.col(f"{c}.error") != "MAX_HOPS_REACHED", F.lit(False))), ("pf_ctx_many_redirects", 10, resolved & (get("hops") >= 3)),
    ])


def combos(ids: str, has_url: Column) -> Column:
    """Points for signals that occur together. `ids` names an array column of signal ids."""
    has = lambda *names: F.arrays_overlap(F.col(ids), F.array(*(F.lit(x) for x in names)))
    otp, pressure = has("pf_otp", "pf_otp_demand"), has("pf_urgency", "pf_threat")
    return _points([
        ("pf_combo_url_otp", 18, has_url & otp), ("pf_combo_remote_otp", 22, has("pf_remote") & otp), ("pf_combo_safe_xfer", 26, has("pf_safe_account") & has("pf_transfer")),
        ("pf_combo_xfer_pressure", 18, has("pf_transfer") & pressure), ("pf_combo_install_pressure", 18, has("pf_url_download") & pressure), ("pf_combo_short_otp", 20, has("pf_url_shortener") & otp),
        ("pf_combo_mismatch_strong", 18, has("pf_url_display_mismatch") & (otp | has("pf_url_download", "pf_transfer"))), ("pf_combo_unknown_url", 12, has("pf_unknown_contact") & has_url),
    ])


def action(score: Column) -> Column:
    return F.when(score >= cat.PREFILTER_AUTO, "auto").when(score >= cat.PREFILTER_SOFT, "soft").otherwise("none")


def prefilter(threads: DataFrame, lines: int = cat.PREFILTER_LINES) -> DataFrame:
    """`threads(thread_id, text[, context])` -> thread_id, score (0 to 100), action, signal_ids (heaviest first), n_urls, gate_pass and reasons, the six heaviest
    with their points. A click on a link makes the action `auto`. `context` is of the type CONTEXT."""
    context = F.col("context") if "context" in threads.columns else F.lit(None)
    t = threads.select("thread_id", F.coalesce("text", F.lit("")).alias("whole"), context.cast(CONTEXT).alias("c"))
    if not threads.isStreaming:
        t = spread(t, "thread_id")
    t = t.select("*", F.array_join(recent_lines(F.col("whole"), lines), "\n").alias("window"))
    t = t.withColumn("urls", loose_urls(F.col("window"))).withColumn("host_names", F.array_distinct(F.transform("urls", host)))
    t = t.withColumns({"hosts": named_hosts("host_names"), "claims": bank_claims(F.col("window"))})
    links = F.slice(F.concat(markdown_links(F.col("window")), F.coalesce("c.link_candidates", F.array().cast("array<struct<text:string,href:string>>"))), 1, 12)
    shown = _points([("pf_url_display_mismatch", 34, display_mismatch(links)), ("pf_url_bare_link", 22, bare_link(F.col("window"), F.col("urls")))])
    t = t.withColumn("signals", F.concat(url_signals("urls", "host_names"), bank_signals("urls", "hosts", "claims"), text_signals(F.col("window")), context_signals("c"), shown))
    if not threads.isStreaming:  # some sixty patterns, of which six columns below make use
        t = written(t)
    has_url = F.size("urls") > 0
    opened = F.coalesce(F.col("c.open_url"), F.lit(0)) > 0
    acted = (F.coalesce(F.col("c.copy_url"), F.lit(0)) + F.coalesce(F.col("c.install_click"), F.lit(0))) > 0
    t = t.withColumn("ids", F.transform("signals", lambda s: s["id"]))
    risky = has_url | F.arrays_overlap("ids", F.array(*(F.lit(x) for x in ("pf_url_download", "pf_otp", "pf_otp_demand"))))
    more = _points([("pf_combo_explicit_act", 14, acted & risky), ("pf_combo_open_url", 0, opened & has_url), ("pf_trigger_open_url", 0, opened)])
    t = t.withColumn("combos", F.concat(combos("ids", has_url), more))
    t = t.withColumn("found", F.concat("signals", "combos"))
    total = F.aggregate("found", F.lit(0), lambda a, s: a + s["points"])
    ranked = F.transform(F.array_sort(F.transform("found", lambda s, i: F.struct((-s["points"]).alias("p"), i.alias("i"), s["id"].alias("id")))), lambda x: F.struct(x["id"].alias("id"), (-x["p"]).alias("points")))
    clicked = opened & has_url
    t = t.withColumns({"ranked": ranked, "score": F.greatest(F.least(F.lit(100), total), F.when(clicked, cat.PREFILTER_AUTO).otherwise(0))})
    # a hint that the window cut off: looked for in the whole thread, without stamps and speakers
    lite = F.regexp_replace(F.regexp_replace("whole", r"(?im)^\s*\d{4}[-./]\d{1,2}[-./]\d{1,2}[ T]+(?:오전|오후)?\s*\d{1,2}:\d{2}(?::\d{2})?\s*", ""), r"(?im)^\s*(?:S|R)\s*:\s*", "")
    lite = F.regexp_replace(lite, r"\s+", " ")
    hinted = F.lit(False)
    for p in GLOBAL_HINTS:
        hinted = hinted | F.rlike(lite, F.lit("(?i)" + p))
    gate = has_url | F.exists("found", lambda s: s["points"] > 0) | (F.col("score") >= min(18, cat.PREFILTER_SOFT)) | hinted
    reasons = F.transform(F.slice("ranked", 1, 6), lambda x: F.concat_ws(" +", x["id"], x["points"].cast("string")))
    act = F.when(clicked, "auto").otherwise(action(F.col("score")))
    return t.select("thread_id", "score", act.alias("action"), F.transform("ranked", lambda x: x["id"]).alias("signal_ids"), F.size("urls").alias("n_urls"), gate.alias("gate_pass"), F.array_join(reasons, " | ").alias("reasons"))


def best_signals(signals: DataFrame) -> DataFrame:
    """Of each thread's signals with one id that with the most points, the first among equals."""
    at = F.row_number().over(W.partitionBy("thread_id", "id").orderBy(F.desc("points"), "ord"))
    return signals.withColumn("at", at).where("at = 1").drop("at")
