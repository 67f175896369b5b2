"""Thread analysis: turns -> hits -> diminishing weights -> stage, score and risk.

`turns(thread_id, ix, role, text)` has a row for each turn: role is S (sender), R (receiver) or U. All per-turn work is column
expressions in one pass; hits stay an array column until they are exploded once. Everything after is partitioned by thread, so one
exchange on `thread_id` serves the windows and the groupings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.functions.text import HANGUL, SPACE, java_pattern, needs_hangul
from threadlens.functions.urls import extract_scored_urls, host, url_feature_hits
from threadlens.plans import catalog as cat
from threadlens.session import spread, sql_text, written

FACTORS = (1.0, 0.85, 0.70, 0.55, 0.45, 0.35)
HIT = "struct<rule_id:string,label:string,stage:string,weight:double,matched:array<string>>"


def matches(patterns: list[str], text: str = "text", prefix: str = "(?i)", hangul: str | None = None) -> str:
    """SQL: whether one of the patterns is found in the column `text`. `hangul` names a column that tells whether the text has a Hangul syllable: patterns that
    cannot match without one are not tried where there is none."""
    found = lambda p: f"rlike({text}, {sql_text(prefix + java_pattern(p))})"
    only = [p for p in patterns if hangul and needs_hangul(p)]
    tests = [found(p) for p in patterns if p not in only]
    if only:
        tests.append(f"({hangul} AND ({' OR '.join(map(found, only))}))")
    return "(" + " OR ".join(tests) + ")"


def rule_hits(text: str = "text", hangul: str | None = None) -> Column:
    """Array of hits of the catalogue on one text, in catalogue order: the distinct matches of all patterns of a rule, 6 at most;
    the weight counts up to three of them. `text` names the column, `hangul` one as in `matches`. Written as SQL: 28 rules are 28 expressions."""
    trimmed = f"x -> regexp_replace(x, {sql_text(f'^{SPACE}+|{SPACE}+' + chr(92) + 'z')}, '')"
    hits = []
    for rule_id, label, stage, weight, patterns in cat.RULES:
        found = []
        for p in patterns:
            java = sql_text("(?i)" + java_pattern(p))
            found.append(f"filter(array(regexp_extract({text}, {java}, 0)), x -> x <> '')" if p in cat.FIRST_ONLY else f"regexp_extract_all({text}, {java}, 0)")
        matched = f"slice(array_distinct(transform(concat({', '.join(found)}), {trimmed})), 1, 6)"
        hit = f"named_struct('rule_id', {sql_text(rule_id)}, 'label', {sql_text(label)}, 'stage', '{stage}', 'weight', {float(weight)}D * least(3, size(m)), 'matched', m)"
        # texts without a match, nearly all of them, pay for the test only
        hits.append(f"CASE WHEN {matches(patterns, text, hangul=hangul)} THEN transform(array({matched}), m -> {hit}) ELSE CAST(array() AS array<{HIT}>) END")
    return F.expr(f"flatten(array({', '.join(hits)}))")


def actor_hint(text: str = "text", hangul: str | None = None) -> str:
    """SQL: demand, comply or neutral. Reads q_otp_relay_demand beside the text."""
    count = lambda patterns: "(" + " + ".join(f"CAST({matches([p], f'lower({text})', '', hangul)} AS INT)" for p in patterns) + ")"
    d, c = count(cat.DEMAND_PATTERNS), count(cat.COMPLY_PATTERNS)
    return f"CASE WHEN trim({text}) = '' THEN 'neutral' WHEN q_otp_relay_demand THEN 'demand' WHEN {d} >= 2 AND {d} > {c} THEN 'demand' WHEN {c} >= 2 AND {c} >= {d} THEN 'comply' ELSE 'neutral' END"


def alert_only(q: dict[str, Column]) -> Column:
    return q["alert_pay"] & ~q["alert_directive"] & q["alert_notice"]


#: SQL over a turn's cues q_<name>, `has_url`, `hint` and `seen` (a code cue in it or in a turn before).
_RELAY = "seen AND q_share AND q_code_noun"
_INSTALL = "(q_app_install OR (q_remote_phrase AND q_install_verb))"
_DOC = "has_url AND q_biz_doc"
#: Id, label, stage, weight, placeholder, condition.
CONTEXT = [
    ("ctx_demand", "맥락: 요구/지시 표현(발신 요구 가능)", "verify", 3, "demand", "hint = 'demand'"),
    ("ctx_otp_relay", "맥락: 인증번호/코드 전달 요구", "verify", 20, "otp-relay", _RELAY),
    ("ctx_install_mention", "맥락: 앱/원격/뷰어 설치 언급", "install", 18, "install", _INSTALL),
    ("ctx_otp_proxy", "맥락: 인증번호를 대신 입력/처리(가로채기)", "verify", 30, "otp-proxy", "q_instead AND q_otp_proxy_noun"),
    ("pii_request", "개인정보 요청", "verify", 18, "pii-request", "q_pii_noun AND q_pii_verb"),
    ("ctx_otp_finance", "맥락: 금융/카드 문맥에서 인증번호 요구", "verify", 28, "otp+finance", f"{_RELAY} AND q_finance"),
    ("ctx_pay_with_link", "맥락: 링크에서 납부/결제 유도", "payment", 22, "pay+link", "has_url AND NOT q_alert_setting AND q_link_pay AND (q_directive OR q_transfer_word)"),
    ("ctx_transfer_phrase", "맥락: 안내계좌/보호조치/자산이전 유도", "payment", 28, "transfer-phrase", "q_safe_transfer"),
    ("transfer", "맥락: 안내 계좌로 이체/송금 유도", "payment", 18, "transfer", "q_safe_transfer"),
    ("ctx_payment_request", "맥락: 입금/송금/충전/납부 요청", "payment", 20, "pay", f"q_pay_verb AND NOT (q_alert_pay AND NOT q_alert_directive AND q_alert_notice) AND NOT ({_INSTALL} AND NOT q_transfer_word AND (q_escrow OR q_pay_in_order_to))"),
    ("ctx_family_scam", "맥락: 가족/지인 사칭 + 새 번호/폰 고장 + 송금 요구", "payment", 30, "family+pay", "q_family AND q_device_excuse AND q_money_ask AND q_amount"),
    ("ctx_job_hook", "맥락: 고수익/단기 구인 미끼", "verify", 22, "job-hook", "q_job_wide"),
    ("ctx_contact_move", "맥락: 오픈채팅/텔레그램 이동 유도", "verify", 22, "contact-move", "q_platform AND q_move"),
    ("ctx_visit_place", "맥락: 특정 장소 방문/이동 유도", "verify", 14, "visit", "q_place AND q_visit_verb"),
    ("ctx_payment_request", "맥락: 보증금/수수료/선입금 요구", "payment", 28, "fee", "q_fee AND q_fee_verb"),
    ("ctx_transfer_demand", "맥락: 이체/송금 지시", "payment", 26, "transfer-demand", "q_transfer_demand"),
    ("ctx_cash_pickup", "맥락: 현금 수거/퀵 전달 유도", "payment", 32, "cash-pickup", "q_cash AND q_cash_verb"),
    ("ctx_giftcard", "맥락: 상품권/기프트카드/핀번호 요구", "payment", 34, "giftcard", "q_giftcard AND q_giftcard_verb"),
    ("ctx_crypto_wallet", "맥락: 코인/지갑주소 송금 요구", "payment", 34, "crypto-wallet", "q_crypto AND q_crypto_verb"),
    ("ctx_account_rental", "맥락: 통장/계좌 대여·수령대행 유도", "payment", 32, "account-rental", "q_mule OR (q_account_lend AND q_lend_hook)"),
    ("ctx_qr_pay", "맥락: QR/간편결제 스캔·결제 유도", "payment", 28, "qr-pay", "q_qr AND q_qr_verb"),
    ("ctx_refund_lure", "맥락: 환불/취소/해지 미끼", "verify", 14, "refund-lure", "q_refund AND q_refund_verb"),
    ("ctx_loan_hook", "맥락: 대출/대환/한도 미끼", "verify", 12, "loan-hook", "q_loan AND q_loan_verb"),
    ("ctx_job_scam", "맥락: 고액/해외 구인 + 신분/계좌 요구", "verify", 30, "job+id", "q_job AND (q_id_ask OR (q_id_mention AND q_id_need))"),
    ("ctx_investment_link", "맥락: 투자/리딩방 + 링크", "verify", 12, "invest+link", "q_invest AND has_url"),
    ("ctx_benefit_link", "맥락: 지원/환급/대상자 조회 + 링크", "verify", 18, "benefit+link", "has_url AND q_benefit"),
    ("ctx_benefit_link_mention", "맥락: 지원/환급/대상자 조회 + 링크 언급", "verify", 8, "benefit+link-mention", "NOT has_url AND q_benefit AND q_benefit_verb"),
    ("ctx_profile_link_mention", "맥락: 메신저/프로필 확인 + 링크 언급", "verify", 10, "profile+link-mention", "NOT has_url AND q_profile AND q_link_word AND q_open_verb"),
    ("ctx_biz_doc_link", "맥락: 업무/회계 문서 + 링크", "verify", 14, "bizdoc+link", _DOC),
    ("ctx_biz_doc_install", "맥락: 업무 문서 열람을 위한 뷰어 설치 유도", "install", 12, "bizdoc+install", f"{_DOC} AND q_viewer AND q_fetch_verb"),
]


def context_hits() -> Column:
    """Array of the context hits of one turn, in their order, from the columns that CONTEXT reads."""
    rows = [f"CASE WHEN {c} THEN named_struct('rule_id', '{i}', 'label', {sql_text(n)}, 'stage', '{s}', 'weight', {float(w)}D, 'matched', array('{m}')) END" for i, n, s, w, m, c in CONTEXT]
    return F.expr(f"array_compact(array({', '.join(rows)}))")


def normalised_stage(h: Column, q: dict[str, Column]) -> Column:
    """The stage of a hit in the light of its turn's text."""
    i = h["rule_id"]
    intranet_safe = q["intranet"] & ~q["intranet_unsafe"]
    alert, strong = alert_only(q), q["strong_pay"]
    asks = q["transfer_request"] | strong
    payment = (
        F.when(i == "transfer", F.when(alert | ~asks, "verify").otherwise("payment"))
        .when(i == "ctx_payment_request", F.when(alert | (q["escrow"] & ~strong & ~q["stage_pay_word"] & ~q["amount"]) | (~asks & ~q["arrears"]), "verify").otherwise("payment"))
        .when(q["escrow"] & q["install_cue"] & (q["install_before_pay"] | ~strong), "install")
        .otherwise("payment")
    )
    return (
        F.when(i == "shortener", "verify")
        .when(i == "link", F.when((intranet_safe & q["scheme_url"]) | ~(q["strong_link"] | q["promo"]), "info").otherwise("verify"))
        .when(i.isin("otp", "ctx_otp_proxy", "ctx_otp_finance", "ctx_otp_relay"), "verify")
        .when(i.isin("personalinfo", "pii_request", "account_verify"), F.when(intranet_safe, "info").otherwise("verify"))
        .when(i.isin("txn_alert", "social", "authority", "threat", "urgent"), "info")
        .when(i.isin("remote", "install_app", "apk"), "install")
        .when(i.isin("safe_account", "ctx_transfer_phrase"), "payment")
        .when(i == "ctx_pay_with_link", F.when(alert, "verify").when(q["arrears"] | strong, "payment").otherwise("verify"))
        .when(i == "url_download_ext", "install").when(i.startswith("url_"), "verify")
        .when(h["stage"] == "payment", payment)
        .otherwise(h["stage"])
    )


def _renamed(alias: str):
    return lambda h: F.struct(F.lit(alias).alias("rule_id"), h["label"].alias("label"), h["stage"].alias("stage"), h["weight"].alias("weight"), h["matched"].alias("matched"))


def _named(name: str):
    return lambda h: h["rule_id"] == name


def with_aliases(hits: str) -> Column:
    """Adds copies of hits under their other names, where no hit has that name yet. `hits` names a column, so that it is worked out once."""
    copies = []
    for name, alias in (("link", "link_mention"), ("government_benefit", "ctx_government_benefit"), ("personalinfo", "pii_request")):
        copy = F.transform(F.slice(F.filter(hits, _named(name)), 1, 1), _renamed(alias))
        copies.append(F.when(F.exists(hits, _named(alias)), F.slice(copy, 1, 0)).otherwise(copy))
    return F.concat(F.col(hits), *copies)


def resolved_stage(has, q: dict[str, Column]) -> Column:
    """The stage of a turn or thread. has(stage, ids): whether a hit has one of the ids and that stage; stage None: any."""
    strong = q["strong_pay"]
    demand = strong | q["amount"] | (q["pay_noun"] & q["pay_imperative"])
    pressure = has(None, cat.PRESSURE) | q["pressure_word"]
    install = has("install", cat.INSTALL_HARD + cat.INSTALL_SOFT)
    return (
        F.when(has("install", cat.INSTALL_HARD), "install")
        .when(install & ((q["escrow"] & ~strong) | q["install_before_pay"]), "install")
        .when(has("payment", cat.PAYMENT_ALWAYS), "payment")
        .when(has("payment", cat.PAYMENT_CONDITIONAL), F.when(demand | pressure, "payment").otherwise("verify"))
        .when(has("payment", cat.PAYMENT_SOFT), F.when(demand | (pressure & strong), "payment").otherwise("verify"))
        .when(has("verify", cat.VERIFY_STRONG), "verify")
        .when(has("verify", cat.VERIFY_WEAK) & q["verify_cue"], "verify")
        .otherwise("info")
    )


def stage_rank(stage: Column) -> Column:
    return F.when(stage == "payment", 3).when(stage == "install", 2).when(stage == "verify", 1).otherwise(0)


def text_features(texts: DataFrame) -> DataFrame:
    """`texts(text)` -> text, what depends on it alone: urls, the cues q_<name>, the hint, and the hits of the catalogue and of URL features."""
    t = texts.select("text", F.rlike("text", F.lit(HANGUL)).alias("hangul"))
    t = t.select("text", "hangul", extract_scored_urls(F.col("text")).alias("urls"), *(F.expr(f"{matches(p, hangul='hangul')} AS q_{k}") for k, p in cat.CUES.items()))
    return t.select("*", F.expr(f"{actor_hint(hangul='hangul')} AS hint"), F.concat(rule_hits("text", "hangul"), url_feature_hits(F.col("text"), F.col("urls"))).alias("own_hits")).drop("hangul")


def marked_features(turns: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """`text_features` of the distinct texts of `turns(text, mark)`, with their marks; written. What `known`, such a table, has already is not tried again."""
    texts = turns.select("mark", "text").distinct()
    if known is not None:
        texts = texts.join(known.select("mark"), "mark", "left_anti")
    found = written(text_features(spread(texts, "mark")).withColumn("mark", F.md5("text")))
    return found if known is None else known.unionByName(found)


def featured(turns: DataFrame) -> DataFrame:
    """`turns` with `text_features` of each text. Messages repeat (templates, forwarded texts, short answers), so all patterns are tried once on each distinct
    text; what was found is written. Texts meet by a hash of 128 bits, so none is shuffled but once."""
    more = [c for c in turns.columns if c not in ("thread_id", "ix", "role", "text")]
    t = turns.select("thread_id", "ix", F.coalesce("role", F.lit("U")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), *more).withColumn("mark", F.md5("text"))
    texts = spread(t.select("mark", "text").distinct(), "mark")
    found = written(text_features(texts).withColumn("mark", F.md5("text")).drop("text"))
    return t.join(found, "mark").drop("mark")


def marked(turns: DataFrame) -> DataFrame:
    """`turns` with roles and texts in place of nulls, and `mark`, a hash of the text."""
    more = [c for c in turns.columns if c not in ("thread_id", "ix", "role", "text")]
    return turns.select("thread_id", "ix", F.coalesce("role", F.lit("U")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), *more).withColumn("mark", F.md5("text"))


def turn_table(turns: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row for each turn: include (whether it counts as a threat), score, stage, urls, hits (the kept ones, with `ord`), and its cues as q_<name>.

    Threads are gone through with a hash in place of each text and the two features that count there, so what a task sorts is small; texts and all else that was found are joined afterwards, and sorted no more. `known` is a table of `marked_features` that may hold some of the texts."""
    t = marked(turns)
    found = marked_features(t, known)
    around = _around(t.drop("text").join(found.select("mark", "hint", "q_otp"), "mark")).drop("hint", "q_otp")
    return _decided(around.join(found, "mark").drop("mark"))


def settled(t: DataFrame) -> DataFrame:
    """`turn_table` from turns whose texts are `featured`: what depends on the turns around."""
    return _decided(_around(t))


def _around(t: DataFrame) -> DataFrame:
    """Adds roles, include and seen, from role, hint and q_otp of a thread's turns."""
    own = W.partitionBy("thread_id")
    t = t.withColumn("roles", F.max(F.col("role") != "U").over(own))
    t = t.withColumn("include", F.expr("CASE WHEN roles THEN role = 'S' OR (role = 'U' AND hint = 'demand') ELSE hint <> 'comply' END"))
    return t.withColumn("seen", F.max(F.col("include") & F.col("q_otp")).over(own.orderBy("ix").rowsBetween(W.unboundedPreceding, 0)))


def _decided(t: DataFrame) -> DataFrame:
    """Each turn by itself, once `_around` has added what it needs."""
    more = [c for c in ("speaker",) if c in t.columns]
    q = {k: F.col(f"q_{k}") for k in cat.CUES}
    t = t.withColumn("has_url", F.expr("size(urls) > 0"))
    # heaviest first, in catalogue order among equals
    raw = F.concat("own_hits", context_hits())
    ranked = F.transform(F.array_sort(F.transform(raw, lambda h, i: F.struct((-h["weight"]).alias("w"), i.alias("i"), h.alias("h")))), lambda x: x["h"])
    t = t.withColumn("raw", F.when(F.col("include"), ranked).otherwise(F.array().cast(f"array<{HIT}>")))
    staged = F.transform("raw", lambda h: F.struct(h["rule_id"].alias("rule_id"), h["label"].alias("label"), normalised_stage(h, q).alias("stage"), h["weight"].alias("weight"), h["matched"].alias("matched")))
    t = t.withColumns({"score": F.expr("least(100D, aggregate(raw, 0D, (a, h) -> a + h.weight))"), "staged": staged})
    t = t.withColumn("all", with_aliases("staged"))
    t = t.withColumn("hits", F.expr("filter(all, h -> startswith(h.rule_id, 'ctx_') OR startswith(h.rule_id, 'url_') OR size(h.matched) = 0 OR exists(h.matched, m -> m <> '' AND contains(text, m)))"))
    has = lambda stage, ids: F.exists("hits", lambda h: h["rule_id"].isin(*ids) & (F.lit(True) if stage is None else h["stage"] == stage))
    t = t.withColumn("stage", resolved_stage(has, q))
    return t.select("thread_id", "ix", "role", *more, "text", "roles", "hint", "include", "urls", "score", "stage", "hits", *(f"q_{k}" for k in cat.CUES))


def sequence_hits(table: DataFrame) -> DataFrame:
    """Hits across turns of threads without roles: a demand that is complied with, a link or a code demand that is denied, in the next turn or the one
    after. Weights are higher where the two turns name different speakers; a demand's hit has the later of the two turns' stages."""
    at = W.partitionBy("thread_id").orderBy("ix")
    t = table.where(~F.col("roles"))
    ask = {"link": F.size("urls") > 0, "code": F.col("q_otp_demand") & F.col("q_share"), "demand": F.col("hint") == "demand"}
    speaker = F.col("speaker") if "speaker" in table.columns else F.lit(None).cast("string")
    t = t.select("thread_id", "ix", "stage", speaker.alias("speaker"), *(c.alias(k) for k, c in ask.items()), *(
        F.lead(F.struct((F.col("hint") == "comply").alias("comply"), F.col("q_denial_after_link").alias("no_link"), F.col("q_denial_after_otp").alias("no_otp"), "stage", speaker.alias("speaker")), k).over(at).alias(f"n{k}") for k in (1, 2)
    ))
    first = lambda flag: F.when(F.col(f"n1.{flag}"), F.col("n1")).when(F.col(f"n2.{flag}"), F.col("n2"))
    t = t.select("*", first("comply").alias("yes"), first("no_link").alias("not_link"), first("no_otp").alias("not_otp"))
    other = lambda c: F.coalesce(F.col("speaker") != F.col(f"{c}.speaker"), F.lit(False))
    later = F.when(stage_rank(F.col("yes.stage")) > stage_rank(F.col("stage")), F.col("yes.stage")).otherwise(F.col("stage"))
    hit = lambda i, label, stage, w: F.struct(F.lit(i).alias("rule_id"), F.lit(label).alias("label"), stage.alias("stage"), w.cast("double").alias("weight"))
    rows = F.array_compact(F.array(
        F.when(F.col("demand") & F.col("yes").isNotNull(), hit("ctx_comply_after_demand", "맥락: 요구 직후 동의/수락(연쇄 위험)", F.when(later == "info", "verify").otherwise(later), F.when(other("yes"), 12).otherwise(8))),
        F.when(F.col("link") & F.col("not_link").isNotNull(), hit("ctx_denial_after_link", "맥락: 링크 제시 직후 본인 부인/미신청", F.lit("verify"), F.when(other("not_link"), 14).otherwise(10))),
        F.when(F.col("code") & F.col("not_otp").isNotNull(), hit("ctx_denial_after_otp", "맥락: 인증번호 요구 직후 본인 부인/미신청", F.lit("verify"), F.lit(14))),
    ))
    return t.select("thread_id", "ix", F.posexplode(rows).alias("ord", "h")).select("thread_id", "ix", (F.col("ord") + 1000).alias("ord"), "h.*", F.array().cast("array<string>").alias("matched"))


def exploded_hits(table: DataFrame) -> DataFrame:
    return table.select("thread_id", "ix", F.posexplode("hits").alias("ord", "h")).select("thread_id", "ix", "ord", "h.*")


def diminished(hits: DataFrame, key: tuple[str, ...] = ("thread_id",), rule: str = "rule_id", order: tuple[str, ...] = ("ix", "ord"), weight: str = "weight") -> DataFrame:
    """Adds `occurrence` of a rule within the key and `diminished`, the weight times the occurrence's factor, to two decimals."""
    n = F.row_number().over(W.partitionBy(*key, rule).orderBy(*order))
    factor = F.lit(FACTORS[-1])
    for k in range(len(FACTORS) - 1, 0, -1):
        factor = F.when(F.col("occurrence") == k, FACTORS[k - 1]).otherwise(factor)
    return hits.withColumn("occurrence", n).withColumn("diminished", F.floor(F.col(weight) * factor * 100 + 0.5) / 100)


def signals(hits: DataFrame) -> DataFrame:
    """For each thread and rule: count, summed weight, stage and label of the heaviest hit (the first among equals), first six examples."""
    best = F.max_by(F.struct("label", "stage"), F.struct("diminished", -F.col("ix"), -F.col("ord")))
    seen = F.array_sort(F.collect_list(F.struct("ix", "ord", "matched")))
    examples = F.slice(F.array_distinct(F.flatten(F.transform(seen, lambda x: x["matched"]))), 1, 6)
    out = hits.groupBy("thread_id", "rule_id").agg(F.count("*").alias("count"), (F.floor(F.sum("diminished") * 100 + 0.5) / 100).alias("weight_sum"), best.alias("best"), examples.alias("examples"))
    return out.select("thread_id", "rule_id", "best.label", "best.stage", "count", "weight_sum", "examples")


def top_signals(rolled: DataFrame, k: int = 12) -> DataFrame:
    at = F.row_number().over(W.partitionBy("thread_id").orderBy(F.desc("weight_sum"), F.desc("count"), "rule_id"))
    return rolled.withColumn("rank", at).where(F.col("rank") <= k)


def risk_steps(has) -> list[tuple[str, str]]:
    """The risk decision as named SQL expressions, each of which may use those before it. has(*ids) gives the SQL of a test whether the array `ids`
    holds one of them. Besides it they read any_url, internal_host, q_<cue> and score_total."""
    some = lambda *names: "(" + " OR ".join(n if n.startswith("q_") else f"f_{n}" for n in names) + ")"
    count = lambda *names: " + ".join(f"CAST({n if n.startswith('q_') else 'f_' + n} AS INT)" for n in names)
    money = ("cash", "transfer_demand", "pay", "transfer")
    acts = ("otp", "otp_finance", "installed", "pay", "transfer_demand", "transfer", "cash", "visit", "pii", "job")
    clues = ("authority", "threat", "urgent", "alert", "first", "move", "otp_finance", "secrecy", "q_anti_verify", "money")
    structures = [
        "f_remote AND f_otp", "f_link AND f_installed AND clues >= 1", "f_link AND f_apk", "f_otp AND q_otp_request",
        f"f_family AND {some('pay', 'urgent', 'transfer_demand')}", "f_link AND f_job_scam AND f_pii", "f_pay AND clues >= 1",
        f"f_invest AND {some('link', 'move')} AND {some('mention', 'apk', 'pay', 'transfer_demand', 'urgent', 'threat', 'authority')}",
        f"f_visit AND {some('job', 'job_scam', 'invest')} AND {some('move', 'link')} AND {some(*money)}",
        f"{some('transfer_demand', 'transfer')} AND clues >= 1", f"f_cash AND {some('authority', 'threat', 'urgent', 'demand', 'link', 'move')}",
        f"{some('job', 'job_scam')} AND {some('move', 'link')} AND {some('visit', *money)}", "f_job_scam",
    ]
    sure = [
        f"f_malicious AND {some('installed', 'remote', 'pay', 'transfer_demand', 'transfer', 'cash', 'otp_finance', 'q_otp_request', 'q_code_request')}",
        "f_link AND q_code_request", f"f_link AND q_otp_entry AND ({some('urgent', 'threat', 'q_now_word')} OR (f_demand AND NOT q_account_notice))",
        "q_business AND f_link AND f_installed", f"{some('job', 'job_scam', 'q_high_pay')} AND {some('link', 'move', 'pii')}",
    ]
    either = lambda xs: " OR ".join(f"({x})" for x in xs)
    quiet = lambda *names: " AND ".join(f"NOT f_{n}" for n in names)
    return [
        *((f"f_{k}", has(*ids)) for k, ids in cat.RISK_FLAGS.items()),
        ("f_link", "f_linked OR any_url"), ("f_pay", some("transfer", "asked")), ("f_wish", some("demand", "q_otp_request", "q_code_request")),
        ("f_action", some(*acts, "called")), ("f_form", some("wish", "transfer_demand", "cash", "transfer", "pay", "installed", "pii", "called")),
        ("benign", f"q_it_support AND internal_host AND NOT {some('installed', 'otp', 'otp_finance', 'pay', 'transfer', 'transfer_demand', 'cash', 'visit', 'pii', 'job', 'called')}"),
        ("clues", count(*clues, "wish", "remote")), ("gate_b", count(*clues, "q_otp_request")),
        ("hard_high", f"NOT benign AND ({either(sure)} OR (f_form AND {some(*acts)} AND gate_b >= 1 AND f_action AND ({either(structures)})))"),
        ("advised", "q_advice AND NOT q_advice_not AND NOT q_advice_action"),
        ("entry_only", "q_otp_entry AND NOT q_otp_request AND NOT q_code_request AND NOT f_otp_finance"),
        ("alert_only", f"f_linked AND (q_alert_thread OR f_alert) AND (q_self_ack OR q_benign_ack) AND NOT q_explicit_pay AND (NOT f_otp OR entry_only) AND {quiet('threat', 'urgent', 'remote', 'apk', 'mention', 'job_scam', 'invest', 'family')}"),
        ("remote_only", f"f_installed AND NOT q_doc_lure AND NOT q_explicit_pay AND {quiet('otp', 'threat', 'authority', 'urgent', 'job_scam', 'invest', 'family')}"),
        ("risk_level", f"CASE WHEN advised THEN 'low' WHEN hard_high AND (alert_only OR remote_only) THEN 'medium' WHEN hard_high THEN 'high' WHEN score_total >= {cat.MEDIUM} THEN 'medium' ELSE 'low' END"),
    ]


def with_risk(df: DataFrame) -> DataFrame:
    """Adds the columns of `risk_steps` to a table of threads, hard_high and risk_level among them."""
    has = lambda *ids: f"arrays_overlap(ids, array({', '.join(repr(i) for i in ids)}))"
    return df.selectExpr("*", *(f"{e} AS {n}" for n, e in risk_steps(has)))


def analyze(turns: DataFrame, calls: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """One row for each thread: score_total, stage_peak, risk_level, hard_high, n_turns, n_hits, top_rule.

    `calls(thread_id, otp_asked, remote_asked, urgent_pressured, first_contact)` adds what was said on the telephone. Null texts are empty;
    turns of one thread that share `ix` are taken in any order. `known` is as in `turn_table`.
    """
    return analyzed(turn_table(turns, known), calls)


def analyzed(table: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """`analyze` from a `turn_table`."""
    return judged(written(table), calls)  # three uses below


def weighed_hits(table: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """All hits of a `turn_table`, of sequences and of what was said on the telephone, with `diminished`."""
    hits = exploded_hits(table).unionByName(sequence_hits(table))
    if calls is not None:
        flags = {"call_otp": "otp_asked", "call_remote": "remote_asked", "call_urgent": "urgent_pressured", "call_first_contact": "first_contact"}
        said = F.array_compact(F.array(*(F.when(F.coalesce(F.col(c), F.lit(False)), F.struct(F.lit(i).alias("rule_id"), F.lit(i).alias("label"), F.lit("install" if i == "call_remote" else "info" if i in ("call_urgent", "call_first_contact") else "verify").alias("stage"), F.lit(float(cat.CALL_WEIGHTS[i])).alias("weight"))) for i, c in flags.items())))
        extra = calls.select("thread_id", F.lit(None).cast("long").alias("ix"), F.posexplode(said).alias("ord", "h")).select("thread_id", F.lit(1 << 40).alias("ix"), "ord", "h.*", F.array().cast("array<string>").alias("matched"))
        hits = hits.unionByName(extra)
    return diminished(hits)


def judged(table: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """`analyze` from a `turn_table` that is written."""
    scored = weighed_hits(table, calls).groupBy("thread_id").agg(F.sum("diminished").alias("total"), F.count("*").alias("n_hits"), F.collect_set("rule_id").alias("ids"), F.collect_set(F.concat_ws("|", "rule_id", "stage")).alias("staged_ids"), F.max_by("rule_id", F.struct("diminished", -F.col("ix"), -F.col("ord"))).alias("top_rule"))
    rolled = table.groupBy("thread_id").agg(F.count("*").alias("n_turns"), F.max(F.size("urls") > 0).alias("any_url"), F.max(F.exists("urls", lambda u: F.rlike(host(u), F.lit(cat.INTERNAL_HOST)))).alias("internal_host"), *(F.max(F.when(F.col("include") | F.lit(k in cat.THREAD_CUES), F.col(f"q_{k}")).otherwise(False)).alias(f"q_{k}") for k in cat.CUES))
    none = F.array().cast("array<string>")
    joined = rolled.join(scored, "thread_id", "left").withColumns({"ids": F.coalesce("ids", none), "staged_ids": F.coalesce("staged_ids", none), "score_total": F.least(F.lit(100.0), F.floor(F.coalesce("total", F.lit(0.0)) * 100 + 0.5) / 100), "n_hits": F.coalesce("n_hits", F.lit(0))})
    has = lambda stage, ids: F.arrays_overlap(F.col("staged_ids") if stage else F.col("ids"), F.array(*(F.lit(f"{i}|{stage}" if stage else i) for i in ids)))
    peak = resolved_stage(has, {k: F.col(f"q_{k}") for k in cat.CUES})
    return with_risk(joined.withColumn("stage_peak", peak)).select("thread_id", "score_total", "risk_level", "stage_peak", "hard_high", "n_turns", "n_hits", "top_rule")


def stage_timeline(table: DataFrame, k: int = 8) -> DataFrame:
    """The first turn of a thread and every turn whose stage is higher than all before it, `k` at most."""
    rank = stage_rank(F.col("stage"))
    own = W.partitionBy("thread_id").orderBy("ix")
    before = F.max("rank").over(own.rowsBetween(W.unboundedPreceding, -1))
    t = table.select("thread_id", "ix", "stage", rank.alias("rank")).withColumn("before", before)
    t = t.where(F.col("before").isNull() | (F.col("rank") > F.col("before")))
    return t.withColumn("step", F.row_number().over(own)).where(F.col("step") <= k).select("thread_id", "step", "ix", "stage")
