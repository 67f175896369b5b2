"""Decisions after the analysis, as named SQL steps in either dialect: receiver gates, interface scores, triggers, evaluation, link and text checks."""

from __future__ import annotations

import re

from threadlens.plans import catalog as cat
from threadlens.plans.dialect import Spark, Steps

#: What receivers say they did, will do, refuse or ask.
RECEIVER = {
    "will": r"(할게|할게요|할께|할께요|하겠|하겠습니다|하겠어요|하려|할\s*거|할거|할\s*겁|할겁|해\s*둘게|해둘게)",
    "go": r"(갈게|갈게요|갈께|갈께요|가겠|가겠습니다|가겠어요|가\s*볼게|가볼게|가\s*볼게요|가볼게요|가\s*보겠|가보겠|갈\s*거|갈거|갈\s*겁|갈겁)",
    "place": r"(은행|atm|현금\s*인출기|편의점|매장|지점|지사|센터|창구|카운터|현장|대리점)",
    "gift": r"(상품권|기프트\s*카드|기프티콘|쿠폰|핀\s*번호|pin\s*code|pincode)",
    "paid": r"(송금했|이체했|입금했|결제했|지불했|충전했)",
    "gave": r"(보냈|전달|말했|알려|줬|보내드렸|전송했)",
    "installed": r"(설치했|다운받|다운로드했|깔았|원격(으로)?\s*해줬|팀뷰어|teamviewer|anydesk|애니데스크|퀵서포트|quicksupport)",
    "otp": r"(인증번호|otp|오티피|보안\s*코드|확인\s*코드|ars)",
    "told": r"(보냈|전달|말했|알려|불러|읽어|입력했)",
    "resist": r"(안\s*할게|거절|차단했|신고했|무시했|끊었|삭제했|거래\s*중단|취소했)",
    "pay": r"(송금|이체|입금|결제|지불|충전)",
    "money": r"(돈|원|계좌|입금|송금|이체|결제|지불|충전|카드|상품권|기프트|기프티콘|쿠폰|핀\s*번호|pin)",
    "send": r"(보내겠|보낼|보내겠습니다|보낼게|보낼게요|보내\s*드릴|보내줄|전달(하겠|할)|전달하겠습니다|전송(하겠|할)|전송하겠습니다)",
    "install": r"(설치|다운\s*받|다운받|다운로드|깔|원격|팀뷰어|teamviewer|anydesk|애니데스크|퀵서포트|quicksupport)",
    "fetch_will": r"(받을게|받을게요|깔게|깔게요|설치할게|설치할게요|다운받을게|다운받을게요|다운로드할게|다운로드할게요|해볼게|해볼게요|해보겠|해보겠습니다)",
    "fetch": r"(설치|다운\s*받|다운받|다운로드|깔)",
    "remote": r"(원격(으로)?\s*(해|해드|해줄)|연결(할|해줄)|접속(할|해볼))",
    "app": r"(팀뷰어|teamviewer|anydesk|애니데스크|퀵서포트|quicksupport)",
    "otp_will": r"(보낼게|보내겠|보내겠습니다|전달(할게|하겠)|말해(줄게|드릴게)|알려(줄게|드릴게)|불러(줄게|드릴게)|읽어(줄게|드릴게)|입력(할게|하겠))",
    "move": r"(방문|이동)",
    "ask": r"(맞나|사기|스캠|피싱|도와(줘|주세요)|확인(해줘|해주세요)|이거\s*뭐야|진짜야)",
    "already": r"(눌렀|열었|접속했|들어갔|연결했|입력했|보냈)",
}
#: The quicker gate of the interface, and the urgency of its alert.
QUICK_GATE = [
    ("r:already", 14, r"(눌렀|열었|설치했|다운받|입력했|보냈|송금했|이체했|인증했|원격(으로)?\s*해줬|연결했)"),
    ("r:about", 10, r"(눌러(볼게|보려)|열어(볼게|보려)|설치(할게|하려)|다운(받을게|받으려)|입력(할게|하려)|보내(줄게|볼게|려)|송금(할게|하려)|이체(할게|하려)|인증(할게|하려)|원격(으로)?\s*해줄게)"),
    ("r:ask", 4, r"(맞나|사기|스캠|피싱|도와(줘|주세요)|확인(해줘|해주세요)|이거\s*뭐야|진짜야)"),
    ("r:resist", 2, r"(안\s*할게|거절|차단했|신고했|무시했|끊었|삭제했)"),
]
URGENCY = [
    ("danger", r"(설치했|설치할게|원격|애니데스크|팀뷰어|눌렀|접속했|입력했|인증번호.*(보낼게|전달)|송금|이체|입금했|보냈어|결제했)"),
    ("warn", r"(알겠|네\s*예|진행할게|확인했어|보낼까|어떻게 하면 돼|따라할게|지금 해볼게)"),
]
#: Hits that make an action of a thread, floors of what was done, boosts of what will be.
ACTION_ANCHORS = (
    "link", "shortener", "otp", "call_otp", "ctx_otp_relay", "ctx_otp_finance", "ctx_otp_finance_relay", "transfer", "safe_account", "ctx_payment_request", "ctx_transfer_phrase", "giftcard",
    "ctx_giftcard", "go_bank_atm", "visit_place", "ctx_visit_place", "remote", "call_remote", "install_app", "apk", "url_download_ext", "ctx_install_mention", "threat",
)
FLOORS = {"r:done:pay": 80, "r:done:install": 70, "r:done:otp": 65}
BOOSTS = {"r:will:pay": 16, "r:will:install": 12, "r:will:otp": 10, "r:will:visit": 8, "r:ask": 1}
SIMILAR_BOOSTS = ((0.96, 10), (0.93, 8), (0.90, 6), (0.87, 4))
PROTOTYPE_BOOSTS = ((0.86, 10), (0.82, 7), (0.78, 5), (0.74, 3))


def receiver_gate(d: Spark, text: str = "r_text") -> Steps:
    """gate_tag, the first that fits what the receiver said, and gate_floor, the score that it makes the least."""
    r = {k: d.found(text, p) for k, p in RECEIVER.items()}
    ladder = [
        ("r:done:pay", f"{r['paid']} OR ({r['gift']} AND {r['gave']})"), ("r:done:install", r["installed"]), ("r:done:otp", f"{r['otp']} AND {r['told']}"), ("r:resist", r["resist"]),
        ("r:will:pay", f"({r['pay']} AND {r['will']}) OR ({r['send']} AND ({r['money']} OR {r['gift']}))"),
        ("r:will:install", f"{r['install']} AND ({r['will']} OR {r['fetch_will']}) AND ({r['fetch']} OR {r['remote']} OR {r['app']})"),
        ("r:will:otp", f"{r['otp']} AND {r['otp_will']}"), ("r:will:visit", f"{r['place']} AND ({r['go']} OR ({r['will']} AND {r['move']}))"), ("r:ask", r["ask"]), ("r:already", r["already"]),
    ]
    tag = " ".join(f"WHEN {c} THEN '{t}'" for t, c in ladder)
    floor = " ".join(f"WHEN '{t}' THEN {n}" for t, n in FLOORS.items())
    quick = " ".join(f"WHEN {d.found(text, p)} THEN '{t}'" for t, _, p in QUICK_GATE)
    boost = " ".join(f"WHEN '{t}' THEN {n}" for t, n, _ in QUICK_GATE)
    urgency = " ".join(f"WHEN {d.found(text, p)} THEN '{t}'" for t, p in URGENCY)
    return [
        ("gate_tag", f"CASE WHEN {text} = '' THEN '' {tag} ELSE '' END"), ("gate_floor", f"CASE gate_tag {floor} ELSE 0 END"),
        ("quick_tag", f"CASE WHEN {text} = '' THEN '' {quick} ELSE '' END"), ("quick_boost", f"CASE quick_tag {boost} ELSE 0 END"), ("urgency", f"CASE {urgency} ELSE 'none' END"),
    ]


def interface_score(d: Spark, medium: int = cat.MEDIUM, high: int = cat.HIGH) -> Steps:
    """From ids, score_total, risk_level, gate_tag, gate_floor, sender_url and pf_triggered: whether to step in, the score and level that are shown, the
    triggered flag, and the score's band and colour."""
    boost = " ".join(f"WHEN '{t}' THEN {n}" for t, n in BOOSTS.items())
    return [
        ("anchored", d.holds("ids", *ACTION_ANCHORS)),
        ("can_show", f"gate_floor > 0 OR (gate_tag <> '' AND gate_tag <> 'r:already') OR pf_triggered OR sender_url OR score_total >= {medium} OR anchored"),
        ("can_raise", f"gate_floor > 0 OR score_total >= {medium} OR anchored"),
        ("soft_boost", f"CASE WHEN can_raise THEN CASE gate_tag {boost} ELSE 0 END ELSE 0 END"),
        ("ui_score", "greatest(0, least(100, greatest(score_total + soft_boost, gate_floor)))"), ("ui_level", f"CASE WHEN gate_floor >= {high} THEN 'high' ELSE risk_level END"),
        ("triggered", "CASE WHEN has_prefilter THEN pf_triggered OR sender_url ELSE n_hits > 0 OR sender_url END"),
        ("band", "CASE WHEN ui_score >= 90 THEN '90+' WHEN ui_score >= 65 THEN '65-89' WHEN ui_score >= 35 THEN '35-64' ELSE '0-34' END"),
        ("colour", "CASE WHEN ui_score >= 65 THEN 'danger' WHEN ui_score >= 35 THEN 'warn' ELSE 'ok' END"), ("block_level", "CASE WHEN ui_score >= 60 THEN 'high' WHEN ui_score >= 30 THEN 'medium' ELSE 'low' END"),
    ]


def similar_boost(d: Spark, gate: float = 0.9) -> Steps:
    """From top_sim and ids the boost of a similar case, that of prototypes, and the trigger score of the interface."""
    tier = lambda column, rows: " ".join(f"WHEN {column} >= {x} THEN {n}" for x, n in rows)
    return [
        ("sim_boost", f"CASE WHEN top_sim < {gate} OR NOT {d.holds('ids', *ACTION_ANCHORS)} THEN 0 {tier('top_sim', SIMILAR_BOOSTS)} ELSE 0 END"), ("proto_boost", f"CASE {tier('top_sim', PROTOTYPE_BOOSTS)} ELSE 0 END"),
        ("call_boost", "CASE WHEN otp_asked THEN 12 ELSE 0 END + CASE WHEN remote_asked THEN 12 ELSE 0 END + CASE WHEN urgent_pressured THEN 6 ELSE 0 END + CASE WHEN first_contact THEN 6 ELSE 0 END"),
        ("trigger_score", "pf_score + call_boost + proto_boost + quick_boost"), ("trigger_why", "CASE WHEN gate_pass THEN 'gatePass' WHEN trigger_score >= 18 THEN 'score>=threshold' ELSE 'below-threshold' END"),
    ]


def prefilter_triggered() -> str:
    """A flag that is set counts first, then a list of triggers, the action, the score against the softer threshold that is there, other lists, the gate."""
    return """CASE WHEN flag IS NOT NULL THEN flag WHEN coalesce(n_should, 0) > 0 THEN true WHEN coalesce(pf_action, '') NOT IN ('', 'none') THEN true
 WHEN pf_score IS NOT NULL AND soft IS NOT NULL THEN pf_score >= soft WHEN pf_score IS NOT NULL AND auto IS NOT NULL THEN pf_score >= auto WHEN pf_score IS NOT NULL THEN false
 WHEN coalesce(n_triggers, 0) > 0 OR coalesce(n_rules, 0) > 0 THEN true ELSE coalesce(gate_pass, false) END"""


def evaluated_triggered() -> Steps:
    """The evaluation's own chain: the prefilter's flags, then score and strongest hit, then calls, then the score against the soft threshold."""
    return [
        ("by_hits", "n_hits > 0 AND CASE WHEN risk_level = 'low' THEN score_total >= 15 AND top_weight >= least(coalesce(soft, 28), 20) ELSE score_total >= 58 AND top_weight >= 20 END"),
        ("by_prefilter", """CASE WHEN flag IS NOT NULL THEN flag WHEN coalesce(n_should, 0) > 0 OR coalesce(pf_action, '') NOT IN ('', 'none') THEN true
 WHEN pf_score IS NOT NULL AND soft IS NOT NULL AND pf_score >= soft THEN true WHEN pf_score IS NOT NULL AND soft IS NULL AND auto IS NOT NULL AND pf_score >= auto THEN true
 WHEN pf_score IS NULL AND gate_pass IS NOT NULL THEN gate_pass ELSE by_hits END"""),
        ("got_triggered", "by_prefilter OR otp_asked OR remote_asked OR urgent_pressured OR (soft IS NOT NULL AND score_total >= soft)"),
    ]


def expected_against_got(d: Spark) -> Steps:
    """why, the checks that do not hold: risk, least score, stage, trigger. What is not expected is not checked; of a harmless case triggers that were left over are not."""
    return [
        ("want_triggered", "CASE WHEN exp_triggered IS NOT NULL THEN exp_triggered WHEN coalesce(n_should, 0) = 0 THEN NULL WHEN exp_risk = 'low' AND exp_stage = 'info' AND exp_score_min <= 0 THEN false ELSE true END"),
        ("why", d.kept([
            ("risk_mismatch", "risk_level <> exp_risk"), ("score_below_min", "exp_score_min IS NOT NULL AND score_total < exp_score_min"),
            ("stage_mismatch", "exp_stage IS NOT NULL AND stage_peak <> exp_stage"), ("triggered_mismatch", "want_triggered IS NOT NULL AND got_triggered <> want_triggered"),
        ])),
    ]


def relabelled(margin: int = 5) -> Steps:
    """Expected values as an engine's result gives them: the policy's risk, the least score, and labels by threat and interface."""
    return [
        ("policy_risk", "CASE WHEN risk_level = 'high' AND hard_high = false THEN 'medium' WHEN risk_level IS NOT NULL THEN risk_level WHEN hard_high THEN 'high' WHEN score_total >= 35 THEN 'medium' ELSE 'low' END"),
        ("base_min", "CASE policy_risk WHEN 'high' THEN 65 WHEN 'medium' THEN 35 ELSE 0 END"),
        ("new_score_min", f"least(greatest(0, base_min - {margin}), greatest(0, CAST(floor(score_total - {margin} + 0.5) AS INT)))"),
        ("ui_score_min", "CASE ui_level WHEN 'high' THEN 60 WHEN 'medium' THEN 30 END"),
        ("consistent", "CASE policy_risk WHEN 'high' THEN score_total >= 65 WHEN 'medium' THEN score_total >= 35 AND score_total < 65 ELSE score_total < 35 END"),
    ]


#: What the interface looks for in a link, with points.
GUARD = [
    ("shortener", 8, r"(bit\.ly|tinyurl\.com|t\.co|goo\.gl|rebrand\.ly|cutt\.ly|s\.id|is\.gd|ow\.ly)"), ("ip-host", 10, r"^https?://(\d{1,3}\.){3}\d{1,3}\b"), ("at-sign", 6, r"@"), ("punycode", 10, r"xn--"),
    ("risky-tld", 8, r"\.(zip|mov|top|xyz|click|link|rest|work|cam|icu|cfd|kim|gq|tk|ml)(/|$)"), ("install", 14, r"(\.apk|\.ipa|\.exe|\.msi|\.pkg|/download\b|install\b)"),
]
CHIPS = [
    ("MUT:hxxp", r"(^|[^a-z])hxxps?://"), ("MUT:[.]", r"\[\s*\.\s*\]"), ("MUT:(dot)", r"\(\s*dot\s*\)"), ("MUT:xn--", r"\bxn--[a-z0-9-]+\b"), ("MUT:@", r"(?:https?|hxxps?)://[^\s/]+@"),
    ("MUT:redirect", r"\b(?:redirect|redir|url|target|dest|destination)=https?"), ("MUT:ip", r"(?:https?|hxxps?)://(?:\d{1,3}\.){3}\d{1,3}(?::\d{2,5})?(?:[/?#]|$)"), ("MUT:short", r"\b(?:bit\.ly|t\.co|tinyurl\.com|me2\.do|vo\.la|is\.gd)\b"),
]


def url_guard(d: Spark, url: str = "url") -> Steps:
    """flags and score of a link, and whether it is blocked."""
    rows = [(n, d.found(url, p)) for n, _, p in GUARD]
    rows.insert(5, ("long-url", f"length({url}) >= 60"))
    points = {n: p for n, p, _ in GUARD} | {"long-url": 4}
    total = " + ".join(f"CASE WHEN {c} THEN {points[n]} ELSE 0 END" for n, c in rows)
    return [("flags", d.joined(d.kept(rows), ",")), ("guard_score", f"least(100, {total})"), ("blocked", "guard_score >= 14")]


def url_chips(d: Spark, text: str = "text") -> Steps:
    found = d.kept([(n, d.found(text, p)) for n, p in CHIPS])
    return [("chips", d.joined(f"slice({found}, 1, 2)" if type(d) is Spark else f"({found})[1:2]", " "))]


#: The interface's own context score; in practice its English words alone are found.
CONTEXT_WORDS = [
    (10, r"\b(otp|one[\s-]?time|auth code|verification code|인증번호|본인확인|보안코드)\b"), (10, r"\b(remote|anydesk|teamviewer|support|원격|제어|앱\s*설치|설치해)\b"), (6, r"\b(urgent|immediately|now|asap|긴급|지금\s*바로|즉시|오늘\s*안에)\b"),
    (8, r"\b(payment|invoice|refund|charge|결제|환불|청구|카드)\b"), (6, r"\b(parcel|delivery|address|shipping|택배|배송|주소)\b"), (8, r"\b(click|open|link|url|접속|클릭|링크)\b"),
]


def context_score(d: Spark, text: str = "text") -> Steps:
    """A pattern that is found counts twice: its match and its group."""
    return [("ctx_score", "least(100, " + " + ".join(f"CASE WHEN {d.found(text, p)} THEN {2 * n} ELSE 0 END" for n, p in CONTEXT_WORDS) + ")")]


#: Rules of a corpus of notices: key, category, pattern.
CORPUS_RULES = [
    ("meta:portal", "meta", r"(통합\s*신고).{0,120}(대응\s*센터|안내|접수|처리)"), ("channel:sms", "channel", r"(문자|sms|mms|lms|알림톡)"), ("channel:call", "channel", r"(전화|통화|ars|콜센터|보이스\s*피싱)"),
    ("channel:kakao", "channel", r"(카카오톡|카톡|kakaotalk)"), ("channel:telegram", "channel", r"(텔레그램|telegram)"), ("channel:email", "channel", r"(이메일|email|메일)"),
    ("action:transfer", "action", r"(송금|이체|입금|계좌\s*이체|대포\s*통장|계좌번호)"), ("action:cash", "action", r"(현금|인출|출금|atm)"), ("action:otp", "action", r"(otp|인증\s*번호|인증\s*코드|보안\s*코드|일회용\s*비밀번호|2차\s*인증)"),
    ("action:remote", "action", r"(원격|원격\s*제어|teamviewer|팀\s*뷰어|anydesk|애니\s*데스크|quick\s*support|퀵\s*서포트)"), ("action:install", "action", r"(apk|앱\s*설치|어플\s*설치|프로그램\s*설치|출처\s*알\s*수\s*없는\s*앱|알\s*수\s*없는\s*출처|권한\s*허용)"),
    ("action:phish_link", "action", r"(https?://|bit\.ly|tinyurl|링크|url|주소\s*클릭)"), ("action:loan", "action", r"(대출|금리|한도|저금리|고금리|대환)"), ("action:job", "action", r"(취업|채용|알바|부업|재택|구인)"),
    ("imp:police", "impersonation", r"(경찰|경찰청|수사관|형사|사이버\s*수사)"), ("imp:prosecutor", "impersonation", r"(검찰|검사|검찰청)"), ("imp:court", "impersonation", r"(법원|영장|체포|구속|재판)"),
    ("imp:bank", "impersonation", r"(은행|금감원|금융감독원|카드사|고객센터)"), ("imp:courier", "impersonation", r"(택배|배송|우체국|물류|운송장)"), ("platform:toss", "platform", r"(토스|toss)"),
    ("platform:kakaobank", "platform", r"(카카오\s*뱅크|kakaobank)"), ("pressure:threat", "pressure", r"(협박|구속|체포|즉시|지금\s*당장|벌금|압류|계좌\s*동결|긴급)"),
]
#: Phrases of notices that would match too much.
BOILERPLATE = (r"경찰청\s*-\s*금융사기\s*통합\s*신고\s*대응\s*센터", r"금융사기\s*통합\s*신고\s*대응\s*센터", r"보이스\s*피싱", r"스미싱", r"접수\s*부터\s*처리\s*까지", r"자주\s*묻는\s*질문", r"FAQ")


def without_boilerplate(d: Spark, text: str = "text") -> str:
    for p in BOILERPLATE:
        text = d.swap(text, p, " ")
    return text


def seams() -> list[tuple[str, str]]:
    """What stands on both sides of each gap (\\s*) of the patterns of `without_boilerplate` and `corpus_counts`: only there can a match go on over a line's end. An empty side may be anything."""
    side = r"[^|()\\*+?.{}\[\]]*"
    found = [(m[1], m[2]) for p in (*BOILERPLATE, *(r[2] for r in CORPUS_RULES)) for m in re.finditer(rf"({side})\\s\*(?=({side}))", p)]
    return list(dict.fromkeys(found))


def seam_masks(d: Spark, texts: list[str]) -> Steps:
    """tails and heads of a line, bits of the `seams` whose first side it ends with and whose second it begins with, in any of the `texts`, its forms while boilerplate goes; a blank form begins with all."""
    either = lambda test: "(" + " OR ".join(test(t) for t in texts) + ")"
    bits = lambda rows: " + ".join(f"CASE WHEN {c} THEN {1 << n}L ELSE 0L END" for n, c in enumerate(rows))
    tails = [either(lambda t: d.found(t, rf"{a}\s*\z")) for a, _ in seams()]
    heads = [either(lambda t: d.found(t, rf"^\s*(?:{b}|\z)")) for _, b in seams()]
    return [("tails", bits(tails)), ("heads", bits(heads))]


def corpus_counts(d: Spark, text: str = "body") -> Steps:
    """n_<i> for the rules in their order, and the signature: of each of three categories the rule found most often, the first among equals."""
    return [*((f"n_{i}", d.count(text, p)) for i, (_, _, p) in enumerate(CORPUS_RULES)), corpus_signature()]


def corpus_signature() -> tuple[str, str]:
    """The signature from n_<i>."""
    picks = []
    for category in ("channel", "action", "impersonation"):
        own = [i for i, r in enumerate(CORPUS_RULES) if r[1] == category]
        most = f"greatest({', '.join(f'n_{i}' for i in own)})"
        picks.append(f"CASE WHEN {most} = 0 THEN '{category}:none' " + " ".join(f"WHEN n_{i} = {most} THEN '{CORPUS_RULES[i][0]}'" for i in own) + " END")
    others = " + ".join(f"n_{i}" for i in range(1, len(CORPUS_RULES)))
    return ("signature", f"CASE WHEN n_0 > 0 AND {others} = 0 THEN 'channel:portal|action:portal|imp:portal' ELSE concat_ws('|', {', '.join(picks)}) END")


#: A stub's features and the case types that they point to, first match first.
FEATURES = [
    ("otp", r"인증번호|OTP|보안코드"), ("remote", r"원격|teamviewer|팀뷰|anydesk|애니데스크|지원앱|앱\s*설치|설치"), ("transfer", r"이체|송금|입금|계좌"), ("cash", r"현금|봉투|퀵|대면"), ("travel", r"출국|항공|비행기|공항|여권|동남아|현지|취업"),
    ("blackmail", r"유흥|업소|성매매|유포|협박|영상|폭로"), ("pii", r"주민|신분증|계좌번호|카드번호|개인정보"), ("cred", r"비밀번호|로그인|아이디"), ("url", r"https?://|www\."), ("qr", r"QR|큐알|큐싱"),
    ("go_bank", r"atm|은행/?atm|현금인출|창구|은행으로|은행\s*가|방문"), ("typo", r"타이포|오타|유사문자|비슷한\s*주소|도메인"), ("short", r"단축|short|t\.|bit\.|tiny"),
]
CASE_TYPES = [
    ("blackmail_sexvisit", r"유흥|유포|협박|영상|폭로|불륜|성매매|업소"), ("job_travel", r"출국|항공|비행기|여권|현지|취업|동남아|캄보|라오|태국"), ("delivery_link", r"택배|배송|운송장|부재|보관"), ("fine_refund_link", r"과태료|범칙금|미납|납부|환급"),
    ("bank_install", r"원격|앱설치|설치|팀뷰|애니데|anydesk|지원앱"), ("bank_otp", r"인증번호|otp|보안코드"), ("account_takeover_cred", r"비밀번호|로그인|계정|인증\s*실패|잠금"), ("pii_collection", r"주민|계좌|카드번호|신분증|개인정보"),
    ("loan_fee", r"대출|수수료|보증금|선입금"), ("go_bank_atm", r"atm|현금인출|은행으로|창구"), ("cash_pickup", r"퀵|봉투|현금|직접\s*전달|대면"),
]


def stub_features(d: Spark, text: str = "text") -> Steps:
    """keywords of a stub and its case type; without a pattern the type is open, to be drawn."""
    kinds = " ".join(f"WHEN {d.found(text, p)} THEN '{t}'" for t, p in CASE_TYPES)
    return [("keywords", d.joined(d.kept([(k, d.found(text, p)) for k, p in FEATURES]), ",")), ("case_type", f"CASE {kinds} ELSE 'open' END")]


#: Which attachments are kept, and names of pages that say nothing of their source.
ATTACHMENT = (r"\.(pdf|hwp|hwpx|doc|docx|ppt|pptx|xls|xlsx|zip|txt|md|csv)$", r"(사례|수법|피해|주의|경고|신종|악성|대응|보이스피싱|스미싱|사기)", r"(이의신청서|신청서|서식|양식|작성(?:예시|방법)|제출서류|위임장|동의서|확인서)")
GENERIC = ("detail", "detail_", "list", "list_", "page", "pages", "board", "boardlist", "boarddetail")


def attachment_skipped(d: Spark, name: str = "name") -> str:
    ending, keep, form = ATTACHMENT
    return f"CASE WHEN trim({name}) = '' THEN false WHEN NOT {d.found(name, ending)} THEN true WHEN {d.found(name, keep)} THEN false ELSE {d.found(name, form)} END"


def source_of_path(d: Spark, path: str = "path") -> Steps:
    """source and number of a page's file; a name that says nothing gives way to the folder below `pages`, else to the file's own folder."""
    generic = ", ".join(f"'{g}'" for g in GENERIC)
    return [
        ("base", d.first(path, r"([^/]*)$", 1)), ("parent", d.first(path, r"([^/]+)/[^/]*$", 1)), ("below", d.first(path, r".*/pages/([^/]+)", 1)),
        ("stem", d.first("base", r"([a-z0-9_]+).*pstSn[_-]?\d+", 1)), ("pst", d.first("base", r"pstSn[_-]?(\d+)", 1)),
        ("source", "CASE WHEN pst = '' THEN NULL WHEN stem = '' THEN nullif(parent, '') WHEN lower(stem) IN (" + generic + ") THEN coalesce(nullif(below, ''), nullif(parent, '')) ELSE stem END"),
    ]
