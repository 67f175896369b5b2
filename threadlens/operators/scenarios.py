"""Test conversations for the analysis, composed from stubs: drawn by hash, checked, and drawn again where a check fails. The lines are neutral ones of our own, with reserved hosts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.text import java_pattern

#: For each case type its anchors, vector, impersonation and pressures.
CASES = {
    "delivery_link": (("A_LINK",), "url", "imp_delivery", ()), "fine_refund_link": (("A_LINK",), "url", "imp_gov", ()), "bank_otp": (("A_OTP",), "none", "imp_bank", ("press_urgent",)),
    "bank_install": (("A_INSTALL",), "none", "imp_bank", ("press_urgent",)), "account_takeover_cred": (("A_CRED",), "url", "imp_bank", ()), "pii_collection": (("A_PII",), "url", "", ()),
    "family_urgent_transfer": (("A_TRANSFER",), "none", "", ("press_urgent", "press_secrecy")), "loan_fee": (("A_TRANSFER",), "none", "", ("press_urgent",)),
    "go_bank_atm": (("A_GO_BANK",), "none", "imp_court", ("press_urgent", "press_secrecy")), "cash_pickup": (("A_CASH_PICKUP",), "none", "", ("press_urgent", "press_secrecy")),
    "job_travel": (("A_TRAVEL",), "none", "", ()), "blackmail_sexvisit": (("A_TRANSFER",), "none", "", ("press_threat", "press_secrecy", "press_urgent")), "benign": ((), "none", "", ()),
}
#: What a sender is called, what a pressure and an anchor look like in a text, and the forms of a telephone number.
ORGANISATIONS = {"imp_delivery": "택배 안내", "imp_gov": "행정 안내", "imp_bank": "은행 안내", "imp_court": "법원 안내", "": "안내"}
PRESSURES = {"press_urgent": "긴급 건이니 지금 바로 확인 바랍니다.", "press_secrecy": "보안상 외부 공유 금지입니다.", "press_threat": "미이행 시 법적 조치 예정입니다."}
ANCHORS = {
    "A_LINK": ("링크에서 확인 바랍니다: {url}", r"https?://\S+"), "A_OTP": ("인증번호 확인이 필요합니다.", r"인증번호|OTP"), "A_INSTALL": ("원격 지원앱 설치가 필요합니다.", r"원격|앱\s*설치"), "A_TRANSFER": ("송금 확인이 필요합니다.", r"송금|이체|입금"),
    "A_CRED": ("로그인 확인이 필요합니다.", r"로그인|비밀번호"), "A_PII": ("신분증 확인이 필요합니다.", r"신분증|주민"), "A_CASH_PICKUP": ("현금 대면 전달 절차가 있습니다.", r"대면|퀵"), "A_GO_BANK": ("은행으로 방문이 필요합니다.", r"은행으로|ATM"), "A_TRAVEL": ("출국 일정 확인이 필요합니다.", r"출국|여권"),
}
PHONE = r"(?<!\d)(?:01[016789]|070|050|02|0[3-6]\d)[ -]?\d{3,4}[ -]?\d{4}(?!\d)|(?<!\d)1[568]\d{2}[ -]?\d{4}(?!\d)"
CALLERS = ("010-{a}-{b}", "070-{a}-{b}", "1588-{b}", "")  # the last one is withheld
ANSWERS, DOUBTS = ("무슨 내용인가요?", "확인해볼게요.", "네."), ("왜 그걸 확인해야 하나요?", "대표번호로 확인하고 다시 연락드리겠습니다.", "지금은 진행하지 않겠습니다.")
STEPS, QUESTIONS, ENDS = ("절차 안내입니다.", "확인이 필요합니다.", "기한이 있습니다."), ("지금 해야 하나요?", "어떻게 하나요?", "왜요?"), ("확인했습니다.", "이상한데요.", "진행 안 하겠습니다.")
ADVICE = ("민감한 정보는 다른 채널로 전달하지 않는 방식이 안전합니다.", "필요하면 대표번호로 직접 확인하는 방식이 안전합니다.")
MOST, MILLION = 20, 1_000_000
TAIL = [int(MILLION * 0.35**j) for j in range(1, MOST // 2 + 1)]  # a further pair of turns with a chance of 0.35 each time


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _texts(*xs: str) -> Column:
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


def _said(role: str, texts: Column) -> Column:
    return F.transform(texts, lambda x: F.struct(F.lit(role).alias("role"), x.alias("text")))


def scenarios(stubs: DataFrame, seed: int = 1, attempts: int = 5, benign: float = 0.2) -> DataFrame:
    """One conversation for each of `stubs(id, case_type, keywords)`: (id, case_type, attempt, caller, url, anchors, turns, errors).

    Every choice is a hash of the seed, the stub's id, the attempt and the choice's name, so the result is the same for any partitioning, order or retried task. A stub is `benign` at the given share, a case type not in CASES is drawn. The pressures, anchors and advice have
    reserved places: what is optional takes the room that they leave of the length (drawn, longer if they need it, 20 at most). `anchors` are those that the sender's words really show. A conversation that breaks a rule is drawn anew; when all attempts did, the row has
    no turns, the errors of the last one, and `attempt` is null. A benign conversation names no keywords, as those are cues. Null types and keywords are empty; repeated ids give equal rows; a null id counts as an empty one. One projection: a fold over attempts that draws nothing once one is fine.
    """

    def draw(k: Column, name: str, n: int) -> Column:
        return F.pmod(F.xxhash64(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), k.cast("string"), F.lit(name))), F.lit(n))

    def pick(k: Column, name: str, xs: tuple[str, ...]) -> Column:
        return F.get(_texts(*xs), draw(k, name, len(xs)).cast("int"))

    def by_case(values: dict[str, Column]) -> Column:
        out = F
        for case, value in values.items():
            out = out.when(F.col("case_type") == case, value)
        return out

    named = [c for c in CASES if c != "benign"]
    whole = F.lit(0)
    kind = F.when(draw(whole, "benign", MILLION) < int(benign * MILLION), "benign").when(F.col("case_type").isin(named), F.col("case_type")).otherwise(pick(whole, "case", tuple(named)))
    given = stubs.select("id", F.coalesce("keywords", F.lit("")).alias("keywords"), kind.alias("case_type")).withColumn("keywords", F.when(F.col("case_type") == "benign", "").otherwise(F.col("keywords")))

    def attempt(k: Column) -> Column:
        number = lambda n: F.lpad(draw(k, n, 10000).cast("string"), 4, "0")
        caller = F.replace(F.replace(pick(k, "caller", CALLERS), F.lit("{a}"), number("a")), F.lit("{b}"), number("b"))
        url = F.when(by_case({c: F.lit(v[1] == "url") for c, v in CASES.items()}), F.concat(F.lit("https://h"), draw(k, "host", 997).cast("string"), F.lit(".example.invalid/"), draw(k, "path", 97).cast("string")))
        may = by_case({c: F.lit(c in ("delivery_link", "fine_refund_link")) for c in CASES}) & (draw(k, "urgent", 2) == 0)
        pressed = F.when(may, _texts(PRESSURES["press_urgent"])).otherwise(by_case({c: _texts(*(PRESSURES[p] for p in v[3])) for c, v in CASES.items()}))
        anchored = by_case({c: _texts(*(ANCHORS[a][0] for a in v[0])) for c, v in CASES.items()})
        advised = by_case({c: _texts(*(() if v[0] else ADVICE)) for c, v in CASES.items()})
        return _let(F.struct(caller.alias("caller"), F.coalesce(url, F.lit("")).alias("url"), F.concat(pressed, anchored, advised).alias("kept")), lambda p: turned(k, p))

    def turned(k: Column, p: Column) -> Column:
        reserved = F.size(p["kept"])
        cap = F.least(F.lit(MOST), F.greatest((draw(k, "length", MOST - 3) + 4).cast("int"), reserved + 3))
        room = cap - reserved
        tag = F.when(p["caller"] != "", F.concat(F.lit("[발신 "), p["caller"], F.lit("] "))).otherwise("")
        opening = F.concat(_said("S", F.array(F.concat(tag, by_case({c: F.lit(ORGANISATIONS[v[2]]) for c, v in CASES.items()}), F.lit("입니다.")))), _said("R", F.array(pick(k, "answer", ANSWERS))), _said("S", _texts("확인 절차가 필요합니다.")))
        words = F.when((F.col("keywords") != "") & (room >= 4), _said("S", F.array(F.concat(F.lit("참고 키워드: "), F.col("keywords"))))).otherwise(_said("S", _texts()))

        def doubted(turns: Column) -> Column:
            fits = (draw(k, "doubt", MILLION) < 400_000) & (cap >= 6) & (F.size(turns) + 2 <= room)
            return F.when(fits, F.concat(turns, _said("R", F.array(pick(k, "refusal", DOUBTS))), _said("S", F.array(F.lit("오늘 안으로 답변 부탁드립니다."))))).otherwise(turns)

        def built(turns: Column) -> Column:
            n = F.least(draw(k, "more", 5).cast("int") + 2, F.greatest(room - F.size(turns), F.lit(0)))
            pool = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct(
                F.when(i % 2 == 0, "S").otherwise("R").alias("role"),
                F.get(F.when(i % 2 == 0, _texts(*STEPS)).otherwise(_texts(*QUESTIONS)), F.pmod(F.xxhash64(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), k.cast("string"), F.concat(F.lit("step"), i.cast("string")))), F.lit(3)).cast("int")).alias("text")))
            return F.when((draw(k, "late", MILLION) < 550_000) & (cap >= 8), F.concat(turns, F.slice(pool, 1, n))).otherwise(turns)

        u = draw(k, "tail", MILLION)
        pairs = sum((F.when(u < x, 1).otherwise(0) for x in TAIL), F.lit(0))
        tail = F.flatten(F.array_repeat(F.concat(_said("R", F.array(pick(k, "end", ENDS))), _said("S", _texts("추가 안내입니다."))), pairs))
        kept = _said("S", F.transform(p["kept"], lambda x: F.replace(x, F.lit("{url}"), p["url"])))
        full = _let(_let(F.concat(opening, words), doubted), lambda t: F.slice(F.concat(built(t), kept, tail), 1, cap))
        return _let(full, lambda turns: _let(F.array_join(F.transform(F.filter(turns, lambda x: x["role"] == "S"), lambda x: x["text"]), "\n"), lambda sender: checked(k, p, turns, sender)))

    def checked(k: Column, p: Column, turns: Column, sender: Column) -> Column:
        shown = F.array_compact(F.array(*(F.when(F.rlike(sender, F.lit("(?i)" + java_pattern(cue))), a) for a, (_, cue) in ANCHORS.items())))
        calm = F.col("case_type") == "benign"
        addresses = F.size(F.array_distinct(F.regexp_extract_all(sender, F.lit(r"https?://\S+"), F.lit(0))))
        rules = {
            "url_count>1": addresses > 1,
            "malicious_missing_anchor": ~calm & (F.size(shown) == 0),
            "missing_pretext_or_cred": F.size(F.filter(turns, lambda x: x["role"] == "S")) < 2,
            "missing_phone": ~F.rlike(sender, F.lit(PHONE)),
            "benign_has_danger_anchor": calm & (F.size(F.array_except(shown, _texts("A_LINK"))) > 0),
            "url_vector_mismatch": (p["url"] == "") & (addresses > 0),
        }
        errors = F.array_compact(F.array(*(F.when(broken, name) for name, broken in rules.items())))
        return F.struct(k.alias("attempt"), p["caller"].alias("caller"), p["url"].alias("url"), shown.alias("anchors"), turns.alias("turns"), errors.alias("errors"))

    shape = "struct<attempt:int,caller:string,url:string,anchors:array<string>,turns:array<struct<role:string,text:string>>,errors:array<string>>"
    tried = F.aggregate(F.sequence(F.lit(1), F.lit(attempts)), F.lit(None).cast(shape), lambda held, k: F.when(F.size(held["errors"]) == 0, held).otherwise(attempt(k).cast(shape)))
    fine = F.size("s.errors") == 0
    return given.withColumn("s", tried).select("id", "case_type", *(F.when(fine, F.col(f"s.{c}")).alias(c) for c in ("attempt", "caller", "url", "anchors", "turns")), "s.errors")
