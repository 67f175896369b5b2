"""Composed conversations against a version that writes one after another."""

import re

import xxhash
from pyspark.sql import functions as F

from threadlens.operators import scenarios as sc
from threadlens.queries import queries


def composed(id, case_type, keywords, seed, attempts, benign):
    def draw(k, name, n):
        return (lambda h: (h - 2**64 if h >= 2**63 else h) % n)(xxhash.xxh64(f"{seed}:{id}:{k}:{name}".encode(), seed=42).intdigest())

    named = [c for c in sc.CASES if c != "benign"]
    if draw(0, "benign", 10**6) < int(benign * 10**6):
        case_type = "benign"
    elif case_type not in named:
        case_type = named[draw(0, "case", len(named))]
    keywords = "" if case_type == "benign" else keywords
    anchors, vector, who, pressures = sc.CASES[case_type]
    for k in range(1, attempts + 1):
        caller = sc.CALLERS[draw(k, "caller", 4)].replace("{a}", f"{draw(k, 'a', 10000):04d}").replace("{b}", f"{draw(k, 'b', 10000):04d}")
        url = f"https://h{draw(k, 'host', 997)}.example.invalid/{draw(k, 'path', 97)}" if vector == "url" else ""
        if case_type in ("delivery_link", "fine_refund_link"):
            pressures = ("press_urgent",) if draw(k, "urgent", 2) == 0 else ()
        kept = [sc.PRESSURES[p] for p in pressures] + [sc.ANCHORS[a][0].replace("{url}", url) for a in anchors] + ([] if anchors else list(sc.ADVICE))
        cap = min(20, max(draw(k, "length", 17) + 4, len(kept) + 3))
        room = cap - len(kept)
        turns = [("S", (f"[발신 {caller}] " if caller else "") + sc.ORGANISATIONS[who] + "입니다."), ("R", sc.ANSWERS[draw(k, "answer", 3)]), ("S", "확인 절차가 필요합니다.")]
        if keywords and room >= 4:
            turns.append(("S", "참고 키워드: " + keywords))
        if draw(k, "doubt", 10**6) < 400000 and cap >= 6 and len(turns) + 2 <= room:
            turns += [("R", sc.DOUBTS[draw(k, "refusal", 3)]), ("S", "오늘 안으로 답변 부탁드립니다.")]
        if draw(k, "late", 10**6) < 550000 and cap >= 8:
            for i in range(min(draw(k, "more", 5) + 2, max(room - len(turns), 0))):
                turns.append(("SR"[i % 2], (sc.QUESTIONS if i % 2 else sc.STEPS)[draw(k, f"step{i}", 3)]))
        turns += [("S", x) for x in kept]
        u = draw(k, "tail", 10**6)
        for x in sc.TAIL:
            if u < x:
                turns += [("R", sc.ENDS[draw(k, "end", 3)]), ("S", "추가 안내입니다.")]
        turns = turns[:cap]
        sender = "\n".join(t for r, t in turns if r == "S")
        shown = [a for a, (_, cue) in sc.ANCHORS.items() if re.search(cue, sender, re.I)]
        links = len(set(re.findall(r"https?://\S+", sender)))
        errors = [n for n, bad in [("url_count>1", links > 1), ("malicious_missing_anchor", case_type != "benign" and not shown), ("missing_pretext_or_cred", sum(r == "S" for r, _ in turns) < 2), ("missing_phone", not re.search(sc.PHONE, sender)),
                                   ("benign_has_danger_anchor", case_type == "benign" and set(shown) - {"A_LINK"}), ("url_vector_mismatch", not url and links > 0)] if bad]
        if not errors:
            return case_type, k, caller, url, shown, turns, []
    return case_type, None, None, None, None, None, errors


def test_like_one_after_another(spark):
    kinds = [*sc.CASES, "open", None]
    rows = [(f"id {i}" if i % 50 else None, kinds[i % len(kinds)], ["", None, "otp,url", "링크 https://a.b/c"][i % 4]) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, case_type string, keywords string")
    for seed, attempts, benign in ((1, 5, 0.2), (2, 1, 0.0), (3, 2, 1.0)):
        seen = set()
        for parts in (1, 5):
            got = {(r.id, r.case_type, tuple(r.errors), r.attempt, r.caller, r.url, tuple(r.anchors or ()), tuple(map(tuple, r.turns or ()))) for r in sc.scenarios(df.repartition(parts), seed, attempts, benign).collect()}
            wanted = set()
            for i, c, w in rows:
                case, k, caller, url, shown, turns, errors = composed(i or "", c, w or "", seed, attempts, benign)
                wanted.add((i, case, tuple(errors), k, caller, url, tuple(shown or ()), tuple(turns or ())))
            assert got == wanted
            seen |= {e for g in got for e in g[2]}
        assert attempts > 2 or "missing_phone" in seen
        assert attempts > 1 or {"url_count>1", "url_vector_mismatch"} <= seen  # the stub's words bring a second address, which no attempt mends


def test_every_conversation_of_the_table(spark):
    rows = queries()["gen_scenarios"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    for r in rows:
        if r.attempt is None:
            assert r.errors and r.thread is None
        else:
            assert not r.errors and 3 <= r.n_turns <= 20 and re.search(sc.PHONE, r.thread)
            assert (r.case_type == "benign") == (not r.anchors)
            assert all(sc.ANCHORS[a][0].split("{")[0] in r.thread for a in sc.CASES[r.case_type][0])  # reserved places are never cut
    assert sum(r.attempt is None for r in rows) < 0.01 * len(rows) and {r.attempt for r in rows} >= {1, 2, 3}


def test_nothing_to_do(spark):
    assert sc.scenarios(spark.createDataFrame([], "id long, case_type string, keywords string, caller string, s int")).count() == 0
