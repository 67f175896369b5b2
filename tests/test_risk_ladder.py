"""Each branch of the risk decision by hand: what makes it true, and the same with one part missing."""

from threadlens.operators import analyze as an
from threadlens.plans import catalog as cat

PAY, INSTALL, TRANSFER, CASH, DEMAND, MOVE = "ctx_payment_request", "ctx_install_mention", "ctx_transfer_demand", "ctx_cash_pickup", "ctx_demand", "ctx_contact_move"
#: ids, cues, whether there is a link in the text, whether a host is internal, score, level
ROWS = [
    # score alone
    ("", "", 0, 0, 34.99, "low"), ("", "", 0, 0, 35, "medium"), ("", "", 1, 0, 100, "medium"),
    # sure signs
    (f"messenger_phishing {PAY}", "", 0, 0, 50, "high"), ("messenger_phishing", "", 0, 0, 50, "medium"), ("messenger_phishing", "otp_request", 0, 0, 50, "high"), ("messenger_phishing", "code_request", 0, 0, 0, "high"),
    ("link", "code_request", 0, 0, 0, "high"), ("", "code_request", 1, 0, 0, "high"), ("", "code_request", 0, 0, 50, "medium"),
    ("link urgent", "otp_entry", 0, 0, 10, "high"), ("link threat", "otp_entry", 0, 0, 10, "high"), ("link", "otp_entry now_word", 0, 0, 10, "high"), ("link authority", "otp_entry", 0, 0, 50, "medium"), ("link txn_alert", "otp_entry", 0, 0, 50, "medium"),
    (f"link {DEMAND}", "otp_entry", 0, 0, 10, "high"), (f"link {DEMAND}", "otp_entry account_notice", 0, 0, 50, "medium"),
    (f"link {INSTALL}", "business doc_lure", 0, 0, 10, "high"), (f"link {INSTALL}", "business", 0, 0, 50, "medium"), (f"link {INSTALL}", "doc_lure", 0, 0, 50, "medium"), (INSTALL, "business doc_lure", 0, 0, 50, "medium"),
    ("job_lure link", "", 0, 0, 10, "high"), ("job_lure", "", 0, 0, 50, "medium"), ("pii_request", "high_pay", 0, 0, 10, "high"), ("authority", "high_pay", 0, 0, 50, "medium"), (f"ctx_job_scam {MOVE}", "", 0, 0, 10, "high"),
    # a demand, an act, a confirming sign and a structure
    ("call_remote otp authority", "", 0, 0, 10, "high"), ("call_remote otp", "", 0, 0, 50, "medium"),
    (f"link {INSTALL} authority", "", 0, 0, 10, "high"), (f"{INSTALL} authority", "", 0, 0, 50, "medium"), ("link apk threat", "", 0, 0, 10, "high"),
    (f"otp {DEMAND}", "otp_request", 0, 0, 10, "high"), (f"otp {DEMAND}", "", 0, 0, 50, "medium"), (DEMAND, "otp_request", 0, 0, 50, "medium"),
    (f"ctx_family_scam urgent {PAY}", "", 0, 0, 10, "high"), ("ctx_family_scam urgent", "", 0, 0, 50, "medium"), ("ctx_family_scam call_first_contact call_otp urgent", "", 0, 0, 10, "high"), ("ctx_family_scam call_first_contact call_otp", "", 0, 0, 50, "medium"),
    (f"{PAY} threat", "", 0, 0, 10, "high"), (PAY, "", 0, 0, 50, "medium"), (f"{PAY} {DEMAND}", "", 0, 0, 50, "medium"), (f"{PAY} ctx_secrecy", "", 0, 0, 10, "high"), (PAY, "anti_verify", 0, 0, 10, "high"),
    (f"invest_lure {MOVE} {INSTALL}", "", 0, 0, 10, "high"), (f"{MOVE} {INSTALL}", "", 0, 0, 50, "medium"), (f"invest_lure {MOVE} call_otp", "", 0, 0, 50, "medium"),
    (f"{TRANSFER} authority", "", 0, 0, 10, "high"), (TRANSFER, "", 0, 0, 50, "medium"), ("transfer txn_alert", "", 0, 0, 10, "high"), ("transfer", "", 0, 0, 50, "medium"), ("go_bank_atm", "", 0, 0, 10, "high"),
    (f"{CASH} {MOVE}", "", 0, 0, 10, "high"), (f"{CASH} call_first_contact", "", 0, 0, 50, "medium"), (CASH, "", 0, 0, 50, "medium"),
    ("ctx_job_scam authority call_otp", "", 0, 0, 10, "high"), ("authority call_otp", "", 0, 0, 50, "medium"), ("ctx_job_scam authority", "", 0, 0, 50, "medium"),
    # advice to be careful
    (f"{PAY} threat", "advice", 0, 0, 100, "low"), (f"{PAY} threat", "advice advice_action", 0, 0, 100, "high"), (f"{PAY} threat", "advice advice_not", 0, 0, 100, "high"),
    # an alert that its reader acknowledges
    ("link txn_alert", "code_request self_ack", 0, 0, 100, "medium"), ("link txn_alert", "code_request benign_ack", 0, 0, 10, "medium"), ("link", "code_request self_ack alert_thread", 0, 0, 10, "medium"), ("link txn_alert", "code_request", 0, 0, 10, "high"), ("link", "code_request self_ack", 0, 0, 10, "high"),
    ("link txn_alert threat", "code_request self_ack", 0, 0, 10, "high"), ("link txn_alert", "code_request self_ack explicit_pay", 0, 0, 10, "high"), ("link txn_alert otp", "code_request self_ack", 0, 0, 10, "high"), ("txn_alert", "code_request self_ack", 1, 0, 10, "high"),
    ("link txn_alert otp urgent", "otp_entry self_ack", 0, 0, 10, "high"), (f"link txn_alert otp {DEMAND}", "otp_entry self_ack", 0, 0, 10, "medium"),
    # an installation and nothing else
    ("link apk call_first_contact", "", 0, 0, 100, "medium"), ("link apk call_first_contact", "explicit_pay", 0, 0, 100, "high"), ("link apk call_first_contact otp", "", 0, 0, 100, "high"),
    # the company's own support
    ("link", "code_request it_support", 0, 1, 20, "low"), ("link", "code_request it_support", 0, 0, 20, "high"), ("link", "code_request", 0, 1, 20, "high"), ("link otp", "code_request it_support", 0, 1, 20, "high"), ("link", "code_request it_support", 0, 1, 40, "medium"),
]


def test_each_branch(spark):
    cues = sorted(cat.THREAD_CUES)
    assert {c for r in ROWS for c in r[1].split()} <= set(cues)
    rows = [(n, ids.split(), bool(url), bool(internal), float(score), *(c in q.split() for c in cues)) for n, (ids, q, url, internal, score, _) in enumerate(ROWS)]
    schema = "n int, ids array<string>, any_url boolean, internal_host boolean, score_total double, " + ", ".join(f"q_{c} boolean" for c in cues)
    got = {r.n: r.risk_level for r in an.with_risk(spark.createDataFrame(rows, schema)).collect()}
    assert [(ROWS[n][:5], got[n]) for n in got if got[n] != ROWS[n][5]] == []
