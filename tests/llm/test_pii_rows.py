"""Personal data that stands beside other values."""

import re

import pandas as pd
import pytest

from threadlens.llm import pii

CARD, OTHER, AMEX = "4111111111111111", "5555555555554444", "3782 822463 10005"


def replaced(text):
    found = pii._pseudonyms(pd.Series([text]), lambda kind, value: pii.MAPS[kind](b"k" * 32, value)).iloc[0]
    return found["text"], {k: int(found[f"n_{k}"]) for k in pii.KINDS if found[f"n_{k}"]}


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        (f"{CARD},{OTHER}", {"card": 2}),
        ("2020-01-02,2020-03-04,123-45-6789", {"date": 2, "ssn": 1}),
        ("17,555-123-4567,192.168.0.1", {"phone": 1, "ip": 1}),
        ("4111 1111 1111 1111 12/27", {"card": 1}),
        ("4111 1111 1111 1111 123", {"card": 1}),
        ("order 1234 4111 1111 1111 1111", {"card": 1}),
        ("4111 1111 1111 1111 5555 5555 5555 4444", {"card": 2}),
        (f"{AMEX} 9999", {"card": 1}),
        ("call 555 123 4567", {"phone": 1}),
        ("555-123-4567 890", {"phone": 1}),
        ("3.4111111111111111 and 1,234,567 and 12,345.67", {}),
    ],
)
def test_values_in_rows(text, kinds):
    new, counts = replaced(text)
    assert counts == kinds
    assert re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", text) or "ip" in kinds
    assert (new == text) == (not kinds)


def test_equal_values_stay_linked():
    alone = replaced("4111 1111 1111 1111")[0]
    assert replaced("4111 1111 1111 1111 12/27")[0] == alone + " 12/27"
    assert replaced("4111 1111 1111 1111 123")[0] == alone + " 123"
    assert replaced(f"{CARD},{OTHER}")[0] == replaced(CARD)[0] + "," + replaced(OTHER)[0]
