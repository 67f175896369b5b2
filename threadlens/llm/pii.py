"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation of each format.

A number or date that passes its format's validation is mapped to another valid one of the same format; what separates its
digits stays, and so does how many digits each part has and, for a date, the order in which it is read. The map is a permutation of the
values of one format and shape that depends on the key, format and shape alone, so equal values get equal pseudonyms in
all documents and on all executors, different values different ones, and nothing has to be looked up or joined.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KINDS = ("email", "ip", "ipv6", "iban", "card", "ssn", "date", "phone")
#: Fixed formats. Cards have 13 to 19 digits, dates the years 1900 to 2099.
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])")
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:.])")
IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")
_FORMS = {
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}(?![0-9])|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}(?![0-9])",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|00[1-9][0-9]{8,13}(?![0-9])|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: Digits after a digit and a point are decimals. After a digit and a comma they may be a row's next value; a group of thousands has no form of these.
_OPEN = r"(?=[0-9+(])(?<![0-9A-Za-z_+])(?:(?=[+(])|(?<![0-9]\.))"
NUMBER = re.compile(_OPEN + "(?:" + "|".join(f"(?P<{k}>{form})" for k, form in _FORMS.items()) + ")(?![A-Za-z_])")
FORMS = {k: re.compile(f"{_OPEN}(?:{form})(?![A-Za-z_])") for k, form in _FORMS.items()}
FIRST_DAY, DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()


def feistel(key: bytes, tweak: str, value: int, size: int) -> int:
    """A permutation of range(size): a Feistel network on the next whole number of bits, walked on until it is back in range."""
    bits = max(2, (size - 1).bit_length())
    low = bits // 2
    high = bits - low
    while True:
        widths, a, b = (high, low), value >> low, value & ((1 << low) - 1)
        for i in range(ROUNDS):
            mixed = hashlib.blake2b(f"{tweak}:{size}:{i}:{b}".encode(), key=key, digest_size=64).digest()
            a, b = b, (a ^ int.from_bytes(mixed, "big")) & ((1 << widths[i % 2]) - 1)
        value = (a << low) | b
        if value < size:
            return value


def luhn_digit(body: str) -> str:
    """The check digit of `body`."""
    total = sum(x - 9 if (x := int(c) * (2 - i % 2)) > 9 else x for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    """`shape` with its digits replaced one by one."""
    taken = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(taken), shape)


def _walk(key: bytes, tweak: str, digits: str, valid: Callable[[str], bool]) -> str:
    """Permutes digit strings of one length until the result is valid as the argument is."""
    while True:
        digits = str(feistel(key, tweak, int(digits), 10 ** len(digits))).zfill(len(digits))
        if valid(digits):
            return digits


def _card(key: bytes, text: str) -> str | None:
    digits = re.sub(r"[^0-9]", "", text)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = digits[0] + str(feistel(key, "card", int(digits[1:-1]), 10 ** (len(digits) - 2))).zfill(len(digits) - 2)
    return _refill(text, body + luhn_digit(body))


def _ssn(key: bytes, text: str) -> str | None:
    valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    digits = text.replace("-", "")
    return _refill(text, _walk(key, "ssn", digits, valid)) if valid(digits) else None


def _ip(key: bytes, text: str) -> str | None:
    parts = text.split(".")
    if max(map(int, parts)) > 255:
        return None
    plain = lambda xs: all(x == str(int(x)) for x in xs)
    if plain(parts):
        value = feistel(key, "ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
        return ".".join(str(x) for x in value.to_bytes(4, "big"))
    # with leading zeros: among those of the same widths that have some
    sizes = [min(256, 10 ** len(x)) for x in parts]
    size = sizes[0] * sizes[1] * sizes[2] * sizes[3]
    value = 0
    for x, n in zip(parts, sizes):
        value = value * n + int(x)
    while True:
        value = rest = feistel(key, "ip" + ".".join(str(len(x)) for x in parts), value, size)
        out = []
        for x, n in zip(reversed(parts), reversed(sizes)):
            rest, octet = divmod(rest, n)
            out.append(str(octet).zfill(len(x)))
        if not plain(out):
            return ".".join(reversed(out))


def _alphabetic(key: bytes, tweak: str, text: str, alphabet: Callable[[str], str], valid: Callable[[str], bool]) -> str:
    """Permutes the characters that have an alphabet, each within its own, until the result is valid as the argument is."""
    shape = "".join(x[0] if (x := alphabet(c)) else c for c in text)
    while True:
        value, size = 0, 1
        for c in text:
            if own := alphabet(c):
                value, size = value * len(own) + own.index(c), size * len(own)
        if size < 2:
            return text
        value, out = feistel(key, f"{tweak}:{shape}", value, size), []
        for c in reversed(text):
            if own := alphabet(c):
                value, x = divmod(value, len(own))
                out.append(own[x])
            else:
                out.append(c)
        text = "".join(reversed(out))
        if valid(text):
            return text


def _ipv6(key: bytes, text: str) -> str | None:
    """Groups keep their number of digits; letters are of one case as before, or of both."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return None
    cases = lambda t: (any(c in "abcdef" for c in t), any(c in "ABCDEF" for c in t))
    was = cases(text)
    symbols = "0123456789" + ("ABCDEF" if was[1] else "") + ("abcdef" if was[0] or not was[1] else "")
    # without letters: one permutation with those that have small ones
    valid = (lambda t: True) if not was[1] else (lambda t: cases(t) == was)
    return _alphabetic(key, f"ipv6{symbols}", text, lambda c: symbols if c != ":" else "", valid)


def iban_check(country: str, body: str) -> str:
    """The two check digits of an account number."""
    return str(98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97).zfill(2)


def _iban(key: bytes, text: str) -> str | None:
    whole = text.replace(" ", "")
    country, check, body = whole[:2], whole[2:4], whole[4:]
    if not 11 <= len(body) <= 30 or iban_check(country, body) != check:
        return None
    kinds = lambda c: "0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    body = _alphabetic(key, "iban" + country, body, kinds, lambda t: True)
    taken = iter(country + iban_check(country, body) + body)
    return "".join(c if c == " " else next(taken) for c in text)


def _as_date(year: int, month: int, day: int) -> dt.date | None:
    try:
        return dt.date(year, month, day)
    except ValueError:
        return None


def _date(key: bytes, text: str) -> str | None:
    """The year first; or last and the day first; or, where only that is a date, the month first. A pseudonym is read as the date was."""
    parts = re.split(r"[-/.]", text)
    marks = re.findall(r"[-/.]", text)
    widths = tuple(map(len, parts))
    forms = {"ymd": lambda d: (d.year, d.month, d.day), "dmy": lambda d: (d.day, d.month, d.year), "mdy": lambda d: (d.month, d.day, d.year)}
    numbers = [int(x) for x in parts]
    if widths[0] == 4:
        form, date = "ymd", _as_date(*numbers)
    elif date := _as_date(numbers[2], numbers[1], numbers[0]):
        form = "dmy"
    else:
        form, date = "mdy", _as_date(numbers[2], numbers[0], numbers[1])
    if date is None:
        return None
    ordinal = date.toordinal() - FIRST_DAY
    while True:
        ordinal = feistel(key, f"date:{form}:{widths}", ordinal, DAYS)
        date = dt.date.fromordinal(FIRST_DAY + ordinal)
        new = [str(n).zfill(w) for n, w in zip(forms[form](date), widths)]
        if tuple(map(len, new)) == widths and not (form == "mdy" and date.day <= 12):
            return "".join(n + m for n, m in zip(new, [*marks, ""]))


def _phone(key: bytes, text: str) -> str | None:
    digits = re.sub(r"[^0-9]", "", text)
    plan = lambda d: d[0] in "23456789" and d[3] in "23456789"
    if text.startswith("+1") and len(digits) == 11:
        head, rest = "1", digits[1:]
    elif text.startswith("00"):
        return "00" + _walk(key, "phone00", digits[2:], lambda d: d[0] != "0")
    elif text.startswith("+"):
        head, rest = digits[:2], digits[2:]
        if not 6 <= len(rest) <= 13:
            return None
        return _refill(text, head + _walk(key, "phone", rest, lambda d: True))
    elif len(digits) == 10:
        head, rest = "", digits
    else:
        return None
    # numbers that are none of the plan are permuted among those that are none, so the map stays one to one
    kind = plan(rest)
    return _refill(text, head + _walk(key, "phone", rest, lambda d: plan(d) == kind))


def _email(key: bytes, text: str) -> str | None:
    """Letters of the local part stay letters of their case, digits digits; the rest and the domain stay."""
    local, _, domain = text.rpartition("@")
    value, size, radix = 0, 1, []
    for c in local.lower():
        n = 26 if "a" <= c <= "z" else 10 if "0" <= c <= "9" else 1
        radix.append(n)
        value, size = value * n + (ord(c) - ord("a") if n == 26 else int(c) if n == 10 else 0), size * n
    if size < 2:
        return None
    value, out = feistel(key, "email", value, size), []
    for c, n in zip(reversed(local), reversed(radix)):
        value, x = divmod(value, n)
        out.append(c if n == 1 else str(x) if n == 10 else chr(ord("A" if c.isupper() else "a") + x))
    return "".join(reversed(out)) + "@" + domain


MAPS = {"email": _email, "ip": _ip, "ipv6": _ipv6, "iban": _iban, "card": _card, "ssn": _ssn, "date": _date, "phone": _phone}


def _readings(text: str, start: int) -> Iterator[tuple[int, str]]:
    """Where a number that starts at `start` may end, and its kind. What looks like one card may be a card and the groups after it, so
    a card may end at any of its groups, longest first."""
    for kind, form in FORMS.items():
        if m := form.match(text, start):
            yield m.end(), kind
            if kind == "card":
                for cut in reversed([g.end() for g in re.finditer(r"[0-9]+", m[0])][:-1]):
                    if sum(c.isdigit() for c in m[0][:cut]) >= 13:
                        yield start + cut, kind


def _pseudonyms(texts: pd.Series, mapped: Callable[[str, str], str | None]) -> pd.DataFrame:
    rows = []
    for text in texts:
        counts = dict.fromkeys(KINDS, 0)

        def put(kind: str, value: str) -> str | None:
            new = mapped(kind, value)
            counts[kind] += new is not None
            return new

        def numbers(piece: str) -> str:
            """Each place that has a number's form: the first form that validates, else on from inside it."""
            parts, done, at = [], 0, 0
            while m := NUMBER.search(piece, at):
                at = m.start() + 1
                for end, kind in _readings(piece, m.start()):
                    if (new := put(kind, piece[m.start() : end])) is not None:
                        parts += [piece[done : m.start()], new]
                        done = at = end
                        break
            return "".join([*parts, piece[done:]])

        def apart(piece: str, forms: list[tuple[str, re.Pattern, str]]) -> str:
            """What has letters is taken out of the way first, so that digits in it are not read as numbers."""
            if not forms:
                return numbers(piece)
            kind, form, sign = forms[0]
            if sign and sign not in piece:
                return apart(piece, forms[1:])
            parts, at = [], 0
            for m in form.finditer(piece):
                if (new := put(kind, m[0])) is not None or kind == "email":
                    parts += [apart(piece[at : m.start()], forms[1:]), new or m[0]]
                    at = m.end()
            return "".join([*parts, apart(piece[at:], forms[1:])])

        if text:
            text = apart(text, [("email", EMAIL, "@"), ("ipv6", IPV6, ":"), ("iban", IBAN, "")])
        rows.append((text, *counts.values()))
    return pd.DataFrame(rows, columns=["text", *(f"n_{k}" for k in KINDS)])


def pseudonymise(text: Column, key: str) -> Column:
    """A struct of the text with pseudonyms and the number of values replaced, by kind. A null text stays null, with zeros."""
    secret = hashlib.sha256(key.encode()).digest()
    schema = "text string, " + ", ".join(f"n_{k} int" for k in KINDS)

    @F.pandas_udf(schema)
    def replaced(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        mapped = lru_cache(1 << 16)(lambda kind, value: MAPS[kind](secret, value))
        for texts in batches:
            yield _pseudonyms(texts, mapped)

    return replaced(text)


def pseudonymised(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `df`: id, text with pseudonyms, and n_<kind>. Null texts stay null, repeated rows repeat; other columns are not read."""
    return df.select(F.col(id_col), pseudonymise(F.col(text_col), key).alias("p")).select(id_col, "p.*")
