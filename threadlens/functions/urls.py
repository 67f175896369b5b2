"""URL scalars: extraction, hosts, registrable domains, suffix and brand tests, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.text import java_pattern, trim_all

SCHEME_URL = r"""(?i)\bhttps?://[^\s<>"')\]]+"""
WWW_URL = r"""(?i)\bwww\.[^\s<>"')\]]+"""
BARE_DOMAIN = r"""\b[a-zA-Z][a-zA-Z0-9-]{0,61}(?:\.[a-zA-Z0-9-]{1,63})+\b"""
BARE_DOMAIN_PATH = r"""\b[a-zA-Z0-9][a-zA-Z0-9-]{0,61}(?:\.[a-zA-Z0-9-]{1,63})+\b(?:/[^\s<>"')\]]*)?"""

#: Fixed lists: second-level registries, official bank and finance hosts, shorteners, file endings, top-level domains.
SECOND_LEVEL = ("co.kr", "or.kr", "go.kr", "ac.kr", "ne.kr")
OFFICIAL_HOSTS = (
    "kbstar.com", "wooribank.com", "shinhan.com", "kebhana.com", "hanabank.com", "ibk.co.kr", "nonghyup.com", "sc.co.kr",
    "standardchartered.co.kr", "citibank.co.kr", "busanbank.co.kr", "knbank.co.kr", "imbank.co.kr", "dgb.co.kr", "jbbank.co.kr",
    "kjbank.com", "jejubank.co.kr", "kakaobank.com", "tossbank.com", "kbanknow.com", "epost.go.kr", "cu.co.kr", "kfcc.co.kr",
)
SHORTENERS = ("t.co", "bit.ly", "tinyurl.com", "goo.gl", "rebrand.ly", "cutt.ly", "is.gd", "vo.la", "me2.do", "han.gl")
DOWNLOAD_ENDINGS = (".apk", ".exe", ".msi", ".dmg", ".pkg", ".scr", ".bat", ".cmd", ".ps1", ".zip", ".rar", ".7z")
SUSPICIOUS_TLDS = ("xyz", "top", "shop", "click", "icu", "info", "work", "live", "loan", "support", "monster", "buzz", "cyou", "cfd", "sbs")
#: Words that name a brand, and the hosts that are its own.
BRANDS = (
    (("국민은행", "KB국민", "kbstar"), ("kbstar.com", "kbfg.com", "kbcard.com")),
    (("신한", "신한은행"), ("shinhan.com", "shinhanbank.com")),
    (("우리은행", "woori"), ("wooribank.com",)),
    (("하나은행", "hana"), ("hanafn.com", "hanabank.com")),
    (("농협", "NH농협"), ("nonghyup.com", "nhbank.com")),
    (("기업은행", "IBK"), ("ibk.co.kr",)),
    (("카카오뱅크",), ("kakaobank.com",)),
    (("토스", "토스뱅크"), ("toss.im", "tossbank.com")),
    (("케이뱅크", "K뱅크"), ("kbanknow.com",)),
)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))


def extract_urls(text: Column, most: int = 30) -> Column:
    """URLs with a scheme, then with www, then bare domains that begin with a letter; without closing marks, first seen first."""
    t = F.coalesce(text, F.lit(""))
    clean = lambda x: trim_all(F.regexp_replace(F.regexp_replace(x, r"""[),.;:'"\]]+\z""", ""), r"""^[("'\[\s]+""", ""))
    found = F.transform(F.concat(_all(t, SCHEME_URL), _all(t, WWW_URL), _all(t, BARE_DOMAIN)), clean)
    return F.slice(F.array_distinct(F.filter(found, lambda x: x != "")), 1, most)


def extract_scored_urls(text: Column, most: int = 20) -> Column:
    """As `extract_urls`, but bare domains may begin with a digit and have a path, and every URL gets a scheme."""
    t = F.coalesce(text, F.lit(""))

    def clean(x: Column) -> Column:
        for pattern in (r"""[)\]}>"'`]+\z""", r"[.,!?;:]+\z", r"…+\z", r"""^[("'\[\s]+"""):
            x = F.regexp_replace(x, pattern, "")
        return trim_all(x)

    found = F.filter(F.transform(F.concat(_all(t, SCHEME_URL), _all(t, WWW_URL), _all(t, BARE_DOMAIN_PATH)), clean), lambda x: x != "")
    schemed = F.transform(found, lambda x: F.when(F.rlike(x, F.lit("(?i)^https?://")), x).otherwise(F.concat(F.lit("https://"), x)))
    return F.slice(F.array_distinct(schemed), 1, most)


def inline_urls(text: Column) -> Column:
    """URLs with a scheme as they are written."""
    return _all(F.coalesce(text, F.lit("")), r"""(?i)\bhttps?://[^\s<>"')]+""")


def protocol(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    """The lower-case host without user, port and final dot; empty if the URL has none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*\z", ""), r"\.\z", ""))


def path_and_query(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1))


def registrable_domain(host_: Column) -> Column:
    """The last two labels, or three under the second-level registries."""
    parts = F.filter(F.split(host_, r"\."), lambda x: x != "")
    tail2 = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")
    tail3 = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3), ".")
    return F.when(F.size(parts) <= 2, host_).when(tail2.isin(*SECOND_LEVEL), tail3).otherwise(tail2)


def suffixes(host_: Column) -> Column:
    """The host and all its endings at a dot, for equi-joins with lists of allowed hosts."""
    parts = F.split(host_, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def is_under(host_: Column, allowed: tuple[str, ...]) -> Column:
    out = host_.isin(*allowed)
    for a in allowed:
        out = out | host_.endswith("." + a)
    return out


def url_feature_hits(text: Column, urls: Column) -> Column:
    """Hits of the eight URL features of the first 10 URLs: (rule_id, label, stage, weight, matched)."""
    parsed = F.filter(F.transform(F.slice(urls, 1, 10), lambda u: F.struct(u.alias("raw"), host(u).alias("host"), protocol(u).alias("proto"), path_and_query(u).alias("path"))), lambda p: p["host"] != "")
    lowered = F.lower(text)

    def matches(test, value) -> Column:
        return F.array_distinct(F.slice(F.transform(F.filter(parsed, test), value), 1, 6))

    def ending(p: Column) -> Column:
        out = F.lit(False)
        for e in DOWNLOAD_ENDINGS:
            out = out | p["path"].endswith(e) | p["path"].contains(e + "?") | p["path"].contains(e + "&")
        return out

    def foreign(own: tuple[str, ...], first: str) -> Column:
        return F.transform(F.filter(parsed, lambda p: ~is_under(p["host"], own)), lambda p: F.concat(F.lit(f"{first} → "), p["host"]))

    raw, name = (lambda p: p["raw"]), (lambda p: p["host"])
    brand = [F.when(F.exists(F.array(*(F.lit(t.lower()) for t in tokens)), lambda t: lowered.contains(t)), foreign(own, tokens[0])).otherwise(F.array().cast("array<string>")) for tokens, own in BRANDS]
    features = [
        ("url_http", "URL: HTTP(비TLS)", "verify", 8, matches(lambda p: p["proto"] == "http", raw)),
        ("url_at_sign", "URL: '@' 포함(우회/위장 가능)", "verify", 16, matches(lambda p: p["raw"].contains("@"), raw)),
        ("url_ip_host", "URL: IP 호스트(의심)", "verify", 18, matches(lambda p: F.rlike(p["host"], F.lit(r"^\d{1,3}(\.\d{1,3}){3}\z")), name)),
        ("url_punycode", "URL: Punycode(xn--) 의심", "verify", 20, matches(lambda p: p["host"].contains("xn--"), name)),
        ("url_deep_subdomain", "URL: 서브도메인 과다(위장 가능)", "verify", 10, matches(lambda p: F.size(F.split(p["host"], r"\.")) >= 5, name)),
        ("url_suspicious_tld", "URL: 의심 TLD", "verify", 12, matches(lambda p: F.regexp_extract(p["host"], r"([^.]+)\z", 1).isin(*SUSPICIOUS_TLDS), name)),
        ("url_download_ext", "URL: 설치/압축 파일 확장자", "install", 22, matches(ending, raw)),
        ("url_brand_mismatch", "은행/결제사칭-도메인불일치", "verify", 26, F.array_distinct(F.slice(F.flatten(F.array(*brand)), 1, 6))),
    ]
    hits = [F.when(F.size(m) > 0, F.struct(F.lit(i).alias("rule_id"), F.lit(label).alias("label"), F.lit(stage).alias("stage"), (F.lit(float(w)) * F.least(F.lit(2), F.size(m))).alias("weight"), m.alias("matched"))) for i, label, stage, w, m in features]
    return F.array_compact(F.array(*hits))


#: Fixed lists: words that a bank's host has, keys that name a further address, what only stands for a bank in general.
BANK_TOKENS = (
    "kbstar", "wooribank", "shinhan", "kebhana", "hanabank", "ibk", "nonghyup", "nh", "sc", "citibank", "busanbank", "knbank", "imbank", "dgb", "jbbank", "kjbank",
    "jejubank", "kakaobank", "tossbank", "kbanknow",
)
REDIRECT_KEYS = ("url", "u", "r", "redirect", "redirect_url", "redirecturl", "return", "returnurl", "continue", "next", "target")
GENERIC_TAILS = ("bank", "card", "pay", "help", "info", "site")


def _trimmed_tail(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), r"""[)\],.?!'"`}>]+\z""", "")


def plain_url(raw: Column) -> Column:
    """A URL as it is meant: without closing marks, with what hides it undone, and with a scheme where it has a host."""
    u = _trimmed_tail(raw)
    u = F.regexp_replace(u, r"(?i)\bhxxp(s?)\s*(?:\[:\]|:)\s*//", "http$1://")
    u = F.regexp_replace(u, r"(?i)\b(https?)\s*(?:\[:\]|:)\s*//", "$1://")
    u = F.trim(F.regexp_replace(F.regexp_replace(u, r"\[\.\]|\(\.\)|\{\.\}", "."), r"(?i)&colon;|&#58;", ":"))
    # through an array of one, so that what undoes the hiding is worked out once
    named = lambda x: F.when(F.rlike(x, F.lit("(?i)^https?://")), x).when(F.rlike(x, F.lit(r"(?i)^www\.|\.[a-z]{2,}([/?#]|\z)")), F.concat(F.lit("https://"), x)).otherwise(x)
    return F.get(F.transform(F.array(u), named), F.lit(0))


#: Fixed patterns: addresses as they are written to pass filters.
LOOSE = (
    r"(?i)https?://[^\s)]+", r"(?i)\bwww\.[^\s)]+", r"(?i)\bhxxps?://[^\s)]+", r"(?i)\b(?:https?|hxxps?)\s*(?:\[:\]|:)\s*//[^\s)]+",
    r"(?i)\b[a-z0-9-]+(?:\[\.\]|\(\.\)|\{\.\})[a-z0-9-]+(?:\[\.\]|\(\.\)|\{\.\})?[a-z0-9.-]*[^\s)]+", r"(?i)\b(?:[a-z0-9-]+\.)+[a-z]{2,24}(?:/[^\s)]*)?\b",
)


def loose_urls(text: Column, most: int = 12) -> Column:
    """URLs with or without scheme, hidden ones among them, made plain; first seen first."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    # what a text must have for each of the patterns to be found: those without pay for this test only
    must = (low.contains("://"), low.contains("www."), low.contains("hxxp"), t.contains("//"), t.contains("[.]") | t.contains("(.)") | t.contains("{.}"), t.contains("."))
    found = F.concat(*(F.when(m, _all(t, p)).otherwise(F.array().cast("array<string>")) for m, p in zip(must, LOOSE, strict=True)))
    found = F.transform(found, lambda x: _trimmed_tail(plain_url(x)))
    return F.slice(F.array_distinct(F.filter(found, lambda x: x != "")), 1, most)


def markdown_links(text: Column, most: int = 10) -> Column:
    """[label](address) as structs of text and href."""
    pattern = r"\[([^\]]{1,120})\]\((https?://[^\s)]+)\)"
    part = lambda g: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(g))
    return F.slice(F.transform(F.arrays_zip(part(1), part(2)), lambda x: F.struct(F.trim(x["0"]).alias("text"), _trimmed_tail(x["1"]).alias("href"))), 1, most)


def redirect_target(url: Column) -> Column:
    """The address that a URL's query hands on, of the keys in their order the first; empty without one."""
    pattern = F.lit(rf"(?i)[?&]({'|'.join(REDIRECT_KEYS)})=([^&#]*)")
    keys = F.array(*(F.lit(k) for k in REDIRECT_KEYS))
    decoded = lambda v: F.coalesce(F.try_url_decode(v), v)
    pairs = F.arrays_zip(F.regexp_extract_all(url, pattern, F.lit(1)), F.regexp_extract_all(url, pattern, F.lit(2)))
    values = F.transform(pairs, lambda x: F.struct(F.array_position(keys, F.lower(x["0"])).alias("at"), decoded(decoded(x["1"])).alias("value")))
    onward = F.array_sort(F.filter(values, lambda x: F.rlike(x["value"], F.lit(r"(?i)^(https?|hxxps?|www\.)"))))
    return F.coalesce(plain_url(F.get(onward, F.lit(0))["value"]), F.lit(""))


def redirect_chain(df: DataFrame, url_col: str, hops: int = 5) -> DataFrame:
    """Adds `chain`, the addresses from `url_col` on along what queries hand on, `hops` at most, ending before one that was there."""
    out = df.withColumn("chain", F.array(plain_url(F.col(url_col)))).withColumn("__last", F.get("chain", F.lit(0)))
    for _ in range(hops - 1):
        out = out.withColumn("__next", F.when(F.col("__last") == "", "").otherwise(redirect_target(F.col("__last"))))
        fresh = (F.col("__next") != "") & ~F.array_contains("chain", F.col("__next"))
        out = out.withColumns({"chain": F.when(fresh, F.array_append("chain", F.col("__next"))).otherwise(F.col("chain")), "__last": F.when(fresh, F.col("__next")).otherwise(F.lit(""))})
    return out.drop("__last", "__next")


def brand_token(host_: Column) -> Column:
    """The first bank word in a host: short ones as a whole label or a part of one between hyphens, others within a label too; null without one."""
    labels = F.filter(F.split(host_, r"\."), lambda x: x != "")
    parts = F.flatten(F.transform(labels, lambda x: F.split(x, "-")))
    joined = F.concat_ws(" ", labels)
    return F.coalesce(*(F.when(F.array_contains(parts, t) | (joined.contains(t) if len(t) > 3 else F.lit(False)), t) for t in BANK_TOKENS))


def base_label(host_: Column) -> Column:
    """The first label, of letters, digits and hyphens."""
    return F.regexp_replace(F.coalesce(F.get(F.filter(F.split(F.lower(host_), r"\."), lambda x: x != ""), F.lit(0)), F.lit("")), "[^a-z0-9-]", "")


def named_host(host_: Column) -> Column:
    """A struct of a host, its domain and its domain's first label: what the tests below ask for again and again is worked out once."""
    rooted = F.get(F.transform(F.array(host_), lambda h: F.struct(h.alias("host"), registrable_domain(h).alias("root"))), F.lit(0))
    return F.get(F.transform(F.array(rooted), lambda x: F.struct(x["host"].alias("host"), x["root"].alias("root"), base_label(x["root"]).alias("label"), base_label(x["host"]).alias("own"))), F.lit(0))


def _few_apart(x: Column, word: str) -> Column:
    """In how many letters `x` and `word` differ, if in two at most, else 99. Lengths never differ by more than that."""
    return F.pmod(F.levenshtein(x, F.lit(word), 2), F.lit(100))


def looks_like_official(named: Column, official: tuple[str, ...] = OFFICIAL_HOSTS) -> Column:
    """`named` is a host as `named_host` gives it. Whether one that is not official is one or two letters off an official one, in its domain or in its first label: the nearest decides. Without a list
    of official hosts, the bank words of five letters and more decide."""
    root, label = named["root"], named["label"]
    near = []
    for o in official:
        near.append(F.least(_few_apart(root, o), F.when(label != "", _few_apart(label, o.split(".")[0])).otherwise(99)))
    for t in () if official else BANK_TOKENS:
        if len(t) >= 5 and not (len(t) >= 6 and t[-4:] in GENERIC_TAILS):
            near.append(F.when(label.endswith(t[-4:]), _few_apart(label, t)).otherwise(99) if len(t) >= 6 else _few_apart(label, t))
    close = F.array_min(F.array(*near)).isin(1, 2)
    return ~is_under(named["host"], official) & close if official else close


def looks_like_brand(named: Column, claims: Column) -> Column:
    """Whether a host's first label is one letter off a bank word, or two where the text claims to be a bank."""
    label = named["own"]
    out = F.lit(False)
    for t in BANK_TOKENS:
        if len(t) > 3:
            out = out | F.when(claims, _few_apart(label, t).isin(1, 2)).otherwise(_few_apart(label, t) == 1)
    return (label != "") & out


def variant_url(domain: Column, seed: Column) -> Column:
    """A made address like an official one, by the seed: itself, two letters swapped, one dropped, one doubled, or letters that look alike."""
    n = F.length(F.regexp_extract(domain, r"^([^.]*)", 1))
    at = F.pmod(F.xxhash64(seed, domain), F.greatest(n - 1, F.lit(1))).cast("int")
    head, tail = F.substring(domain, F.lit(1), at), lambda k: F.substring(domain, at + 1 + k, F.length(domain))
    one, two = F.substring(domain, at + 1, F.lit(1)), F.substring(domain, at + 2, F.lit(1))
    alike = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(domain, "rn", "m"), "vv", "w"), "o", "0"), "l", "1")
    kind = F.pmod(F.xxhash64(domain, seed), F.lit(5))
    made = F.when(kind == 0, domain).when(kind == 1, F.concat(head, two, one, tail(2))).when(kind == 2, F.concat(head, tail(1))).when(kind == 3, F.concat(head, one, one, tail(1))).otherwise(alike)
    return F.concat(F.lit("https://"), made)
