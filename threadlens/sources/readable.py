"""The main content of a page: the container whose paragraphs weigh most."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlens.functions.text import strip_html

#: Elements by their part in a page, and names that speak for and against main content.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title".split())
INLINE = frozenset("a abbr b bdi bdo cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
ASIDE = frozenset("nav aside footer header form button select iframe svg head".split())
LIKELY, UNLIKELY = re.compile(r"article|body|content|entry|main|page|post|text|story", re.I), re.compile(r"\bads?\b|banner|breadcrumb|comment|cookie|footer|menu|modal|popup|promo|related|share|sidebar|sponsor|widget", re.I)
TAG_SCORE = {"article": 10, "main": 10, "section": 5, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "form": -3, "ul": -3, "ol": -3, "li": -3, "th": -5}
LEAST = 25  # characters of a paragraph that counts

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>", re.S)
_NAMES = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_COMMAS = re.compile("[,，、،]")


class _Element:
    __slots__ = ("begin", "end", "left", "linked", "name", "own", "score", "size", "skip")

    def __init__(self, name: str, begin: int, score: float, skip: bool) -> None:
        self.name, self.begin, self.end, self.score, self.skip = name, begin, begin, score, skip
        self.own: list[str] = []  # texts directly in the element, inline elements in it included
        self.size = self.linked = 0


def _tidy(text: str) -> str:
    text = re.sub("[ \t]+", " ", text.replace(" ", " ").replace("\r\n", "\n"))
    return re.sub(r"\n\s*\n\s*", "\n\n", text).strip()


def main_content(page: str, spare_unlikely: bool = False) -> tuple[float, str]:
    """The score and the text of the container with most weight, the first among equals; (0, "") where no paragraph counts.

    One pass over the tags holds a stack of open elements. A paragraph of LEAST characters weighs 1, one more for each comma and for each 100 characters, 3 at most; its container gets that, the container's own half of it. A container starts with the
    value of its tag and 25 for a class or id that speaks for it, and in the end keeps the share of its text that is not linked. Asides, and what is named like one unless `spare_unlikely`, are left out.
    """
    stack, depth, done, pieces, at = [_Element("", 0, 0.0, False)], Counter(), [], [], 0

    def close() -> None:
        e = stack.pop()
        depth[e.name] -= 1
        up = stack[-1]
        if e.name in INLINE:
            up.own += e.own
        elif not e.skip:
            pieces.append("\n")
            said = _tidy("".join(e.own))
            if len(said) >= LEAST:
                weight = 1 + len(_COMMAS.findall(said)) + min(len(said) // 100, 3)
                first, second = (up, stack[-2] if len(stack) > 1 else None) if e.name in PARAGRAPHS else (e, up)
                first.score += weight
                if second is not None:
                    second.score += weight / 2
        e.end = len(pieces)
        if not e.skip:
            up.size += e.size
            up.linked += e.size if e.name == "a" else e.linked
            if e.name not in INLINE and e.name not in PARAGRAPHS and e.score > 0 and e.size > e.linked:
                done.append((e.score * (1 - e.linked / e.size), -e.begin, e.end))

    def say(text: str) -> None:
        if text and not stack[-1].skip:
            text = entities.unescape(text)
            pieces.append(text)
            stack[-1].own.append(text)
            stack[-1].size += len(text.strip())

    while found := _TOKEN.search(page, at):
        say(page[at : found.start()])
        at, ending, name = found.end(), found[1], (found[2] or "").lower()
        if not name:
            continue
        if ending:
            if depth[name]:
                while stack[-1].name != name:
                    close()
                close()
            continue
        if name in VOID:
            say("\n" if name in ("br", "hr") else "")
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if name not in INLINE:  # a block ends a paragraph that was left open, and the inline elements in it
            while depth["p"] and (stack[-1].name == "p" or stack[-1].name in INLINE):
                close()
        named = " ".join("".join(m) for m in _NAMES.findall(found[3]))
        against = bool(UNLIKELY.search(named)) and not LIKELY.search(named)
        skip = stack[-1].skip or name in ASIDE or (against and not spare_unlikely)
        stack.append(_Element(name, len(pieces), TAG_SCORE.get(name, 0) + (25 if LIKELY.search(named) else 0), skip))
        depth[name] += 1
        if not skip and name not in INLINE:
            pieces.append("\n")
        if found[3].rstrip().endswith("/"):
            close()
    say(page[at:])
    while len(stack) > 1:
        close()
    if not done:
        return 0.0, ""
    score, begin, end = max(done)
    return score, _tidy("".join(pieces[-begin:end]))


def main_text(html: Column, fallback: Column | None = None) -> Column:
    """A struct of title, text and main: the main content where it is long enough (a fifth of the fallback, 50 characters at least, of which 200 always do), else the fallback, by default all text without tags, and an empty title. Null pages are empty."""
    page, plain = F.coalesce(html, F.lit("")), strip_html(html) if fallback is None else fallback

    @F.pandas_udf("strict string, spared string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            yield pd.DataFrame([(main_content(x)[1], main_content(x, True)[1]) for x in pages], columns=["strict", "spared"])

    least = F.least(F.lit(200), F.greatest(F.lit(50), F.length(plain) * 0.2))
    title = F.trim(F.regexp_replace(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    held = F.transform(F.array(F.struct(read(page).alias("m"), plain.alias("plain"), least.alias("least"))), lambda x: F.struct(
        F.when(F.length(x["m"]["strict"]) >= x["least"], x["m"]["strict"]).when(F.length(x["m"]["spared"]) >= x["least"], x["m"]["spared"]).alias("found"), x["plain"].alias("plain")))
    return F.get(F.transform(held, lambda x: F.struct(
        F.when(x["found"].isNotNull(), F.substring(title, 1, 200)).otherwise("").alias("title"), F.coalesce(x["found"], x["plain"]).alias("text"), x["found"].isNotNull().alias("main"))), F.lit(0))
