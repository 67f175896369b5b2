"""Text scalars: normalisation, trimming, titles, dates, previews and tokens, as column expressions."""

from __future__ import annotations

from re import _constants as regex
from re import _parser as regex_parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers' scripting language has it; Java's \s knows only the ASCII part.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: A word boundary between ASCII word characters and all others; Java's \b counts Hangul as word characters.
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def java_pattern(pattern: str) -> str:
    """A pattern written with \\b and a final $ in the ASCII sense, for Java."""
    return pattern.replace(r"\b", BOUNDARY)


#: A Hangul syllable.
HANGUL = "[\uAC00-\uD7A3]"


def needs_hangul(pattern: str) -> bool:
    """Whether each match of a pattern holds a Hangul syllable; False where that is not plain to see."""
    syllable = lambda code: 0xAC00 <= code <= 0xD7A3

    def needs(items) -> bool:
        return any(
            syllable(x) if op is regex.LITERAL
            else all(needs(branch) for branch in x[1]) if op is regex.BRANCH
            else needs(x[3]) if op is regex.SUBPATTERN
            else all(kind is regex.LITERAL and syllable(y) or kind is regex.RANGE and syllable(y[0]) and syllable(y[1]) for kind, y in x) if op is regex.IN
            else x[0] > 0 and needs(x[2]) if op in (regex.MAX_REPEAT, regex.MIN_REPEAT)
            else False
            for op, x in items
        )

    return needs(regex_parser.parse(pattern))


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def normalize_thread(text: Column) -> Column:
    """Line ends to LF, tabs to spaces, runs of spaces to one, three and more line ends to two, trimmed."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n")
    t = F.regexp_replace(t, "\t", " ")
    t = F.regexp_replace(t, r"[ \x{00A0}]+", " ")
    return trim_all(F.regexp_replace(t, "\n{3,}", "\n\n"))


def normalize_corpus(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), " ", " ")
    t = F.regexp_replace(t, "[ \t]+", " ")
    t = F.regexp_replace(t, "\r\n", "\n")
    return trim_all(F.regexp_replace(t, "\n{3,}", "\n\n"))


def strip_html(html: Column) -> Column:
    t = F.coalesce(html, F.lit(""))
    for tag in ("script", "style", "noscript"):
        t = F.regexp_replace(t, rf"(?is)<{tag}{BOUNDARY}[^>]*>.*?</{tag}>", " ")
    return normalize_corpus(F.regexp_replace(t, "<[^>]+>", " "))


def infer_title(html: Column, body: Column) -> Column:
    """The <title>, else the first line that is not blank, of 200 characters at most."""
    titled = trim_all(F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    lines = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), trim_all), lambda x: x != "")
    return F.substring(F.coalesce(F.nullif(titled, F.lit("")), F.get(lines, F.lit(0)), F.lit("")), 1, 200)


def infer_date(text: Column) -> Column:
    """The first 20YY-M-D, dots and slashes allowed, as an ISO date; null without one."""
    pattern = r"(20\d{2})[.\-/]\s*(\d{1,2})[.\-/]\s*(\d{1,2})"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(F.rlike(text, F.lit(pattern)), F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))


def day_key(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def lexical(text: Column) -> Column:
    return F.lower(trim_all(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def for_embedding(text: Column) -> Column:
    """Lower case, without URLs, digits as 0, of 2200 characters at most."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), java_pattern(r"""\bhttps?://[^\s<>"')]+"""), " ")
    return F.substring(trim_all(F.regexp_replace(F.regexp_replace(t, r"[0-9]", "0"), r"\s+", " ")), 1, 2200)


def token(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def shortened(text: Column, size: int, mark: str) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(mark))).otherwise(text)


def lines_of(text: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), "\n", -1)


def speaker_lines(text: Column, speaker: str) -> Column:
    """The contents of the lines that begin with a speaker's letter and a colon."""
    mark = rf"(?i)^\s*{speaker}\s*:"
    return F.transform(F.filter(lines_of(text), lambda x: F.rlike(x, F.lit(mark))), lambda x: trim_all(F.regexp_replace(x, mark, "")))


def sender_text(text: Column) -> Column:
    """The sender's lines; the whole text if no line is marked so."""
    found = speaker_lines(text, "S")
    return F.when(F.size(found) == 0, F.coalesce(text, F.lit(""))).otherwise(F.array_join(found, "\n"))


def receiver_text(text: Column) -> Column:
    return F.array_join(speaker_lines(text, "R"), " ")


def recent_lines(text: Column, n: int = 16) -> Column:
    """The last n lines that are not blank, trimmed."""
    kept = F.filter(F.transform(lines_of(text), trim_all), lambda x: x != "")
    return F.slice(kept, F.greatest(F.size(kept) - n + 1, F.lit(1)), n)


def characters(text: Column) -> Column:
    return F.filter(F.split(text, "", -1), lambda c: c != "")


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters; none for shorter texts. Characters are split once, so the work is linear."""
    c = characters(lexical(text))
    starts = F.when(F.size(c) >= 3, F.sequence(F.lit(0), F.size(c) - 3)).otherwise(F.array().cast("array<int>"))
    whole = F.arrays_zip(c, F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 3, F.greatest(F.size(c) - 2, F.lit(0))))
    grams = F.transform(F.slice(whole, 1, F.greatest(F.size(c) - 2, F.lit(0))), lambda x: F.concat(x["0"], x["1"], x["2"]))
    return F.when(F.size(starts) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - |a ∩ b| / |a ∪ b| of two arrays without repeats; two empty ones are equal."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - common / union)


def marked_sender_lines(text: Column, by: str = " ") -> Column:
    """The lines that begin with S:, as they are, joined."""
    return F.array_join(F.filter(F.transform(lines_of(text), trim_all), lambda x: F.rlike(x, F.lit(r"^S:\s*"))), by)


#: Fixed patterns: headers of a block's first line, first match first; the name's group takes one character, as the pattern has it.
HEADERS = (
    r"^\[\s*(?:오전|오후)?\s*\d{1,2}:\d{2}\s*\]\s*(.{1,40}?)(?::\s*)?(.*)$", r"^\d{4}[.\-/]\d{1,2}[.\-/]\d{1,2}\s+(?:오전|오후)?\s*\d{1,2}:\d{2}\s+(.{1,40}?)(?::\s*)?(.*)$",
    r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}\s+(.{1,40}?)(?::\s*)?(.*)$", r"^(?:오전|오후)?\s*\d{1,2}:\d{2}\s+(.{1,40}?)(?::\s*)?(.*)$",
)


def parsed_block(block: Column) -> Column:
    """A struct of header, speaker and content of a block of lines: S: and R: first, then words for sender and receiver, then stamps with a name."""
    raw = trim_all(F.regexp_replace(F.coalesce(block, F.lit("")), "\r\n", "\n"))
    first = trim_all(F.regexp_extract(raw, r"^([^\n]*)", 1))
    rest = F.regexp_extract(raw, r"(?s)^[^\n]*\n?(.*)\z", 1)
    made = lambda header, who, after: F.struct(header.cast("string").alias("header"), who.alias("speaker"), trim_all(F.concat_ws("\n", F.nullif(trim_all(after), F.lit("")), F.nullif(rest, F.lit("")))).alias("content"))
    part = lambda p, g: F.regexp_extract(first, p, g)
    mark, word = r"(?i)^(S|R)\s*:\s*(.*)$", r"(?i)^(sender|receiver|발신|수신)\s*:\s*(.*)$"
    out = F.when(F.rlike(first, F.lit(mark)), made(F.lit(None), F.upper(part(mark, 1)), part(mark, 2)))
    out = out.when(F.rlike(first, F.lit(word)), made(F.lit(None), F.when(F.lower(part(word, 1)).isin("receiver", "수신"), "R").otherwise("S"), part(word, 2)))
    for p in HEADERS:
        out = out.when(F.rlike(first, F.lit(p)), made(first, F.nullif(trim_all(part(p, 1)), F.lit("")), part(p, 2)))
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("header"), F.lit(None).cast("string").alias("speaker"), raw.alias("content")))


def caller_number(text: Column) -> Column:
    """What stands in [발신 ...], as a number with hyphens where it is one; empty without it."""
    inside = F.regexp_extract(F.coalesce(text, F.lit("")), r"\[\s*발신\s*([^\]]+?)\s*\]", 1)
    three, two = r"(\d{2,4})\s*-\s*(\d{3,4})\s*-\s*(\d{3,4})", r"(\d{4})\s*-\s*(\d{4})"
    joined = lambda p, n: F.concat_ws("-", *(F.regexp_extract(inside, p, i + 1) for i in range(n)))
    rest = trim_all(F.regexp_replace(F.regexp_replace(inside, r"\s+", " "), r"\s*-\s*", "-"))
    return F.when(inside.contains("발신번호표시제한"), "발신번호표시제한").when(F.rlike(inside, F.lit(three)), joined(three, 3)).when(F.rlike(inside, F.lit(two)), joined(two, 2)).otherwise(rest)


def without_caller(text: Column) -> Column:
    """The text without the first [발신 ...] after S: or at its start."""
    raw = trim_all(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"))
    return trim_all(F.regexp_replace(raw, r"(?s)\A(.*?(?:\A|\bS:\s*))\[\s*발신[^\]]*\]\s*", "$1"))


def masked_replies(text: Column) -> Column:
    """The receiver's lines, and what follows them until the sender speaks again, as (reply)."""
    lines = lines_of(text)
    start = F.struct(F.lit(False).alias("reply"), F.array().cast("array<string>").alias("out"))
    mark = r"(?i)^\s*([SR])\s*:"

    def step(s: Column, line: Column) -> Column:
        who = F.upper(F.regexp_extract(line, mark, 1))
        reply = F.when(who == "", s["reply"]).otherwise(who == "R")
        shown = F.when(who == "R", "R: (reply)").when(who == "S", line).when(s["reply"], "(reply)").otherwise(line)
        return F.struct(reply.alias("reply"), F.array_append(s["out"], shown).alias("out"))

    return F.array_join(F.aggregate(lines, start, step, lambda s: s["out"]), "\n")


def once_in_a_row(lines: Column) -> Column:
    """An array without elements that equal the one before."""
    return F.filter(lines, lambda x, i: (i == 0) | (F.get(lines, i - 1) != x))


#: Fixed patterns: lines of portal pages that are no text, and where its text begins and ends.
PORTAL_DROP = r"(?i)^(네이버 연관채널 태그정보|본문으로 바로가기|메뉴열기|로그인|회원가입|기관소개|자주\s*묻는\s*질문|공지사항|보도자료|FAQ|예방\s*및\s*조치(\s*메뉴)?|알림[·.\s]*소식|목록)$"
PORTAL_NOTE = r"^이\s*누리집은\s*대한민국\s*공식\s*전자정부\s*누리집입니다\.?$|이메일\s*주소가\s*자동\s*수집|정보통신망법|게시글\s*보기$"
ATTACHMENT_DROP = r"^\[?\s*상세\s*방법\s*확인\s*\]?$|^게시글\s*보기$"
JUNK_LINE = r"경찰청\s*누리집$|^.{0,21}누리집$|^(회원가입|로그인|공지사항|보도자료|목록|기관소개|자주묻는 질문)$|^.{0,13}게시글\s*보기$|^(서울특별시|부산광역시|대구광역시|인천광역시|광주광역시|대전광역시|울산광역시|세종특별자치시|경기도남부|경기도북부|강원|충북|충남|전북|전남|경북|경남|제주)\s*경찰청$|본\s*홈페이지에.*이메일\s*주소가\s*자동\s*수집.*거부"


def _tidy_lines(text: Column) -> Column:
    return F.filter(F.transform(lines_of(text), lambda x: trim_all(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def portal_body(text: Column) -> Column:
    """The text of a portal page: no menus, from the posting on, up to the footer."""
    kept = once_in_a_row(F.filter(_tidy_lines(text), lambda x: ~F.rlike(x, F.lit(PORTAL_DROP))))
    joined = F.array_join(kept, "\n")
    body = F.regexp_replace(F.when(F.rlike(joined, F.lit(r"게시글\s*보기")), F.regexp_replace(joined, r"(?s)\A.*?((?:\A|(?<=\n))[^\n]*게시글\s*보기)", "$1")).otherwise(joined), r"(?s)(\A|\n)[^\n]*경찰청\s*누리집.*\z", "")
    return F.array_join(F.filter(F.split(body, "\n"), lambda x: (x != "") & ~F.rlike(x, F.lit(PORTAL_NOTE))), "\n")


def attachment_body(text: Column) -> Column:
    """The text of an attachment without blank lines, repeats in a row and buttons."""
    return F.array_join(F.filter(once_in_a_row(_tidy_lines(text)), lambda x: ~F.rlike(x, F.lit(ATTACHMENT_DROP))), "\n")


def example_lines(lines: Column, most: int = 6, size: int = 240) -> Column:
    """The lines that say something, each once, of `size` characters at most."""
    tidy = F.filter(F.transform(lines, lambda x: trim_all(F.regexp_replace(x, r"\s+", " "))), lambda x: (x != "") & ~F.rlike(x, F.lit(JUNK_LINE)))
    return F.slice(F.array_distinct(F.transform(tidy, lambda x: shortened(x, size, "…"))), 1, most)


#: Fixed pattern: mobile and internet numbers, with or without country code and hyphens.
PERSONAL_PHONE = r"(?:\+?82\s*)?0?(?:1[016789]|70)[\s-]?\d{3,4}[\s-]?\d{4}"


def personal_phones(text: Column, most: int = 6) -> Column:
    """Personal numbers, each once, with hyphens."""
    digits = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PERSONAL_PHONE), F.lit(0)), lambda x: F.regexp_replace(F.regexp_replace(x, r"[^\d]", ""), "^82", "0"))
    whole = F.transform(F.filter(digits, lambda x: F.rlike(x, F.lit(r"^0*(1[016789]|70)\d{7,8}$"))), lambda x: F.concat(F.lit("0"), F.regexp_replace(x, "^0+", "")))
    shown = lambda x: F.regexp_replace(x, r"^(\d{3})(\d{3,4})(\d{4})$", "$1-$2-$3")
    return F.slice(F.transform(F.array_distinct(whole), shown), 1, most)
