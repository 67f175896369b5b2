"""Blocks with ranges against a fold by lines, telephone turns by hand, main contents against a tree."""

import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from threadlens.functions import blocks as bl
from threadlens.sources import readable as rd

LINES = ["S: hello", "r : hi  ", "  sender: x", "수신: 네", "", "   ", "plain words", "  indented", "오전 10:21 홍길동: 안녕", "9:05   : nobody", "10:21 no colon", "[오후 3:10] Kim: yes", "[3:10]", "2026.01.14 오후 3:21 Lee : q",
         "2026-01-14T10:21 z", "Sure: not a mark", "\ttab\t", "1:2 a: b", "\u3000wide\u3000", "S:"]


def by_lines(text, who=None):
    """The blocks of a text, one line after another."""
    out, held, at = [], None, 0
    for raw in (text or "").replace("\r\n", "\n").split("\n"):
        line, end = raw.strip(), at + len(raw)
        mark = re.match(r"(S|R|sender|receiver|발신|수신)\s*:", line, re.I)
        clock = r"(?:오전|오후)?\s*\d{1,2}:\d{2}"
        head = any(re.match(p, line) for p in (rf"\[\s*{clock}\s*\]", rf"\d{{4}}[.\-/]\d{{1,2}}[.\-/]\d{{1,2}}\s+{clock}", r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}", rf"{clock}\s+.{{1,40}}:"))
        if not line:
            held = None
        else:
            if held is None or mark or head or who:
                name = head and re.match(rf"(?:(?:\d{{4}}[.\-/]\d{{1,2}}[.\-/]\d{{1,2}}\s+)?{clock}\s+|\[\s*{clock}\s*\]\s*)(.{{1,40}}?):", line)
                speaker = ("R" if mark[1].lower() in ("r", "receiver", "수신") else "S") if mark else who or "U"
                held = [at, end, speaker, (name[1].strip() or None) if name else None, []]
                out.append(held)
            held[1] = end
            held[4].append(raw.rstrip())
        at = end + 1
    return [(*h[:4], "\n".join(h[4]).strip()) for h in out][:200]


def test_blocks_like_a_fold_by_lines(spark):
    rng = random.Random(5)
    texts = [None, "", "\n\n  \n", "x", "S: a\r\n\r\nb\r\nR: c", "\n".join(["S: many"] * 450)] + [rng.choice(["\n", "\r\n"]).join(rng.choice(LINES) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", bl.block_ranges(F.col("t")).alias("b"), bl.block_ranges(F.col("t"), "R").alias("p")).collect():
        assert [tuple(x) for x in r.b] == by_lines(r.t), r.t
        assert [tuple(x) for x in r.p] == by_lines(r.t, "R"), r.t


def test_ranges_give_the_blocks_back(spark):
    c = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select(F.concat(F.lit("S: "), "text").alias("t"))
    n = 0
    for r in c.select("t", bl.block_ranges(F.col("t")).alias("b"), bl.block_ranges(F.col("t"), "S").alias("p")).collect():
        for x in [*r.b, *r.p]:
            assert "\n".join(line.rstrip() for line in r.t[x.start : x.end].split("\n")).strip() == x.text
            n += 1
    assert n > 500


def test_long_threads(spark):
    df = spark.createDataFrame([("\n".join(["R: x"] * 100000) + "\n" * 100000 + " " * 100000 + "end",)], "t string")
    r = df.select(bl.block_ranges(F.col("t"), None, 200).alias("b"), bl.phone_turns(F.col("t")).alias("p")).first()
    assert len(r.b) == 200 and r.b[199].start == 199 * 5 and len(r.p) == 300


def test_telephone_turns(spark):
    rows = [("before\n\n s: a \n  b\n\nc\nR :\nS:\n d\nr: e",), ("",), (None,), ("S:\nR: ",), ("Sx: y",)]
    got = spark.createDataFrame(rows, "t string").select(bl.phone_turns(F.col("t")).alias("p")).select("p", bl.turns_text(F.col("p"), 2).alias("two"), bl.turns_text(F.col("p"), -1).alias("none")).collect()
    assert [[tuple(x) for x in r.p] for r in got] == [[("S", "before"), ("S", "a\nb\nc"), ("S", "d"), ("R", "e")], [], [], [], [("S", "Sx: y")]]
    assert [r.two for r in got] == ["S: before\nS: a\nb\nc", "", "", "", "S: Sx: y"] and got[0].none == ""


class Tree(HTMLParser):
    """A page as nested lists: [name, names, child, ...]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["", ""]
        self.path, self.mute = [self.root], None

    def handle_starttag(self, tag, attrs):
        if self.mute:
            return
        if tag in rd.VOID:
            self.path[-1].append("\n" if tag in ("br", "hr") else "")
        elif tag in rd.RAW:
            self.mute = tag
        else:
            if tag not in rd.INLINE:
                up = len(self.path)
                while up > 1 and self.path[up - 1][0] in rd.INLINE:
                    up -= 1
                if self.path[up - 1][0] == "p":
                    del self.path[up - 1 :]
            node = [tag, " ".join(v or "" for k, v in attrs if k in ("class", "id"))]
            self.path[-1].append(node)
            self.path.append(node)

    def handle_endtag(self, tag):
        if self.mute:
            self.mute = None if tag == self.mute else self.mute
        elif tag in [n[0] for n in self.path]:
            while self.path.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.mute:
            self.path[-1].append(data)


def by_tree(page, spare):
    """The main content of a page, each container judged by itself."""
    tree = Tree()
    tree.feed(page)
    tree.close()
    against = lambda n: bool(rd.UNLIKELY.search(n[1])) and not rd.LIKELY.search(n[1])
    out = lambda n: n[0] in rd.ASIDE or (against(n) and not spare)
    inner = lambda n: [c for c in n[2:] if isinstance(c, list) and not out(c)]

    def own(n):
        return "".join(c if isinstance(c, str) else own(c) if c[0] in rd.INLINE and not out(c) else "" for c in n[2:])

    def size(n, linked=False):
        return sum((0 if linked else len(c.strip())) if isinstance(c, str) else 0 if out(c) else size(c, linked and c[0] != "a") for c in n[2:])

    def text(n):
        return "".join(c if isinstance(c, str) else "" if out(c) else text(c) if c[0] in rd.INLINE else f"\n{text(c)}\n" for c in n[2:])

    def weight(n):
        said = rd._tidy(own(n))
        return 0 if n[0] in rd.INLINE or len(said) < rd.LEAST else 1 + sum(said.count(c) for c in ",，、،") + min(len(said) // 100, 3)

    def score(n):
        below = [(c, d) for c in inner(n) for d in [None, *inner(c)]]
        s = rd.TAG_SCORE.get(n[0], 0) + (25 if rd.LIKELY.search(n[1]) else 0) + weight(n)
        for c, d in below:
            m = c if d is None else d
            if d is None:
                s += weight(m) if m[0] in rd.PARAGRAPHS else weight(m) / 2
            elif m[0] in rd.PARAGRAPHS:
                s += weight(m) / 2
        return s

    best = (0.0, "")

    def walk(n):
        nonlocal best
        if n[0] and n[0] not in rd.INLINE | rd.PARAGRAPHS and size(n) and (raw := score(n)) > 0:
            value = raw * (1 - size(n, True) / size(n))
            if value > best[0]:
                best = (value, rd._tidy(text(n)))
        for c in inner(n):
            walk(c)

    walk(tree.root)
    return best


def test_main_content_like_a_tree(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    rng = random.Random(3)
    bits = ["<div>", "</div>", "<p>", "</p>", "<section class='story'>", "</section>", "<div id=sidebar>", "<ul>", "<li>", "</li>", "</ul>", "<b>", "</b>", "<a href='x'>", "</a>", "<nav>", "</nav>", "<br>", "&amp;", "<!-- c -->", "<script>var a='<p>';</script>",
            "short", "words that are long enough to count, as they say, here. ", "x, " * 50, "<table><tr><td>", "</td></tr></table>"]
    pages += ["<main>" + "".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) + "</main>" for _ in range(300)]
    for page in pages:
        for spare in (False, True):
            got, wanted = rd.main_content(page, spare), by_tree(page, spare)
            assert abs(got[0] - wanted[0]) < 1e-9 and got[1] == wanted[1], page


def test_main_text_and_its_guard(spark):
    body = "This is the body of an article, which is long enough to be taken for what it is. " * 4
    rows = [(1, f"<title> A  title </title><nav><a href=x>menu {'link ' * 30}</a></nav><article><p>{body}</p></article><footer>foot</footer>"), (2, "<p>too short</p>"), (3, None), (4, ""), (5, f"<div class=sidebar><p>{body}</p></div>"), (6, "<p " * 2000), (7, "<div>" * 20000 + body)]
    got = {r.i: r.m for r in spark.createDataFrame(rows, "i int, html string").select("i", rd.main_text(F.col("html")).alias("m")).collect()}
    assert tuple(got[1]) == ("A title", body.strip(), True)
    assert tuple(got[2]) == ("", "too short", False) and tuple(got[3]) == tuple(got[4]) == ("", "", False)
    assert got[5].text == body.strip() and got[5].main and not got[6].main and got[7].text == body.strip()
