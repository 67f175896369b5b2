"""Queries of blocks with their ranges, telephone turns and main contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions import blocks as bl
from threadlens.queries.tables import query
from threadlens.session import table
from threadlens.sources.readable import main_text

# conversations as threads with marks, heads, blank lines and odd spaces, the same in both engines
_LINE = """CASE turn % 5 WHEN 0 THEN concat(CASE role WHEN 'user' THEN 'S: ' ELSE ' receiver : ' END, coalesce(text, '')) WHEN 1 THEN concat('오전 10:', lpad(CAST(turn % 60 AS {text}), 2, '0'), ' Kim ', CAST(conv_id % 7 AS {text}), ': ', coalesce(text, ''))
 WHEN 2 THEN concat({nl}, '[오후 1:05] ', role, ' : ', coalesce(text, '')) WHEN 3 THEN concat({nl}, '  ', coalesce(text, ''), '  ') ELSE concat('2026-01-14 10:21 Lee: ', {nl}, coalesce(text, '')) END"""
_THREADS = f"SELECT conv_id, replace(string_agg(line, chr(13) || chr(10) ORDER BY turn NULLS FIRST, line NULLS FIRST), chr(13) || chr(10), chr(10)) AS t FROM (SELECT conv_id, turn, {_LINE.format(text='VARCHAR', nl='chr(10)')} AS line FROM conversations) GROUP BY conv_id"


def _threads(spark, sf_dir):
    lines = F.array_sort(F.collect_list(F.struct("turn", F.expr(_LINE.format(text="STRING", nl=r"'\n'")).alias("line"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\r\n").alias("t"))


_CLOCK = r"(?:오전|오후)?\s*\d{1,2}:\d{2}"
_MARK = r"(?i)^\s*(S|R|sender|receiver|발신|수신)\s*:"


@query(rf"""WITH t AS ({_THREADS}), l AS (SELECT conv_id, unnest(string_split(t, chr(10))) AS raw, unnest(range(len(string_split(t, chr(10))))) AS pos FROM t),
m AS (SELECT *, trim(raw, ' ' || chr(9)) AS line, sum(length(raw) + 1) OVER (PARTITION BY conv_id ORDER BY pos) - length(raw) - 1 AS begins FROM l),
f AS (SELECT *, line = '' AS blank, lower(regexp_extract(line, '{_MARK}', 1)) AS mark,
  regexp_matches(line, '^\[\s*{_CLOCK}\s*\]') OR regexp_matches(line, '^\d{{4}}[.\-/]\d{{1,2}}[.\-/]\d{{1,2}}\s+{_CLOCK}') OR regexp_matches(line, '^\d{{4}}-\d{{2}}-\d{{2}}[ T]\d{{2}}:\d{{2}}') OR regexp_matches(line, '^{_CLOCK}\s+.{{1,40}}:') AS head FROM m),
g AS (SELECT *, prefixed, NOT blank AND (prefixed OR mark <> '' OR head OR lag(blank, 1, true) OVER (PARTITION BY prefixed, conv_id ORDER BY pos)) AS opens FROM f CROSS JOIN (VALUES (false), (true)) AS v(prefixed)),
b AS (SELECT *, sum(opens::INT) OVER (PARTITION BY prefixed, conv_id ORDER BY pos) AS block FROM g)
SELECT conv_id, prefixed, block::INT AS block, min(begins)::INT AS start_at, max(begins + length(raw))::INT AS end_at,
 CASE WHEN arg_min(mark, pos) IN ('r', 'receiver', '수신') THEN 'R' WHEN arg_min(mark, pos) <> '' THEN 'S' WHEN prefixed THEN 'R' ELSE 'U' END AS speaker,
 nullif(trim(CASE WHEN arg_min(head, pos) THEN coalesce(nullif(regexp_extract(arg_min(line, pos), '^{_CLOCK}\s+(.{{1,40}}?):', 1), ''), nullif(regexp_extract(arg_min(line, pos), '^\[\s*{_CLOCK}\s*\]\s*(.{{1,40}}?):', 1), ''), regexp_extract(arg_min(line, pos), '^\d{{4}}[.\-/]\d{{1,2}}[.\-/]\d{{1,2}}\s+{_CLOCK}\s+(.{{1,40}}?):', 1)) END), '') AS label,
 md5(trim(string_agg(rtrim(raw, ' ' || chr(9)), chr(10) ORDER BY pos), ' ' || chr(9))) AS digest FROM b WHERE NOT blank AND block <= 200 GROUP BY conv_id, prefixed, block""")
def txt_block_ranges(spark, sf_dir):
    """Blocks of all conversations with their ranges, once by marks and once with each line taken as the receiver's where it has no mark."""
    both = F.array(F.struct(F.lit(False).alias("prefixed"), bl.block_ranges(F.col("t")).alias("blocks")), F.struct(F.lit(True).alias("prefixed"), bl.block_ranges(F.col("t"), "R").alias("blocks")))
    t = _threads(spark, sf_dir).select("conv_id", F.explode(both).alias("x")).select("conv_id", "x.prefixed", F.posexplode("x.blocks").alias("at", "b"))
    return t.select("conv_id", "prefixed", (F.col("at") + 1).alias("block"), F.col("b.start").alias("start_at"), F.col("b.end").alias("end_at"), "b.speaker", "b.label", F.md5(F.encode("b.text", "UTF-8")).alias("digest"))


@query(rf"""WITH t AS ({_THREADS}), l AS (SELECT conv_id, unnest(string_split(t, chr(10))) AS raw, unnest(range(len(string_split(t, chr(10))))) AS pos FROM t),
m AS (SELECT conv_id, pos, trim(raw, ' ' || chr(9)) AS line FROM l), f AS (SELECT *, regexp_matches(line, '(?i)^[sr]\s*:') AS marked FROM m WHERE line <> ''),
g AS (SELECT *, sum(marked::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS turn FROM f),
u AS (SELECT conv_id, turn, CASE WHEN regexp_matches(arg_min(line, pos), '(?i)^r\s*:') THEN 'R' ELSE 'S' END AS who, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '(?i)^[sr]\s*:\s*', '') AS said FROM g GROUP BY conv_id, turn),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM u WHERE said <> '')
SELECT t.conv_id, count(n)::INT AS n_turns, md5(coalesce(string_agg(who || ': ' || said, chr(10) ORDER BY n) FILTER (n <= 6), '')) AS digest FROM t LEFT JOIN k ON k.conv_id = t.conv_id AND n <= 300 GROUP BY t.conv_id""")
def txt_phone_turns(spark, sf_dir):
    """Turns as a telephone shows them, and the first six of them written again."""
    t = _threads(spark, sf_dir).select("conv_id", bl.phone_turns(F.col("t")).alias("turns"))
    return t.select("conv_id", F.size("turns").alias("n_turns"), F.md5(F.encode(bl.turns_text(F.col("turns"), 6), "UTF-8")).alias("digest"))


@query()
def src_main_content(spark, sf_dir):
    """Title and main content of every page, or its text without tags where there is too little of it."""
    return table(spark, sf_dir, "pages").select("page_id", main_text(F.col("html")).alias("m")).select("page_id", "m.title", "m.text", "m.main")
