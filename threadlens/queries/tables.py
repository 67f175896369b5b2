"""One query for each operator, over whole tables, and where SQL can say it, the same in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.functions import text as tx
from threadlens.functions import urls as ux
from threadlens.operators import analyze as an
from threadlens.operators import corpus as co
from threadlens.operators import evaluate as ev
from threadlens.operators import prefilter as pf
from threadlens.operators import similarity as si
from threadlens.plans import catalog as cat
from threadlens.queries.templates import threads, threads_sql
from threadlens.session import spread, table, written
from threadlens.streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads(table(spark, sf_dir, "events"))


def _threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("ix", F.concat_ws(": ", "role", "text").alias("line"))))
    return _turns(spark, sf_dir).groupBy("thread_id").agg(F.array_join(F.transform(turns, lambda x: x["line"]), "\n").alias("text"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.analyze(_turns(spark, sf_dir))


# --- text ---------------------------------------------------------------------------------------------------------------------

_WS = r"[\s\x{00A0}\x{FEFF}\x{3000}]"
_STRIP = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'),
  '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript>', ' ', 'g'), '<[^>]+>', ' ', 'g')"""
_NORM = rf"regexp_replace(regexp_replace(replace(regexp_replace(replace({{x}}, chr(160), ' '), '[ \t]+', ' ', 'g'), chr(13) || chr(10), chr(10)), '\n{{{{3,}}}}', chr(10) || chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g')"
_PLAIN = _NORM.replace("{{3,}}", "{3,}").replace("{x}", _STRIP)


@query(f"SELECT page_id, {_PLAIN} AS body FROM pages")
def txt_html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_html(F.col("html")).alias("body"))


@query(rf"""SELECT page_id, substr(coalesce(nullif(regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), ''), ''), 1, 200) AS title FROM pages
WHERE regexp_matches(html, '(?is)<title[^>]*>\s*\S')""")
def txt_title_infer(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where(F.rlike("html", F.lit(r"(?is)<title[^>]*>\s*\S")))
    return p.select("page_id", tx.infer_title(F.col("html"), tx.strip_html(F.col("html"))).alias("title"))


@query(rf"""SELECT doc_id, length(t) AS n_chars_norm, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(9), ' '),
  '[ \x{{00A0}}]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g') AS t FROM documents)""")
def txt_normalize_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tx.normalize_thread(F.col("text")).alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("n_chars_norm"), F.md5(F.encode("t", "UTF-8")).alias("digest"))


@query(r"""SELECT doc_id, md5(lower(regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))) AS lexical,
 length(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', '', 'g')) AS n_token_chars FROM documents""")
def txt_lexical_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(F.encode(tx.lexical(F.col("text")), "UTF-8")).alias("lexical"), F.length(tx.token(F.col("text"))).cast("long").alias("n_token_chars"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT doc_id, pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM l), n AS (SELECT * FROM k WHERE line <> ''),
p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM n)
SELECT d.doc_id, coalesce(count(line), 0)::INT AS n_lines, coalesce(count_if(line IS DISTINCT FROM before AND line IS NOT NULL), 0)::INT AS n_kept FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY d.doc_id""")
def txt_consecutive_dedupe(spark, sf_dir):
    return co.drop_consecutive_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


_CONV = "SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'S: ' WHEN 'assistant' THEN 'R: ' ELSE '' END || coalesce(text, ''), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id"


@query(rf"""WITH c AS ({_CONV}), l AS (SELECT conv_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM c),
f AS (SELECT *, trim(line) = '' AS blank, lower(regexp_extract(line, '(?i)^\s*(S|R|sender|receiver|발신|수신)\s*[:：]', 1)) AS mark FROM l),
g AS (SELECT *, NOT blank AND (mark <> '' OR regexp_matches(line, '^\s*(\[?(오전|오후)\s*\d{{1,2}}:\d{{2}}\]?|\d{{4}}[.\-]\d{{1,2}}[.\-]\d{{1,2}}|\d{{1,2}}:\d{{2}}\s)') OR lag(blank, 1, true) OVER w) AS new FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
b AS (SELECT *, sum(new::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS block FROM g)
SELECT conv_id, block::BIGINT AS block, CASE arg_min(mark, pos) WHEN 's' THEN 'S' WHEN 'r' THEN 'R' ELSE 'U' END AS speaker, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars_block FROM b WHERE NOT blank AND block <= 200 GROUP BY conv_id, block""")
def txt_split_blocks(spark, sf_dir):
    mark = F.when(F.col("role") == "user", "S: ").when(F.col("role") == "assistant", "R: ").otherwise("")
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(mark, F.coalesce("text", F.lit(""))).alias("line"))))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("t"))
    b = co.split_blocks(c, "conv_id", "t")
    return b.select("conv_id", "block", "speaker", "n_lines", (F.length("text") - F.col("n_lines") + 1).cast("long").alias("n_chars_block"))


@query(r"""SELECT conv_id, len(k)::INT AS n_recent, md5(array_to_string(k[-16:], chr(10))) AS digest FROM (SELECT conv_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[-16:] AS k FROM (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id))""")
def prefilter_window(spark, sf_dir):
    lines = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("line"))))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(tx.recent_lines(F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("k"))
    return c.select("conv_id", F.size("k").alias("n_recent"), F.md5(F.encode(F.array_join("k", "\n"), "UTF-8")).alias("digest"))


# --- URLs ---------------------------------------------------------------------------------------------------------------------

_HOST = r"""lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)', 1), '^.*@', ''), ':\d*$', ''), '\.$', ''))"""
_SECOND = ", ".join(f"'{x}'" for x in ux.SECOND_LEVEL)
_OFFICIAL = ", ".join(f"('{x}')" for x in ux.OFFICIAL_HOSTS)


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(
 regexp_extract_all(html, '(?i)\bhttps?://[^\s<>"'')\]]+') || regexp_extract_all(html, '(?i)\bwww\.[^\s<>"'')\]]+') || regexp_extract_all(html, '\b[a-zA-Z][a-zA-Z0-9-]{0,61}(?:\.[a-zA-Z0-9-]{1,63})+\b'),
 lambda x: regexp_replace(regexp_replace(x, '[),.;:''"\]]+$', ''), '^[("''\[\s]+', '')), lambda x: x <> ''))), ' ') AS urls FROM pages""")
def url_extract_distinct(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.array_join(F.array_sort(ux.extract_urls(F.col("html"), 1 << 20)), " ").alias("urls"))


@query(f"""SELECT page_id, h AS host, CASE WHEN len(p) <= 2 THEN h WHEN array_to_string(p[-2:], '.') IN ({_SECOND}) THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain
FROM (SELECT page_id, h, list_filter(string_split(h, '.'), lambda x: x <> '') AS p FROM (SELECT page_id, {_HOST} AS h FROM pages))""")
def url_host_parts(spark, sf_dir):
    h = table(spark, sf_dir, "pages").select("page_id", ux.host(F.col("url")).alias("host"))
    return h.select("page_id", "host", ux.registrable_domain(F.col("host")).alias("domain"))


_ALLOWED = ("example.com", "example.net", "kbstar.com")


@query(f"""WITH h AS (SELECT page_id, {_HOST} AS host FROM pages), a(suffix) AS (VALUES ('example.com'), ('example.net'), ('kbstar.com'))
SELECT suffix, count(DISTINCT page_id) AS n_pages FROM h JOIN a ON host = suffix OR ends_with(host, '.' || suffix) GROUP BY suffix""")
def url_suffix_join(spark, sf_dir):
    h = table(spark, sf_dir, "pages").select("page_id", ux.host(F.col("url")).alias("host"))
    allowed = spark.createDataFrame([(a,) for a in _ALLOWED], "suffix string")
    ends = h.select("page_id", F.explode(ux.suffixes(F.col("host"))).alias("suffix"))
    return ends.join(F.broadcast(allowed), "suffix").groupBy("suffix").agg(F.countDistinct("page_id").alias("n_pages"))


@query(f"""WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages), d AS (SELECT DISTINCT CASE WHEN len(p) <= 2 THEN host ELSE array_to_string(p[-2:], '.') END AS domain FROM (SELECT host, string_split(host, '.') AS p FROM h WHERE host <> '')),
o(official) AS (VALUES {_OFFICIAL})
SELECT domain, min(levenshtein(domain, official))::INT AS distance, arg_min(official, (levenshtein(domain, official), official)) AS nearest FROM d, o GROUP BY domain""")
def url_typosquat(spark, sf_dir):
    h = table(spark, sf_dir, "pages").select(ux.host(F.col("url")).alias("host")).where("host <> ''").distinct()
    parts = F.split("host", r"\.")
    d = h.select(F.when(F.size(parts) <= 2, F.col("host")).otherwise(F.array_join(F.slice(parts, F.size(parts) - 1, 2), ".")).alias("domain")).distinct()
    near = F.array_min(F.array(*(F.struct(F.levenshtein("domain", F.lit(o)).alias("d"), F.lit(o).alias("o")) for o in ux.OFFICIAL_HOSTS)))
    return d.select("domain", near.alias("n")).select("domain", F.col("n.d").alias("distance"), F.col("n.o").alias("nearest"))


@query()
def url_risk_score(spark, sf_dir):
    t = _turns(spark, sf_dir).withColumn("urls", ux.extract_scored_urls(F.col("text"))).where(F.size("urls") > 0)
    hits = t.select("thread_id", "ix", F.explode(ux.url_feature_hits(F.col("text"), F.col("urls"))).alias("h"))
    return hits.select("thread_id", "ix", "h.rule_id", "h.weight", F.array_join("h.matched", " ").alias("matched"))


# --- rules, stages, risk ------------------------------------------------------------------------------------------------------


def _quoted(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


def _rule_hits_sql() -> str:
    parts = []
    for n, (rule_id, _, _, weight, patterns) in enumerate(cat.RULES):
        found = []
        for p in patterns:
            if p == cat.LINK_PATTERN:  # the SQL engine's patterns have no look-ahead: hosts are filtered instead
                found.append(r"list_filter(regexp_extract_all(text, '(?i)https?://[^\s)]+'), lambda u: NOT regexp_matches(u, '(?i)^https?://(drive\.google\.com|docs\.google\.com|github\.com)\b') AND NOT regexp_matches(u, '(?i)^https?://[^/\s)]*intranet\b'))")
            elif p in cat.FIRST_ONLY:
                found.append(f"list_filter([regexp_extract(text, {_quoted(p)})], lambda u: u <> '')")
            else:
                found.append(f"regexp_extract_all(text, {_quoted(p)})")
        matched = f"list_distinct(list_transform({' || '.join(found)}, lambda u: trim(u)))"
        parts.append(f"SELECT thread_id, ix, {n}::INT AS ord, '{rule_id}' AS rule_id, {float(weight)}::DOUBLE * least(3, len({matched})) AS weight FROM t WHERE len({matched}) > 0")
    return f"WITH t AS ({threads_sql()}) " + " UNION ALL ".join(parts)


def _raw_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each turn, from those of each distinct text. Texts meet by a hash, and what has no hits goes once these are written: else the filter is moved below the distinct, and, as it is known to hold for what was written,
    to the turns beside the join as well, so that all patterns are tried twice on every turn."""
    turns = _turns(spark, sf_dir).withColumn("mark", F.md5("text"))
    found = written(spread(turns.select("mark", "text").distinct(), "mark").select("mark", an.rule_hits("text").alias("hits"))).where(F.size("hits") > 0)
    hits = turns.drop("text").join(found, "mark").select("thread_id", "ix", F.explode("hits").alias("h"))
    order = {(r[0], r[1]): n for n, r in enumerate(cat.RULES)}
    place = F.create_map(*(F.lit(x) for (i, label), n in order.items() for x in (f"{i}|{label}", n)))
    return hits.select("thread_id", "ix", F.element_at(place, F.concat_ws("|", "h.rule_id", "h.label")).alias("ord"), "h.rule_id", "h.weight", "h.label", "h.stage", "h.matched")


@query(_rule_hits_sql())
def rule_hits(spark, sf_dir):
    return _raw_hits(spark, sf_dir).select("thread_id", "ix", "ord", "rule_id", "weight")


_FACTOR = "CASE k WHEN 1 THEN 1.0 WHEN 2 THEN 0.85 WHEN 3 THEN 0.70 WHEN 4 THEN 0.55 WHEN 5 THEN 0.45 ELSE 0.35 END::DOUBLE"


@query(f"""WITH h AS ({_rule_hits_sql()}), w AS (SELECT *, row_number() OVER (PARTITION BY thread_id, rule_id ORDER BY ix, ord) AS k FROM h),
d AS (SELECT *, floor(weight * {_FACTOR} * 100 + 0.5) / 100 AS d FROM w)
SELECT thread_id, rule_id, count(*) AS "count", floor(sum(d) * 100 + 0.5) / 100 AS weight_sum FROM d GROUP BY thread_id, rule_id""")
def rule_signals_rollup(spark, sf_dir):
    return an.signals(an.diminished(_raw_hits(spark, sf_dir))).select("thread_id", "rule_id", "count", "weight_sum")


@query(f"""WITH w AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity::DOUBLE AS q, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)
SELECT l_orderkey, floor(sum(floor(q * {_FACTOR} * 100 + 0.5)) + 0.5) / 100 AS total FROM w GROUP BY l_orderkey""")
def agg_diminishing(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("double"))
    d = an.diminished(rows, ("l_orderkey",), "l_returnflag", ("l_linenumber", "l_partkey", "l_suppkey"), "q")
    return d.groupBy("l_orderkey").agg((F.floor(F.sum(F.floor(F.col("diminished") * 100 + 0.5)) + 0.5) / 100).alias("total"))


@query("""WITH r AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'payment' WHEN 'signup' THEN 'install' WHEN 'click' THEN 'verify' ELSE 'info' END AS stage FROM events),
k AS (SELECT *, CASE stage WHEN 'payment' THEN 3 WHEN 'install' THEN 2 WHEN 'verify' THEN 1 ELSE 0 END AS rank FROM r),
b AS (SELECT *, max(rank) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k)
SELECT user_id AS thread_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS step, event_id AS ix, stage FROM b WHERE before IS NULL OR rank > before""")
def stage_timeline(spark, sf_dir):
    stage = F.when(F.col("event_type") == "purchase", "payment").when(F.col("event_type") == "signup", "install").when(F.col("event_type") == "click", "verify").otherwise("info")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("ix"), stage.alias("stage"))
    return an.stage_timeline(e)


@query("SELECT user_id, event_id, max(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events")
def seen_flag(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return co.seen_before(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id", "seen")


@query("""WITH t AS (SELECT user_id, event_id, ts, event_type = 'purchase' AND value > 400 AS strong, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS size, max(ts) OVER (PARTITION BY user_id) AS last FROM events),
f AS (SELECT *, min(CASE WHEN strong THEN n END) OVER (PARTITION BY user_id) AS first FROM t)
SELECT user_id AS thread_id, event_id AS ix, CASE WHEN first IS NULL THEN 'rolling' ELSE 'strong' END AS reason FROM f
WHERE CASE WHEN first IS NULL THEN n > size - 20 AND ts >= last - INTERVAL 3 DAYS ELSE n >= greatest(first - 4, 1) AND n < greatest(first - 4, 1) + 160 END""")
def context_window_auto(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("ix"), "ts", "event_type", "value")
    return co.context_window(e, (F.col("event_type") == "purchase") & (F.col("value") > 400)).select("thread_id", "ix", "reason")


@query("""WITH l AS (SELECT conv_id, turn, role, lead(role, 1) OVER w = 'assistant' AS a1, lead(role, 2) OVER w = 'assistant' AS a2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN a1 THEN 1 ELSE 2 END AS answer_step FROM l WHERE role = 'user' AND (a1 OR a2)""")
def seq_within_two(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("ix"), "role")
    out = co.answered_within(c, F.col("role") == "user", F.col("role") == "assistant")
    return out.select(F.col("thread_id").alias("conv_id"), F.col("ix").alias("turn"), "answer_step")


@query()
def thread_analysis(spark, sf_dir):
    return an.analyze(_turns(spark, sf_dir))


@query()
def turn_stages(spark, sf_dir):
    t = an.turn_table(_turns(spark, sf_dir))
    return t.select("thread_id", "ix", "include", "hint", "score", "stage", F.size("hits").alias("n_hits"))


@query()
def prefilter_gate(spark, sf_dir):
    p = pf.prefilter(_threads(spark, sf_dir))
    return p.select("thread_id", "score", "action", F.array_join("signal_ids", ",").alias("signals"), "n_urls", "gate_pass")


_PF = cat.PREFILTER
_PF_SQL = " UNION ALL ".join(f"SELECT thread_id, ix, {n} AS ord, '{i}' AS id, {p} AS points FROM t WHERE regexp_matches(lower(text), '{pattern.replace(chr(39), chr(39) * 2)}')" for n, (i, (p, pattern)) in enumerate(_PF.items()))


@query(f"""WITH t AS ({threads_sql()}), s AS ({_PF_SQL}), b AS (SELECT thread_id, id, max(points) AS points FROM s GROUP BY thread_id, id)
SELECT thread_id, least(100, sum(points))::BIGINT AS score, CASE WHEN sum(points) >= 52 THEN 'auto' WHEN sum(points) >= 28 THEN 'soft' ELSE 'none' END AS "action" FROM b GROUP BY thread_id""")
def prefilter_best_signal(spark, sf_dir):
    t = _turns(spark, sf_dir).select("thread_id", "ix", F.posexplode(pf.text_signals(F.col("text"))).alias("ord", "s")).select("thread_id", "ix", "ord", "s.*")
    t = t.where(F.col("id").isin(*_PF)).withColumn("ord", F.col("ix") * 100 + F.col("ord"))
    best = pf.best_signals(t)
    total = best.groupBy("thread_id").agg(F.sum("points").alias("p"))
    return total.select("thread_id", F.least(F.lit(100), "p").cast("long").alias("score"), pf.action(F.col("p")).alias("action"))


@query("""SELECT CASE WHEN s >= 90 THEN '90+' WHEN s >= 65 THEN '65-89' WHEN s >= 35 THEN '35-64' ELSE '0-34' END AS band, count(*) AS n FROM (SELECT user_id, least(100, floor(sum(value) / 50)) AS s FROM events GROUP BY user_id) GROUP BY 1""")
def risk_banding(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.least(F.lit(100), F.floor(F.sum("value") / 50)).alias("s"))
    band = F.when(F.col("s") >= 90, "90+").when(F.col("s") >= 65, "65-89").when(F.col("s") >= 35, "35-64").otherwise("0-34")
    return s.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


# --- evaluation and rollups ---------------------------------------------------------------------------------------------------

_JUDGED = "SELECT d.doc_id, toxic, quality, (n_chars > 2000)::INT AS got_long, (lang = 'en')::INT AS got_en FROM labels l JOIN documents d USING (doc_id)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 2000).cast("int").alias("got_long"), (F.col("lang") == "en").cast("int").alias("got_en"))
    j = table(spark, sf_dir, "labels").join(d, "doc_id")
    return j.withColumn("why", ev.reasons({"quality": F.col("quality") == F.col("got_long"), "toxic": F.col("toxic") == F.col("got_en")}))


_WHY = "list_sort(list_filter([CASE WHEN quality <> got_long THEN 'quality' END, CASE WHEN toxic <> got_en THEN 'toxic' END], lambda x: x IS NOT NULL))"


@query(f"SELECT quality || '->' || got_long AS pair, count(*) AS n FROM ({_JUDGED}) GROUP BY 1")
def eval_confusion(spark, sf_dir):
    return ev.confusion(_judged(spark, sf_dir), "quality", "got_long")


@query(f"""WITH j AS (SELECT doc_id, {_WHY} AS why FROM ({_JUDGED})), f AS (SELECT array_to_string(why, '+') AS combo, doc_id, row_number() OVER (PARTITION BY array_to_string(why, '+') ORDER BY doc_id) AS pos FROM j WHERE len(why) > 0)
SELECT combo, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (pos <= 3) AS examples FROM f GROUP BY combo""")
def eval_reason_combo(spark, sf_dir):
    return ev.reason_combos(_judged(spark, sf_dir), "why", "doc_id")


@query(f"""WITH j AS (SELECT {_WHY} AS why, quality || '->' || got_long AS pair FROM ({_JUDGED})), e AS (SELECT 'meta' AS key, 'cases' AS subkey FROM j UNION ALL SELECT 'meta', CASE WHEN len(why) = 0 THEN 'pass' ELSE 'fail' END FROM j
 UNION ALL SELECT 'pair', pair FROM j UNION ALL SELECT 'reason', unnest(why) FROM j) SELECT key, subkey, count(*) AS n FROM e GROUP BY key, subkey""")
def eval_summary_long(spark, sf_dir):
    pair = F.concat_ws("->", F.col("quality").cast("string"), F.col("got_long").cast("string"))
    return ev.summary(_judged(spark, sf_dir), F.size("why") == 0, F.col("why"), pair)


@query("""WITH o AS (SELECT o_orderpriority, o_totalprice::DOUBLE AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, max(n) AS n, min(v) AS min, max(v) AS max, max(v) FILTER (r = 10 * (n - 1) // 100) AS p10, max(v) FILTER (r = 50 * (n - 1) // 100) AS p50, max(v) FILTER (r = 90 * (n - 1) // 100) AS p90 FROM o GROUP BY o_orderpriority""")
def eval_floor_percentile(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_totalprice").cast("double").alias("v"))
    return ev.floor_percentiles(o, ["o_orderpriority"], "v")


@query("SELECT lang AS signature, source, count(doc_id) AS n_docs, sum(count(doc_id)) OVER (PARTITION BY lang)::BIGINT AS signature_docs FROM documents GROUP BY lang, source")
def sig_pack_rollup(spark, sf_dir):
    return ev.signature_pack(table(spark, sf_dir, "documents"), "lang", "source", "doc_id")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 3")
def topk_per_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ev.top_per_group(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("SELECT source, n_chars, min(doc_id) AS doc_id FROM documents GROUP BY source, n_chars")
def dedupe_first_wins(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "n_chars", "doc_id")
    return ev.first_wins(d, ["source", "n_chars"], ["doc_id"])


_TERMS = ("the", "les", "und", "los", "password", "token")


@query("SELECT doc_id, array_to_string(list_filter(['the', 'les', 'und', 'los', 'password', 'token'], lambda t: NOT contains(lower(coalesce(text, '')), t)), ',') AS missing FROM documents")
def set_diff_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(co.missing_terms(F.coalesce("text", F.lit("")), _TERMS), ",").alias("missing"))


@query("SELECT c_custkey, (('0x' || substr(sha1(c_custkey::VARCHAR), 1, 8))::BIGINT % 97) AS bucket FROM customer")
def id_hash_bucket(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", co.hash_bucket(F.col("c_custkey"), 97).alias("bucket"))


@query()
def pii_scrub(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(F.encode(co.scrub_phones(F.coalesce("text", F.lit(""))), "UTF-8")).alias("digest"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, 'https?://[^\s)]+'))::INT AS n_url, len(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9-]{0,61}(?:\.[a-zA-Z0-9-]{1,63})+'))::INT AS n_domain,
 len(regexp_extract_all(text, '0\d{1,2}-\d{3,4}-\d{4}'))::INT AS n_phone, len(regexp_extract_all(text, '\d{1,3}(?:,\d{3})+\s*원|\d+\s*(?:만원|원)'))::INT AS n_money FROM documents""")
def corpus_entities(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in co.entity_counts(F.col("text")).items()))


@query(r"""WITH f AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '\d{4,}')) AS found FROM documents) SELECT doc_id, len(found)::INT AS n_frozen FROM f""")
def mut_freeze_numbers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", co.frozen(F.col("text"), r"\d{4,}", "num").alias("t"))
    return d.select("doc_id", F.size(F.array_distinct(F.regexp_extract_all("t", F.lit(r"<NUM_\d+>"), F.lit(0)))).alias("n_frozen"))


# --- similarity ---------------------------------------------------------------------------------------------------------------

_UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))"


@query(f"""WITH u AS (SELECT vec_id, {_UNIT} AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, r.vec_id AS id, round(list_dot_product(q.v, r.v), 6) AS sim FROM u q JOIN u r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id)::INT AS rank FROM s) SELECT query_id, id, rank FROM k WHERE rank <= 5""")
def sim_dense_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return si.top_k(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5).select("query_id", "id", "rank")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), w AS (SELECT user_id, event_type, ln(1 + n) / ln(1 + max(n) OVER (PARTITION BY user_id)) AS w FROM c)
SELECT user_id, event_type, round(w, 6) AS w FROM w""")
def sim_sparse_weights(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return si.sparse_weights(c, "user_id", "event_type", "n").select("user_id", "event_type", F.round("w", 6).alias("w"))


@query()
def sim_sparse_cosine_topk(spark, sf_dir):
    kinds = ["click", "error", "purchase", "signup", "view"]
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    w = si.sparse_weights(c, "user_id", "event_type", "n").groupBy("user_id").agg(*(F.coalesce(F.max(F.when(F.col("event_type") == k, F.col("w"))), F.lit(0.0)).alias(k) for k in kinds))
    v = w.select("user_id", F.array(*kinds).alias("v"))
    return si.top_k(v, v.where("user_id % 20 = 0"), "user_id", "v", 5).select("query_id", "id", F.round("sim", 4).alias("sim"), "rank")


@query(r"""WITH c AS (SELECT conv_id, turn, string_split(lower(regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')), '') AS c FROM conversations),
g AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS g FROM c),
p AS (SELECT a.conv_id, a.turn, len(list_intersect(a.g, b.g)) AS common, len(a.g) + len(b.g) AS total FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)
SELECT conv_id, turn, round(CASE WHEN total - common = 0 THEN 0.0 ELSE 1 - common::DOUBLE / (total - common) END, 6) AS distance FROM p""")
def sim_trigram_jaccard(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.trigrams(F.col("text")).alias("g"))
    at = W.partitionBy("conv_id").orderBy("turn")
    c = c.select("*", F.lag("turn").over(at).alias("t"), F.lag("g").over(at).alias("b")).where("t = turn - 1")
    return c.select("conv_id", "turn", F.round(tx.jaccard_distance(F.col("g"), F.col("b")), 6).alias("distance"))


@query()
def sim_hash64(spark, sf_dir):
    return si.hashed_trigrams(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), "id", F.col("text"))


@query()
def cluster_leaders(spark, sf_dir):
    r = an.signals(an.diminished(_raw_hits(spark, sf_dir)))
    top = F.max_by("rule_id", F.struct("weight_sum", "count", "rule_id"))
    items = r.groupBy("thread_id").agg(F.collect_set("rule_id").alias("keys"), F.sum("weight_sum").alias("score"), top.alias("grp"))
    return si.leader_clusters(items.select("grp", F.xxhash64("thread_id").alias("id"), "score", "keys"))


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTES, true) AS new FROM events),
s AS (SELECT user_id, ts, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def stream_session_events(spark, sf_dir):
    return live.sessions(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts")


@query()
def stream_gate(spark, sf_dir):
    return live.gate_turns(_turns(spark, sf_dir)).select("thread_id", "ix", "gate_score", "gate_action")
