"""Queries of dataset engineering: joins by priority, gates of mutants, seeded orders, logs, reports, phones and callers."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions import text as tx
from threadlens.functions import urls as ux
from threadlens.operators import engineering as en
from threadlens.operators.corpus import hash_bucket
from threadlens.plans.dialect import DUCK, SPARK, stepped
from threadlens.queries.tables import query
from threadlens.queries.templates import threads, threads_sql
from threadlens.session import table


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r FROM orders)
SELECT c_custkey, o_orderkey AS first_order FROM customer LEFT JOIN o ON o_custkey = c_custkey AND r = 1""")
def join_by_priority(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    c = en.joined_by_priority(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", ["o_totalprice", "o_orderkey"])
    return c.select("c_custkey", F.col("found.o_orderkey").alias("first_order"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def join_unknown(spark, sf_dir):
    known = table(spark, sf_dir, "orders").select("o_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey").join(known, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT coalesce(d.lang, '-') AS lang, count(*) AS n, count(d.doc_id) AS n_known FROM labels l LEFT JOIN documents d USING (doc_id) GROUP BY 1")
def join_meta(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d_id"), "lang")
    j = table(spark, sf_dir, "labels").join(d, F.col("doc_id") == F.col("d_id"), "left")
    return j.groupBy(F.coalesce("lang", F.lit("-")).alias("lang")).agg(F.count("*").alias("n"), F.count("d_id").alias("n_known"))


_CANDIDATES = """SELECT user_id AS parent, event_id AS attempt, CASE WHEN event_id % 41 = 0 THEN ' ' ELSE 'text' END AS text, CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS n_removed, CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END AS n_added,
 (event_id % 100) / 100.0 AS distance, 0.5 + (event_id % 50) / 100.0 AS similarity, event_id % 3 AS got_risk, event_id % 2 AS exp_risk, event_id % 4 AS got_stage, event_id % 2 AS exp_stage, event_id % 90 AS got_score, 35 AS exp_score_min FROM {events}"""


def _candidates(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("threadlens_events")
    return spark.sql(_CANDIDATES.format(events="threadlens_events")).selectExpr("*", *(f"{e} AS {n}" for n, e in en.mutation_gates(SPARK)))


@query("SELECT drop_reason, count(*) AS n FROM (" + stepped(_CANDIDATES.format(events="events"), en.mutation_gates(DUCK), ["drop_reason"]) + ") GROUP BY drop_reason")
def mut_gate_reasons(spark, sf_dir):
    return _candidates(spark, sf_dir).groupBy("drop_reason").agg(F.count("*").alias("n"))


@query("SELECT parent, min(attempt) AS attempt FROM (" + stepped(_CANDIDATES.format(events="events"), en.mutation_gates(DUCK), ["parent", "attempt", "drop_reason"]) + ") WHERE drop_reason = '' GROUP BY parent")
def mut_first_kept(spark, sf_dir):
    return en.first_kept(_candidates(spark, sf_dir), "parent", "attempt").select("parent", "attempt")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('7-' || o_orderkey::VARCHAR), o_orderkey)::INT AS place FROM orders")
def seeded_order(spark, sf_dir):
    return en.seeded_order(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), 7, "o_orderkey", ["o_custkey"])


@query("""WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events), k AS (SELECT * FROM l WHERE event_type IS DISTINCT FROM before),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)::INT AS back FROM k) SELECT user_id, event_id, event_type, back FROM r WHERE back <= 20""")
def log_ring(spark, sf_dir):
    return en.log_ring(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"], "event_type", 20)


@query("""SELECT n_name, '## ' || n_name || chr(10) || string_agg('- ' || c_custkey::VARCHAR || ': ' || c_mktsegment, chr(10) ORDER BY c_custkey) AS report FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
def markdown_report(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return en.markdown(c, F.col("n_name"), "c_custkey", F.concat(F.lit("- "), F.col("c_custkey").cast("string"), F.lit(": "), "c_mktsegment"), ["n_name"])


_POOL = ("010-0000-101", "070-0000-201", "02-0000-200", "1588-0000", "031-0000-300")


@query(f"SELECT c_custkey, ([{', '.join(repr(p) for p in _POOL)}])[(('0x' || substr(sha1(c_custkey::VARCHAR), 1, 8))::BIGINT % {len(_POOL)}) + 1] AS phone FROM customer")
def pii_phone_pool(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.get(F.array(*(F.lit(p) for p in _POOL)), hash_bucket(F.col("c_custkey"), len(_POOL)).cast("int")).alias("phone"))


@query(f"""SELECT thread_id, ix, CASE WHEN regexp_matches(inside, '(\\d{{2,4}})\\s*-\\s*(\\d{{3,4}})\\s*-\\s*(\\d{{3,4}})') THEN regexp_replace(inside, '\\s*-\\s*', '-', 'g') ELSE inside END AS caller
FROM (SELECT thread_id, ix, regexp_extract(text, '\\[\\s*발신\\s*([^\\]]+?)\\s*\\]', 1) AS inside FROM ({threads_sql()}))""")
def txt_callers(spark, sf_dir):
    return threads(table(spark, sf_dir, "events")).select("thread_id", "ix", tx.caller_number(F.col("text")).alias("caller"))


@query("""WITH w AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT a.user_id, a.event_type, a.n + b.n AS w FROM w a JOIN w b ON b.user_id = a.user_id + 1 AND b.event_type = a.event_type)
SELECT user_id, event_type, w, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, event_type)::INT AS rank FROM p) WHERE rank <= 3""")
def sim_shared_keys(spark, sf_dir):
    w = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    other = w.select((F.col("user_id") - 1).alias("user_id"), "event_type", F.col("n").alias("m"))
    return en.shared_keys(w.join(other, ["user_id", "event_type"]), ["user_id"], "event_type", "n", "m").select("user_id", "event_type", "w", "rank")


@query("SELECT conv_id, count(*) AS n, CASE WHEN count(*) <= 4 THEN 'S' WHEN count(*) <= 8 THEN 'M' WHEN count(*) <= 12 THEN 'L' ELSE 'XL' END AS bucket FROM conversations GROUP BY conv_id")
def gen_length_bucket(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return n.withColumn("bucket", F.when(F.col("n") <= 4, "S").when(F.col("n") <= 8, "M").when(F.col("n") <= 12, "L").otherwise("XL"))


@query()
def url_loose(spark, sf_dir):
    t = threads(table(spark, sf_dir, "events")).select("thread_id", "ix", ux.loose_urls(F.col("text")).alias("urls")).where(F.size("urls") > 0)
    return t.select("thread_id", "ix", F.array_join("urls", " ").alias("urls"))


@query()
def url_redirects(spark, sf_dir):
    t = threads(table(spark, sf_dir, "events")).select("thread_id", "ix", F.explode(ux.loose_urls(F.col("text"))).alias("url"))
    return ux.redirect_chain(t, "url").where(F.size("chain") > 1).select("thread_id", "ix", F.array_join("chain", " ").alias("chain"))


@query()
def url_like_official(spark, sf_dir):
    t = threads(table(spark, sf_dir, "events")).select(F.explode(ux.loose_urls(F.col("text"))).alias("url")).select(ux.host(F.col("url")).alias("host")).distinct()
    t = t.withColumn("n", ux.named_host(F.col("host")))
    return t.select("host", ux.brand_token(F.col("host")).alias("brand"), ux.looks_like_official(F.col("n")).alias("typo"), ux.looks_like_brand(F.col("n"), F.lit(True)).alias("like_brand"))


@query()
def mut_freeze(spark, sf_dir):
    """Texts frozen and restored; `same` is whether nothing was lost."""
    t = threads(table(spark, sf_dir, "events")).select("thread_id", "ix", "text").withColumn("f", en.freeze(F.col("text")))
    return t.select("thread_id", "ix", F.col("f.text").alias("frozen"), F.size("f.spans").alias("n_spans"), (en.restored(F.col("f.text"), F.col("f.spans"))["text"] == F.col("text")).alias("same"))


@query()
def mut_endings(spark, sf_dir):
    t = threads(table(spark, sf_dir, "events")).select(F.concat_ws("/", "thread_id", F.col("ix").cast("string")).alias("id"), "text")
    return en.ending_variants(t, "id", "text", 2)


@query()
def txt_masked_replies(spark, sf_dir):
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.when(F.col("role") == "user", "S: ").otherwise("R: "), F.coalesce("text", F.lit(""))).alias("line"))))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("t"))
    return c.select("conv_id", F.md5(F.encode(tx.masked_replies(F.col("t")), "UTF-8")).alias("digest"), F.size(F.filter(F.split(tx.masked_replies(F.col("t")), "\n"), lambda x: x.endswith("(reply)"))).alias("n_replies"))
