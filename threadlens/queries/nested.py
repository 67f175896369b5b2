"""Queries of nested rewriting and of shuffles."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.operators import nested as ne
from threadlens.queries.tables import query
from threadlens.session import table

_PHONE = "concat_ws(' ', {name}, 'tel 010-', '02-' || lpad(CAST({key} % 900 + 100 AS {text}), 3, '0') || '-1234', '010-2' || lpad(CAST({key} % 1000 AS {text}), 3, '0') || '-5678', {phone})"


@query(
    "SELECT c_custkey, regexp_replace(regexp_replace("
    + _PHONE.format(name="c_name", key="c_custkey", phone="c_mktsegment", text="VARCHAR")
    + r""", '(^|\D)01[016789][ -]?\d{3,4}[ -]?\d{4}(?:\b)', '\1<mobile>', 'g'), '(^|\D)(?:02|0[3-6]\d)[ -]?\d{3,4}[ -]?\d{4}(?:\b)', '\1<landline>', 'g') AS contact FROM customer"""
)
def pii_deep(spark, sf_dir):
    """Contacts in structs in arrays in maps, one map for each nation, scrubbed where they are and then taken out again."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.expr(_PHONE.format(name="c_name", key="c_custkey", phone="c_mktsegment", text="STRING")).alias("contact"))
    # a map of a list of a struct for each customer: rows stay apart, whatever the nation's size
    held = c.select(F.create_map(F.col("c_nationkey").cast("string"), F.array(F.struct("c_custkey", F.struct("contact").alias("about")))).alias("book"))
    return ne.scrub_deep(held).select(F.explode(F.flatten(F.map_values("book"))).alias("x")).select("x.c_custkey", "x.about.contact")


@query("""WITH RECURSIVE g AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS a FROM orders GROUP BY o_custkey),
r AS (SELECT o_custkey, a, len(a) - 1 AS i, 7::BIGINT AS x FROM g
 UNION ALL
 SELECT o_custkey, list_transform(range(1, len(a) + 1), lambda k: CASE WHEN k = i + 1 THEN a[j + 1] WHEN k = j + 1 THEN a[i + 1] ELSE a[k] END), i - 1, x3
 FROM (SELECT *, floor(x3 / 4294967296.0::DOUBLE * (i + 1))::BIGINT AS j FROM (SELECT *, xor(x2, (x2 << 5) & 4294967295) AS x3 FROM (SELECT *, xor(x1, x1 >> 17) AS x2 FROM (SELECT *, xor(x, (x << 13) & 4294967295) AS x1 FROM r WHERE i > 0)))))
SELECT o_custkey, unnest(a) AS o_orderkey, unnest(range(1, len(a) + 1)) AS place FROM r WHERE i <= 0""")
def seeded_shuffle(spark, sf_dir):
    return ne.shuffled(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 7).select("o_custkey", "o_orderkey", "place")
