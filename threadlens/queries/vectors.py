"""Queries of the vector operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.operators import similarity as si
from threadlens.operators import vectors as ve
from threadlens.queries.tables import query
from threadlens.session import table

#: Leaders one after another: the next is the first that none of those before it has taken.
_CLUSTERS = """
WITH RECURSIVE e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
near AS MATERIALIZED (SELECT a.id, list(b.id) AS likes FROM e a JOIN e b ON b.id >= a.id AND round(list_cosine_similarity(a.v, b.v), 9) >= 0.86 GROUP BY a.id),
r AS (SELECT id AS leader, likes AS taken FROM near WHERE id = (SELECT min(id) FROM near)
      UNION ALL
      SELECT near.id, list_distinct(list_concat(r.taken, near.likes)) FROM r, near WHERE near.id = (SELECT min(n.id) FROM near n WHERE NOT list_contains(r.taken, n.id))),
m AS (SELECT min(r.leader) AS leader, x.id FROM r JOIN (SELECT id AS l, unnest(likes) AS id FROM near) x ON x.l = r.leader GROUP BY x.id)
"""


@query(_CLUSTERS + "SELECT id AS vec_id, leader FROM m")
def clu_greedy(spark, sf_dir):
    return ve.greedy_clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("vec_id", "leader")


@query(_CLUSTERS + "SELECT leader, count(*) AS size, round(avg(list_cosine_similarity(l.v, e.v)), 4) AS avg_sim FROM m JOIN e ON e.id = m.id JOIN e l ON l.id = leader GROUP BY leader")
def clu_report(spark, sf_dir):
    return ve.cluster_report(ve.greedy_clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


@query(r"""
WITH f AS (SELECT conv_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{2,}')) AS f FROM conversations),
c AS (SELECT id, f, count(*) AS n FROM f GROUP BY ALL),
t AS (SELECT id, f, n FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, f) <= 24),
w AS (SELECT id, f, ln(1 + n) / ln(1 + max(n) OVER (PARTITION BY id)) AS w FROM t),
u AS (SELECT id, f, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS u FROM w),
p AS (SELECT a.id AS query_id, b.id, round(sum(a.u * b.u), 6) AS sim FROM u a JOIN u b ON a.f = b.f WHERE a.id % 20 = 0 AND a.id <> b.id GROUP BY ALL)
SELECT query_id, id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id)::INT AS rank FROM p WHERE sim >= 0.4 QUALIFY rank <= 5
""")
def sim_sparse_search(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.explode(F.expr("regexp_extract_all(lower(coalesce(text, '')), '[a-z]{2,}', 0)")).alias("f"))
    weights = si.sparse_weights(words.groupBy("id", "f").agg(F.count("*").alias("n")), "id", "f", "n")
    vectors = ve.written(ve.sparse_vectors(weights, "id", "f", "w"))
    return ve.sparse_top_k(vectors, vectors.where("id % 20 = 0"), 5, 0.4)
