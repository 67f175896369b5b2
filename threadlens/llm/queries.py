"""The registered queries of this subpackage, one for each operator, and their SQL where there is one."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import conversations as _conversations
from threadlens.llm import decontaminate as _decontaminate
from threadlens.llm import exact as _exact
from threadlens.llm import language as _language
from threadlens.llm import packing as _packing
from threadlens.llm import phrases as _phrases
from threadlens.llm import pii as _pii
from threadlens.llm import quality as _quality
from threadlens.llm import secrets as _secrets
from threadlens.llm import simhash as _simhash
from threadlens.llm import suffixes as _suffixes
from threadlens.llm import toxicity as _toxicity
from threadlens.llm import warc as _warc

#: Where the public vocabularies are.
TOKENIZERS = os.environ.get("THREADLENS_TOKENIZERS", "/opt/tokenizers")
#: The pseudonyms' key of the registered query. Where none is set it is this one, which is no secret: it makes runs comparable on test data. Real use names a key of its own.
PSEUDONYM_KEY = os.environ.get("THREADLENS_PSEUDONYM_KEY", "documented test key, not a secret")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _simhash.near_duplicate_groups(_read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _secrets.digest(_secrets.secret_spans(_read(spark, sf_dir, "documents")))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _language.predict_languages(_read(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suffixes.remove_repeats(_read(spark, sf_dir, "documents")).drop("kept")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack_documents(_read(spark, sf_dir, "documents"))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pii.pseudonymised(_read(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = _quality.quality_verdicts(_read(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", *_quality.BASE, "base_failed", "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    grade = F.when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).when(F.col("toxic") == 0, 0)
    labels = _read(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))
    return _toxicity.grade_documents(_read(spark, sf_dir, "documents"), labels)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontaminate.overlaps(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _warc.round_trip(_read(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrases.collocations(_read(spark, sf_dir, "documents"))


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_groups(_read(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations.repaired(_conversations.damaged(_read(spark, sf_dir, "conversations")), present=F.col("present"))


OPERATORS = (op1_simhash, op2_secrets, op3_language, op4_repeats, op5_packing, op6_pseudonyms, op7_quality, op8_toxicity, op9_decontamination, op10_warc, op11_phrases, op12_exact, op13_conversation_repair)

#: Base 32 from the 40 hex digits of SHA-1, five digits (20 bits, 4 letters) at a time.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * i + 1}, 5))::INT >> {15 - 5 * k}) & 31) + 1, 1)" for i in range(8) for k in range(4)
)
OP10_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
first AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM p JOIN first USING (h)
"""


OP11_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda w: w <> '') AS w FROM t),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, w[i:i + m - 1] AS g, m, count(*) AS a FROM s, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, g, m, a, unnest(range(1, m)) AS k FROM g WHERE m >= 2 AND a >= 100),
q AS (SELECT c.lang, c.g, c.m, c.a, k, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a) AS score
      FROM c JOIN g l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN g r ON r.lang = c.lang AND r.g = c.g[k + 1:] JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
o AS (SELECT lang, a, g, m, unnest(range(2, m)) AS j FROM b),
i AS (SELECT lang, a, g[x:x + j - 1] AS g FROM (SELECT lang, a, g, j, unnest(range(1, m - j + 2)) AS x FROM o)),
z AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = b.lang AND i.g = b.g AND 100 * i.a >= 100 * b.a))
SELECT lang, row_number() OVER v AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM z WINDOW v AS (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) QUALIFY rank <= 2000
"""
OP12_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS x FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY x) AS group_size, row_number() OVER w = 1 AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x ORDER BY n DESC, doc_id NULLS LAST)
"""


def _op2_sql() -> str:
    """Matches of each pattern with running positions, then the weak parts that have what completes them within the scope."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    patterns = [(_secrets.ASSIGN, 2), (_secrets.ACCESS, 0), (_secrets.HEX, 0), (_secrets.IDENTIFIER, 2), (_secrets.ENDPOINT, 0)]
    found = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS p, unnest(range(len(f))) AS i, unnest(list_transform(f, lambda y: length(y))) AS n, unnest(list_transform(g, lambda y: length(y))) AS own, unnest(list_transform(s[1:len(f)], lambda y: length(y))) AS gap "
        f"FROM (SELECT doc_id, regexp_extract_all(x, {q(p)}) AS f, regexp_extract_all(x, {q(p)}, {g}) AS g, regexp_split_to_array(x, {q(p)}) AS s FROM t WHERE regexp_matches(x, {q(p)}))"
        for n, (p, g) in enumerate(patterns)
    )
    near = lambda role: f"EXISTS (SELECT 1 FROM k o WHERE o.doc_id = k.doc_id AND o.role = '{role}' AND abs(o.a - k.a) <= {_secrets.SCOPE})"
    names = ", ".join(f"'{k}'" for k in _secrets.KINDS)
    roles = ", ".join(f"'{_secrets.ROLE[k]}'" for k in _secrets.KINDS)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), m AS ({found}),
e AS (SELECT *, sum(gap + n) OVER (PARTITION BY doc_id, p ORDER BY i) AS z FROM m),
c AS (SELECT doc_id, CASE WHEN p = 0 AND own >= 12 THEN 0 WHEN p = 0 AND own >= {_secrets.WEAK_SECRET} THEN 3 WHEN p IN (1, 2) THEN p WHEN p = 3 THEN 4 WHEN p = 4 THEN 5 END AS kind, (z - n)::BIGINT AS a, z::BIGINT AS z FROM e),
k AS (SELECT *, ([{names}])[kind + 1] AS name, ([{roles}])[kind + 1] AS role FROM c WHERE kind IS NOT NULL),
s AS (SELECT doc_id, kind, a, name || ':' || a || ':' || z AS line FROM k WHERE kind < 3 OR (kind = 3 AND ({near("id")} OR {near("endpoint")})) OR (kind = 4 AND {near("secret")}) OR (kind = 5 AND {near("id")} AND {near("secret")}))
SELECT t.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(line, ',' ORDER BY a, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(line, ',' ORDER BY a, kind), '') AS spans
FROM t LEFT JOIN s ON s.doc_id = t.doc_id GROUP BY t.doc_id
"""


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": _op2_sql(), "op10_warc": OP10_SQL, "op11_phrases": OP11_SQL, "op12_exact": OP12_SQL}
