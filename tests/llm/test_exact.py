"""Exact groups against plain grouping, whatever the blocks and the limits."""

import collections
import hashlib
import random
import re

import duckdb
import pytest

from threadlens.llm import exact
from threadlens.llm import queries as registered

SF = "/root/testdata/sf0.001"


def want(rows):
    bare = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = collections.defaultdict(list)
    for i, b in enumerate(bare):
        groups[b].append(i)
    out = []
    for b, own in groups.items():
        best = min(own, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0))
        out += [(rows[i][0], rows[best][0], len(own), i == best, hashlib.sha256(b.encode()).hexdigest()) for i in own]
    return sorted(out, key=str)


@pytest.mark.parametrize("block,most", [(1024, 4096), (4, 2), (7, 1), (1, 3)])
def test_groups(spark, block, most):
    rng = random.Random(block)
    base = ["".join(rng.choice("ab é😀\n\t") for _ in range(rng.randint(0, 90))) for _ in range(25)]
    base += ["ab" * 40, "ab" * 41, "ab" * 20 + "ba" * 20, "abab", "x", " ", "a\x0bb\x0cc\rd"]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", " \n", *base, *(b + " " for b in base)])) for _ in range(120)] + [(3, base[3])] * 30 + [(None, base[4])] * 3
    df = spark.createDataFrame([(*r, 1, "n", "i", "h") for r in rows], "doc_id long, text string, doc int, name string, id string, h string")
    got = exact.exact_groups(df.repartition(3), block=block, most=most)
    assert sorted(map(tuple, got.collect()), key=str) == want(rows)
    assert exact.exact_groups(df.limit(0)).count() == 0


def test_long_text(spark):
    one = "".join(random.Random(1).choice("abcdefgh ") for _ in range(3_000_000))
    rows = [(1, one), (2, one.replace(" ", "")), (3, one[:-1] + "z"), (4, "z" + one[1:]), (5, one + "a")]
    got = exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == want(rows)


def test_query_like_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = registered.op12_exact(spark, SF)
    table = con.sql(registered.OP12_SQL)
    assert got.columns == table.columns and sorted(map(tuple, got.collect())) == sorted(table.fetchall())
