"""Clusters and sparse search against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from threadlens.operators import vectors as ve


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b)) / n, 9) if n else 0.0


@pytest.mark.parametrize("front", [8192, 7])
def test_greedy_clusters(spark, front):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.35) for x in rng.choice(centres)]) for i in rng.sample(range(1000), 160)]
    rows += [(1001 + i, rows[5][1]) for i in range(20)] + [(2000, None), (2001, []), (2002, [0.0] * 6), (None, rows[0][1])]
    want, leaders = {}, []
    for i, v in sorted(r for r in rows if r[0] is not None):
        mine = next((x for x in leaders if v and any(v) and cosine(dict(rows)[x], v) >= 0.86), i)
        if mine == i and v and any(v):
            leaders.append(i)
        want[i] = mine
    found = ve.greedy_clusters(spark.createDataFrame(rows, "id long, v array<double>").repartition(5), "id", "v", front=front)
    got = found.collect()
    assert {r.id: r.leader for r in got} == want and len(got) == len(want) and 5 < len(leaders) < 120
    assert all(abs(r.sim - (1 if r.id == r.leader else cosine(dict(rows)[r.leader], dict(rows)[r.id]))) < 1e-8 for r in got if r.id < 2000)
    report = {r.leader: r["size"] for r in ve.cluster_report(found).collect()}
    assert sum(report.values()) == len(want) and report[2000] == 1
    assert ve.greedy_clusters(spark.createDataFrame([], "id long, v array<double>"), "id", "v").count() == 0


@pytest.mark.parametrize("least", [0.2, 0.7])
def test_sparse_search(spark, least):
    rng = random.Random(3)
    cells = [(i, f"f{int(rng.paretovariate(0.7)) % 60}", rng.choice([0.5, 1.0, 2.0, -1.0])) for i in range(150) for _ in range(rng.randint(1, 8))]
    cells += [(200 + i, f, 1.0) for i in range(30) for f in ("f1", "f2", "f7")] + [(300, None, 1.0), (None, "f1", 1.0)]
    maps = {}
    for i, f, w in cells:
        if i is not None and f is not None and w > 0:
            maps.setdefault(i, {}).setdefault(f, 0.0)
            maps[i][f] += w
    sim = lambda a, b: round(sum(w * b.get(f, 0.0) for f, w in a.items()) / math.sqrt(sum(x * x for x in a.values())) / math.sqrt(sum(x * x for x in b.values())), 6)
    want = []
    for q in maps:
        if q % 10 == 0:
            near = sorted((-sim(maps[q], maps[i]), i) for i in maps if i != q)
            want += [(q, i, -s, n) for n, (s, i) in enumerate([x for x in near if -x[0] >= least][:4], 1)]
    vectors = ve.written(ve.sparse_vectors(spark.createDataFrame(cells, "id long, f string, w double"), "id", "f", "w"))
    got = [tuple(r) for r in ve.sparse_top_k(vectors, vectors.where("id % 10 = 0"), 4, least).collect()]
    assert sorted(got) == sorted(want) and len(got) > 20
    assert ve.sparse_top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_sparse_cosine_of_two_columns(spark):
    rows = [({"a": 1.0, "b": 2.0}, {"b": 3.0, "c": 4.0}), ({}, {"a": 1.0}), (None, {"a": 1.0}), ({"a": 2.0}, {"a": 5.0})]
    got = [r[0] for r in spark.createDataFrame(rows, "x map<string,double>, y map<string,double>").select(F.round(ve.sparse_cosine("x", "y"), 6)).collect()]
    assert got == [round(6 / math.sqrt(5) / 5, 6), 0.0, 0.0, 1.0]


def test_sparse_search_in_blocks(spark, monkeypatch):
    """Blocks of few features, strings as ids, and tasks that see a block only."""
    rng = random.Random(5)
    cells = [(f"k{i:03}", f"f{rng.randint(0, 9)}", rng.choice([0.5, 1.0])) for i in range(120) for _ in range(5)]
    vectors = ve.written(ve.sparse_vectors(spark.createDataFrame(cells, "id string, f string, w double"), "id", "f", "w"))
    asked = vectors.where("id like '%0'")
    seen, plain = spark.sparkContext.accumulator(0), ve._scored

    def counted(k, least):
        score = plain(k, least)
        return lambda classes, queries: (seen.add(1), score(classes, queries))[1]

    monkeypatch.setattr(ve, "_scored", counted)
    few = sorted(map(tuple, ve.sparse_top_k(vectors, asked, 3, 0.5, entries=100).collect()))
    assert seen.value > 4
    assert few == sorted(map(tuple, ve.sparse_top_k(vectors, asked, 3, 0.5).collect())) and len(few) == 36
    maps = {r.id: {x.f: x.u for x in r.vec} for r in vectors.collect()}
    for q in [i for i in maps if i.endswith("0")]:
        sims = sorted((-round(sum(u * maps[i].get(f, 0.0) for f, u in maps[q].items()), 6), i) for i in maps if i != q)[:3]
        assert [(q, i, -s, n) for n, (s, i) in enumerate(sims, 1)] == sorted((x for x in few if x[0] == q), key=lambda x: x[3])
