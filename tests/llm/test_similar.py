"""The pipeline's near-duplicate stage against brute force: Jaccard similarity of 5-word shingles of 0.8 or more."""

import random

import pytest

from tests.llm.test_operators import SF, groups

import corpus_pipeline as cp
from threadlens.llm import simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = (text or "").translate(LOWER).encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def survivors(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    return set(groups(sets, lambda a, b: jaccard(sets[a], sets[b]) >= 0.8).values())


def test_stage_is_jaccard(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    after = {r.doc_id for r in cp.near_duplicates(spark, docs, SF).collect()}
    assert after == survivors({r.doc_id: r.text for r in docs.collect()})


@pytest.mark.parametrize("limit", [4096, 8])
def test_groups_are_jaccard(spark, limit):
    """Chains of rewritten copies, whose ends are not similar, and near copies that are not similar enough."""
    rng = random.Random(5)
    texts = {}
    for base in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 400))]
        for step in range(8):
            texts[base * 8 + step] = " ".join(words)
            for _ in range(max(1, len(words) // rng.choice([30, 60, 120]))):
                words[rng.randrange(len(words))] = f"w{rng.randrange(3000)}"
    texts |= {200: None, 201: "", 202: " \n", 203: "One two", 204: "one TWO", 205: "one two three"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(frame, shard_limit=limit).collect()}
    sets = {d: shingles(t) for d, t in texts.items()}
    assert found == groups(sets, lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)


def test_recall_just_above_the_threshold(spark):
    """Copies of which one word in fifty is another, with a similarity of 0.8 to 0.85: of each pair one goes."""
    rng = random.Random(11)
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows, pairs = list(docs), []
    for d, t in docs:
        words = t.split(" ")
        if 120 < len(words) < 1500:
            for i in rng.sample(range(len(words)), max(1, int(len(words) * rng.uniform(0.018, 0.023)))):
                words[i] = f"zq{rng.randrange(10**9)}"
            if 0.8 <= jaccard(shingles(t), shingles(" ".join(words))) <= 0.85:
                pairs.append((d, 10**7 + d))
                rows.append((10**7 + d, " ".join(words)))
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 100 and sum(a in kept and b in kept for a, b in pairs) <= 0.01 * len(pairs)


def test_shingle_sets_are_passed_on_in_small_batches():
    import pyarrow as pa
    import xxhash

    from threadlens.llm import simhash

    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(50)] + [None, "", "a b", "a b"]
    made = list(simhash._gram_rows(5, 42, most=100)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])))
    assert len(made) == 17 and max(len(b.column(1).flatten()) for b in made) <= 136
    rows = [r for b in made for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    sets = list(simhash._shingle_sets(texts, 5, 42))
    assert [g for _, g in rows] == [x.view("int64").tolist() for x in sets]
    assert [k % (1 << 64) for k, _ in rows] == [xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets]


def near_copies(n, seed=3):
    """Copies of one text, each with one to eight words replaced: pairs have similarities from 0.4 to 0.95."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(3000)}" for _ in range(150)]
    texts = {}
    for d in range(n):
        copy = list(words)
        for i in rng.sample(range(len(copy)), rng.randrange(1, 9)):
            copy[i] = f"x{rng.randrange(10**9)}"
        texts[d] = " ".join(copy)
    return texts


@pytest.mark.parametrize("plan", [{}, {"shard_limit": 16}, {"gram_limit": 4000}])
def test_large_group_of_near_copies(spark, plan):
    texts = near_copies(120)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(frame, **plan).collect()}
    sets = {d: shingles(t) for d, t in texts.items()}
    expected = groups(sets, lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    assert found == expected and 2 < len(set(expected.values())) < 100


def test_rows_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch):
    """A shard passes on less rows than it has members; all pairs of a group would be 19900, most of them in several shards."""
    made, kind = [], type(spark.range(1))
    plain = kind.mapInArrow

    def counting(self, func, schema, *more, **named):
        out = plain(self, func, schema, *more, **named)
        if schema == "a long, b long":
            made.append(out.count())
        return out

    monkeypatch.setattr(kind, "mapInArrow", counting)
    frame = spark.createDataFrame(list(near_copies(200).items()), "doc_id long, text string")
    assert simhash.similar_groups(frame).count() == 200
    assert len(made) == 1 and made[0] < 24 * 200


def test_shards_are_cut_at_any_batch():
    import numpy as np
    import pyarrow as pa

    sets = list(simhash._shingle_sets(near_copies(60).values(), 5, 42))
    rows = [(kind, kind // 2, k, 0, k, g.view("int64").tolist()) for kind in range(3) for k, g in enumerate(sets) if kind < 2 or k < 3]
    schema = pa.schema([(c, pa.int64()) for c in ("kind", "value", "key", "fp", "comp")] + [("grams", pa.list_(pa.int64()))])
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    whole = [r for b in simhash._near_links(24, 0.8)(iter(table.to_batches())) for r in zip(*(c.to_pylist() for c in b.columns))]
    small = [r for b in simhash._near_links(24, 0.8)(iter(table.to_batches(max_chunksize=7))) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert whole == small and 2 < len(whole) < 2 * 60
    assert all(len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) for a, b in whole)
