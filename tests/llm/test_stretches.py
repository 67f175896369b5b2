"""Overlaps inside longer stretches that are not equal enough, and benchmark texts without an id of their own."""

import itertools
import random

import pytest

from threadlens.llm import decontaminate


def by_hand(same, least=12, share=0.8):
    """Score, from and until of the best stretch that counts; ties by the first start."""
    best = None
    for a, b in itertools.combinations_with_replacement([i for i, x in enumerate(same) if x], 2):
        n, hits = b - a + 1, sum(same[a : b + 1])
        if n >= least and hits >= share * n and (best is None or 3 * hits - 2 * n > best[0]):
            best = (3 * hits - 2 * n, a, b + 1)
    return best


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_hidden_overlaps(spark, limit):
    rng = random.Random(4)
    shapes = [[1] * 12 + [0, 1] * 10 + [1] * 11]
    shapes += [list(itertools.chain.from_iterable([1] * rng.randrange(3, 16) + [0] * rng.randrange(1, 5) for _ in range(5))) for _ in range(60)]
    docs, items = [], []
    for n, same in enumerate(shapes):
        words = [f"w{n}x{i}" for i in range(len(same))]
        items.append((None if n == 0 else n // 2, " ".join(words)))
        docs.append((n, " ".join(w if s else f"o{n}x{i}" for i, (w, s) in enumerate(zip(words, same)))))
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=limit).collect()
    found = {r.doc_id: (3 * r.n_matched - 2 * r.n_overlap, r.doc_from, r.doc_from + r.n_overlap) for r in got}
    due = {n: b for n, same in enumerate(shapes) if (b := by_hand(same))}
    assert len(got) == len(found) and found.keys() == due.keys() and 0 in found
    assert {n: v[0] for n, v in found.items()} == {n: v[0] for n, v in due.items()}
    assert {r.doc_id: r.item_id for r in got} == {n: items[n][0] for n in due}
