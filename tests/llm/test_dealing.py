"""How repeated passages are dealt to shards: what a slice sends does not grow with the number of shards, and a fragment that is everywhere is merged on the way."""

import random

import numpy as np
import pyarrow as pa
from tests.llm.test_operators import cut

from threadlens.llm import suffixes

NONE = np.zeros(0, np.uint64)


def sent(shards, fan=suffixes.FAN, n=9_300_000):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(20000)]
    texts, size = [], 0
    while size < n:
        texts.append(" ".join(rng.choices(words, k=500)))
        size += len(texts[-1])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc", "mark", "text"])
    return list(suffixes._send(shards, suffixes.SEGMENT, NONE, fan)([batch]))


def test_a_slice_sends_as_much_whatever_the_input():
    size = lambda out: (sum(b.num_rows for b in out), sum(b.nbytes for b in out))
    some, many = size(sent(1250)), size(sent(4_200_000))
    assert all(b < 1.2 * a for a, b in zip(some, many))


def test_redealing_keeps_all_anchors_and_merges_frequent_ones():
    shards, fan = 300, 7
    once = sorted(b for out in sent(shards, shards, 300_000) for b in out.column(0).to_pylist() if b is not None)
    again = [b for out in suffixes._redeal(shards, NONE)(sent(shards, fan, 300_000)) for b in out.column(0).to_pylist() if b is not None]
    assert set(again) == set(once) and len(again) == len(set(again))
    # one fragment in as many slices as 100 TB have, in small: each sends its smallest document on
    line = "a licence line that stands in every document of the corpus, word for word, again. "
    frames = []
    for k in range(400):
        texts = pa.array([line + "x" * 3] * 2)
        batch = pa.RecordBatch.from_arrays([pa.array([2 * k, 2 * k + 1], pa.int64()), pa.array([2 * k, 2 * k + 1], pa.int64()), texts], ["doc", "mark", "text"])
        frames += suffixes._send(shards, suffixes.SEGMENT, NONE, fan)([batch])
    entries = lambda out: sum(len(suffixes.unpack_anchors(b)[0]) for r in out for b in r.column(2).to_pylist() if b is not None)
    dealt = list(suffixes._redeal(shards, NONE)(frames))
    settled = sum(r.column(0).null_count for r in dealt) + 400
    assert entries(frames) >= 400 and entries(dealt) == entries(frames) // 400 and settled >= 799


def test_repeats_dealt_twice(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["alpha", "bravo", "charlie", "delta", "é"]) for _ in range(n))
    common = say(15)
    rows = [(rng.choice([None, *range(90)]), f"{say(rng.randrange(25))} {common if rng.random() < 0.7 else ''} {say(rng.randrange(25))}") for _ in range(150)]
    for more in ({}, {"hot": 4}, {"hot": 8, "crowd": 1, "seen": 2}):
        got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), shard_bytes=400, fan=3, **more)
        assert sorted(tuple(r)[1:5] for r in got.drop("kept").collect()) == sorted(cut(rows))
