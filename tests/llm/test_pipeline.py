"""The pipeline stage by stage, each against what brute force says of its own input."""

import re

from tests.llm.test_operators import SF, base_spans, counts
from tests.llm.test_similar import survivors

import corpus_pipeline as cp


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for n, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        columns = docs.columns
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        if name != "best_fit_packing":
            after = {r.doc_id: r for r in docs.collect()}
            assert docs.columns == columns and len(after) == docs.count() and set(after) <= set(before)
        if name == "quality_rules":
            for d in after:
                c = counts(before[d].text)
                assert c[0] >= 20 and 100 * c[4] <= 30 * c[0]
        elif name == "near_duplicates":
            assert set(after) == survivors({d: r.text for d, r in before.items()})
        elif name == "secret_scan":
            assert set(after) == set(before) and not any(base_spans(r.text) for r in after.values()) and all(r.n_chars == len(r.text) for r in after.values())
            assert all(after[d].text == r.text for d, r in before.items() if not base_spans(r.text) and "<secret>" not in after[d].text)
        elif name == "best_fit_packing":
            size = {}
            for r in docs.collect():
                size[r.doc_id] = size.get(r.doc_id, 0) + r.n_tokens
            assert size == {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for d, r in before.items()}


def test_run_is_all_stages(spark):
    assert cp.run(spark, SF).count() > 0 and len(cp.STAGES) == 5
