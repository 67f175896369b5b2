import pytest

from threadlens.sources import jsonl as js


def test_lenient_and_lint(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id":"a","n":1}\n\n{bad\n{"id":"b","n":2,}\n# note\n')
    assert js.read_lenient(spark, str(p), "id string, n int").where("id is not null").count() >= 1
    got = js.lint(spark.read.text(str(p)), "id string, n int").collect()
    assert [(r.ok, r.parsed.id) for r in got if r.ok] == [(True, "a"), (True, "b")]
    with pytest.raises(Exception):
        js.read_strict(spark, str(p), "id string, n int").collect()


def test_tagged_union(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "id int, v string")
    got = js.tagged_union([("first", a), ("second", b)], "id").collect()
    assert sorted((r.id, r.v, r.tag) for r in got) == [(1, "x", "first"), (2, "z", "second")]
