"""Rewriting of random nested types, and the sequence of shuffles."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.operators import nested as ne


def a_type(rng, depth):
    kind = rng.choice(["s", "s", "i", "a", "m", "t"]) if depth else rng.choice("si")
    if kind == "a":
        return T.ArrayType(a_type(rng, depth - 1))
    if kind == "m":
        return T.MapType(T.StringType(), a_type(rng, depth - 1))
    if kind == "t":
        return T.StructType([T.StructField(f"f.{i}" if i else "x", a_type(rng, depth - 1)) for i in range(rng.randint(1, 3))])
    return T.StringType() if kind == "s" else T.LongType()


def a_value(rng, kind):
    if rng.random() < 0.15:
        return None
    if isinstance(kind, T.ArrayType):
        return [a_value(rng, kind.elementType) for _ in range(rng.randint(0, 3))]
    if isinstance(kind, T.MapType):
        return {f"010-1234-567{i}": a_value(rng, kind.valueType) for i in range(rng.randint(0, 3))}
    if isinstance(kind, T.StructType):
        return tuple(a_value(rng, f.dataType) for f in kind.fields)
    return rng.choice(["", "call 010-1234-5678", "02-123-4567 or 070-1234-5678", "none"]) if isinstance(kind, T.StringType) else rng.randrange(99)


def plain(value, kind, rewrite):
    if value is None:
        return None
    if isinstance(kind, T.ArrayType):
        return [plain(x, kind.elementType, rewrite) for x in value]
    if isinstance(kind, T.MapType):
        return {k: plain(x, kind.valueType, rewrite) for k, x in value.items()}
    if isinstance(kind, T.StructType):
        return tuple(plain(x, f.dataType, rewrite) for x, f in zip(value, kind.fields))
    return rewrite(value) if isinstance(kind, T.StringType) else value


@pytest.mark.parametrize("seed", range(6))
def test_every_string_is_rewritten(spark, seed):
    rng = random.Random(seed)
    schema = T.StructType([T.StructField(n, a_type(rng, 3)) for n in ("a b", "c.d", "e")] + [T.StructField("s", T.StringType())])
    rows = [tuple(a_value(rng, f.dataType) for f in schema.fields) for _ in range(12)]
    df = spark.createDataFrame(rows, schema)
    got = ne.scrub_deep(df, lambda c: F.concat(F.lit("<"), c, F.lit(">")))
    names = lambda kind: T._parse_datatype_json_string(kind.json().replace('"nullable":false', '"nullable":true').replace('"containsNull":false', '"containsNull":true').replace('"valueContainsNull":false', '"valueContainsNull":true'))
    assert names(got.schema) == names(df.schema)
    assert [plain(tuple(r), schema, lambda x: x) for r in got.collect()] == [plain(r, schema, lambda x: f"<{x}>") for r in rows]


def test_telephones_are_scrubbed_deep(spark):
    df = spark.sql("SELECT named_struct('a', array(map('k', 'call 010-1234-5678 now')), 'n', 5) AS x, '02-123-4567' AS y, array(array('1588-1234')) AS z")
    assert ne.scrub_deep(df).first().asDict(recursive=True) == {"x": {"a": [{"k": "call <mobile> now"}], "n": 5}, "y": "<landline>", "z": [["<service>"]]}


def test_shuffles(spark):
    # worked out by hand from the generator: the first numbers of seed 1
    x, drawn = 1, []
    for _ in range(3):
        x ^= (x << 13) % 2**32
        x ^= x >> 17
        x ^= (x << 5) % 2**32
        drawn.append(x)
    assert drawn == [270369, 67634689, 2647435461]
    assert ne.permutation(4, 1).tolist() == ne.permutation(4, 0).tolist() == [2, 1, 3, 0]
    assert ne.permutation(0, 5).tolist() == [] and ne.permutation(1, 5).tolist() == [0]
    rows = [(k, i) for k, n in (("a", 5), ("b", 5), (None, 3), ("big", 70000)) for i in range(n)]
    got = {}
    for r in ne.shuffled(spark.createDataFrame(rows, "k string, i long").repartition(4), ["k"], ["i"], 99).collect():
        got.setdefault(r.k, {})[r.place] = r.i
    assert all([got[k][p] for p in range(1, n + 1)] == ne.permutation(n, 99).tolist() for k, n in (("a", 5), ("b", 5), (None, 3), ("big", 70000)))
