"""Rewriting of every string in nested columns, and shuffles by a fixed generator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.operators.corpus import scrub_phones


def holds_strings(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return holds_strings(kind.elementType)
    if isinstance(kind, T.MapType):
        return holds_strings(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(holds_strings(f.dataType) for f in kind.fields)
    return isinstance(kind, T.StringType)


def each_string(value: Column, kind: T.DataType, rewrite: Callable[[Column], Column]) -> Column:
    """`value` of the type `kind` with `rewrite` on every string in it, in structs, arrays and the values of maps, at any depth. Keys of maps stay, as two could become one; nulls stay nulls at every depth. What holds no string is not touched."""
    if not holds_strings(kind):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: each_string(x, kind.elementType, rewrite))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, x: each_string(x, kind.valueType, rewrite))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(each_string(value.getField(f.name), f.dataType, rewrite).alias(f.name) for f in kind.fields)))
    return rewrite(value)


def scrub_deep(df: DataFrame, rewrite: Callable[[Column], Column] = scrub_phones) -> DataFrame:
    """`df` with every string of every column rewritten, by default without telephone numbers. Names and types of columns stay. One projection, no Python."""
    return df.select(*(each_string(F.col(f"`{f.name}`"), f.dataType, rewrite).alias(f.name) for f in df.schema.fields))


def permutation(n: int, seed: int) -> np.ndarray:
    """Where each place of a shuffled list of `n` comes from: Fisher and Yates from the end, driven by xorshift of 32 bits with the shifts 13, 17 and 5. A seed of 0 is 1."""
    out, x = np.arange(n), (seed & 0xFFFFFFFF) or 1
    for i in range(n - 1, 0, -1):
        x ^= x << 13 & 0xFFFFFFFF
        x ^= x >> 17
        x ^= x << 5 & 0xFFFFFFFF
        j = int(x / 4294967296 * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def shuffled(df: DataFrame, keys: list[str], order: list[str], seed: int) -> DataFrame:
    """Adds `place` (from 1) of each row in its group's list, taken by `order` and shuffled with `seed`; null keys are a group.

    A group's permutation depends on its size alone, so each size is worked out once, and rows are joined to it by size and place: no group is gathered. The task of a size holds eight bytes for each place.
    """
    own = W.partitionBy(*keys)
    t = df.withColumns({"__at": F.row_number().over(own.orderBy(*order)).cast("long"), "__n": F.count(F.lit(1)).over(own)})

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n in batch["n"]:
                source = permutation(int(n), seed)
                for lo in range(0, int(n), 1 << 16):
                    part = source[lo : lo + (1 << 16)]
                    yield pd.DataFrame({"__n": int(n), "__at": part + 1, "place": np.arange(lo, lo + len(part)) + 1})

    sizes = t.select(F.col("__n").alias("n")).distinct()
    return t.join(sizes.mapInPandas(places, "__n long, __at long, place long"), ["__n", "__at"]).drop("__n", "__at")
