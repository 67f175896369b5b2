"""Connected components of a link table, wholly as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.shared import materialise


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """`links(a, b)` of a sortable type -> `(node, root)`, root being the smallest node reachable.

    Alternates two star rewrites until no link changes: first each node hands its larger neighbours to its
    smallest one, then each node hands its smaller neighbours to the smallest. Links shrink to one star per
    component in a number of rounds that grows with the logarithm of the longest path. Each round is written to the
    checkpoint folder. Minima are aggregated before the shuffle, so a node with very many links is not a hot
    task there; the join that follows can be split by AQE.
    """
    links = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialise(links)
    before = None
    for _ in range(rounds):
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = larger.groupBy("u").agg(F.min("v").alias("m"))
        links = materialise(
            larger.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u > v").distinct()
        )
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
