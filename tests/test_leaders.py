"""Leader clusters against the rule taken item by item, in groups of more items than meet in a task."""

import random

from threadlens.operators import similarity as si
from threadlens.queries import queries, tables

SF = "/root/testdata/sf0.001"


def by_hand(rows, least=0.45):
    leaders, out = {}, {}
    for grp, i, _, keys in sorted(rows, key=lambda r: (-r[2], r[1])):
        best = max(((len(set(keys) & k) / max(len(set(keys) | k), 1), -n) for n, (_, k) in enumerate(leaders.get(grp, []))), default=(0.0, 0))
        if best[0] >= least:
            out[i] = leaders[grp][-best[1]][0]
        else:
            leaders.setdefault(grp, []).append((i, set(keys)))
            out[i] = i
    return out


def test_items_beyond_the_bound(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["g", "h", None]), i, float(rng.randrange(50)), rng.sample("abcdefghijklmnop", rng.randrange(6))) for i in range(700)]
    got = si.leader_clusters(spark.createDataFrame(rows, "grp string, id long, score double, keys array<string>"), most=100).collect()
    assert len(got) == len(rows) and {r.id: r.leader for r in got} == by_hand(rows)


def test_each_thread_has_a_row_and_groups_are_rules(spark):
    got = queries()["cluster_leaders"](spark, SF).collect()
    rules = {r.rule_id for r in tables.rule_hits(spark, SF).select("rule_id").distinct().collect()}
    threads = tables.rule_hits(spark, SF).select("thread_id").distinct().count()
    assert len(got) == threads and {r.grp for r in got} <= rules
