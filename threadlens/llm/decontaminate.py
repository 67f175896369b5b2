"""Benchmark decontamination by spaced seeds. Column expressions and joins only.

A mask names the token positions that a seed looks at and those that it ignores, so a seed survives substitutions at the
ignored ones. Seeds of all positions of the training texts are joined with those of the benchmark. A hit says how far an item is
shifted against a text; only the distinct (text, item, shift) go on, and for these the two token sequences are laid side by
side: of the stretches that are long and equal enough the one with the best score (a match +1, a mismatch -2) is the overlap.
Items too short for a mask are looked up whole. Texts are named by 128-bit marks, never by ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.shared import fresh_name, materialise, sized, text_marks

#: Fixed masks: 1 looks at a token, 0 ignores it.
MASKS = ("1101011", "11100101", "110010011")
#: What is joined with the texts is sent to every executor only up to this size; beyond it both sides are shuffled. The plan is the same.
BROADCAST_BYTES = 32 << 20
SEED_BYTES, HIT_BYTES, MARK_BYTES = 48, 64, 32
MISMATCH = 2


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, hashed to 64 bits each. Null: none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.xxhash64(x))


def _seeds(df: DataFrame, keep: list[str], whole: list[int]) -> DataFrame:
    """From `keep` and h, an array of token hashes: `keep`, at and seed, one row for each position and mask that fits, and for each length in `whole`."""
    # the outer form: for the inner one Spark would add a filter on the array's size and work the tokens out twice
    placed = df.select(*keep, "h", F.posexplode_outer("h").alias("at", "first"))
    seeds = []
    for n, mask in enumerate([*MASKS, *("1" * k for k in whole)]):
        looked = [F.get("h", F.col("at") + k) for k, c in enumerate(mask) if c == "1" and k]
        seeds.append(F.when(F.col("at") + len(mask) <= F.size("h"), F.xxhash64(F.lit(n if n < len(MASKS) else -len(mask)), F.col("first"), *looked)))
    return placed.select(*keep, "at", F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def _best_stretch(doc: Column, item: Column) -> Column:
    """The stretch of two equally long arrays with the highest score as a struct of score, from and until (end exclusive)."""
    start = F.struct(*(F.lit(0).alias(k) for k in ("run", "since", "at", "score", "from", "until")))

    def step(s: Column, same: Column) -> Column:
        alive = s["run"] > 0
        run = F.when(alive, s["run"]).otherwise(0) + F.when(same, 1).otherwise(-MISMATCH)
        since = F.when(alive, s["since"]).otherwise(s["at"])
        better = run > s["score"]
        return F.struct(
            run.alias("run"), since.alias("since"), (s["at"] + 1).alias("at"),
            F.when(better, run).otherwise(s["score"]).alias("score"),
            F.when(better, since).otherwise(s["from"]).alias("from"), F.when(better, s["at"] + 1).otherwise(s["until"]).alias("until"),
        )

    return F.aggregate(F.zip_with(doc, item, lambda a, b: a == b), start, step)


def _best_valid(least: Column, share: float) -> Column:
    """Of the stretches from an equal token to an equal token with `least` tokens and `share` of them equal, the one with the highest score, as `_best_stretch`
    gives it; null if there is none. `m` holds the places of the equal tokens. Such a stretch only gains by whole runs, so it starts and ends with one."""
    at = lambda k: F.get("m", k)
    places = F.sequence(F.lit(0), F.size("m") - 1)
    starts = F.filter(places, lambda k: F.coalesce(at(k - 1) < at(k) - 1, F.lit(True)))
    ends = F.filter(places, lambda k: F.coalesce(at(k + 1) > at(k) + 1, F.lit(True)))
    length = lambda a, b: at(b) - at(a) + 1
    good = lambda a, b: (b >= a) & (length(a, b) >= least) & (b - a + 1 >= share * length(a, b))
    made = lambda a, b: F.struct(((1 + MISMATCH) * (b - a + 1) - MISMATCH * length(a, b)).alias("score"), (-at(a)).alias("before"), (at(b) + 1).alias("until"))
    best = F.array_max(F.transform(starts, lambda a: F.array_max(F.transform(F.filter(ends, lambda b: good(a, b)), lambda b: made(a, b)))))
    return F.when(best.isNotNull(), F.struct(best["score"].alias("score"), (-best["before"]).alias("from"), best["until"].alias("until")))


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    min_tokens: int = 12, min_share: float = 0.8, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """`(doc_id, item_id, n_items, n_overlap, n_matched, doc_from, item_from)`: for each document and benchmark text that share a verified overlap the best one.

    An overlap counts if it has `min_tokens` tokens (or all the item's, if these are fewer), of which `min_share` are equal; an item with fewer
    tokens than the shortest mask counts where all of it occurs. Positions are in tokens. Benchmark texts of equal tokens count as one: `item_id` is
    their smallest id, null only if all their ids are, `n_items` their number. Null and empty texts have no overlap. Rows that share id and text give
    one result, rows that share an id alone one each; null ids are like any other. Other columns are not read.
    """
    found = _text_overlaps(docs, benchmark, text_col, item_col, item_text_col, min_tokens, min_share, broadcast_bytes)
    found = materialise(found)
    rows = docs.select(F.col(id_col).alias("id"), *(m.alias(n) for m, n in zip(text_marks(F.col(text_col)), ("m1", "m2"))))
    joined = rows.join(sized(found, broadcast_bytes, HIT_BYTES), ["m1", "m2"]).dropDuplicates(["id", "m1", "m2", "item"])
    return joined.select(F.col("id").alias(id_col), "item_id", "n_items", "n_overlap", "n_matched", "doc_from", "item_from")


def _text_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, min_tokens: int, min_share: float, broadcast_bytes: int) -> DataFrame:
    """As `overlaps`, for each distinct text, named by m1 and m2, and each distinct item."""
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text_col)).alias("h")).where(F.size("h") > 0)
    items = items.groupBy("h").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))
    # written, so that an item keeps its number
    items = materialise(items.withColumn("item", F.monotonically_increasing_id()))
    shortest = min(map(len, MASKS))
    whole = sorted(r[0] for r in items.where(F.size("h") < shortest).select(F.size("h")).distinct().collect())
    long = _seeds(items.where(F.size("h") >= shortest), ["item"], [])
    short = [_seeds(items.where(F.size("h") == n), ["item"], [n]) for n in whole]
    seeds = long
    for part in short:
        seeds = seeds.union(part)
    seeds = materialise(seeds.select("seed", "item", F.col("at").alias("item_at")))
    named = docs.select(*(m.alias(n) for m, n in zip(text_marks(F.col(text_col)), ("m1", "m2"))), F.col(text_col).alias("t"))
    lean = named.select("m1", "m2", tokens(F.col("t")).alias("h"))
    met = _seeds(lean, ["m1", "m2"], whole).join(sized(seeds, broadcast_bytes, SEED_BYTES), "seed")
    met = materialise(met.groupBy("m1", "m2", "item", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.lit(1).alias("one")).drop("one"))
    # the texts that have hits: each once, its tokens beside them
    some = sized(met.select("m1", "m2").distinct(), broadcast_bytes, MARK_BYTES)
    texts = named.join(some, ["m1", "m2"], "left_semi").groupBy("m1", "m2").agg(F.min("t").alias("t"))
    hits = texts.select("m1", "m2", tokens(F.col("t")).alias("h")).join(met, ["m1", "m2"]).join(items.withColumnRenamed("h", "item_h"), "item")
    # the item laid over the text as the hit's shift says, clipped to what both have
    item_from = F.greatest(F.lit(0), -F.col("shift"))
    width = F.least(F.size("item_h") - item_from, F.size("h") - (item_from + F.col("shift")))
    keys = ["m1", "m2", "item", "item_id", "n_items"]
    laid = hits.select(*keys, "shift", item_from.alias("item_from"), F.size("item_h").alias("item_size"), F.slice("h", item_from + F.col("shift") + 1, width).alias("a"), F.slice("item_h", item_from + 1, width).alias("b"))
    # exploding an array of one keeps the conditions below from working the stretch out once more each
    alone = lambda c: F.explode(F.array(c))
    kept = [*keys, "shift", "item_from", "item_size"]
    least = F.least(F.lit(min_tokens), F.col("item_size"))
    best = laid.select(*kept, "a", "b", alone(_best_stretch(F.col("a"), F.col("b"))).alias("s"))
    length = F.col("s.until") - F.col("s.from")
    matched = ((F.col("s.score") + MISMATCH * length) / (1 + MISMATCH)).cast("int")
    # an item without a mask is known by all its tokens alone
    share = F.when(F.col("item_size") < shortest, 1.0).otherwise(min_share)
    valid = (length >= least) & (matched >= share * length)
    # a best stretch that does not count may hide one that does
    equal = F.filter(F.transform(F.zip_with("a", "b", lambda x, y: x == y), lambda same, i: F.when(same, i)), lambda i: i.isNotNull())
    best = best.select(*kept, "s", alone(F.struct(valid.alias("valid"), F.when(~valid, equal).alias("m"))).alias("v")).select(*kept, "s", "v.*").where(F.col("valid") | (F.size("m") >= share * least))
    best = best.select(*kept, alone(F.when(F.col("valid"), F.struct("s.score", "s.from", "s.until")).otherwise(_best_valid(least, share))).alias("s")).where("s is not null")
    found = best.select(
        *keys, length.alias("n_overlap"), matched.alias("n_matched"),
        (F.col("item_from") + F.col("shift") + F.col("s.from")).alias("doc_from"), (F.col("item_from") + F.col("s.from")).alias("item_from"),
    )
    top = F.max(F.struct("n_matched", "n_overlap", (-F.col("doc_from")).alias("d"), (-F.col("item_from")).alias("i"))).alias("top")
    return found.groupBy(*keys).agg(top).select(*keys, "top.n_overlap", "top.n_matched", (-F.col("top.d")).alias("doc_from"), (-F.col("top.i")).alias("item_from"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, **limits: float) -> DataFrame:
    """The rows of `docs` whose own text has no verified overlap with the benchmark, with the columns of `docs`. Ids are not looked at: a row with a
    null or repeated id goes or stays by its text. Only the marks of texts that go are joined with the rows."""
    limits = {"min_tokens": 12, "min_share": 0.8} | limits
    found = _text_overlaps(docs, benchmark, text_col, "item_id", "text", limits["min_tokens"], limits["min_share"], broadcast_bytes)
    b1, b2 = fresh_name(docs, "bad_1"), fresh_name(docs, "bad_2")
    bad = materialise(found.select(F.col("m1").alias(b1), F.col("m2").alias(b2)).distinct())
    m1, m2 = text_marks(F.col(f"`{text_col}`"))
    return docs.join(sized(bad, broadcast_bytes, MARK_BYTES), (m1 == F.col(b1)) & (m2 == F.col(b2)), "left_anti")
