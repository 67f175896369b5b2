"""Quality rules: base counts of a text, and robust multivariate outliers for each language and source.

All of it is column expressions, grouping and joins. The statistic vector of a document is put on an integer grid, so sums over a
group are exact and a result does not depend on how rows are dealt. For each (language, source) the minimum-covariance-determinant
estimate is sought from three starts: medians and median deviations, the classical moments, and the correlations of hyperbolic tangents of
the robustly scaled statistics. From each, concentration steps: every document has a squared Mahalanobis distance, the `support` share
with the smallest ones gives the next centre and covariance, until nothing changes; of the starts the one with the least determinant is
taken. A step needs one grouping: sums are kept for each band of distance, and a window over the bands of a group, whose
number is bounded, finds the band where the share is reached. No group of rows meets in a task.

One formula holds for groups of every size: a group's covariance weighs as its documents, the mean of all groups' as `prior` documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.llm.shared import materialise, sized, words, written

#: Fixed values of the base rule.
SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

GRID = 1000
#: Statistic -> the standard deviation that is added, on the 0.001 grid: what a short text cannot tell apart. Shares are square roots, so
#: one symbol in 280 characters or one repeated line in a hundred is one deviation.
FLOORS = {"word_length": 40, "symbols": 60, "capitals": 20, "repeated_lines": 100, "repeated_words": 100, "variety": 20}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STARTS = 3


@dataclass(frozen=True)
class OutlierRule:
    """support: share of a group that an estimate rests on. steps: most concentration steps from a start; nearly all end before, as nothing
    changes. cut: the upper tail of the chi-square distribution beyond which a document goes. prior: documents that the mean covariance weighs as.
    model_bytes: estimates up to this size are sent to the documents; beyond it both are shuffled to meet."""

    support: float = 0.75
    steps: int = 12
    cut: float = 1e-3
    prior: int = 30
    model_bytes: int = 32 << 20


def chi_square_share(x: float, k: int) -> float:
    """The chi-square distribution function with k degrees at x, by its series."""
    a, term, total = k / 2, 1.0, 1.0
    for n in range(1, 2000):
        term *= x / 2 / (a + n)
        total += term
        if term < 1e-17 * total:
            break
    return math.exp(a * math.log(x / 2) - x / 2 - math.lgamma(a + 1)) * total


def chi_square_quantile(p: float, k: int) -> float:
    """Its p-quantile, by bisection."""
    low, high = 1e-9, 400.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_share(mid, k) < p else (low, mid)
    return (low + high) / 2


def consistency(support: float, k: int) -> float:
    """What the covariance of the central share is to be multiplied with for normal data."""
    return support / chi_square_share(chi_square_quantile(support, k), k + 2)


def _settled(df: DataFrame) -> DataFrame:
    """`df` behind an explode of arrays of one row each: what stands above, filters above all, is not pushed below it, where each
    use of a column would work the whole chain of expressions out once more."""
    return df.select(F.explode(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))).alias("r")).select("r.*")


def base_counts(df: DataFrame, keep: list[Column], text: Column) -> DataFrame:
    """`keep` and the counts of BASE, with n_lines, n_capitals, n_letters and n_distinct, for each row of `df`.

    Null and blank texts have no words. Windows are compared by 64-bit hashes of their words' 64-bit hashes, within one text.
    """
    ours = [f"__kept_{i}" for i in range(len(keep))]
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\f\r"))) > 0)
    step = df.select(*(c.alias(n) for c, n in zip(keep, ours)), body.alias("t"), words(text).alias("w"), lines.alias("l"))
    step = step.select(
        *ours,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("t", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_capitals", "n_letters", "n_distinct"]
    step = step.withColumn("n_distinct", F.size(F.array_distinct("h")).cast("long"))
    starts = F.sequence(F.lit(0), F.size("h") - WINDOW_WORDS)
    hashed = F.transform(starts, lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(WINDOW_WORDS))))
    step = step.select(*ours, *counts, F.when(F.size("h") >= WINDOW_WORDS, hashed).otherwise(F.array().cast("array<bigint>")).alias("v"))
    several = F.size("v") > F.size(F.array_distinct("v"))
    pairs = F.array_sort(F.transform("v", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    step = step.select(*ours, *counts, F.when(several, pairs).alias("s"))
    like = lambda e, j: F.coalesce(F.get("s", j)["x"] == e["x"], F.lit(False))
    found = F.array_sort(F.transform(F.filter("s", lambda e, j: like(e, j - 1) | like(e, j + 1)), lambda e: e["i"]))
    step = step.select(*ours, *counts, found.alias("p"))
    span = lambda i, j: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get("p", j + 1) - i, F.lit(WINDOW_WORDS)))
    covered = F.aggregate(F.transform("p", span), F.lit(0).cast("long"), lambda a, x: a + x)
    return _settled(step.select(*ours, *counts, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words")))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def statistic_vector() -> dict[str, Column]:
    """The transformed statistics on the grid, as longs, in the order of FLOORS."""
    grid = lambda c: F.floor(c * GRID + 0.5).cast("long")
    share = lambda a, b: grid(F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1).cast("long"))))
    return {
        "word_length": grid(F.log(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1).cast("long")))),
        "symbols": share("n_symbols", "word_chars"),
        "capitals": share("n_capitals", "n_letters"),
        "repeated_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        # how the number of different words grows with their number, alike for long and short texts
        "variety": grid(F.log(F.greatest("n_distinct", F.lit(1).cast("long"))) / F.log(F.greatest("n_words", F.lit(2).cast("long")))),
    }


def _pairs() -> list[tuple[str, str]]:
    names = list(FLOORS)
    return [(a, b) for i, a in enumerate(names) for b in names[: i + 1]]


def _factored(df: DataFrame, keys: list[str]) -> DataFrame:
    """From the centre m_ and the covariance c_ the lower Cholesky factor l_, and half the logarithm of the determinant. Written as SQL, where a
    column may name those before it."""
    names = list(FLOORS)
    steps = []
    for i, a in enumerate(names):
        for j, b in enumerate(names[: i + 1]):
            value = " - ".join([f"c_{a}_{b}", *(f"l_{a}_{k} * l_{b}_{k}" for k in names[:j])])
            steps.append(f"sqrt({value}) AS l_{a}_{b}" if i == j else f"({value}) / l_{b}_{b} AS l_{a}_{b}")
    half = " + ".join(f"ln(l_{a}_{a})" for a in names)
    return df.selectExpr(*keys, "n", *(f"m_{a}" for a in names), *(f"c_{a}_{b}" for a, b in _pairs()), *steps, f"{half} AS half_log_det")


def _moments(sums: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """From n and sums the centre and `scale` times the covariance plus floors, factored."""
    cov = [f"{scale!r}D * (q_{a}_{b} / n - (s_{a} / n) * (s_{b} / n)) + {FLOORS[a] ** 2 if a == b else 0}D AS c_{a}_{b}" for a, b in _pairs()]
    return _factored(sums.selectExpr(*keys, "n", *(f"s_{a} / n AS m_{a}" for a in FLOORS), *cov), keys)


def _distance(df: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """Adds the squared Mahalanobis distance, by forward substitution, to the columns `keep`, all of them without it."""
    names = list(FLOORS)
    steps = [f"({' - '.join([f'({a} - m_{a})', *(f'l_{a}_{b} * z_{b}' for b in names[:i])])}) / l_{a}_{a} AS z_{a}" for i, a in enumerate(names)]
    kept = [f"`{c}`" for c in keep or df.columns]
    return df.selectExpr(*kept, *steps, f"{' + '.join(f'z_{a} * z_{a}' for a in names)} AS {name}").selectExpr(*kept, name)


def _sums(columns: bool) -> list[Column]:
    """Sums of the vector and its products: of rows (columns False) or of sums."""
    if columns:
        return [F.expr(f"sum({c}) AS {c}") for c in ("n", *(f"s_{a}" for a in FLOORS), *(f"q_{a}_{b}" for a, b in _pairs()))]
    return [F.expr("count(*) AS n"), *(F.expr(f"sum({a}) AS s_{a}") for a in FLOORS), *(F.expr(f"sum({a} * {b}) AS q_{a}_{b}") for a, b in _pairs())]


def group_key() -> Column:
    """Names a language and source; what is null is left out, so it is a name of its own."""
    return F.to_json(F.struct("lang", "source"))


def _middles(values: DataFrame) -> DataFrame:
    """From `(key, stat, v, n)`, how often a value comes, the lower median of each key and statistic."""
    own = W.partitionBy("key", "stat")
    upto = F.sum("n").over(own.orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    ranked = values.withColumn("upto", upto).withColumn("all", F.sum("n").over(own))
    return ranked.where(2 * F.col("upto") >= F.col("all")).groupBy("key", "stat").agg(F.min("v").alias("mid"))


def _starts(keyed: DataFrame, bound: int) -> DataFrame:
    """For each key the three estimates that concentration starts from, told apart by `start`."""
    names, keys = list(FLOORS), ["key", "start"]
    each = F.array(*(F.struct(F.lit(i).alias("stat"), F.col(a).alias("v")) for i, a in enumerate(names)))
    values = materialise(keyed.select("key", F.explode(each).alias("e")).groupBy("key", "e.stat", "e.v").agg(F.count("*").alias("n")))
    middle = materialise(_middles(values))
    off = values.join(middle, ["key", "stat"]).groupBy("key", "stat", F.abs(F.col("v") - F.col("mid")).alias("v")).agg(F.sum("n").alias("n"))
    spread = _middles(off).withColumnRenamed("mid", "mad")
    at = lambda c, i: F.max(F.when(F.col("stat") == i, F.col(c)))
    at = lambda c, i: f"max(CASE WHEN stat = {i} THEN {c} END)"
    wide = middle.join(spread, ["key", "stat"]).groupBy("key").agg(
        *(F.expr(f"CAST({at('mid', i)} AS double) AS m_{a}") for i, a in enumerate(names)), *(F.expr(f"sqrt(pow(1.4826D * {at('mad', i)}, 2) + {FLOORS[a] ** 2}D) AS d_{a}") for i, a in enumerate(names))
    )
    wide = materialise(wide)
    middles = [f"m_{a}" for a in names]
    one = wide.selectExpr("key", "0 AS start", "0L AS n", *middles, *((f"d_{a} * d_{a} AS c_{a}_{b}" if a == b else f"0D AS c_{a}_{b}") for a, b in _pairs()))
    bent = keyed.join(sized(wide, bound, 16 * len(names) + 64), "key")
    bent = bent.selectExpr("key", *(f"CAST(round(1000 * tanh(({a} - m_{a}) / d_{a})) AS long) AS {a}" for a in names)).groupBy("key").agg(*_sums(False))
    # a little is added to the variances, so that nothing correlates wholly
    dev = [f"q_{a}_{b} / n - (s_{a} / n) * (s_{b} / n) + {1000 if a == b else 0}D AS v_{a}_{b}" for a, b in _pairs()]
    bent = bent.selectExpr("key", "n", *dev).join(wide, "key")
    three = bent.selectExpr("key", "2 AS start", "n", *middles, *(f"v_{a}_{b} / sqrt(v_{a}_{a} * v_{b}_{b}) * d_{a} * d_{b} AS c_{a}_{b}" for a, b in _pairs()))
    two = _moments(keyed.groupBy("key").agg(*_sums(False)).withColumn("start", F.lit(1)), keys, 1.0)
    return _factored(one, keys).unionByName(two).unionByName(_factored(three, keys))


MODEL_ROW = 16 * (len(FLOORS) * (len(FLOORS) + 3)) + 128


def estimates(stats: DataFrame, rule: OutlierRule = OutlierRule()) -> DataFrame:
    """`stats(lang, source, <vector>)`, one row for each document that passes the base rule -> for each (lang, source), named by `key`, the
    centre m_ and the Cholesky factor l_ of the covariance, and the number of documents `n` that they rest on. Null is a language and a source."""
    keyed = materialise(stats.select(group_key().alias("key"), *FLOORS))
    keys = ["key", "start"]
    scale = consistency(rule.support, len(FLOORS))
    model = materialise(_starts(keyed, rule.model_bytes))
    settled = []
    for step in range(rule.steps):
        spread = _distance(keyed.join(sized(model, rule.model_bytes, MODEL_ROW), "key"), "d2", [*keys, *FLOORS])
        # written here so that sums are dealt by key and band; in one plan with the windows they would be by key, a hot group to one task
        bands = materialise(spread.groupBy(*keys, F.expr("CAST(floor(ln(1 + d2) * 100) AS long) AS band")).agg(*_sums(False)))
        upto = W.partitionBy(*keys).orderBy("band").rowsBetween(W.unboundedPreceding, -1)
        bands = bands.withColumns({"before": F.coalesce(F.sum("n").over(upto), F.lit(0)), "all": F.sum("n").over(W.partitionBy(*keys))})
        new = _moments(bands.where(F.col("before") < F.ceil(rule.support * F.col("all"))).groupBy(*keys).agg(*_sums(True)), keys, scale)
        state = f"struct({', '.join(['half_log_det', *(f'm_{a}' for a in FLOORS)])})"
        new = materialise(new.join(model.selectExpr(*keys, f"{state} AS old"), keys).selectExpr("*", f"old = {state} AS same").drop("old"))
        last = step == rule.steps - 1
        settled.append(new if last else new.where("same"))
        model = new.where("not same").drop("same")
        if last or model.isEmpty():
            break
    found = settled[0]
    for part in settled[1:]:
        found = found.union(part)
    least = F.row_number().over(W.partitionBy("key").orderBy("half_log_det", "start"))
    found = materialise(found.withColumn("place", least).where("place = 1").drop("place", "same"))
    # the mean covariance, of whole numbers, so that it does not depend on the order of addition
    mean = found.agg(F.sum("n").alias("n"), *(F.expr(f"sum(CAST(round(n * c_{a}_{b}) AS decimal(38, 0))) AS c_{a}_{b}") for a, b in _pairs())).first()
    of_all = {(a, b): float(mean[f"c_{a}_{b}"]) / float(mean["n"]) if mean["n"] else 0.0 for a, b in _pairs()}
    weighed = found.selectExpr("key", "n", *(f"m_{a}" for a in FLOORS), *(f"(n * c_{a}_{b} + {rule.prior * of_all[a, b]!r}D) / (n + {rule.prior}) AS c_{a}_{b}" for a, b in _pairs()))
    return _factored(weighed, ["key"])


def score(counted: DataFrame, model: DataFrame, rule: OutlierRule = OutlierRule()) -> DataFrame:
    """Adds the vector, base_failed, distance (null for documents that fail the base rule) and kept to rows with lang, source and the counts."""
    model = materialise(model.select(F.col("key").alias("m_key"), *(f"m_{a}" for a in FLOORS), *(f"l_{a}_{b}" for a, b in _pairs())))
    ready = _settled(counted.withColumns(statistic_vector() | {"base_failed": base_failed(), "key": group_key()}))
    joined = _settled(_distance(ready.join(sized(model, rule.model_bytes, MODEL_ROW), F.col("key") == F.col("m_key"), "left"), "d2"))
    out = joined.withColumn("distance", F.when(~F.col("base_failed"), F.sqrt("d2")))
    far = F.coalesce(F.col("d2") > chi_square_quantile(1 - rule.cut, len(FLOORS)), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~far).select(*counted.columns, *FLOORS, "base_failed", "distance", "kept")


def quality_verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", rule: OutlierRule = OutlierRule()) -> DataFrame:
    """One row for each row of `df`: its id, the counts of `base_counts`, the vector, base_failed, distance and kept.

    Null texts have no words and fail the base rule. Null languages and sources are groups of their own. Rows repeat as they do in `df`.
    Other columns are not read. An empty table gives an empty result.
    """
    keep = [F.col(id_col), F.col(lang_col).cast("string"), F.col(source_col).cast("string")]
    counted = base_counts(df, keep, F.col(text_col)).withColumnsRenamed({"__kept_0": id_col, "__kept_1": "lang", "__kept_2": "source"})
    counted = materialise(counted)
    passing = counted.where(~base_failed()).select("lang", "source", *(c.alias(n) for n, c in statistic_vector().items()))
    return score(counted, estimates(passing, rule), rule)


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", rule: OutlierRule = OutlierRule()) -> DataFrame:
    """The rows of `df` that the rules keep, with its columns. Each text is counted once: the counts are written beside the row, the estimates
    read them alone, and the verdict is worked out where the row is. Nulls and repeated rows are as in `quality_verdicts`."""
    keep = [F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.col(lang_col).cast("string"), F.col(source_col).cast("string")]
    counted = base_counts(df, keep, F.col(text_col)).withColumnsRenamed({"__kept_0": "row", "__kept_1": "lang", "__kept_2": "source"})
    counted = written(counted, "counted")
    passing = counted.where(~base_failed()).select("lang", "source", *(c.alias(n) for n, c in statistic_vector().items()))
    return score(counted, estimates(passing, rule), rule).where("kept").select("row.*")
