"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade > k) = 1 / (1 + exp(threshold_k - score)): one score, a weighted sum of hashed features, is shared by the ordered
thresholds. Features are screened first, so few are left that count; weights have an L2 penalty.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Training:
    """rows_per_grade: the bound of the labelled sample that is fitted, for each grade. dims: hash buckets. min_rows,
    min_z: only features in so many rows, whose share of rows differs between the first grade and the others by so many standard errors, are fitted."""

    rows_per_grade: int = 4000
    dims: int = 1 << 18
    prefixes: tuple[int, ...] = (4, 5)
    min_rows: int = 3
    min_z: float = 4.0
    penalty: float = 1e-4
    steps: int = 500
    rate: float = 0.05


def word_features(word: str, plan: Training) -> list[int]:
    """Hash buckets of a word and of its beginnings."""
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % plan.dims for x in ("w" + word, *(f"{n}{word[:n]}" for n in plan.prefixes if len(word) >= n))]


def distinct_words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray


def screen(flat: np.ndarray, row: np.ndarray, grade: np.ndarray, plan: Training) -> tuple[np.ndarray, np.ndarray]:
    """Leaves the features that tell the first grade from the others."""
    here = np.unique(row * plan.dims + flat)
    bucket, high = here % plan.dims, grade[here // plan.dims] > 0
    of_high, of_low = np.bincount(bucket[high], minlength=plan.dims), np.bincount(bucket[~high], minlength=plan.dims)
    n_high, n_low = max((grade > 0).sum(), 1), max((grade == 0).sum(), 1)
    p = (of_high + of_low) / (n_high + n_low)
    z = (of_high / n_high - of_low / n_low) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n_high + 1 / n_low))
    kept = ((of_high + of_low >= plan.min_rows) & (np.abs(z) >= plan.min_z))[flat]
    return flat[kept], row[kept]


def fit(indices: list[np.ndarray], grade: np.ndarray, grades: int, plan: Training) -> Model:
    """Maximum likelihood of the cumulative logit model. indices: feature buckets of each row, repeats counted."""
    sizes = np.array([len(x) for x in indices])
    flat = np.concatenate(indices).astype(np.int64) if len(indices) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(indices)), sizes)
    n = max(len(indices), 1)
    flat, row = screen(flat, row, grade, plan)
    share = np.array([(grade > k).mean() if len(grade) else 0.0 for k in range(grades - 1)])
    theta = -np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
    theta = np.maximum.accumulate(theta + 1e-3 * np.arange(grades - 1))
    w, seen, seen_theta = np.zeros(plan.dims), np.full(plan.dims, 1e-8), np.full(grades - 1, 1e-8)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    balance = np.bincount(grade, minlength=grades).astype(float) if len(grade) else np.ones(grades)
    cost = (n / (np.maximum(balance, 1) * max((balance > 0).sum(), 1)))[grade] if len(grade) else np.zeros(0)
    for _ in range(plan.steps if len(np.unique(grade)) > 1 else 0):
        score = np.bincount(row, w[flat], n)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        upper, lower = sigmoid(edges[grade + 1] - score), sigmoid(edges[grade] - score)
        upper[grade == grades - 1], lower[grade == 0] = 1.0, 0.0
        p = np.maximum(upper - lower, 1e-12)
        down = -(upper + lower - 1) * cost / n  # slope of the loss along the score
        slope = np.bincount(flat, down[row], plan.dims)
        of_theta = np.zeros(grades - 1)
        for k in range(grades - 1):
            up, low = grade == k, grade == k + 1
            of_theta[k] = -(upper[up] * (1 - upper[up]) / p[up] * cost[up]).sum() / n + (lower[low] * (1 - lower[low]) / p[low] * cost[low]).sum() / n
        seen += slope * slope
        seen_theta += of_theta * of_theta
        step = plan.rate / np.sqrt(seen)
        w = w - step * slope
        w = np.sign(w) * np.maximum(np.abs(w) - step * plan.penalty, 0)
        theta = np.maximum.accumulate(theta - plan.rate / np.sqrt(seen_theta) * of_theta)
    return Model(w.astype(np.float32), theta)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", grades: int = 3, plan: Training = Training()) -> Model:
    """Fits labelled rows of `docs`. Of each grade about `rows_per_grade` labels are taken, by a hash of their id, so the sample, the one broadcast and the
    one task that fits are bounded. Texts are turned to features before they are dealt, one row for each labelled id. Null ids, grades and grades out of range
    are left out; an id with several grades has the highest; of several texts with a labelled id that with the least hash counts. Without labels
    the model knows the first grade only."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(grade_col).between(0, grades - 1)).select(F.col(id_col).alias("l_id"), F.col(grade_col).cast("int").alias("grade"))
    usable = usable.groupBy("l_id").agg(F.max("grade").alias("grade"))
    counts = {r["grade"]: r["count"] for r in usable.groupBy("grade").count().collect()}
    draw = F.pmod(F.xxhash64("l_id", F.lit("sample")), F.lit(1 << 30))
    chosen = F.lit(False)
    for g, n in counts.items():
        chosen = chosen | ((F.col("grade") == g) & (draw < int((1 << 30) * min(1.0, plan.rows_per_grade / n))))
    sample = usable.where(chosen)

    @F.pandas_udf("array<int>")
    def featured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sorted(i for w in distinct_words(t) for i in word_features(w, plan)) for t in texts])

    met = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("d_id") == F.col("l_id"))
    # a row for each id, chosen before it is dealt, so repeats of a document do not meet in one task
    rows = met.select("l_id", "grade", F.xxhash64("text").alias("mark"), featured(F.col("text")).alias("features"))
    rows = rows.groupBy("l_id").agg(F.min_by(F.struct("grade", "features"), F.struct("mark", F.size("features"))).alias("r")).select(F.lit(0).alias("one"), "l_id", "r.*")

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("l_id", ignore_index=True)
        buckets = [np.asarray(x, np.int32) for x in rows["features"]]
        model = fit(buckets, rows["grade"].to_numpy(np.int64), grades, plan)
        return pd.DataFrame({"weights": [model.weights.tobytes()], "thresholds": [model.thresholds.tobytes()]})

    fitted = rows.groupBy("one").applyInPandas(learn, "weights binary, thresholds binary").collect()
    if not fitted:
        return Model(np.zeros(plan.dims, np.float32), np.full(grades - 1, 40.0))
    return Model(np.frombuffer(fitted[0]["weights"], np.float32), np.frombuffer(fitted[0]["thresholds"], np.float64))


def severity(text: Column, model: Model, plan: Training = Training()) -> Column:
    """A struct of expected_severity, severity (the likeliest grade) and p_toxic, the probability of a grade above the first. Null and wordless texts have score 0."""
    used = {int(i): float(model.weights[i]) for i in np.flatnonzero(model.weights)}
    theta = model.thresholds.tolist()

    @F.pandas_udf("expected_severity double, severity int, p_toxic double")
    def graded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, float] = {}
        for texts in batches:
            scores = np.zeros(len(texts))
            for i, text in enumerate(texts):
                total = 0.0
                for word in sorted(distinct_words(text)):
                    value = known.get(word)
                    if value is None:
                        if len(known) > 1 << 18:
                            known.clear()
                        value = known[word] = sum(used.get(k, 0.0) for k in word_features(word, plan))
                    total += value
                scores[i] = total
            above = 1 / (1 + np.exp(np.clip(np.array(theta)[None, :] - scores[:, None], -40, 40)))
            each = -np.diff(np.concatenate([np.ones((len(texts), 1)), above, np.zeros((len(texts), 1))], axis=1), axis=1)
            yield pd.DataFrame({"expected_severity": above.sum(axis=1), "severity": each.argmax(axis=1).astype(np.int32), "p_toxic": above[:, 0]})

    return graded(text)


def grade_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", grades: int = 3, plan: Training = Training(), cut: float = 0.5) -> DataFrame:
    """One row for each row of `docs`: id, expected_severity, severity, p_toxic and toxic (p_toxic of `cut` or more). Repeated rows repeat; other columns are not read."""
    model = train(docs, labels, id_col, text_col, grade_col, grades, plan)
    scored = docs.select(F.col(id_col), severity(F.col(text_col), model, plan).alias("s")).select(id_col, "s.*")
    return scored.withColumn("toxic", F.col("p_toxic") >= cut)
