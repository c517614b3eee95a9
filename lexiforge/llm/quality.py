"""Quality classifier: regularised quadratic discriminant analysis of transformed document statistics.

Each class is a Gaussian whose covariance is shrunk towards the pooled one and its diagonal. A score is
the logistic of the difference of the two log densities plus the log prior odds; the Mahalanobis terms
come from Cholesky factors computed once. Means and covariances are sums over all labelled rows, added
up on the executors; only those sums reach the driver.

Defined cases: a null or empty text has the statistics of zero words and is scored like any other;
repeated rows score alike; a null doc_id keeps its row and counts as held out; labels that are null,
repeated (the largest counts) or without a document are harmless; without labels of both classes every
score is the share of class 1 (1 if there are no labels at all, so that nothing is rejected).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexiforge.llm.common import cut, fold_bucket, table

THRESHOLD = 0.3
#: Shares of the pooled covariance and of its diagonal in each class's covariance, and a floor on variances.
TO_POOLED, TO_DIAGONAL, FLOOR = 0.05, 0.05, 1e-3
#: How far a standardised statistic may lie from the middle: keeps one odd value from deciding alone.
CLIP = 8.0
STATISTICS = ("words", "word_length", "variety", "top_word", "echo", "upper", "digits", "bangs", "bars", "junk", "stops", "line_words", "repeated_lines", "non_word")
_JUNK = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-|")
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))


def statistics(text: str | None) -> list[float]:
    """Numbers that tell prose from tables, shouting, symbol noise and repetition; all finite."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    count = Counter(words)
    top = max(count.values(), default=0)
    echo = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    upper, lower, digits = without(_UPPER), without(_LOWER), without(_DIGITS)
    bangs, bars, stops, junk = raw.count(b"!"), raw.count(b"|"), raw.count(b".") + raw.count(b","), without(_JUNK)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    spaces = without(b" \t\r\n\x0b\x0c")
    per = max(1, n)
    return [
        np.log1p(n), np.log1p((size - spaces) / per), np.log(max(1, len(count))) / np.log(max(2, n)), np.log1p(top) - 0.5 * np.log1p(n), np.log1p(100 * echo / per),
        np.sqrt(upper / max(1, upper + lower)), np.log1p(100 * digits / size), np.log1p(20 * bangs / per), np.log1p(20 * bars / per), np.log1p(20 * junk / per),
        np.log1p(10 * stops / per), np.log1p(n / max(1, len(lines))), (1 - len(set(lines)) / len(lines)) if lines else 0.0, np.log1p(100 * (size - upper - lower - digits - spaces - bangs - bars - stops - junk) / size),
    ]


def _rows(batches):
    """The last column is the text, which its statistics replace."""
    for batch in batches:
        found = [list(map(float, statistics(t))) for t in batch.columns[-1].to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "x"])


def measured(docs: DataFrame, **more: Column) -> DataFrame:
    """(doc_id, held_out, ..., x): x holds STATISTICS in order; columns of docs may be carried along by name."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (fold_bucket(F.col("doc_id")) == 0).alias("held_out"),
        *[c.alias(name) for name, c in more.items()], F.col("text").cast("string").alias("text"),
    )
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema[2:-1])
    return rows.mapInArrow(_rows, f"doc_id long, held_out boolean, {kinds}x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, lower Cholesky factor's inverse, log density at the mean plus log prior."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple
    factors: tuple
    levels: tuple

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -CLIP, CLIP)
        if not self.means:
            return np.full(len(x), self.levels[0])
        logs = [level - 0.5 * (((z - mean) @ factor.T) ** 2).sum(axis=1) for mean, factor, level in zip(self.means, self.factors, self.levels)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -60, 60)))


def _moments(batches):
    """Counts, sums and sums of products of (y, x) rows, per class; statistics stay as they are."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        y = np.array(batch.column(0).to_pylist(), np.int64)
        x = np.array(batch.column(1).to_pylist(), np.float64).reshape(len(y), -1)
        for k in set(y.tolist()):
            one = np.hstack([np.ones((int((y == k).sum()), 1)), x[y == k]])
            sums[k] = sums.get(k, 0) + one.T @ one
    flat = [(k, i, float(v)) for k, m in sums.items() for i, v in enumerate(m.ravel())]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat) if flat else ([], [], []), (pa.int32(), pa.int32(), pa.float64()))], ["y", "i", "v"])


def fit(rows: DataFrame) -> Discriminant:
    """From rows (y, x); each class's row of ones, sums and products is 15 by 15 numbers, whatever the input."""
    d = len(STATISTICS)
    found = rows.select(F.col("y").cast("int").alias("y"), "x").mapInArrow(_moments, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    sums = {k: np.zeros((d + 1, d + 1)) for k in (0, 1)}
    for r in found:
        sums[r["y"]].flat[r["i"]] = r["v"]
    return discriminant(sums)


def discriminant(sums: dict[int, np.ndarray]) -> Discriminant:
    d = len(STATISTICS)
    n = {k: s[0, 0] for k, s in sums.items()}
    if min(n.values()) < 2:
        share = n[1] / (n[0] + n[1]) if n[0] + n[1] else 1.0
        return Discriminant(np.zeros(d), np.ones(d), (), (), (share,))
    both = sums[0] + sums[1]
    centre = both[0, 1:] / both[0, 0]
    scale = np.sqrt(np.maximum(np.diag(both)[1:] / both[0, 0] - centre**2, FLOOR**2))
    means = {k: (s[0, 1:] / n[k] - centre) / scale for k, s in sums.items()}
    scatter = {}
    for k, s in sums.items():
        mean = s[0, 1:] / n[k]
        scatter[k] = (s[1:, 1:] - n[k] * np.outer(mean, mean)) / np.outer(scale, scale)
    pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
    factors, levels = [], []
    for k in (0, 1):
        own = scatter[k] / n[k]
        shrunk = (1 - TO_POOLED - TO_DIAGONAL) * own + TO_POOLED * pooled + TO_DIAGONAL * np.diag(np.diag(pooled)) + FLOOR * np.eye(d)
        low = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(low))
        levels.append(float(np.log(n[k] / (n[0] + n[1])) - np.log(np.diag(low)).sum()))
    return Discriminant(centre, scale, (means[0], means[1]), tuple(factors), tuple(levels))


def with_score(rows: DataFrame, model: Discriminant) -> DataFrame:
    """Measured rows with their score in place of x."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in rows.schema if f.name != "x"]

    def run(batches):
        for batch in batches:
            x = np.array(batch.columns[-1].to_pylist(), np.float64).reshape(batch.num_rows, -1)
            found = shared.value.scores(x) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], [*batch.schema.names[:-1], "score"])

    return rows.select(*[f.name for f in kept], "x").mapInArrow(run, "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept) + "score double")


def scores(rows: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, held_out, score, predicted) from measured rows."""
    return with_score(rows.select("doc_id", "held_out", "x"), model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def learned(rows: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Learned from the labelled ones of measured rows that are not held out."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("y"))
    return fit(rows.where("not held_out").select("doc_id", "x").join(known, "doc_id"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Every document scored."""
    rows = cut(measured(docs))
    return scores(rows, learned(rows, labels, label))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
