"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of its own vector and those of its character n-grams, a document the mean of its words, and a softmax
over two classes follows; n-gram vectors and softmax are trained together. An unseen misspelling shares
most n-grams with the word it stands for. As all of this is linear up to the softmax, an n-gram's weight
can be folded into one number for scoring, and a document's score needs no matrices.

Labels are learned from a bounded, documented sample: PER_CLASS rows of class 0 and 1 and at
most SAMPLE_CHARS characters of each, taken by a hash of the id. Only n-grams whose documents tell the classes
apart (by the G test) have vectors, so a language with few labelled texts isn't lost among the n-grams of others.

Defined cases: a null or empty text, or one without words, gets the score of the bias alone, which is
below the threshold; repeated rows score alike; a null doc_id keeps its row and counts as held out;
labels that are null, repeated (the largest counts) or without a document are harmless; equal labelled rows are learned once; without labels
of both classes every score is the share of class 1 in the sample (0 if there are none).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiforge.llm.common import fold_bucket, table

PER_CLASS = (5000, 2000)
SAMPLE_CHARS = 14_000_000
BUCKETS = 1 << 20
DIM = 8
SIZES = (3, 4, 5, 6, 7)
EPOCHS = 20
#: A small sample is gone through more often, for so many steps at least.
LEAST_STEPS = 240
#: How far each step draws an n-gram's whole vector to zero, against the rate: only those that keep earning it stay.
DECAY = 0.1
#: N-grams in fewer documents of the sample have no vector.
LEAST_DOCS = 4
#: And those with a lower G statistic (this one comes up by chance once in a thousand) have none.
LEAST_G = 10.83
BATCH = 128
THRESHOLD = 0.5
#: Words whose scores an executor's worker remembers; when full, it starts anew.
REMEMBERED = 200_000
_TABLE = {i: " " for i in range(128) if not (48 <= i <= 57 or 97 <= i <= 122)}


def words(text: str | None) -> list[str]:
    return text.lower().translate(_TABLE).split() if text else []


def ngrams(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every character n-gram of every word, with marks at both ends, and of the word itself."""
    lengths = np.fromiter(map(len, some), np.int64, len(some)) + 2
    chars = np.frombuffer(("<" + "><".join(some) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(some), dtype=np.int32), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))
    rows, grams = [], []
    for n in SIZES:
        if len(chars) < n:
            continue
        h = np.full(len(chars) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h ^ chars[i : len(chars) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        whole = left[: len(h)] >= n
        rows.append(owner[: len(h)][whole])
        grams.append((h[whole] >> np.uint64(20)).astype(np.int64) % BUCKETS)
    rows.append(np.arange(len(some), dtype=np.int32))
    grams.append(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in some), np.int64, len(some)) % BUCKETS)
    return np.concatenate(rows), np.concatenate(grams)


def word_means(some: list[str], weight: np.ndarray) -> np.ndarray:
    """The mean of a scalar n-gram weight over each word's n-grams."""
    if not some:
        return np.zeros(0)
    rows, grams = ngrams(some)
    return np.bincount(rows, weight[grams], len(some)) / np.bincount(rows, minlength=len(some))


@dataclass(frozen=True)
class Model:
    """weight: log-odds of class 1 that each n-gram bucket adds; bias: log-odds of an empty document."""

    weight: np.ndarray
    bias: float


class _Batch:
    """Documents as counts of words, and the n-grams of those words; of the latter, only those numbered 0 or more in `number`."""

    def __init__(self, texts: list[str | None], labels: np.ndarray, number: np.ndarray | None = None):
        seen: dict[str, int] = {}
        ids, sizes = [], []
        for t in texts:
            own = words(t)
            sizes.append(len(own))
            ids.append(np.fromiter((seen.setdefault(w, len(seen)) for w in own), np.int32, len(own)))
        self.labels, self.n_words, self.n_docs = labels, len(seen), len(texts)
        doc = np.repeat(np.arange(len(texts)), sizes)
        pair, count = np.unique(doc * max(1, len(seen)) + np.concatenate(ids), return_counts=True)
        self.doc, self.word = (pair // max(1, len(seen))).astype(np.int32), (pair % max(1, len(seen))).astype(np.int32)
        self.share = (count / np.maximum(1, np.array(sizes))[self.doc]).astype(np.float32)
        rows, grams = ngrams(list(seen)) if seen else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        self.per_word = np.maximum(1, np.bincount(rows, minlength=len(seen))).astype(np.float32)
        if number is not None:
            grams = number[grams]
            rows, grams = rows[grams >= 0], grams[grams >= 0]
        order = np.argsort(rows, kind="stable")
        self.owner, self.grams = rows[order].astype(np.int32), grams[order].astype(np.int32)

    def count_docs(self, often: np.ndarray) -> None:
        """Add to often[class, bucket] in how many documents each bucket occurs."""
        starts = np.searchsorted(self.owner, np.arange(self.n_words + 1))
        ends = np.searchsorted(self.doc, np.arange(self.n_docs + 1))
        for d in range(self.n_docs):
            own = self.word[ends[d] : ends[d + 1]]
            size = starts[own + 1] - starts[own]
            at = np.repeat(starts[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            often[self.labels[d], np.unique(self.grams[at])] += 1


def g_statistic(often: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The G statistic of each column of often (class, n-gram), the documents of a class that hold it, against the class sizes."""

    def log_likelihood(k, n, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    both = often.sum(axis=0) / size.sum()
    return 2 * sum(log_likelihood(often[c], size[c], often[c] / size[c]) - log_likelihood(often[c], size[c], both) for c in (0, 1))


def fit(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, seed: int = 7, decay: float = DECAY, least_docs: int = LEAST_DOCS) -> Model:
    """Minibatch Adam on the cross entropy of both layers at once; each class weighs the same."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        p = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    parts = [order[a : a + BATCH] for a in range(0, len(y), BATCH)]
    of = lambda part, number=None: _Batch([texts[i] for i in part], y[part], number)
    often, size = np.zeros((2, BUCKETS)), np.bincount(y, minlength=2)
    for part in parts:
        of(part).count_docs(often)
    kept = np.flatnonzero((often.sum(axis=0) >= least_docs) & (g_statistic(often, size) >= LEAST_G))
    number = np.full(BUCKETS, -1, np.int32)
    number[kept] = np.arange(len(kept))
    batches = [of(part, number) for part in parts]
    per_class = len(y) / (2 * size)
    params = [rng.normal(0, 0.01, (len(kept), DIM)).astype(np.float32), rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)]
    table, soft, bias = params
    epochs = max(epochs, -(-LEAST_STEPS // len(batches)))
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = 0.3 * (1 - epoch / epochs) + 0.01
        for k in rng.permutation(len(batches)):
            b = batches[k]
            flat = table[b.grams]
            vectors = np.stack([np.bincount(b.owner, flat[:, d], b.n_words) for d in range(DIM)], axis=1) / b.per_word[:, None]
            flat = vectors[b.word] * b.share[:, None]
            docs = np.stack([np.bincount(b.doc, flat[:, d], b.n_docs) for d in range(DIM)], axis=1).astype(np.float32)
            logits = docs @ soft + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(b.n_docs), b.labels] -= 1
            d_logits = (p * per_class[b.labels][:, None] / b.n_docs).astype(np.float32)
            grads = [np.zeros_like(table), docs.T @ d_logits + 1e-4 * soft, d_logits.sum(axis=0)]
            d_flat = (d_logits @ soft.T)[b.doc] * b.share[:, None]
            for d in range(DIM):
                d_word = np.bincount(b.word, d_flat[:, d], b.n_words) / b.per_word
                grads[0][:, d] = np.bincount(b.grams, d_word[b.owner], len(kept))
            step += 1
            for i, (q, g) in enumerate(zip(params, grads)):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                q -= rate * (0.1 if i == 0 else 0.3) * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
                if i == 0:
                    norm = np.sqrt(np.einsum("ij,ij->i", q, q))
                    q *= np.maximum(0, 1 - 0.1 * rate * decay / np.maximum(norm, 1e-9))[:, None]
    odds, weight = soft[:, 1] - soft[:, 0], np.zeros(BUCKETS)
    weight[kept] = table @ odds
    return Model(weight, float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int] = PER_CLASS, chars: int = SAMPLE_CHARS) -> tuple[list[str | None], list[int]]:
    """Texts and labels for learning; both bounds hold for each class."""
    known = labels.where(F.col(label).isin(0, 1) & (fold_bucket(F.col("doc_id")) != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    turn = [F.xxhash64("doc_id", F.lit(11)), F.col("doc_id"), F.col("row")]
    few = [known.where(F.col("y") == y).orderBy(*turn[:2]).limit(per_class[y]) for y in (0, 1)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("text"))
    own = rows.join(F.broadcast(few[0].unionByName(few[1])), "doc_id").groupBy("doc_id", "row", "y").agg(F.max(F.coalesce(F.char_length("text"), F.lit(0))).alias("size"))
    taken = []
    for y in (0, 1):
        so_far = 0
        for r in own.where(F.col("y") == y).orderBy(*turn).limit(per_class[y]).collect():
            if so_far + r["size"] <= chars:
                so_far += r["size"]
                taken.append((r["doc_id"], r["row"], y))
    # Of the rows named, which are few and no longer than the bounds, come the texts.
    named = docs.sparkSession.createDataFrame(taken, "doc_id long, row long, y int")
    got = rows.join(F.broadcast(named), ["doc_id", "row"]).dropDuplicates(["doc_id", "row"]).select("doc_id", "row", "y", "text").toArrow().sort_by([("y", "ascending"), ("doc_id", "ascending"), ("row", "ascending")])
    return got["text"].to_pylist(), got["y"].to_pylist()


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    return fit(*sample(docs, labels, label))


def scorer(model: Model):
    """A function from texts to scores, which remembers the words it has seen."""
    known: dict[str, float] = {}

    def score(texts: list[str | None]) -> list[float]:
        out = []
        for t in texts:
            own = words(t)
            new = [w for w in set(own) if w not in known]
            if new:
                if len(known) > REMEMBERED:
                    known.clear()
                    new = list(set(own))
                known.update(zip(new, word_means(new, model.weight).tolist()))
            odds = model.bias + (sum(map(known.__getitem__, own)) / len(own) if own else 0.0)
            out.append(1 / (1 + np.exp(-min(max(odds, -60.0), 60.0))))
        return out

    return score


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = scorer(shared.value)
        for batch in batches:
            found = score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_bucket(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the model rejects; each row is judged where it stands, nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        score = scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([x < THRESHOLD for x in score(batch.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, train(docs, table(spark, sf_dir, "labels")))
