"""Pairwise comparison of documents: each is profiled once, then profiles are joined over a table of pairs.

pairs: (left_id, right_id). Pairs are dealt into cells by blocks of both ids, and a document's long profile (its lemmas,
tags or bigrams) is sent once to each cell that has a pair of it, not once for each pair; what two documents
share is found there. Pairs of near ids lie in few cells; at worst a profile is sent once for each pair.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexiforge.functions import constants as C
from lexiforge.functions.text import ratio, similarity_label
from lexiforge.operators.metrics import sentence_stats, tag_bigrams, tag_shares
from lexiforge.operators.tokens import only_words

# Weights of the parts in the overall similarity.
WEIGHTS = {"jaccard": 0.30, "pos_similarity": 0.20, "syntactic_similarity": 0.15, "ttr_similarity": 0.15, "bigram_similarity": 0.20}


def nearby_pairs(docs: DataFrame, within: str = "source", window: int = 40, id_: str = "doc_id") -> DataFrame:
    """(left_id, right_id) inside a group whose ids differ by at most the window.

    Ids are dealt into buckets of that width and each row meets its own and the next bucket only, so the
    number of candidates grows with the rows and not with the square of a group.
    """
    a = docs.select(within, F.col(id_).alias("left_id"), F.explode(F.array(F.floor(F.col(id_) / window), F.floor(F.col(id_) / window) + 1)).alias("slot"))
    b = docs.select(within, F.col(id_).alias("right_id"), F.floor(F.col(id_) / window).alias("slot"))
    return a.join(b, [within, "slot"]).where((F.col("right_id") > F.col("left_id")) & (F.col("right_id") - F.col("left_id") <= window)).select("left_id", "right_id")


def _both(pairs: DataFrame, profile: DataFrame, columns: list[str]) -> DataFrame:
    """pairs with a profile's columns of both sides, suffixed 1 and 2."""
    out = pairs
    for side, k in (("left_id", "1"), ("right_id", "2")):
        out = out.join(profile.select(F.col("doc_id").alias(side), *[F.col(c).alias(c + k) for c in columns]), side, "left")
    return out


#: Ids of a block; a cell holds the profiles of two blocks at most.
BLOCK = 512


def _in_cells(pairs: DataFrame, long: DataFrame, key: str, value: str, found: Callable, name: str, kind: str) -> DataFrame:
    """(left_id, right_id, name) for distinct pairs that share a key: found(keys in order, numbers of the shared ones, both values).

    long: (doc_id, key, value), a row for each key of a document.
    """
    ids = dict(pairs.dtypes)
    block = lambda c: F.floor(F.col(c) / BLOCK) if ids[c] in ("tinyint", "smallint", "int", "bigint") else F.pmod(F.xxhash64(c), F.lit(BLOCK))
    own = pairs.where("left_id is not null and right_id is not null").select("left_id", "right_id", F.concat_ws(" ", block("left_id"), block("right_id")).alias("cell")).distinct()
    needed = own.select(F.col("cell").alias("of"), F.explode(F.array("left_id", "right_id")).alias("doc_id")).distinct()
    held = needed.join(long.where(F.col(key).isNotNull()).select("doc_id", F.col(key).alias("key"), F.col(value).alias("value")), "doc_id")

    def run(two: pa.Table, profiles: pa.Table) -> pa.Table:
        words = profiles["key"].combine_chunks().dictionary_encode()
        order = np.argsort(np.array(words.dictionary.to_pylist(), object), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        keys, values = rank[words.indices.to_numpy()], profiles["value"].to_numpy()
        docs = profiles["doc_id"].combine_chunks().dictionary_encode()
        by = np.argsort(docs.indices.to_numpy(), kind="stable")
        keys, values = keys[by], values[by]
        ends = np.cumsum(np.bincount(docs.indices.to_numpy(), minlength=len(docs.dictionary)))
        at = {d: slice(e - n, e) for d, e, n in zip(docs.dictionary.to_pylist(), ends, np.diff(ends, prepend=0))}
        names = [words.dictionary[int(i)].as_py() for i in order] if len(order) else []
        place, last, out = np.full(len(order), -1), None, []
        for left, right in sorted(zip(two["left_id"].to_pylist(), two["right_id"].to_pylist())):
            if left not in at or right not in at:
                continue
            if left != last:
                place[:] = -1
                place[keys[at[left]]] = np.arange(at[left].start, at[left].stop)
                last = left
            here = place[keys[at[right]]]
            shared = here >= 0
            if shared.any():
                out.append((left, right, found(names, keys[at[right]][shared], values[here[shared]], values[at[right]][shared])))
        kinds = (two.schema.field("left_id").type, two.schema.field("right_id").type, {"long": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}[kind])
        return pa.table([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], ["left_id", "right_id", name])

    return own.groupBy("cell").cogroup(held.groupBy("of")).applyInArrow(run, f"left_id {ids['left_id']}, right_id {ids['right_id']}, {name} {kind}")


def lemma_parts(pairs: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(left_id, right_id, n_common, n_union, jaccard, ttr_similarity) of lemma sets; lemmas: (doc_id, lemma, n), which are counted once for all."""
    size = lemmas.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lemmas"), ratio(F.count(F.lit(1)), F.sum("n")).alias("lemma_ttr"))
    common = _in_cells(pairs, lemmas, "lemma", "n", lambda _, keys, x, y: len(keys), "n_common", "long")
    out = _both(pairs, size, ["n_lemmas", "lemma_ttr"]).join(common, ["left_id", "right_id"], "left").na.fill(0, ["n_common", "n_lemmas1", "n_lemmas2"]).na.fill(0.0, ["lemma_ttr1", "lemma_ttr2"])
    out = out.withColumn("n_union", F.col("n_lemmas1") + F.col("n_lemmas2") - F.col("n_common"))
    return out.select("left_id", "right_id", "n_common", "n_union", F.coalesce(ratio(F.col("n_common"), F.col("n_union")), F.lit(0.0)).alias("jaccard"), closeness(F.col("lemma_ttr1"), F.col("lemma_ttr2"), 0.01).alias("ttr_similarity"))


def jaccard(pairs: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(left_id, right_id, n_common, n_union, jaccard) of lemma sets; lemmas: (doc_id, lemma, n)."""
    return lemma_parts(pairs, lemmas).drop("ttr_similarity")


def tag_similarity(pairs: DataFrame, shares: DataFrame) -> DataFrame:
    """1 - half the sum of |p - q| over all tags. As both sum to 1 (or are empty), that follows from the sum of min(p, q)."""
    sums = shares.groupBy("doc_id").agg(F.sum("share").alias("s"))
    least = _in_cells(pairs, shares, "tag", "share", lambda _, keys, x, y: float(np.minimum(x, y).sum()), "least", "double")
    out = _both(pairs, sums, ["s"]).join(least, ["left_id", "right_id"], "left").na.fill(0.0, ["s1", "s2", "least"])
    return out.select("left_id", "right_id", F.greatest(F.lit(0.0), 1 - (F.col("s1") + F.col("s2") - 2 * F.col("least")) / 2).alias("pos_similarity"))


def closeness(x: Column, y: Column, floor: float) -> Column:
    """1 - |x - y| / max(x, y, floor), at least 0."""
    return F.greatest(F.lit(0.0), 1 - F.abs(x - y) / F.greatest(x, y, F.lit(floor)))


def syntax_similarity(pairs: DataFrame, sentences: DataFrame) -> DataFrame:
    out = _both(pairs, sentences, ["mean_len"]).na.fill(0.0, ["mean_len1", "mean_len2"])
    return out.select("left_id", "right_id", closeness(F.col("mean_len1"), F.col("mean_len2"), 1.0).alias("syntactic_similarity"))


def ttr_similarity(pairs: DataFrame, diversity: DataFrame) -> DataFrame:
    out = _both(pairs, diversity, ["lemma_ttr"]).na.fill(0.0, ["lemma_ttr1", "lemma_ttr2"])
    return out.select("left_id", "right_id", closeness(F.col("lemma_ttr1"), F.col("lemma_ttr2"), 0.01).alias("ttr_similarity"))


def bigram_similarity(pairs: DataFrame, bigrams: DataFrame, rounded: bool = True) -> DataFrame:
    """Cosine of tag bigram frequencies, which are rounded to 5 places first unless told otherwise; an empty side gives 0."""
    freq = F.round("freq", 5) if rounded else F.col("freq")
    long = bigrams.select("doc_id", F.concat_ws(" ", "p1", "p2").alias("pair"), freq.alias("freq"))
    norms = long.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("freq") * F.col("freq"))).alias("norm"))
    dot = _in_cells(pairs, long, "pair", "freq", lambda _, keys, x, y: float(x @ y), "dot", "double")
    out = _both(pairs, norms, ["norm"]).join(dot, ["left_id", "right_id"], "left")
    return out.select("left_id", "right_id", F.coalesce(F.col("dot") / (F.col("norm1") * F.col("norm2")), F.lit(0.0)).alias("bigram_similarity"))


def common_lemmas(pairs: DataFrame, lemmas: DataFrame, k: int = 30, service: tuple[str, ...] = C.SERVICE) -> DataFrame:
    """(left_id, right_id, common): up to k shared lemmas but service words, by joint count, then by name."""
    own = lemmas.where(~F.col("lemma").isin(*service))

    def first(names, keys, x, y):
        return [names[i] for i in keys[np.lexsort((keys, -(x + y)))[:k]]]

    return _in_cells(pairs, own, "lemma", "n", first, "common", "array<string>")


def lemma_counts(tokens: DataFrame) -> DataFrame:
    return only_words(tokens).groupBy("doc_id", F.lower("lemma").alias("lemma")).agg(F.count(F.lit(1)).alias("n"))


def compare(pairs: DataFrame, tokens: DataFrame, docs: DataFrame, rounded: bool = True) -> DataFrame:
    """All parts, the overall similarity of the unrounded parts, and its label."""
    on = ["left_id", "right_id"]
    out = lemma_parts(pairs, lemma_counts(tokens)).drop("n_common", "n_union")
    for part in (tag_similarity(pairs, tag_shares(tokens)), syntax_similarity(pairs, sentence_stats(docs)), bigram_similarity(pairs, tag_bigrams(tokens), rounded)):
        out = out.join(part, on)
    out = out.withColumn("overall", sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)))
    return out.withColumn("verdict", similarity_label(F.col("overall")))


def vector_similarity(pairs: DataFrame, means: DataFrame) -> DataFrame:
    """Cosine of documents' mean vectors, cut to [0, 1]; means: (doc_id, vec)."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = _both(pairs, means, ["vec"])
    cosine = dot(F.col("vec1"), F.col("vec2")) / F.nullif(F.sqrt(dot(F.col("vec1"), F.col("vec1")) * dot(F.col("vec2"), F.col("vec2"))), F.lit(0.0))
    return both.select("left_id", "right_id", F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine)), F.lit(0.0)).alias("vector_similarity"))
