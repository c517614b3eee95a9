"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, a Hamming check, components.

Defined cases: a null or empty text, or one of white space alone, has fingerprint zero and links like
any other; a text of one or two words has that whole sequence as its only shingle. Rows repeat as they
come. A null doc_id keeps its row; the smallest non-null id of the component names it (null if none).
Other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiforge.llm.common import connected_components, cut, fresh, table

SEED = 42
SHINGLE = 3
DISTANCE = 2
BLOCKS = 4
#: Buckets of at most so many fingerprints are joined pair by pair; larger ones go by midpoints.
PAIRWISE = 48
_CHUNK = 1 << 14


def fingerprint(raw: bytes | None) -> int:
    """The 64-bit SimHash of a text's UTF-8 bytes: lower-cased A-Z, 3-word shingles with repeats, XXH64."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    n = len(words)
    buf = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if n < SHINGLE:
        return h(buf, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count, total = np.zeros(64, np.int64), n - SHINGLE + 1
    for at in range(0, total, _CHUNK):
        to = min(at + _CHUNK, total)
        hashes = np.fromiter((h(buf[a:b], SEED) for a, b in zip(starts[at:to].tolist(), ends[at + SHINGLE - 1 : to + SHINGLE - 1].tolist())), np.uint64, to - at)
        count += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > total, bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(batches):
    for batch in batches:
        raw = batch.column(1).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_signed(fingerprint(x)) for x in raw], pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of documents (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _masks(blocks: int, distance: int) -> list[int]:
    """Any two fingerprints at the distance or nearer agree on all bits of at least one mask."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [_signed(sum(block[i] for i in kept)) for kept in combinations(range(blocks), blocks - distance)]


def links(fps: DataFrame, blocks: int = BLOCKS, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints fp at Hamming distance 1 or 2.

    With 4 blocks, two fingerprints that differ in 2 bits share at least 2 whole blocks, so each of the
    6 block pairs is a join key. Buckets of up to `pairwise` fingerprints are joined with themselves
    and verified. A larger bucket would have quadratically many pairs; there, each fingerprint names
    itself and its 64 neighbours at distance 1 as midpoints. Two fingerprints are within distance 2 if
    and only if they share a midpoint, and a midpoint has at most 65 fingerprints, so this is exact,
    linear and free of hot keys; a star through each midpoint stands for its pairs.
    """
    keys = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks(blocks, DISTANCE))])).alias("k")).select("fp", "k.t", "k.key")
    sizes = cut(keys.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = cut(keys.join(sizes, ["t", "key"]))
    small = shared.where(F.col("n") <= pairwise)
    a, b = small.select("t", "key", F.col("fp").alias("a")), small.select("t", "key", F.col("fp").alias("b"))
    near = a.join(b, ["t", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")
    hot = shared.where(F.col("n") > pairwise).select("fp").distinct()
    middles = hot.select("fp", F.explode(F.concat(F.array("fp"), F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)]))).alias("mid"))
    stars = middles.groupBy("mid").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = stars.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")
    return near.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document."""
    marked = cut(fingerprints(docs))
    first = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = cut(connected_components(links(first.select("fp"))))
    least = first.join(roots, first.fp == roots.node).groupBy("root").agg(F.min("first").alias("least"))
    least = roots.join(cut(least), "root").select(F.col("node").alias("fp"), "least")
    named = cut(first.join(least, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest doc_id, then the smallest hash of its text.

    Rows with an id come before those without; an id that stands on several rows is no reason to keep or
    drop any of them.
    """
    text = fresh(docs, "text")
    rows = docs.withColumn(text, F.xxhash64(F.col("text").cast("string")))
    # A fingerprint follows from the text, so the text's hash takes the place of the id.
    marked = cut(fingerprints(rows.select(F.col(text).alias("doc_id"), "text")).distinct().select(F.col("doc_id").alias(text), "fp"))
    roots = cut(connected_components(links(marked.select("fp").distinct())))
    named = marked.join(roots, marked.fp == roots.node, "left").select(text, F.coalesce("root", "fp").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.col(text).alias("hash"))
    first = cut(rows.select("doc_id", text).join(named, text).groupBy("root").agg(F.min(order).alias("first")).select("first.id", "first.hash"))
    kept = rows.join(first, (rows[text] == first["hash"]) & rows["doc_id"].cast("long").eqNullSafe(first["id"]), "left_semi")
    return kept.dropDuplicates(["doc_id", text]).select(docs.columns)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
