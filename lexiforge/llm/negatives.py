"""Hard negatives: per anchor, all rows sorted by integer score and id, and what lies between two limits read off.

Components become integers, so scores are exact. Rows are dealt into tiles and anchors into blocks; a
task holds one of each. It computes the block's scores, sorts every anchor's rows of the tile by score
and id (lexsort), and reads in that order: first each anchor's best rows of the same label, which are
merged over the tiles and give the positives; then, with the positives known, it finds by binary search
where rows at or below the positive's score begin, and from there takes the first rows of other labels
down to the lower limit. Each tile gives as many as are wanted in all, so merging them loses none, and
no task ever holds more than a tile.

Defined cases: rows with a null label, a null vector or any null or non-finite component take no part,
nor do rows whose squared length exceeds 2^62, since scores would not fit a long; only vectors with as
many components as the anchor are compared, and empty ones score 0; a row with a null vec_id is no
anchor and comes after equal scores; repeated rows are rows of their own, so a copy of an anchor is one
of its positives, and a repeated anchor returns its rows as often; ties in score and vec_id return the
same values whichever is taken; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexiforge.llm.common import cut, table

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
TILE = 8192
BLOCK = 2048
#: Anchors whose scores of a tile are sorted at a time.
STRIP = 128
#: Squared lengths above this would let a score exceed a long.
MOST = 2.0**62


def cells(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as a long; null where one is null, not finite, or all are too large together."""
    x = F.transform(vector, lambda v: v.cast("double") * F.lit(float(scale)))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))
    fits = F.aggregate(x, F.lit(0.0), lambda s, v: s + (F.abs(v) + 1) * (F.abs(v) + 1)) < MOST
    return F.when(sound & fits, F.transform(x, lambda v: F.floor(v)))


def scored_rows(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(node, vec_id, label, cells) of the rows that take part, with the labels that hold here."""
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    relabelled = F.when(F.coalesce(vec_id % 7 == 0, F.lit(False)), (label + 1) % 10).otherwise(label)
    rows = vectors.select(vec_id.alias("vec_id"), relabelled.alias("label"), cells(F.col("embedding"), scale).alias("cells"))
    return rows.where("label is not null and cells is not null").withColumn("node", F.monotonically_increasing_id())


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of a and b: in floats where their numbers stay exact, else in longs."""
    norm = lambda x: math.sqrt(float((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
    bound = norm(a) * norm(b) * (1 + 1e-9)
    for kind, exact in ((np.float32, 2**24), (np.float64, 2**53)):
        if bound < exact:
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    return a @ b.T


_PACKED = "dim int, no int, nodes binary, ids binary, unnamed binary, labels binary, cells binary"


def _pack(key, part):
    """The rows of a tile or block as one row of bytes, in the order of their ids, those without one last."""
    ids = part["vec_id"].combine_chunks()
    unnamed = ids.is_null().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy()
    order = np.lexsort((ids, unnamed))
    x = part["cells"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    of = lambda v: v[order].tobytes()
    values = [of(part["node"].to_numpy()), of(ids), of(unnamed), of(part["label"].to_numpy()), of(x.astype(np.int32) if not x.size or np.abs(x).max() < 2**31 else x)]
    return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([v], pa.binary()) for v in values], names=[c.split()[0] for c in _PACKED.split(", ")])


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (node, vec_id, label, cells) dealt by node into parts of about the given size."""
    count = max(1, -(-rows.count() // size))
    dealt = rows.select(F.size("cells").alias("dim"), F.pmod(F.xxhash64("node"), F.lit(count).cast("long")).cast("int").alias("no"), "node", "vec_id", "label", "cells")
    return cut(dealt.groupBy("dim", "no").applyInArrow(_pack, _PACKED))


class _Part:
    def __init__(self, row: dict):
        read = lambda name, kind=np.int64: np.frombuffer(row[name], kind)
        self.nodes, self.ids, self.labels, self.unnamed = read("nodes"), read("ids"), read("labels"), read("unnamed", np.bool_)
        n = len(self.nodes)
        wide = row["dim"] and len(row["cells"]) == 8 * n * row["dim"]
        self.cells = read("cells", np.int64 if wide else np.int32).reshape(n, row["dim"]).astype(np.int64)


def _sorted_scores(anchors: _Part, rows: _Part):
    """Per anchor (its number, the rows' order, their scores in that order): by score, then by id, ids that are null last."""
    place = np.arange(len(rows.nodes))  # rows lie in the order of their ids
    for at in range(0, len(anchors.nodes), STRIP):
        score = products(anchors.cells[at : at + STRIP], rows.cells)
        order = np.lexsort((np.broadcast_to(place, score.shape), -score), axis=-1)
        ordered = np.take_along_axis(score, order, axis=1)
        for i in range(len(score)):
            yield at + i, order[i], ordered[i]


def best_of_label(anchors: _Part, rows: _Part, k: int) -> list[tuple[int, int, int]]:
    """(anchor, row, score): each anchor's first k other rows of its label."""
    out = []
    for i, order, score in _sorted_scores(anchors, rows):
        at = np.flatnonzero((rows.labels[order] == anchors.labels[i]) & (rows.nodes[order] != anchors.nodes[i]))[:k]
        out += zip([i] * len(at), order[at].tolist(), score[at].tolist())
    return out


def lower_limit(positive: int) -> int:
    """The smallest score n with 80 * positive <= 100 * n; exact, and within a long."""
    return positive - positive // 5


def between_limits(anchors: _Part, rows: _Part, positives: dict[int, list[tuple[int, int]]], k: int) -> list[tuple[int, int, int, int]]:
    """(anchor, number of its positive, row, score): the first k rows of other labels within the positive's limits."""
    out = []
    for i, order, score in _sorted_scores(anchors, rows):
        other = None
        for no, positive in positives.get(int(anchors.nodes[i]), ()):
            first = np.searchsorted(-score, -positive, "left")
            last = np.searchsorted(-score, -lower_limit(positive), "right")
            if first >= last:
                continue
            if other is None:
                other = np.flatnonzero(rows.labels[order] != anchors.labels[i])
            a, b = np.searchsorted(other, (first, last))
            at = other[a : min(b, a + k)]
            out += zip([i] * len(at), [no] * len(at), order[at].tolist(), score[at].tolist())
    return out


_FOUND = "node long, no int, anchor_id long, other_id long, score long"


def _task(positives: int, negatives: int, second: bool):
    """Per pair of an anchor block and a tile: candidates for positives, or in the second pass for negatives."""

    def run(key, part):
        blocks = {r["side"]: r for r in part.to_pylist()}
        found = []
        if len(blocks) == 2:
            anchors, rows = _Part(blocks["anchors"]), _Part(blocks["rows"])
            if second:
                chosen: dict[int, list[tuple[int, int]]] = {}
                given = np.frombuffer(blocks["anchors"]["chosen"] or b"", np.int64).reshape(-1, 3)
                for node, no, score in given.tolist():
                    chosen.setdefault(node, []).append((no, score))
                found = between_limits(anchors, rows, chosen, negatives)
            else:
                found = [(i, 0, j, s) for i, j, s in best_of_label(anchors, rows, positives)]
        i, no, j, score = (np.array(c, np.int64) for c in (zip(*found) if found else ((),) * 4))
        if found:
            columns = [pa.array(anchors.nodes[i]), pa.array(no.astype(np.int32)), pa.array(anchors.ids[i]), pa.array(rows.ids[j], mask=rows.unnamed[j]), pa.array(score)]
        else:
            columns = [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]
        return pa.table(columns, names=[c.split()[0] for c in _FOUND.split(", ")])

    return run


def _chosen(key, part):
    """A block's positives (node, number, score) as bytes."""
    rows = np.stack([part[c].to_numpy().astype(np.int64) for c in ("node", "no", "score")], axis=1)
    return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([rows.tobytes()], pa.binary())], names=["dim", "no", "chosen"])


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors: rows whose id `every` divides."""
    rows = cut(scored_rows(vectors, scale))
    own = rows.where(F.col("vec_id") % every == 0)
    tiles, blocks = packed(rows, tile), packed(own, block)
    names = [c for c in tiles.columns if c != "no"]
    row_side = tiles.withColumnRenamed("no", "tile").join(F.broadcast(blocks.select("dim", F.col("no").alias("block"))), "dim")

    def pairs(anchors: DataFrame) -> DataFrame:
        """Every anchor block with every tile of its length; what is broadcast are the numbers of parts, not rows."""
        anchor_side = anchors.withColumnRenamed("no", "block").join(F.broadcast(tiles.select("dim", F.col("no").alias("tile"))), "dim")
        both = row_side.select(F.lit("rows").alias("side"), "block", "tile", *names, F.lit(None).cast("binary").alias("chosen"))
        return both.unionByName(anchor_side.select(F.lit("anchors").alias("side"), "block", "tile", *names, "chosen")).groupBy("dim", "block", "tile")

    best = Window.partitionBy("node", "no").orderBy(F.desc("score"), F.asc_nulls_last("other_id"))
    first = pairs(blocks.withColumn("chosen", F.lit(None).cast("binary"))).applyInArrow(_task(positives, negatives, False), _FOUND)
    first = cut(first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives).select("node", F.col("rank").alias("no"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # A block's anchors are few and so are their positives, so each block gets its own as one value.
    count = max(1, -(-own.count() // block))
    dims = own.select("node", F.size("cells").alias("dim"))
    chosen = first.join(dims, "node").select("dim", F.pmod(F.xxhash64("node"), F.lit(count).cast("long")).cast("int").alias("part"), "node", "no", F.col("positive_score").alias("score"))
    chosen = chosen.groupBy("dim", "part").applyInArrow(_chosen, "dim int, no int, chosen binary")
    second = pairs(blocks.join(chosen, ["dim", "no"])).applyInArrow(_task(positives, negatives, True), _FOUND)
    second = second.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return second.join(first, ["node", "no"]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
with e as (select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::BIGINT as label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) as v
    from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label as own, b.vec_id as other_id, b.label,
        list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT as score
    from e a join e b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 100 = 0),
p as (select anchor_id, other_id as positive_id, score as positive_score from s where own = label
    qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, p.positive_id, row_number() over best::INT as rank, s.other_id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and s.own <> s.label and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score
window best as (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id)
qualify row_number() over best <= 5
"""
