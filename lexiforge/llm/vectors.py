"""Embedding near-duplicates: int8 tile products with rigorous error bounds.

Equal vectors are one class. Classes are dealt into tiles of int8 numbers, a byte per component, with
each vector's scale and the norm of its quantisation error; each pair of tiles is one task, which
multiplies them. A product bounds the true cosine from both sides: pairs that must be above the
threshold are links, pairs that cannot be are not. The vectors of pairs between the bounds, and no
others, then go to the same pairs of tiles in double precision, where those pairs are computed again.
A task returns link counts and a spanning forest of its links, never the pairs, so a large group of
copies costs as much output as it has members.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing and are their own component; vectors of different lengths never link; repeated rows are
vectors of their own; a null vec_id keeps its row, is counted by others and does not name a component
unless all its members lack an id.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiforge.llm.common import connected_components, cut, table

THRESHOLD = 0.95
TILE = 8192
STRIP = 512
#: Products of int8 numbers stay exact in float32 up to this length, and so do sums of their blocks in double.
_EXACT = 1000
_CHUNK = 1 << 15


class Tile(NamedTuple):
    """Unit vectors as int8 rows: each row times its scale is off by at most its error (a norm)."""

    cells: np.ndarray
    scale: np.ndarray
    error: np.ndarray


def even(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest number to 0.5 to 1, so that no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def quantised(unit: np.ndarray) -> Tile:
    """Each row by a scale of its own (a column), and an upper bound on the norm of what rounding took from it."""
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    q = np.rint(unit / scale)
    return Tile(q.astype(np.int8), scale, np.sqrt(((unit - q * scale) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12)


def unit_tile(x: np.ndarray) -> Tile:
    """A row's numbers depend on that row alone, so every task quantises it alike."""
    x = even(x)
    return quantised(x / np.linalg.norm(x, axis=1)[:, None])


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label, where each entry names its root, after joining the roots of i and j."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            break
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def bounded(x: Tile, y: Tile | None, threshold: float):
    """(i, j, sure) in strips of rows of x: pairs that link for sure, and those that the bounds leave open.

    Without y, the pairs within x. Products of int8 numbers are exact in float32 up to _EXACT
    components, longer ones are summed in blocks. A first comparison by the largest error leaves
    few pairs, whose own bounds then decide.
    """
    own = y is None
    y = x if own else y
    d, widest = x.cells.shape[1], y.error.max()
    q = y.cells.astype(np.float32)
    steps = y.scale[:, 0].astype(np.float32)
    for at in range(0, len(x.cells), STRIP):
        to, left = min(at + STRIP, len(x.cells)), at if own else 0
        p = x.cells[at:to].astype(np.float32)
        if d <= _EXACT:
            product = p @ q[left:].T
        else:
            product = sum((p[:, k : k + _EXACT] @ q[left:, k : k + _EXACT].T).astype(np.float64) for k in range(0, d, _EXACT))
        if own:
            k = np.arange(to - at)
            product[:, : to - at][k[:, None] >= k[None, :]] = -np.inf
        least = (threshold - x.error[at:to] - (1 + x.error[at:to]) * widest - 1e-5) / x.scale[at:to, 0]
        i, j = np.nonzero(product * steps[left:] >= least[:, None])
        near = product[i, j].astype(np.float64) * x.scale[at + i, 0] * y.scale[left + j, 0]
        i, j = i + at, j + left
        slack = x.error[i] + (1 + x.error[i]) * y.error[j] + 1e-9
        keep = near + slack >= threshold
        yield i[keep], j[keep], (near - slack >= threshold)[keep]


class _Links:
    """Link counts by weight and a forest over the rows of one tile, or of two in order."""

    def __init__(self, wx: np.ndarray, wy: np.ndarray | None):
        self.wx, self.wy, self.shift = wx, wx if wy is None else wy, 0 if wy is None else len(wx)
        n = self.shift + len(self.wy)
        self.count, self.label, self.open = np.zeros(n, np.int64), np.arange(n), np.zeros(n, bool)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        n = len(self.count)
        self.count += np.bincount(i, self.wy[j], n).astype(np.int64) + np.bincount(j + self.shift, self.wx[i], n).astype(np.int64)
        self.label = _hook(self.label, i, j + self.shift)


def sure_links(x: Tile, wx: np.ndarray, y: Tile | None = None, wy: np.ndarray | None = None, threshold: float = THRESHOLD) -> _Links:
    """The links that the bounds prove; open marks the rows of pairs that they do not decide."""
    links = _Links(wx, wy)
    for i, j, sure in bounded(x, y, threshold):
        links.add(i[sure], j[sure])
        links.open[i[~sure]] = links.open[j[~sure] + links.shift] = True
    return links


def open_links(x: np.ndarray, wx: np.ndarray, y: np.ndarray | None = None, wy: np.ndarray | None = None, threshold: float = THRESHOLD) -> tuple[_Links, int]:
    """The links among pairs that the bounds leave open, by double precision, and how many such pairs there were."""
    links, again = _Links(wx, wy), 0
    u, v = even(x), even(x if y is None else y)
    nu, nv = np.linalg.norm(u, axis=1), np.linalg.norm(v, axis=1)
    for i, j, sure in bounded(unit_tile(x), None if y is None else unit_tile(y), threshold):
        i, j = i[~sure], j[~sure]
        again += len(i)
        for k in range(0, len(i), _CHUNK):
            p, q = i[k : k + _CHUNK], j[k : k + _CHUNK]
            near = np.einsum("ij,ij->i", u[p], v[q]) / (nu[p] * nv[q]) >= threshold
            links.add(p[near], q[near])
    return links, again


_TILED = "node long, dim int, tile int, weight long, cells binary, scale double, error double"


def _quantise(batches):
    """Rows (node, dim, tile, weight, x) with x as int8 bytes; dims may be mixed."""
    for batch in batches:
        dims, x = batch.column(1).to_numpy(), batch.column(4)
        cells, scale, error = np.empty(len(dims), object), np.zeros(len(dims)), np.zeros(len(dims))
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            tile = unit_tile(x.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d))
            cells[at], scale[at], error[at] = [r.tobytes() for r in tile.cells], tile.scale[:, 0], tile.error
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(cells, pa.binary()), pa.array(scale), pa.array(error)], [c.split()[0] for c in _TILED.split(", ")])


_BLOCK = "dim int, tile int, nodes binary, weights binary, cells binary, scales binary, errors binary"


def _pack(key, part):
    of = lambda name: part[name].to_numpy().tobytes()
    row = [key[0].as_py(), key[1].as_py(), of("node"), of("weight"), b"".join(part["cells"].to_pylist()), of("scale"), of("error")]
    kinds = [pa.int32()] * 2 + [pa.binary()] * 5
    return pa.table({c.split()[0]: pa.array([v], k) for c, v, k in zip(_BLOCK.split(", "), row, kinds)})


def _read(block: dict) -> tuple[np.ndarray, np.ndarray, Tile]:
    nodes, of = np.frombuffer(block["nodes"], np.int64), lambda name: np.frombuffer(block[name], np.float64)
    return nodes, np.frombuffer(block["weights"], np.int64), Tile(np.frombuffer(block["cells"], np.int8).reshape(len(nodes), -1), of("scales")[:, None], of("errors"))


_LINKED = "dim int, low int, high int, tile int, node long, links long, root long, open boolean"


def _rows(key, names, tiles, links: _Links):
    """The rows of a pair of tiles that link or are open."""
    hit = np.flatnonzero((links.count > 0) | links.open)
    same = [pa.array(np.full(len(hit), k.as_py(), np.int32)) for k in key]
    columns = [*same, pa.array(tiles[hit].astype(np.int32)), pa.array(names[hit]), pa.array(links.count[hit]), pa.array(names[links.label[hit]]), pa.array(links.open[hit])]
    return pa.table(columns, names=[c.split()[0] for c in _LINKED.split(", ")])


def _products(threshold: float):
    """Per pair of tiles: what the int8 products prove, and which vectors take part in pairs left open."""

    def run(key, part):
        blocks = part.sort_by("tile").to_pylist()
        found = [_read(b) for b in blocks]
        (names, wx, x), second = found[0], found[1] if len(found) == 2 else None
        tiles = np.repeat([b["tile"] for b in blocks], [len(f[0]) for f in found])
        if second:
            return _rows(key, np.concatenate([names, second[0]]), tiles, sure_links(x, wx, second[2], second[1], threshold))
        own = key[1].as_py() == key[2].as_py()
        return _rows(key, names, tiles, sure_links(x, wx, threshold=threshold) if own else _Links(wx, None))

    return run


def _again(threshold: float):
    """Per pair of tiles, on the whole vectors of open pairs alone."""

    def run(key, part):
        tile = part["tile"].to_numpy()
        x = part["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(tile), -1)
        names, weights, low = part["node"].to_numpy(), part["weight"].to_numpy(), key[1].as_py()
        if low == key[2].as_py():
            return _rows(key, names, tile, open_links(x, weights, threshold=threshold)[0])
        a, b = np.flatnonzero(tile == low), np.flatnonzero(tile != low)
        both = np.concatenate([a, b])
        return _rows(key, names[both], tile[both], open_links(x[a], weights[a], x[b], weights[b], threshold)[0])

    return run


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all rows with x null where nothing can link, one row per distinct vector: node, x, weight, least)."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(sound, F.lit(False)), x).alias("x"))
    found = cut(rows.where("x is not null").groupBy("x").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight")))
    return rows, cut(found.withColumn("node", F.monotonically_increasing_id()))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector."""
    rows, distinct = classes(vectors)
    tiles = max(1, -(-distinct.count() // tile))
    dealt = distinct.select("node", F.size("x").alias("dim"), F.pmod(F.xxhash64("node"), F.lit(tiles).cast("long")).cast("int").alias("tile"), "weight", "x")
    packed = cut(dealt.mapInArrow(_quantise, _TILED).groupBy("dim", "tile").applyInArrow(_pack, _BLOCK))
    pairs = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).select("dim", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), *[c for c in packed.columns if c != "dim"])
    proved = cut(pairs.groupBy("dim", "low", "high").applyInArrow(_products(threshold), _LINKED))
    left = proved.where("open").select("dim", "low", "high", "tile", "node").join(distinct.select("node", "weight", "x"), "node")
    decided = left.groupBy("dim", "low", "high").applyInArrow(_again(threshold), _LINKED)
    linked = cut(proved.unionByName(decided).where("links > 0").select("node", "links", "root"))
    roots = connected_components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = cut(linked.groupBy("node").agg(F.sum("links").alias("links")))
    named = distinct.drop("x").join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = cut(named)
    least = cut(named.groupBy("root").agg(F.min("least").alias("component_id")))
    named = named.join(least, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    by_vector = cut(distinct.select("node", "x").join(named, "node").drop("node"))
    found = rows.where("x is not null").join(by_vector, "x").select("vec_id", "n_links", "component_id")
    alone = rows.where("x is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
