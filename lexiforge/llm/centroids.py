"""Clusters around integer centroids: each vector meets only centroids whose norm its upper bound admits.

Centroids are sorted by norm. The one whose norm comes next to a vector's gives an upper bound on the
distance to the nearest; as |‖c‖ - ‖x‖| is at most the distance of c and x, only centroids with norms
in the annulus around the vector's can be as near, and binary search finds them. Those are compared
exactly, in integers; the annulus is closed and widened by what rounding of norms could hide, so that
ties at its border are compared as well and the smaller number wins them.

A round is one pass over the vectors, without a shuffle of them: tasks return sums, counts and inertia
per centroid. Only the centroids, a few hundred numbers, are on the driver.

Defined cases: rows whose vector is null, has another length than DIM, holds a null or non-finite
component, or has a squared length above 2^58 (distances might not fit a long) are left out; a null
vec_id keeps its row but starts no centroid; repeated rows are rows of their own (equal starting
hashes are ordered by the vectors); with fewer rows than centroids there are as many centroids as rows
that can start one; an empty table, or one in which none can, gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexiforge.llm.common import cut, table

DIM = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
MOST = 2.0**58
#: Rows whose distances are computed at a time.
STRIP = 4096


def cells(vector: Column, dim: int = DIM, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as an integer, or null where the row is left out."""
    x = F.transform(vector, lambda v: v.cast("double") * F.lit(float(scale)))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fits = F.aggregate(x, F.lit(0.0), lambda s, v: s + (F.abs(v) + 1) * (F.abs(v) + 1)) < MOST
    return F.when((F.size(vector) == dim) & sound & fits, F.transform(x, lambda v: F.floor(v).cast("int")))


class Ring:
    """Centroids in the order of their norms."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.centroids = norms[self.order], centroids[self.order].astype(np.int64)

    def annulus(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of the centroids by norm that can be nearest to each row of x."""
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        after = np.searchsorted(self.norms, norm).clip(0, len(self.norms) - 1)
        before = np.maximum(after - 1, 0)
        near = np.where(norm - self.norms[before] <= self.norms[after] - norm, before, after)
        bound = np.sqrt(self.squared(x, near).astype(np.float64))
        slack = 1e-9 * (norm + bound + 1)
        return np.searchsorted(self.norms, norm - bound - slack, "left"), np.searchsorted(self.norms, norm + bound + slack, "right")

    def squared(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        d = x - self.centroids[which]
        return np.einsum("ij,ij->i", d, d)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each row of x; ties go to the smaller cluster."""
        at, end = self.annulus(x)
        best, cluster = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.order))
        while len(rows := np.flatnonzero(at < end)):
            found, number = self.squared(x[rows], at[rows]), self.order[at[rows]]
            wins = (found < best[rows]) | (found == best[rows]) & (number < cluster[rows])
            best[rows[wins]], cluster[rows[wins]] = found[wins], number[wins]
            at = at + 1
        return cluster.astype(np.int32), best


def _strips(batches, dim: int):
    """(batch offset columns, matrix) in strips of STRIP rows."""
    for batch in batches:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        for k in range(0, len(x), STRIP):
            yield batch.column(0).slice(k, STRIP), x[k : k + STRIP].astype(np.int64)


def _round(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Per non-empty cluster (rows, inertia, sum of each component); a task returns one row per cluster."""
    k, dim = centroids.shape

    def run(batches):
        ring, n, inertia = Ring(centroids), np.zeros(k, np.int64), [0] * k
        sums = [[0] * dim for _ in range(k)]
        for _, x in _strips(batches, dim):
            cluster, distance = ring.nearest(x)
            n += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                own = cluster == c
                # Halves, so that sums of many long numbers can't overflow.
                inertia[c] += (int((distance[own] >> 32).sum()) << 32) + int((distance[own] & 0xFFFFFFFF).sum())
                sums[c] = [a + b for a, b in zip(sums[c], x[own].sum(axis=0).tolist())]
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(n[full]), pa.array([str(inertia[c]) for c in full], pa.string()), pa.array([list(map(str, sums[c])) for c in full], pa.list_(pa.string()))], ["cluster", "n", "inertia", "sums"])

    total = lambda c: F.sum(c.cast("decimal(38,0)")).cast("string")
    found = rows.mapInArrow(run, "cluster int, n long, inertia string, sums array<string>").groupBy("cluster")
    found = found.agg(F.sum("n").alias("n"), total(F.col("inertia")).alias("inertia"), F.array(*[total(F.col("sums")[i]) for i in range(dim)]).alias("sums"))
    return {r["cluster"]: (r["n"], int(r["inertia"]), list(map(int, r["sums"]))) for r in found.collect()}


def fit(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids after the rounds; rows: (vec_id, cells)."""
    turn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    start = rows.where("vec_id is not null").orderBy(turn, "cells").limit(k).select("cells").collect()
    centroids = np.array([r["cells"] for r in start], np.int64)
    for _ in range(rounds if len(start) else 0):
        for c, (n, _, sums) in _round(rows, centroids).items():
            centroids[c] = [s // n for s in sums]
    return centroids


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per vector that is kept.

    Inertia is null where it does not fit a long.
    """
    rows = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), cells(F.col("embedding"), dim, scale).alias("cells")).where("cells is not null"))
    centroids = fit(rows, k, rounds, seed)
    if not len(centroids):
        return rows.limit(0).select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    fits = lambda v: v if v < 2**63 else None
    last = _round(rows, centroids)
    total = fits(sum(v[1] for v in last.values()))
    of_cluster = [fits(last[c][1]) if c in last else 0 for c in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches):
        ring = Ring(centroids)
        for ids, x in _strips(batches, dim):
            cluster, distance = ring.nearest(x)
            at = pa.array(cluster)
            yield pa.RecordBatch.from_arrays(
                [ids, at, pa.array(distance), pa.array(of_cluster, pa.int64()).take(at), pa.array([total] * len(ids), pa.int64()), pa.array(digests).take(at)],
                ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _sql(k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The rounds written out one after the other."""
    nearest = """a{i} as materialized (select p.i, c.cluster, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT as distance
        from p cross join c{i} c qualify row_number() over (partition by p.i order by distance, c.cluster) = 1)"""
    update = """s{i} as (select cluster, j, sum(x)::HUGEINT as s, count(*)::HUGEINT as n from (select a.cluster, unnest(p.v) as x, unnest(range(len(p.v))) as j from a{i} a join p using (i)) group by all),
    m{i} as (select cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT order by j) as v from s{i} group by 1),
    c{j} as materialized (select c.cluster, coalesce(m.v, c.v) as v from c{i} c left join m{i} m using (cluster))"""
    parts = [f"""p as materialized (select row_number() over (order by vec_id) as i, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) as v
        from embeddings where len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as cluster, v from p where vec_id is not null qualify cluster < {k})"]
    for i in range(rounds):
        parts += [nearest.format(i=i), update.format(i=i, j=i + 1)]
    parts.append(nearest.format(i=rounds))
    return f"""with {', '.join(parts)}
    select p.vec_id, a.cluster::INT as cluster, a.distance, sum(a.distance) over (partition by a.cluster)::BIGINT as cluster_inertia, sum(a.distance) over ()::BIGINT as inertia,
        sha256(array_to_string(c.v, ',')) as centroid_sha256 from a{rounds} a join p using (i) join c{rounds} c on c.cluster = a.cluster"""


OP12_SQL = _sql()
