"""Hard negatives and centroid clusters against plain integer computation."""

import hashlib
import math
from collections import Counter

import numpy as np

from lexiforge.llm import centroids, negatives

VECTORS = "vec_id long, embedding array<double>, label int, node long, score int, cells string"
ODD = [(901, None, 1), (902, [], 2), (903, [float("nan")] * 6, 1), (904, [None] * 6, 1), (905, [float("inf")] * 6, 1), (906, [1.0, 2.0], 1), (700, [1.0, 0.5], 1), (907, [0.25] * 6, None), (908, [1e300] * 6, 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], VECTORS)


def vectors(rng, n=420, dim=6):
    """Many ties, repeated rows, a null id, and a third of all rows with one vector."""
    rows = [(int(i), (rng.integers(-3, 4, dim) / 4 + rng.choice([0.0, 0.001], dim)).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    rows += [(1000 + i, [0.5] * dim, i % 3) for i in range(n // 3)]
    return [*rows, rows[7], rows[100], (None, rows[3][1], 1), (None, rows[200][1], 0)]


# Hard negatives -------------------------------------------------------------------------------------


def plain_negatives(rows, every=100):
    kept = []
    for vec_id, x, label in rows:
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x) or any(abs(v) > 1e6 for v in x):
            continue
        kept.append((vec_id, [math.floor(256 * v) for v in x], (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label))
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for i, (a, x, own) in enumerate(kept):
        if a is None or a % every:
            continue
        scored = [(b, sum(p * q for p, q in zip(x, y)), label) for j, (b, y, label) in enumerate(kept) if j != i and len(y) == len(x)]
        for p, ps, _ in sorted((r for r in scored if r[2] == own), key=order)[:5]:
            fits = sorted((r for r in scored if r[2] != own and 80 * ps <= 100 * r[1] <= 100 * ps), key=order)[:5]
            out += [(a, p, k + 1, b, ps, s) for k, (b, s, _) in enumerate(fits)]
    return Counter(out)


def test_hard_negatives(spark):
    rows = vectors(np.random.default_rng(1)) + ODD + [(100, [3e5] * 6, 1)]
    want = plain_negatives(rows)
    for tile, block in ((50, 2), (8192, 2048)):
        got = negatives.hard_negatives(frame(spark, rows).repartition(5), tile=tile, block=block)
        assert Counter(map(tuple, got.collect())) == want
    assert len(want) > 50 and any(v > 1 for v in want.values())
    assert negatives.hard_negatives(frame(spark, rows).limit(0)).count() == 0
    assert negatives.hard_negatives(frame(spark, [r for r in rows if r[0] is None or r[0] % 100])).count() == 0


def test_scores_stay_exact():
    """Numbers past what floats hold are multiplied as longs, and limits do not overflow."""
    rng = np.random.default_rng(2)
    for most in (40, 2**14, 2**28):
        a, b = rng.integers(-most, most, (5, 60)), rng.integers(-most, most, (9, 60))
        assert negatives.products(a, b).tolist() == [[sum(int(p) * int(q) for p, q in zip(x, y)) for y in b] for x in a]
    for p in (*range(-25, 26), 2**62, -(2**62), 2**63 - 1):
        n = negatives.lower_limit(p)
        assert 80 * p <= 100 * n and 80 * p > 100 * (n - 1)


# Centroid clusters ----------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dim):
    kept = [(i, [math.floor(1024 * v) for v in x]) for i, x, _ in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) and abs(v) < 1e5 for v in x)]
    at = sorted(((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None))[:k]
    c = [list(x) for _, x in at]
    far = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y))
    near = lambda x: min((far(x, y), j) for j, y in enumerate(c))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for j in range(len(c)):
            if mine := [x for (_, x), o in zip(kept, own) if o == j]:
                c[j] = [sum(v) // len(mine) for v in zip(*mine)]
    found = [(i, *near(x)[::-1]) for i, x in kept]
    inertia = Counter()
    for _, j, d in found:
        inertia[j] += d
    return Counter((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found)


def test_centroid_clusters(spark):
    rows = vectors(np.random.default_rng(3)) + ODD
    for k, rounds in ((8, 10), (40, 3), (3, 0)):
        got = centroids.clusters(frame(spark, rows).repartition(5), k, rounds, dim=6)
        assert Counter(map(tuple, got.collect())) == plain_clusters(rows, k, rounds, 6)
    few = rows[:3]
    assert Counter(map(tuple, centroids.clusters(frame(spark, few), dim=6).collect())) == plain_clusters(few, 8, 10, 6)
    assert centroids.clusters(frame(spark, few).limit(0), dim=6).count() == 0
    assert centroids.clusters(frame(spark, [(None, [0.5] * 6, 1)]), dim=6).count() == 0
    assert centroids.clusters(frame(spark, few)).count() == 0


def test_annulus_holds_every_nearest_centroid_and_ties():
    rng = np.random.default_rng(4)
    for most in (3, 1000, 2**27):
        c = rng.integers(-most, most + 1, (50, 4)) * rng.integers(0, 3, (50, 1))
        c[40:] = c[:10]  # equal centroids: the smaller number wins
        x = np.concatenate([rng.integers(-2 * most, 2 * most + 1, (400, 4)), c, -c])
        ring = centroids.Ring(c)
        cluster, distance = ring.nearest(x)
        d = [[sum((int(p) - int(q)) ** 2 for p, q in zip(v, y)) for y in c] for v in x]
        assert cluster.tolist() == [min(range(50), key=lambda j: (r[j], j)) for r in d] and distance.tolist() == [min(r) for r in d]
    # Far from the origin in one direction, the annulus leaves most centroids out.
    shells = rng.normal(size=(200, 8)) * 100
    shells = (shells / np.linalg.norm(shells, axis=1)[:, None] * (np.arange(200)[:, None] * 1000 + 1)).astype(np.int64)
    first, end = centroids.Ring(shells).annulus(shells + 3)
    assert (end - first).mean() < 5
