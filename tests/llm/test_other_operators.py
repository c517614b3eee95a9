"""Operators on pages, vectors and images, the shared components, and the pipeline."""

import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiforge.llm import common, fixity, images, vectors

from .test_text_operators import components


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5000, 5000 + i) for i in range(200)] + [(7, 7)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    assert got == {n: r for n, r in components(sorted({x for e in edges for x in e}), edges).items() if n in nodes}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# Fixity ---------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, id long, digest string"


def test_fixity(spark):
    rows = [(i * 3 - 100, f"u{i}", f"<p>{i}</p>", 1, "x") for i in range(500)] + [(None, None, None, 1, "x"), (4, "a", "b", 1, "x"), (4, "a", "b", 1, "x"), (4, "a", "c", 1, "x")]
    ours = spark.createDataFrame(rows, PAGES)
    assert fixity.audit(ours, ours.repartition(7)).where("status <> 'ok'").count() == 0
    theirs = [r for r in rows if r[0] != 50] + [(99_999_999, "new", "", 1, "x")]
    theirs = [(r[0], r[1], r[2] + "!", *r[3:]) if r[0] == 101 else r for r in theirs]
    theirs.remove((4, "a", "b", 1, "x"))
    got = {r.page_id: r.status for r in fixity.audit(ours, spark.createDataFrame(theirs, PAGES)).where("status <> 'ok'").collect()}
    assert got == {50: "missing", 101: "corrupt", 4: "corrupt", 99_999_999: "extra"}
    none = spark.createDataFrame([], PAGES)
    assert fixity.audit(none, none).count() == 0 and {r.status for r in fixity.audit(ours, none).collect()} == {"missing"} and {r.status for r in fixity.audit(none, ours).collect()} == {"extra"}


def test_descent_reads_only_branches_that_differ(spark):
    ours = fixity.leaves(spark.createDataFrame([(i, "u", str(i)) for i in range(10_000)], "page_id long, url string, html string"))
    height = fixity.height_of(ours)
    levels = fixity.tree(ours, height)
    assert [x.count() for x in levels] == [10_000, 157, 3, 1]
    other = fixity.tree(ours.withColumn("digest", F.when(F.col("id") == 777, "bad").otherwise(F.col("digest"))), height)
    assert [a.join(b, ["id", "digest"], "left_anti").count() for a, b in zip(levels, other)] == [1, 1, 1, 1]


# Vectors --------------------------------------------------------------------------------------------


def plain_near(rows, threshold=0.95):
    x = {i: np.array(v, float) for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)}
    cos = lambda a, b: len(a) == len(b) and float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) >= threshold
    edges = [(i, j) for i in x for j in x if i < j and cos(x[i], x[j])]
    n = [sum(i in e for e in edges) for i in range(len(rows))]
    root = components(range(len(rows)), edges)
    least = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[root[i]] = min(v, least.get(root[i], v))
    return [(v, n[i], least.get(root[i]), v == least.get(root[i])) for i, (v, _) in enumerate(rows)]


def test_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] * rng.uniform(0.5, 3) + rng.normal(0, rng.choice([0.0, 0.05, 0.2, 0.3]), 24)).tolist()) for i in range(300)]
    rows += [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [None] * 24), (905, [float("inf")] + [1.0] * 23), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, rows[0][1]), (5, rows[5][1])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, node long, x int")
    want = sorted(map(repr, plain_near(rows)))
    for tile in (50, 8192):
        assert sorted(map(repr, map(tuple, vectors.near_duplicates(frame, tile=tile).collect()))) == want
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_bounds_hold_and_few_pairs_are_computed_again():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 64)) * 10.0 ** rng.integers(-200, 200, (600, 1))
    x[300:] = x[:300] * (1 + rng.normal(0, 0.25, (300, 64)))
    u = vectors.even(x)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = (u @ u.T >= 0.95) & ~np.eye(600, dtype=bool)
    ones = np.ones(600, np.int64)
    sure, (rest, again) = vectors.sure_links(vectors.unit_tile(x), ones), vectors.open_links(x, ones)
    assert (sure.count + rest.count == near.sum(1)).all() and 0 < again < 600 * 599 / 2 / 100
    # Pairs left open are decided alike when only their own vectors are there, in one tile or in two.
    part = np.flatnonzero(sure.open)
    few, n = vectors.open_links(x[part], ones[part])
    assert n == again and (few.count == rest.count[part]).all() and rest.count[~sure.open].sum() == 0
    two, _ = vectors.open_links(x[:300], ones[:300], x[300:], ones[300:])
    proved = vectors.sure_links(vectors.unit_tile(x[:300]), ones[:300], vectors.unit_tile(x[300:]), ones[300:])
    assert (two.count + proved.count == np.concatenate([near[:300, 300:].sum(1), near[300:, :300].sum(1)])).all()
    q = vectors.quantised(u)
    assert q.cells.dtype == np.int8 and (np.linalg.norm(u - q.cells.astype(float) * q.scale, axis=1) <= q.error).all() and np.abs(q.cells.astype(int)).max() <= 127


def test_long_vectors_stay_exact():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 2500))
    x[20:] = x[:20] + rng.normal(0, 0.32, (20, 2500))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    sure, (rest, _) = vectors.sure_links(vectors.unit_tile(x), np.ones(40, np.int64)), vectors.open_links(x, np.ones(40, np.int64))
    assert (sure.count + rest.count == ((u @ u.T >= 0.95) & ~np.eye(40, dtype=bool)).sum(1)).all()


# Images ---------------------------------------------------------------------------------------------


def picture(rng, side=96):
    return np.clip(images.resized(rng.uniform(0, 255, (20, 20)), side / 20), 0, 255).astype(np.uint8)


def test_images(spark):
    rng = np.random.default_rng(3)
    rows, at = [], 0

    def add(a):
        nonlocal at
        rows.append((at, a.shape[1], a.shape[0], np.ascontiguousarray(a).tobytes()))
        at += 1

    for _ in range(12):
        a = picture(rng)
        edited = np.clip(a.astype(float) * 0.85 + 15 + rng.normal(0, 1.5, a.shape), 0, 255).astype(np.uint8)
        for b in (a, a, a[8:90, 6:92], edited, np.rot90(a)):
            add(b)
    rows += [(500, None, None, None), (501, 3, 3, b"x" * 9), (502, 40, 40, b"\x80" * 1600), (503, 9, 9, b"short"), (None, *rows[0][1:]), (504, 40, 40, b"\x80" * 1600)]
    media = spark.createDataFrame([(*r, 1) for r in rows], "media_id long, width int, height int, pixels binary, same int")
    for pairwise in (images.PAIRWISE,):
        got = {r.media_id: r.component_id for r in images.copies(media).collect()}
        want = {i: i // 5 * 5 for i in range(60)}
        assert sum(got[i] == want[i] for i in want) >= 57 and not any(got[i] // 5 != i // 5 for i in want)
    assert got[500] == 500 and got[501] == 501 and got[503] == 503 and got[504] == 502 and got[None] == 0
    assert images.copies(media.limit(0)).count() == 0


def test_leaders_find_the_same_classes(spark):
    """A group that shares hot keys comes out whole, whether by leaders or pair by pair."""
    rng = np.random.default_rng(9)
    a = picture(rng)
    near = [np.clip(a.astype(float) + rng.normal(0, 1, a.shape), 0, 255).astype(np.uint8) for _ in range(40)]
    far = [picture(rng) for _ in range(10)]
    rows = [(i, 96, 96, x.tobytes()) for i, x in enumerate(near + far)]
    media = spark.createDataFrame(rows, "media_id long, width int, height int, pixels binary")
    described = common.cut(media.mapInArrow(images._described, "media_id long, same string, points binary, bits binary").withColumnRenamed("media_id", "node"))
    for pairwise in (3, 1000):
        edges = [tuple(r) for r in images.links(described, pairwise).collect()]
        assert components(range(50), edges) == {i: 0 if i < 40 else i for i in range(50)}


def described_points(at, bits):
    p = np.zeros((len(at), 4), np.float32)
    p[:, 0], p[:, 1] = at[:, 0], at[:, 1]
    return p, np.ascontiguousarray(bits)


def described_as(spark, *parts):
    """Rows (node, points, bits) of images that hold the stated (points, descriptors)."""
    rows = []
    for node, (at, bits) in enumerate(parts):
        packed = np.zeros(len(at), images._POINT)
        packed["y"], packed["x"] = at[:, 0], at[:, 1]
        rows.append((node, bytearray(packed.tobytes()), bytearray(np.ascontiguousarray(bits).tobytes())))
    return spark.createDataFrame(rows, "node long, points binary, bits binary")


def test_images_that_link_to_a_leader_are_compared_with_others_too(spark):
    """An original links a left and a right crop that share nothing, though it links to a leader at hot keys first."""
    rng = np.random.default_rng(5)
    at, bits = rng.integers(10, 200, (24, 2)), rng.integers(0, 256, (24, 32), np.uint8)
    left, right = (at[:12], bits[:12]), (at[12:], bits[12:])
    for order in ([left, left, (at, bits), right], [right, left, (at, bits), left], [(at, bits), left, left, right]):
        frame = described_as(spark, *order)
        for pairwise in (1, 2, 1000):
            assert set(components(range(4), [tuple(r) for r in images.links(frame, pairwise).collect()]).values()) == {0}


def described(a):
    return images.describe(np.ascontiguousarray(a).tobytes(), a.shape[1], a.shape[0])


def test_crops_down_to_a_quarter_of_the_area_link():
    rng = np.random.default_rng(12)
    for _ in range(12):
        a = np.clip(images.resized(rng.uniform(0, 255, (40, 40)), 4.8), 0, 255).astype(np.uint8)
        whole = described(a)
        for y, x, side in ((20, 15, 136), (41, 63, 96), (0, 0, 96), (96, 96, 96)):
            assert images.agreeing(*whole, *described(a[y : y + side, x : x + side])) >= images.AGREE
    # A contrasty part holds the strongest corners; crops without it link as well.
    a = np.clip(128 + (a - 128.0) * np.where(np.arange(192) < 60, 1, 0.4), 0, 255).astype(np.uint8)
    assert images.agreeing(*described(a), *described(a[50:146, 80:176])) >= images.AGREE


def test_matching_in_blocks_changes_nothing(monkeypatch):
    rng = np.random.default_rng(13)
    a = picture(rng)
    pair = (*described(a), *described(a[8:90, 6:92]))
    want = images.agreeing(*pair)
    monkeypatch.setattr(images, "_CELLS", 50)
    assert images.agreeing(*pair) == want >= images.AGREE


def turned(a, degrees):
    """a turned about its centre, without the rim that would come from outside."""
    t, (h, w) = np.deg2rad(degrees), a.shape
    yy, xx = np.mgrid[:h, :w]
    y = h / 2 + np.cos(t) * (yy - h / 2) - np.sin(t) * (xx - w / 2)
    x = w / 2 + np.sin(t) * (yy - h / 2) + np.cos(t) * (xx - w / 2)
    out = a[np.clip(np.rint(y), 0, h - 1).astype(int), np.clip(np.rint(x), 0, w - 1).astype(int)]
    return out[h // 8 : -(h // 8), w // 8 : -(w // 8)]


def shared(p, q):
    """How many keys count for two described images."""
    (k, s), (m, t) = images.join_keys(*p), images.join_keys(*q)
    one, two = np.isin(k, m), np.isin(m, k)
    return int(((k[one][:, None] == m[two][None, :]) & images.near_shapes(*np.broadcast_arrays(s[one][:, None], t[two][None, :]))).sum())


EDITS = {
    "crop": lambda a: a[len(a) // 12 : -len(a) // 16, len(a) // 16 : -len(a) // 24], "half of the area": lambda a: a[len(a) // 7 :, len(a) // 6 :][: int(len(a) * 0.71), : int(len(a) * 0.71)],
    "scale 0.9": lambda a: images.resized(a.astype(float), 0.9), "scale 0.8": lambda a: images.resized(a.astype(float), 0.8), "scale 0.7": lambda a: images.resized(a.astype(float), 0.7),
    "scale 1.25": lambda a: images.resized(a.astype(float), 1.25), "turn 90": np.rot90, "turn 20": lambda a: turned(a, 20), "turn 7": lambda a: turned(a, 7),
    "blurred": lambda a: images._box(a.astype(float)) / 25, "recompressed": lambda a: np.rint(a / 12.0) * 12 + np.random.default_rng(1).normal(0, 3, a.shape), "darker": lambda a: a * 0.7 + 10,
}


@pytest.mark.parametrize("side, n", [(96, 40), (192, 12)])
def test_edited_copies_are_found(side, n):
    """Of every edit, nearly all copies share keys and link; of what brute force links, the keys lose next to nothing."""
    rng = np.random.default_rng(14)
    linked, found = dict.fromkeys(EDITS, 0), dict.fromkeys(EDITS, 0)
    for _ in range(n):
        a = np.clip(images.resized(rng.uniform(0, 255, (side // 24 * 5, side // 24 * 5)), 4.8), 0, 255).astype(np.uint8)
        whole = described(a)
        for name, edit in EDITS.items():
            d = described(np.clip(np.rint(edit(a)), 0, 255).astype(np.uint8))
            if images.agreeing(*whole, *d) >= images.AGREE:
                linked[name] += 1
                found[name] += shared(whole, d) >= images.SHARED
    print(side, linked, found)
    assert all(found[e] >= 0.9 * n for e in EDITS) and sum(found.values()) >= 0.97 * sum(linked.values())


def test_unrelated_pictures_share_few_keys():
    """Of 400 pictures of their own, few pairs share a key by chance: fewer for more images, though copies are found as often."""
    rng = np.random.default_rng(23)
    own = [described(picture(rng, 72)) for _ in range(400)]
    kept = []
    for most, length, tables in images.SIZES:
        assert images.key_sizes(most or 10**9) == [length, tables]
        keys, shapes = zip(*(images.join_keys(*d, length, tables) for d in own))
        node, key, shape = np.repeat(np.arange(len(own)), [len(k) for k in keys]), np.concatenate(keys), np.concatenate(shapes)
        order, pairs = np.argsort(key, kind="stable"), set()
        node, key, shape = node[order], key[order], shape[order]
        for apart in range(1, len(key)):
            i = np.flatnonzero(key[apart:] == key[:-apart])
            if not len(i):
                break
            i = i[(node[i] != node[i + apart]) & images.near_shapes(shape[i], shape[i + apart])]
            pairs |= set(zip(node[i].tolist(), node[i + apart].tolist()))
        kept.append(len({(min(p), max(p)) for p in pairs}))
    print(kept)
    assert kept[0] <= 50 and kept[1] <= 25 and kept[2] <= 15


def test_longer_keys_find_as_many_copies():
    """At every number of images, copies of small pictures share keys."""
    rng = np.random.default_rng(24)
    linked, found = 0, [0] * len(images.SIZES)
    for _ in range(40):
        a = np.clip(images.resized(rng.uniform(0, 255, (15, 15)), 4.8), 0, 255).astype(np.uint8)
        for edit in EDITS.values():
            whole, d = described(a), described(np.clip(np.rint(edit(a)), 0, 255).astype(np.uint8))
            if images.agreeing(*whole, *d) >= images.AGREE:
                linked += 1
                for at, (_, *size) in enumerate(images.SIZES):
                    found[at] += shared((*whole, *size), (*d, *size)) >= images.SHARED
    print(linked, found)
    assert min(found) >= 0.95 * linked


def test_neighbours_equal_all_distances(monkeypatch):
    """Crowded, scattered, tied, lone points of several scales: cells find what the matrix of distances gives."""
    rng = np.random.default_rng(19)
    for n, size in ((0, 5), (1, 5), (2, 900), (7, 3000), (300, 12), (400, 90), (200, 5000)):
        y, x, k = rng.integers(0, size, n).astype(float), rng.integers(0, size * 3, n).astype(float), rng.integers(0, 3, n)
        apart = np.hypot(y[:, None] - y, x[:, None] - x)
        want = {(i, int(j)) for i in range(n) for j in np.argsort(np.where((k == k[i]) & (np.arange(n) != i), apart[i], np.inf), kind="stable")[: min(images.NEAR, (k == k[i]).sum() - 1)]}
        for patches, cells in ((images._PATCHES, images._CELLS), (13, 40)):
            monkeypatch.setattr(images, "_PATCHES", patches)
            monkeypatch.setattr(images, "_CELLS", cells)
            i, j = images.neighbours(y, x, k)
            assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want


def test_strips_change_nothing(monkeypatch):
    """An image worked on in strips of a few rows has the same corners, descriptors and keys; far from the border too."""
    a = np.clip(images.resized(np.random.default_rng(20).uniform(0, 255, (30, 50)), 4.8), 0, 255).astype(np.uint8)
    whole = described(a)
    monkeypatch.setattr(images, "_PIXELS", 700)
    monkeypatch.setattr(images, "_PATCHES", 11)
    assert all(np.array_equal(p, q) for p, q in zip(whole, described(a)))
    far = whole[0] + np.array([0, 30_000, 0, 0], np.float32)
    packed = np.zeros(len(far), images._POINT)
    packed["y"], packed["x"], packed["k"] = far[:, 0], far[:, 1], far[:, 2]
    assert np.array_equal(images._read(packed.tobytes(), whole[1].tobytes())[0][:, :2], far[:, :2])


def test_a_large_photograph_stays_small_in_memory():
    """A picture of 12 million pixels is described and has its keys within a gigabyte."""
    code = """
import resource, numpy as np
from lexiforge.llm import images
a = images.resized(np.random.default_rng(21).uniform(0, 255, (300, 400)), 10.0).astype(np.uint8)
p, d = images.describe(a.tobytes(), 4000, 3000)
keys, _ = images.join_keys(p, d)
print(len(p), len(keys), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], env={**os.environ, "PYTHONPATH": root}, capture_output=True, text=True, check=True)
    n, keys, peak = map(int, done.stdout.split())
    assert n > 50_000 and keys > n and peak < 1_000_000


def test_classes_equal_brute_force_over_all_pairs(spark):
    """Copies of several edits among other pictures: the classes of all pairs that link come out, hot keys or not."""
    rng = np.random.default_rng(16)
    rows = []
    for _ in range(8):
        a = picture(rng)
        rows += [a] + [np.clip(np.rint(EDITS[e](a)), 0, 255).astype(np.uint8) for e in ("crop", "scale 0.8", "turn 90", "darker", "blurred", "recompressed")]
    rows += [picture(rng) for _ in range(10)]
    media = spark.createDataFrame([(i, a.shape[1], a.shape[0], np.ascontiguousarray(a).tobytes()) for i, a in enumerate(rows)], "media_id long, width int, height int, pixels binary")
    known = [described(a) for a in rows]
    want = components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if images.agreeing(*known[i], *known[j]) >= images.AGREE])
    for pairwise in (2, images.PAIRWISE):
        assert {r.media_id: r.component_id for r in images.copies(media, pairwise).collect()} == want
    assert len(set(want.values())) == 18


def test_a_pair_has_one_key_from_either_side(spark):
    """Turned by a quarter, an image keeps its keys and shapes; and Spark compares shapes as this test does."""
    a = picture(np.random.default_rng(17))
    p, q = described(a), described(np.rot90(a))
    assert shared(p, q) >= 0.5 * len(images.join_keys(*p)[0])
    (k, s), (m, t) = images.join_keys(*p), images.join_keys(*q)
    frame = lambda keys, shapes, name: spark.createDataFrame(list(zip(keys.tolist(), shapes.tolist())), f"key long, {name} long")
    assert frame(k, s, "s").join(frame(m, t, "t"), "key").where(images.alike(F.col("s"), F.col("t"))).count() == shared(p, q)
    none = images.join_keys(np.zeros((0, 4), np.float32), np.zeros((0, 32), np.uint8))
    one = images.join_keys(p[0][:1], p[1][:1])
    assert [len(x) for x in (*none, *one)] == [0, 0, 0, 0]


def test_keys_of_few_and_of_many_are_summed(spark):
    """Two images with one key that many share and one that nobody else has are compared."""
    rng = np.random.default_rng(15)
    at, bits = np.stack([np.repeat([10, 90], 8) + np.tile(np.arange(8) * 10, 2) % 70, np.tile(np.arange(8) * 23, 2)], axis=1), rng.integers(0, 256, (16, 32), np.uint8)
    a, b = (at, bits), (at, bits.copy())
    keys, _ = images.join_keys(*described_points(*a))
    pair = lambda k: (at[k], bits[k])
    others = [pair([0, 1]) for _ in range(5)]
    frame = described_as(spark, *others[:2], a, b, *others[2:])
    want = components(range(7), [(i, j) for i, p in enumerate((*others[:2], a, b, *others[2:])) for j, q in enumerate((*others[:2], a, b, *others[2:])) if i < j and images.agreeing(*described_points(*p), *described_points(*q)) >= images.AGREE])
    for pairwise in (1, 3, 1000):
        assert components(range(7), [tuple(r) for r in images.links(frame, pairwise).collect()]) == want == {0: 0, 1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6}
    assert len(keys)


def test_pairing_in_batches_equals_pairing_at_once():
    """Keys that go on over batches, and hot ones among them, give what a plain double loop gives; so do leaders."""
    rng = np.random.default_rng(18)
    key = np.sort(np.concatenate([rng.integers(0, 60, 300), np.full(25, 30), np.full(9, 31)]))
    node, shape = rng.integers(0, 40, len(key)), rng.integers(0, 1 << 20, len(key)) & 0x30003
    node = np.concatenate([np.sort(node[key == k]) for k in sorted(set(key.tolist()))])
    root = node // 3
    rows = list(zip(key.tolist(), node.tolist(), root.tolist(), shape.tolist()))
    near = lambda s, t: images.near_shapes(np.array([s]), np.array([t]))[0]
    many = {k: int((key == k).sum()) for k in set(key.tolist())}
    split = lambda size: [pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in (key, node, root, shape)], ["key", "node", "root", "shape"]) for i in range(0, len(key), size)]
    got = lambda run, size: sorted([tuple(r.values()) for b in run(iter(split(size))) for r in b.to_pylist()], key=repr)
    for pairwise in (1, 4, 9, 1000):
        pairs = [(None, min(n, m), min(n, m), max(n, m)) for x, (k, n, r, s) in enumerate(rows) for l, m, q, t in rows[:x] if k == l and r != q and many[k] <= pairwise and near(s, t)]
        want = sorted(pairs + [r for r in rows if many[r[0]] > pairwise], key=repr)
        assert all(got(images._paired(pairwise), size) == want for size in (1, 7, 64, 1000))
    heads = {}
    for k, n, _, s in rows:
        heads.setdefault(k, (n, s))
    want = sorted([(heads[k][0], n) for k, n, _, s in rows if n != heads[k][0] and near(s, heads[k][1])], key=repr)
    assert want and all(got(images._led, size) == want for size in (1, 7, 64, 1000))


# Pipeline -------------------------------------------------------------------------------------------


def test_pipeline(spark, sf):
    """Each stage on what the last kept: its decisions hold, columns stay, nothing else is lost."""
    import corpus_pipeline
    from lexiforge.llm import mixing, secrets, simhash

    from .test_text_operators import plain_components, plain_fingerprint

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.cut(stage(spark, docs, sf))
        seen[name] = (docs, out)
        if name != "packing":
            assert out.columns == columns
        docs = out
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    before, after = seen["simhash"]
    plain = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in before.collect()])
    assert ids(after) == {d for d, _, c in plain if d == c} and after.count() == len(ids(after))
    before, after = seen["secrets"]
    assert ids(before) == ids(after) and secrets.scan(after)[0].where("size(findings) > 0").count() == 0
    clean = {r.doc_id: r.text for r in before.collect()}
    dirty = {r.doc_id for r in secrets.scan(before)[0].where("size(findings) > 0").collect()}
    assert all(r.text == clean[r.doc_id] for r in after.collect() if r.doc_id not in dirty)
    before, after = seen["mixing"]
    assert after.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == mixing.mix(before).agg(F.sum("taken")).first()[0]
    before, after = seen["packing"]
    assert ids(before) == ids(after)
    assert corpus_pipeline.run(spark, sf).agg(F.sum("length")).first()[0] == pytest.approx(after.agg(F.sum("length")).first()[0])
    assert simhash and len(corpus_pipeline.STAGES) == 5
