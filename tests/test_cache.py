"""The cache against a plain one in Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import cache

BEGIN = datetime(2024, 5, 1)
SCHEMA = "seq long, at timestamp, op string, key string, data string, other int"


def plain(rows, limit, budget):
    """What is held after all uses, walked through one by one."""
    now, state = max((r[1] for r in rows), default=None), {}
    for seq, at, op, key, data, _ in sorted(rows):
        if op == "clear":
            state = {}
        elif key is None:
            continue
        elif op == "set":
            state[key] = [data, at, at]
        elif op == "get" and key in state:
            state[key][2] = at
        elif op == "invalidate":
            state.pop(key, None)
    live = [(k, d, len((d or "").encode())) for k, (d, s, _) in sorted(state.items(), key=lambda x: (-int((x[1][2] - BEGIN).total_seconds()), x[0])) if (now - s).total_seconds() < limit]
    out, total = [], 0
    for k, d, n in live:
        total += n
        if total <= budget:
            out.append((k, d, n))
    return sorted(out, key=repr)


@pytest.mark.parametrize("step, budget", [(900, 300), (0.01, 400), (0.4, 50), (40, 10**9), (40, 0)])
def test_cache_equals_a_plain_one(spark, step, budget):
    """Uses over days and thousands within seconds; sets of null and empty data, null keys and ops, clears."""
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        op = rng.choices(["set", "get", "invalidate", "clear", None], [60, 40, 8, 0.1, 1])[0]
        rows.append((i, BEGIN + timedelta(seconds=round(i * step, 6)), op, rng.choice([None, *map(str, range(150))]), rng.choice([None, "", "é", "abcdef", "x" * 20]), i))
    # Hex keys, as content has.
    rows = [(*r[:3], r[3] and f"{int(r[3]) * 7919 % 65521:04x}", *r[4:]) for r in rows]
    log = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows, 500_000, budget)
    got = sorted(((r.key, r.data, r.size) for r in cache.held(log, 500_000, budget).collect()), key=repr)
    assert got == want
    again = cache.held(cache.bounded_log(log, 500_000, budget), 10**9, budget)
    assert sorted(((r.key, r.data, r.size) for r in again.collect()), key=repr) == want


def test_found_and_empty(spark):
    log = spark.createDataFrame([(0, BEGIN, "set", "k", "v", 0), (1, BEGIN, "set", "gone", "v", 0), (2, BEGIN, "invalidate", "gone", None, 0)], SCHEMA)
    wanted = spark.createDataFrame([("k", 1), ("k", 2), ("gone", 3), ("new", 4)], "key string, n int")
    assert sorted((r.n, r.data) for r in cache.found(wanted, log).collect()) == [(1, "v"), (2, "v"), (3, None), (4, None)]
    assert cache.held(log.where("false")).count() == 0
    keys = [r.k for r in spark.createDataFrame([("a b\n",), (" a b",), (None,), ("",)], "t string").select(cache.content_key(F.col("t")).alias("k")).collect()]
    assert keys[0] == keys[1] and keys[2] == keys[3] != keys[0]
