"""A cache of results by content: a log of its uses, and what it still holds after a time limit and a byte budget.

log: (seq, at, op, key, data); op is set, get, invalidate or clear; seq gives the order. A set replaces what
its key held, an invalidate ends one key, a clear ends all keys.

Defined cases: a key never set, and one whose last set is older than the limit, is not held; a null key or op
is ignored; null data is held and has no bytes; of equal sets the one with the greater seq counts; an empty log
holds nothing; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Results are held for so many seconds, and so many bytes in all.
TIME_LIMIT = 30 * 24 * 3600
BYTES = 500_000_000
_HOUR = 3600


def content_key(text: Column) -> Column:
    """The key of a text: MD5 without white space at its ends."""
    return F.md5(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""))


def _micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def live(log: DataFrame, time_limit: int = TIME_LIMIT) -> DataFrame:
    """(key, data, set_at, used_at, size) of what is set, neither ended nor too old at the log's latest time.

    One pass by key; latest time and last clear are one row.
    """
    now = log.agg(F.max("at").alias("now"), F.max(F.when(F.col("op") == "clear", F.col("seq"))).alias("cleared"))
    when = lambda *ops: F.col("op").isin(*ops)
    last = log.where("key is not null").groupBy("key").agg(
        F.max_by(F.when(when("set"), F.struct("seq", "at", "data")), F.when(when("set"), F.col("seq"))).alias("v"),
        F.max(F.when(when("invalidate"), F.col("seq"))).alias("ended"), F.max(F.when(when("set", "get"), F.col("at"))).alias("used_at"),
    )
    held = last.where("v is not null").join(F.broadcast(now)).where("v.seq > coalesce(ended, v.seq - 1) and v.seq > coalesce(cleared, v.seq - 1)")
    held = held.where(_micros("now") - _micros("v.at") < F.lit(time_limit * 1_000_000))
    return held.select("key", "v.data", F.col("v.at").alias("set_at"), "used_at", F.coalesce(F.octet_length("data"), F.lit(0)).cast("long").alias("size"))


def _running(entries: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """(by..., before, bytes): bytes of each group and of all groups in front of it."""
    sums = entries.groupBy(*by).agg(F.sum("size").alias("bytes"))
    return sums.withColumn("before", F.sum("bytes").over(Window.orderBy(*order)) - F.col("bytes"))


def held(log: DataFrame, time_limit: int = TIME_LIMIT, budget: int = BYTES) -> DataFrame:
    """What live() gives without the least recently used that go beyond the budget: the running sum of bytes from the latest second of use on, by key within a second, may not exceed it.

    Sums go by hours first, of which the time limit leaves a bounded number; one hour lies across the budget, and
    only its entries are summed by second and part of the keys, then those of one second and part one by one. So no
    task orders all entries.
    """
    second = F.floor(_micros("used_at") / 1_000_000)
    entries = live(log, time_limit).withColumns({"hour": F.floor(second / _HOUR), "second": second, "part": F.substring("key", 1, 2)})
    hours = _running(entries, ["hour"], [F.desc("hour")]).where(F.col("before") <= budget)
    near = entries.join(F.broadcast(hours), "hour")
    whole = near.where(F.col("before") + F.col("bytes") <= budget)
    across = near.where(F.col("before") + F.col("bytes") > budget).withColumn("sooner", F.col("before")).drop("before", "bytes")
    parts = _running(across, ["second", "part"], [F.desc("second"), F.asc("part")]).where(F.col("before") <= budget)
    rows = across.join(parts, ["second", "part"])
    own = Window.partitionBy("second", "part").orderBy("key")
    rows = rows.withColumn("sum", F.col("sooner") + F.col("before") + F.sum("size").over(own)).where(F.col("sum") <= budget)
    columns = ["key", "data", "set_at", "used_at", "size"]
    return whole.select(columns).unionByName(rows.select(columns))


def found(wanted: DataFrame, log: DataFrame, time_limit: int = TIME_LIMIT, budget: int = BYTES) -> DataFrame:
    """wanted with a column data: what the cache holds for each key, or null."""
    return wanted.join(held(log, time_limit, budget).select("key", "data"), "key", "left")


def bounded_log(log: DataFrame, time_limit: int = TIME_LIMIT, budget: int = BYTES) -> DataFrame:
    """A log with the same entries and nothing else, to write in place of a long one: sets, and the last use as a get."""
    kept = held(log, time_limit, budget)
    one = kept.select("key", "data", "used_at", F.explode(F.array(F.struct(F.lit(0).alias("seq"), F.lit("set").alias("op"), F.col("set_at").alias("at")), F.struct(F.lit(1).alias("seq"), F.lit("get").alias("op"), F.col("used_at").alias("at")))).alias("x"))
    return one.select(F.col("x.seq").cast("long").alias("seq"), "x.at", "x.op", "key", F.when(F.col("x.op") == "set", F.col("data")).alias("data"))
