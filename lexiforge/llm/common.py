"""What the operators of this subpackage share: reading tables, cutting lineage, components of a graph."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local[") or sc.master == "local":
        own = tempfile.mkdtemp(prefix="lexiforge-checkpoint-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(own)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")


#: Spark deletes the shuffle files of a query at its end while this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, where it outlives lost executors.

    What was shuffled on the way is deleted once the checkpoint is written, since nothing reads it again.
    """
    conf = df.sparkSession.conf
    ensure_checkpoint_dir(df.sparkSession)
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        # The setting is read when a DataFrame is made, so that df itself would not have it.
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken, name = {c.lower() for c in df.columns}, f"_lf_{stem}"
    while name in taken:
        name += "_"
    return name


def fold_bucket(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; 0 marks held-out rows. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b: longs); root is the smallest node of its component.

    Alternating large-star and small-star steps: each is one grouped minimum, combined before its
    shuffle, and one join. The minima are cut off first, so that both join sides come straight from
    an exchange and adaptive execution can split a hub that holds a large part of all edges.
    An empty edge table gives an empty result; self loops and repeated edges are harmless.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    print_of = lambda d: tuple(d.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    last = print_of(e)
    if not last[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        smallest = cut(e.groupBy("u").agg(F.min("v").alias("m")))
        large = cut(
            e.join(smallest.select(F.col("u").alias("v"), "m"), "v", "left")
            .select("u", F.coalesce("m", "v").alias("v")).distinct()
        )
        smallest = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        e = cut(
            large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()
        )
        now = print_of(e)
        if now == last:
            roots = e.select("v").distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
        last = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
