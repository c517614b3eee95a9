"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key scaled by its quality weight; the smallest keys of a source come
first. A source's target is met by complete epochs over all its documents, then by the documents with
the smallest keys until the rest of the budget is used up; the last of them is cut to fit. The weight is
the score of the quality classifier where labels are given, else it falls with the junk symbols per word.

Defined cases: a null or empty text has size 0 and takes nothing; a null source is a source of its own,
last in order; repeated rows are mixed row by row; equal keys go by doc_id; other columns are ignored;
labels of one class alone weigh all documents alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexiforge.llm import quality
from lexiforge.llm.common import cut, table

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (1, 2, 3)
MOST = 3
#: Keys of a source are dealt into bins of about so many, whose sums place a document without sorting the source.
PER_BIN = 1024
#: Sources, and the bins of all sources, are put in order in ranges of about so many.
PER_RANGE = 50_000
LEAST_WEIGHT = 0.05
_JUNK = r"[!|%$&*#<>{}\[\]=+~^\\]"


def junk_weight(text: Column, size: Column) -> Column:
    """LEAST_WEIGHT to 1: falls with the number of junk symbols per word."""
    return F.greatest(F.lit(LEAST_WEIGHT), 1 - F.regexp_count(text, F.lit(_JUNK)) / F.greatest(size, F.lit(1)))


def row_hash() -> Column:
    """Tells rows of one doc_id apart by text and source."""
    return F.xxhash64(F.col("text").cast("string"), F.col("source").cast("string"))


def weighed(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, row, size, weight): row tells rows of one doc_id apart. Texts are read once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    facts = {"source": F.col("source").cast("string"), "row": row_hash(), "size": size}
    if labels is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(n) for n, c in facts.items()], junk_weight(text, size).alias("weight"))
    rows = cut(quality.measured(docs, **facts))
    scored = quality.with_score(rows, quality.learned(rows, labels))
    return scored.select("doc_id", *facts, F.greatest(F.lit(LEAST_WEIGHT), "score").alias("weight"))


def drawn(docs: DataFrame, seed: int = 42, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, row, source, name, size, key): name is never null, key above zero."""
    unit = (F.shiftrightunsigned(F.xxhash64("doc_id", "row", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    key = F.greatest(-F.log(unit) / F.col("weight"), F.lit(1e-300))
    return weighed(docs, labels).select("doc_id", "row", "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("name"), "size", key.alias("key"))


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], per_range: int = PER_RANGE) -> DataFrame:
    """rows with the sums over all rows before each, in an order without ties.

    Rows are dealt into ranges of that order; only the ranges' own sums, a row per range, are summed in one place.
    """
    ranges = max(1, -(-rows.count() // per_range))
    dealt = cut(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    whole = dealt.groupBy("_range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    whole = whole.select("_range", *[F.coalesce(F.sum(n).over(before(Window.orderBy("_range"))), F.lit(0)).alias(f"_{n}") for n in sums])
    own = [(F.coalesce(F.sum(c).over(before(Window.partitionBy("_range").orderBy(*order))), F.lit(0))).alias(n) for n, c in sums.items()]
    out = dealt.select("*", *own).join(F.broadcast(whole), "_range")
    return out.select(*rows.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def targets(sized: DataFrame, cycle: tuple[int, ...] = CYCLE, most: int = MOST, per_range: int = PER_RANGE) -> DataFrame:
    """(name, source_size, target) per source.

    Sources fill up in the order of most * size / weight. While those before one are full, each weight
    unit of the others gets what is left over by the weight left over; the first source that this does
    not fill gives the share of all that follow.
    """
    per = cut(sized.groupBy("name", "source").agg(F.sum("size").alias("source_size")))
    by_name = F.col("source").asc_nulls_last()
    per = running(per, [by_name], {"turn": F.lit(1)}, per_range)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("turn") % len(cycle) + 1).cast("int")))
    per = cut(per.withColumn("cap", F.col("source_size") * float(most)).withColumn("full_at", F.col("cap") / F.col("weight")))
    every = per.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    per = running(per, [F.col("full_at").asc(), by_name], {"full": F.col("cap"), "weight_full": F.col("weight")}, per_range)
    per = cut(per.withColumn("unit", (F.lit(every["size"]) - F.col("full")) / (F.lit(every["weight"]) - F.col("weight_full"))))
    share = per.where("unit < full_at").agg(F.min_by("unit", F.struct("full_at", "name")).alias("share")).first()["share"]
    target = F.col("cap") if share is None else F.least(F.col("cap"), F.lit(share) * F.col("weight"))
    return per.select("name", "source_size", target.alias("target"))


def mix(docs: DataFrame, seed: int = 42, cycle: tuple[int, ...] = CYCLE, most: int = MOST, per_bin: int = PER_BIN, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, row), one row per document.

    A key's place in its source is the sum over all lower bins of the source plus the sum over lower
    keys in its own bin, so a source with a third of all rows is spread over as many groups as it needs.
    Bins are equal steps of the key's logarithm, which has the same spread whatever the weight: a step
    holds at most its own length, over e, of the rows of a source.
    """
    sized = cut(drawn(docs, seed, labels))
    step = min(1.0, per_bin * math.e / max(1, sized.count()))
    goals = cut(targets(sized, cycle, most))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    binned = sized.withColumn("bin", F.floor(F.log("key") / step))
    sums = binned.groupBy("name", "bin").agg(F.sum("size").alias("bin_size"))
    sums = cut(running(sums, [F.col("name").asc(), F.col("bin").asc()], {"before": F.col("bin_size")}))
    first = sums.groupBy("name").agg(F.min("before").alias("first"))
    sums = cut(sums.join(first.join(goals, "name"), "name").withColumn("below", F.col("before") - F.col("first")).drop("bin_size", "before", "first"))
    within = Window.partitionBy("name", "bin").orderBy("key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = binned.join(sums, ["name", "bin"]).withColumn("sooner", F.col("below") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("sooner")))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"), "row")


def take(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it was taken, the last copy cut after its last word taken.

    Rows equal in id, text and source are merged before the join, and one is taken as often as all of them together.
    """
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_lf_path")]
    plan = cut(plan.where("taken > 0").groupBy(*key, F.col("row").alias("_lf_row")).agg(F.sum("taken").alias("_lf_taken"), F.first("size").alias("_lf_size")))
    one = docs.select("*", *key, row_hash().alias("_lf_row"))
    one = one.join(plan, ["_lf_path", "_lf_row"]).dropDuplicates(["_lf_path", "_lf_row"])
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    part = (F.col("_lf_taken") % F.col("_lf_size")).cast("int")
    copies = F.concat(
        F.array_repeat(F.lit(None).cast("string"), F.floor(F.col("_lf_taken") / F.col("_lf_size")).cast("int")),
        F.when(part > 0, F.array(F.array_join(F.slice(words, F.lit(1), part), ""))).otherwise(F.expr("cast(array() as array<string>)")),
    )
    out = one.withColumn("_lf_cut", F.explode(copies))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_lf_cut").isNull(), F.col("n_chars")).otherwise(F.char_length("_lf_cut").cast("long")))
    return out.withColumn("text", F.coalesce("_lf_cut", "text")).select(docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels")).drop("row")
