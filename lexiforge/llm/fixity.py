"""Merkle fixity audit of WARC records.

Each record is hashed; records in the order of their ids form ranges of 64, those again ranges of 64, up
to one root. A range's hash covers the id, byte length and hash of each child in order, so it stands for
an ordered stretch of offsets. Two replicas with the same root are the same. Otherwise the audit descends
from the root and looks only at the children of ranges that differ, until it has the damaged records.

Ranges are cut by id, not by count, so that a lost record changes its own branch alone.

Defined cases: a null url or html counts as empty; a null page_id is a key of its own, before all
others; records with the same id, repeated rows among them, form one leaf whose hash covers all of them
in any order; an empty replica has no root, and then all records of the other are missing or extra;
other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexiforge.llm.common import cut, table

BITS = 6
#: Offsets count from the start of a file, which holds this many ids.
FILE_BITS = 12
_NO_ID = -(2**63)


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The WARC record of a page."""
    body, text = F.coalesce(html, F.lit("")), lambda x: F.coalesce(x.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), text(url), F.lit("\r\nWARC-Record-ID: <urn:page:"), text(page_id),
        F.lit(">\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def leaves(pages: DataFrame) -> DataFrame:
    """(id, size, digest, n), one row per page id; records are hashed where they are read."""
    one = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(_NO_ID)).alias("id"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    one = one.select("id", F.octet_length("record").cast("long").alias("size"), F.sha2("record", 256).alias("digest"))
    same = one.groupBy("id", "size", "digest").agg(F.count(F.lit(1)).alias("k"))
    mark = lambda seed: F.bit_xor(F.xxhash64("digest", "k", F.lit(seed)))
    per = same.groupBy("id").agg(F.sum(F.col("size") * F.col("k")).alias("size"), F.min("digest").alias("least"), F.sum("k").alias("n"), F.concat_ws(":", mark(1), mark(2), mark(3), mark(4)).alias("all"))
    return per.select("id", "size", F.when(F.col("n") == 1, F.col("least")).otherwise(F.sha2(F.concat_ws("|", "n", "all"), 256)).alias("digest"), "n")


def tree(bottom: DataFrame, height: int) -> list[DataFrame]:
    """Levels from the leaves to the root, each (id, size, digest); every node has at most 64 children."""
    levels = [bottom.select("id", "size", "digest")]
    for k in range(height):
        top = k == height - 1
        parent = F.lit(0).cast("long") if top else F.shiftright("id", BITS)
        children = F.transform(F.array_sort(F.collect_list(F.struct("id", "size", "digest"))), lambda x: F.concat_ws(":", x["id"], x["size"], x["digest"]))
        levels.append(cut(levels[-1].groupBy(parent.alias("id")).agg(F.sum("size").alias("size"), F.sha2(F.array_join(children, ","), 256).alias("digest"))))
    return levels


def height_of(*replicas: DataFrame) -> int:
    """Levels above the leaves, such that the last but one has at most 64 nodes."""
    ids = reduce(DataFrame.unionByName, [r.select("id") for r in replicas]).agg(F.min("id"), F.max("id")).first()
    low, high = ids[0] or 0, ids[1] or 0
    height = 1
    while high - low >= 1 << BITS:
        low, high, height = low >> BITS, high >> BITS, height + 1
    return height


def descend(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """(id, status) of the leaves that differ: corrupt, missing (there) or extra (there)."""
    at = None
    for k in range(len(ours) - 1, -1, -1):
        a, b = (x.select("id", F.col("digest").alias(name)) for x, name in ((ours[k], "a"), (theirs[k], "b")))
        if at is not None:
            up = F.lit(0).cast("long") if k == len(ours) - 2 else F.shiftright("id", BITS)
            a, b = (x.withColumn("up", up).join(at, "up", "left_semi").drop("up") for x in (a, b))
        found = a.join(b, "id", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
        at = cut(found.select(F.col("id").alias("up"), F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("corrupt").alias("status")))
    return at.withColumnRenamed("up", "id")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(page_id, file_id, offset, length, digest, status) for every record of either replica.

    offset and length place the record in the primary's file; an extra record has neither.
    """
    ours, theirs = cut(leaves(primary)), cut(leaves(replica))
    height = height_of(ours, theirs)
    damage = descend(tree(ours, height), tree(theirs, height))
    file_id = F.shiftright("id", FILE_BITS)
    before = Window.partitionBy("file_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    placed = ours.withColumn("file_id", file_id).withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    known = placed.join(damage.where("status <> 'extra'"), "id", "left").select("id", "file_id", "offset", F.col("size").alias("length"), "digest", F.coalesce("status", F.lit("ok")).alias("status"))
    extra = theirs.join(damage.where("status = 'extra'"), "id").select("id", file_id.alias("file_id"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("length"), "digest", "status")
    return known.unionByName(extra).select(F.nullif("id", F.lit(_NO_ID)).alias("page_id"), "file_id", "offset", "length", "digest", "status")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica for the query: the same pages, some altered, lost or added, as its SQL has them too."""
    kept = pages.where("page_id is null or page_id % 389 <> 7")
    html = F.when(F.col("page_id") % 97 == 13, F.concat(F.coalesce("html", F.lit("")), F.lit("\u0000"))).otherwise(F.col("html"))
    added = pages.where("page_id % 991 = 5").select((-1 - F.col("page_id")).alias("page_id"), "url", "html")
    return kept.select("page_id", "url", html.alias("html")).unionByName(added)


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return audit(pages, damaged(pages))


_RECORD = "concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), 'WARC-Record-ID: <urn:page:', {id}, '>', chr(13), chr(10), 'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10), coalesce(html, ''), chr(13), chr(10), chr(13), chr(10))"
OP1_SQL = f"""
with ours as (select page_id, page_id >> 12 as file_id, {_RECORD.format(id="page_id")} as r from pages)
select page_id, file_id,
    coalesce(sum(strlen(r)) over (partition by file_id order by page_id rows between unbounded preceding and 1 preceding), 0)::BIGINT as "offset",
    strlen(r)::BIGINT as length, sha256(r) as digest,
    case when page_id % 389 = 7 then 'missing' when page_id % 97 = 13 then 'corrupt' else 'ok' end as status
from ours
union all
select -1 - page_id, (-1 - page_id) >> 12, null, null, sha256({_RECORD.format(id="(-1 - page_id)")}), 'extra' from pages where page_id % 991 = 5
"""
