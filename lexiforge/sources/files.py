"""Files as tables: texts in several encodings, Word documents, dictionaries in JSON, CSV, TSV and zip archives."""

from __future__ import annotations

import io
import json
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

# Encodings in the order in which they are tried.
ENCODINGS = ("utf-8", "cp1251", "cp866", "latin-1")
KINDS = (".txt", ".docx")
_WORD_NAMESPACE = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode(raw: bytes, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """The text in the first encoding that reads it; line ends become newlines."""
    for name in encodings:
        try:
            return raw.decode(name).replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            pass
    raise ValueError(f"none of {encodings} reads these bytes")


def docx_text(raw: bytes) -> str:
    """Body paragraphs that are not blank, a line each; tables, headers and footers are left out."""
    body = ElementTree.parse(zipfile.ZipFile(io.BytesIO(raw)).open("word/document.xml")).getroot().find(f"{_WORD_NAMESPACE}body")
    lines = ["".join(t.text or "" for t in p.iter(f"{_WORD_NAMESPACE}t")) for p in body.findall(f"{_WORD_NAMESPACE}p")]
    return "\n".join(line for line in lines if line.strip())


def read_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, ord, text) of .txt and .docx files, each path once, in the order given; other kinds are refused."""
    paths = list(dict.fromkeys(paths))
    for p in paths:
        if not p.lower().endswith(KINDS):
            raise ValueError(f"only {' and '.join(KINDS)} files can be read: {p}")
    if not paths:
        return spark.createDataFrame([], "path string, ord int, text string")

    @F.pandas_udf("string")
    def text_of(path: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([docx_text(c) if p.lower().endswith(".docx") else decode(c) for p, c in zip(path, content)])

    order = spark.createDataFrame([(p.split("/")[-1], p, i) for i, p in enumerate(paths)], "name string, given string, ord int")
    files = spark.read.format("binaryFile").load(paths).withColumn("text", text_of("path", "content"))
    same = F.col("path").endswith(F.col("given")) | (F.regexp_replace("path", "^[a-z]+:/*", "/") == F.regexp_replace("given", "^[a-z]+:/*", "/"))
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(F.broadcast(order), "name").where(same).select("path", "ord", "text").orderBy("ord")


def paste(spark: SparkSession, texts: list[str] | DataFrame) -> DataFrame:
    """Pasted texts as documents: a list is numbered; rows keep their columns, with plain line ends and no null text."""
    if isinstance(texts, DataFrame):
        return texts.withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"))
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def json_words(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """(domain, word) of a JSON array of words, or of an object's keys: stripped, lower case; other values are skipped."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.when(F.trim("value").startswith("["), F.filter(F.from_json("value", "array<string>"), lambda w: w.isNotNull())).otherwise(F.map_keys(F.from_json("value", "map<string,string>")))).alias("word"))
    return rows.select(F.lit(domain).alias("domain"), F.lower(F.trim("word")).alias("word"))


def json_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(lemma, rank, ipm, pos) of an object of [rank, ipm, pos]."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("lemma", "v"))
    return rows.select("lemma", F.col("v")[0].cast("int").alias("rank"), F.col("v")[1].cast("double").alias("ipm"), F.col("v")[2].alias("pos"))


def json_sentiments(spark: SparkSession, path: str) -> DataFrame:
    """(lemma, sentiment, stype, pos) of an object of [sentiment, type, pos]."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("lemma", "v"))
    return rows.select("lemma", F.col("v")[0].alias("sentiment"), F.col("v")[1].alias("stype"), F.col("v")[2].alias("pos"))


def json_layers(spark: SparkSession, path: str) -> DataFrame:
    """(ord, surface, layers) of an object whose values are a layer or an array of them, in the file's order.

    JSON objects have no order in a map column, and the order decides ties, so the file is read on the
    driver: a lexicon, not data.
    """
    text = spark.read.text(path, wholetext=True).first()[0]
    pairs = json.loads(text, object_pairs_hook=list)
    rows = [(i, k, v if isinstance(v, list) else [v]) for i, (k, v) in enumerate(pairs)]
    return spark.createDataFrame(rows, "ord int, surface string, layers array<string>")


# Names of columns in frequency lists.
ALIASES = {
    "rank": ["№", "N", "Rank", "rank", "#", "no", "No"], "lemma": ["Лемма", "lemma", "Lemma", "word", "Word"],
    "pos": ["Часть речи", "PoS", "pos", "POS", "tag", "Tag"], "ipm": ["ipm", "Ipm", "IPM", "Freq", "freq", "frequency", "Частота на миллион", "freq_ipm"],
}


def csv_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(ord, lemma, rank, ipm, pos) of a list with a header, tabs if the header has one, else commas.

    Rows without a lemma, with a comment, with what is no number, or with neither rank nor ipm are left out.
    """
    header = spark.read.text(path).first()[0]
    rows = spark.read.csv(path, header=True, sep="\t" if "\t" in header else ",", inferSchema=False)
    named = {k: next((c for a in names for c in rows.columns if c == a), None) for k, names in ALIASES.items()}
    of = lambda k, other: F.coalesce(F.trim(F.col(f"`{named[k]}`")), F.lit(other)) if named[k] else F.lit(other)
    empty = lambda x: F.when(x == "", "0").otherwise(x)
    out = rows.select(F.monotonically_increasing_id().alias("ord"), of("lemma", "").alias("lemma"), empty(of("rank", "0")).try_cast("int").alias("rank"), F.regexp_replace(empty(of("ipm", "0")), ",", ".").try_cast("double").alias("ipm"), of("pos", "").alias("pos"))
    return out.where((F.col("lemma") != "") & ~F.col("lemma").startswith("#") & F.col("rank").isNotNull() & F.col("ipm").isNotNull() & ~((F.col("rank") == 0) & (F.col("ipm") == 0)))


def tsv_frequencies(spark: SparkSession, path: str, shadowed: bool = False) -> DataFrame:
    """(ord, lemma, rank, ipm, pos) of lines lemma, pos, ipm, rank with an optional header; only ranks above 0."""
    from lexiforge.operators.lexicons import short_pos

    parts = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.split("value", "\t").alias("p")).where(F.size("p") >= 4)
    cell = lambda i: F.get("p", F.lit(i))
    rows = parts.select("ord", F.lower(F.trim(cell(0))).alias("lemma"), F.coalesce(F.trim(cell(3)).try_cast("int"), F.lit(0)).alias("rank"), F.coalesce(F.regexp_replace(cell(2), ",", ".").try_cast("double"), F.lit(0.0)).alias("ipm"), short_pos(cell(1), shadowed).alias("pos"))
    return rows.where((F.col("lemma") != "") & (F.col("rank") > 0))


def docx_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of all documents in a folder: their paragraphs that are not blank, a line each, tables left out."""
    from lexiforge.sources.office import read_docx

    lines = F.transform(F.filter("blocks", lambda b: ~b["kind"].isin("head", "row") & b["cells"][0].rlike(r"(?U)\S")), lambda b: b["cells"][0])
    return read_docx(spark, path).select("name", F.array_join(lines, "\n").alias("text"))


def zip_lines(spark: SparkSession, path: str, encoding: str = "cp1251") -> DataFrame:
    """(ord, lemma, rank, ipm, pos) of lines of rank, ipm, word, pos in an archive or a folder of them; each member is read by a task of its own."""
    from lexiforge.sources.office import archive_lines

    rows = archive_lines(spark, path, encoding)
    p = F.split(F.trim("line"), r"\s+")
    out = rows.where(F.size(p) >= 3).select(F.col("no").alias("ord"), F.lower(F.get(p, F.lit(2))).alias("lemma"), F.get(p, F.lit(0)).try_cast("int").alias("rank"), F.regexp_replace(F.get(p, F.lit(1)), ",", ".").try_cast("double").alias("ipm"), F.coalesce(F.get(p, F.lit(3)), F.lit("")).alias("pos"))
    return out.where((F.col("rank") > 0) & F.col("ipm").isNotNull())


def write_frequencies(rows: DataFrame, path: str) -> None:
    """A dictionary as JSON lines of {lemma, value: [rank, ipm, pos]}, a part per task."""
    rows.select("lemma", F.array(F.col("rank").cast("string"), F.round("ipm", 3).cast("string"), F.col("pos")).alias("value")).write.mode("overwrite").json(path)


def write_domain(vocab: DataFrame, added: DataFrame, path: str) -> None:
    """A new version of a dictionary with the words that were added; the old one is left alone."""
    vocab.select("domain", "word").unionByName(added.select("domain", "word")).distinct().write.mode("errorifexists").partitionBy("domain").parquet(path)
