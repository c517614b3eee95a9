"""Stores as append-only logs with views of the latest state: corpus, annotations, user dictionary, queries.

Files in a lake are not changed in place. A change is a row with a growing seq and an op ("put" or
"delete"); what holds is the last row of each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexiforge.functions import constants as C
from lexiforge.functions.text import lookup, one_line

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A corpus of so many words and texts is ready for training.
LEAST_WORDS, LEAST_TEXTS = 500, 3


def fold_ascii(word: Column) -> Column:
    """Lower case for A to Z alone, as the store compares words: Слово and слово are two words."""
    return F.translate(word, ASCII_UPPER, ASCII_LOWER)


def latest(log: DataFrame, keys: list[str | Column], seq: str = "seq") -> DataFrame:
    """The last row of each key, unless it deletes; one grouped maximum, no sort."""
    named = [F.col(k).alias(f"_k{i}") if isinstance(k, str) else k.alias(f"_k{i}") for i, k in enumerate(keys)]
    row = F.max_by(F.struct(*log.columns), seq).alias("row")
    out = log.select("*", *named).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(row).select("row.*")
    return out.where(F.coalesce("op", F.lit("put")) != "delete") if "op" in log.columns else out


def annotations(log: DataFrame) -> DataFrame:
    """The latest verdict per (text_hash, lemma, layer)."""
    return latest(log, ["text_hash", "lemma", "layer"])


def dictionary(log: DataFrame) -> DataFrame:
    """The latest entry per word and category."""
    return latest(log, [fold_ascii(F.trim("word")), "category"]).withColumn("word", F.trim("word"))


def tombstones(current: DataFrame, where: Column, seq: Column) -> DataFrame:
    """Rows to append so that what matches is gone: one key, one id or all."""
    return current.where(where).withColumns({"op": F.lit("delete"), "seq": seq})


def corpus_rows(docs: DataFrame, lemmas: DataFrame, domain: Column | None = None) -> DataFrame:
    """(id, text, lemmas, domain, word_count) to append; a text that is blank or has no lemmas is left out."""
    out = docs.join(lemmas.select("doc_id", "lemmas"), "doc_id").where((F.trim("text") != "") & (F.size("lemmas") > 0))
    return out.select(F.col("doc_id").alias("id"), "text", "lemmas", (F.lit("") if domain is None else domain).alias("domain"), F.size("lemmas").cast("long").alias("word_count"))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """One row: n_texts, n_words, last_id, ready, words_needed."""
    out = corpus.agg(F.count(F.lit(1)).alias("n_texts"), F.coalesce(F.sum("word_count"), F.lit(0)).cast("long").alias("n_words"), F.max("id").alias("last_id"))
    return out.withColumns({"ready": (F.col("n_words") >= LEAST_WORDS) & (F.col("n_texts") >= LEAST_TEXTS), "words_needed": F.greatest(F.lit(0).cast("long"), LEAST_WORDS - F.col("n_words"))})


def annotation_stats(current: DataFrame) -> DataFrame:
    """One row: total, excluded, confirmed."""
    of = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)), F.lit(0)).cast("long")
    return current.agg(F.count(F.lit(1)).alias("total"), of("exclude").alias("excluded"), of("confirm").alias("confirmed"))


def annotation_list(current: DataFrame, size: int = 60) -> DataFrame:
    """Newest first, a long context cut short."""
    shown = F.when(F.char_length("context") > size, F.concat(F.substring("context", 1, size - 2), F.lit("…"))).otherwise(F.col("context"))
    return current.withColumn("context", shown).orderBy(F.desc("seq"))


def dictionary_list(current: DataFrame) -> DataFrame:
    """Words in order with the label of their layer or domain."""
    label = lookup({k: v for k, (v, _) in C.LAYERS.items()} | C.DOMAINS, F.col("category"))
    return current.withColumn("label", F.coalesce(label, "category")).orderBy(fold_ascii(F.col("word")), "word")


def history_row(pattern: str, result_count: int, text: Column, ts: Column, id_: Column) -> list[Column]:
    """Columns of a query log row; the snippet is 80 characters on one line."""
    return [id_.alias("id"), ts.alias("ts"), F.lit(pattern).alias("pattern"), F.lit(result_count).cast("long").alias("result_count"), one_line(text).alias("text_snippet")]


def recent(rows: DataFrame, k: int, id_: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(id_)).limit(k)


def unique_patterns(history: DataFrame, k: int = 50) -> DataFrame:
    """(pattern, last_id) by the latest use."""
    return history.groupBy("pattern").agg(F.max("id").alias("last_id")).orderBy(F.desc("last_id")).limit(k)
