"""Queries on files: dictionaries are written to the session's shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiforge.operators import lexicons as L, store
from lexiforge.plans.lexicon_plans import DICT, VOCAB, dictionary, vocab
from lexiforge.plans.shared import documents, table
from lexiforge.sources import files
from lexiforge.sources.shared import scratch


def as_text(rows: DataFrame, spark: SparkSession) -> str:
    """One file of lines; for dictionaries, whose size does not grow with the texts."""
    path = scratch(spark)
    rows.coalesce(1).write.text(path)
    return path


def csv_auto(spark, d):
    path = scratch(spark)
    dictionary(spark, d).select(F.col("rank").alias("Rank"), F.col("lemma").alias("Lemma"), F.col("pos").alias("PoS"), F.col("ipm").alias("Freq")).coalesce(1).write.csv(path, header=True)
    return files.csv_frequencies(spark, path).select("lemma", F.col("rank").cast("long").alias("rank"), "pos")


def tsv(spark, d):
    rows = dictionary(spark, d).select(F.concat_ws("\t", "lemma", "pos", F.regexp_replace(F.round("ipm", 3).cast("string"), "\\.", ","), F.col("rank").cast("string")))
    return files.tsv_frequencies(spark, as_text(rows, spark), shadowed=True)


def json_map(spark, d):
    entries = F.map_from_entries(F.collect_list(F.struct("lemma", F.array(F.col("rank").cast("string"), F.col("ipm").cast("string"), F.col("pos")))))
    return files.json_frequencies(spark, as_text(dictionary(spark, d).agg(F.to_json(entries)), spark)).select("lemma", F.col("rank").cast("long").alias("rank"), "pos")


def sentiments(spark, d):
    """(lemma, sentiment, stype, pos) of the languages' frequent words, as follows from their length."""
    pick = lambda names: F.get(F.array(*map(F.lit, names)), F.char_length("lemma") % len(names))
    return vocab(spark, d).select(F.col("word").alias("lemma")).distinct().select("lemma", pick(SENTIMENTS).alias("sentiment"), pick(KINDS).alias("stype"), pick(PARTS).alias("pos"))


SENTIMENTS, KINDS, PARTS = ["positive", "negative", "neutral"], ["fact", "opinion", "feeling", ""], ["Noun", "Verb"]


def json_senti(spark, d):
    entries = F.map_from_entries(F.collect_list(F.struct("lemma", F.array("sentiment", "stype", "pos"))))
    return files.json_sentiments(spark, as_text(sentiments(spark, d).agg(F.to_json(entries)), spark))


def json_list(spark, d):
    rows = vocab(spark, d).where("domain = 'en'").agg(F.to_json(F.collect_list(F.concat(F.lit(" "), F.upper("word")))))
    return files.json_words(spark, as_text(rows, spark), "en")


def convert(spark, d):
    """A list read, reduced to one row per lemma, written as a dictionary and read again."""
    path = scratch(spark)
    files.write_frequencies(L.best_by_ipm(tsv(spark, d)), path)
    return spark.read.json(path).select("lemma", F.col("value")[0].cast("long").alias("rank"), F.col("value")[2].alias("pos"))


def versioned(spark, d):
    path = scratch(spark)
    files.write_domain(vocab(spark, d), spark.createDataFrame([("en", "novelword")], "domain string, word string"), path)
    return spark.read.parquet(path).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def appended(spark, d):
    path = scratch(spark)
    rows = documents(spark, d).select(F.col("doc_id").alias("id"), F.regexp_count("text", F.lit(r"\p{L}+")).cast("long").alias("word_count"))
    store.append(rows.where("id % 2 = 0"), path)
    store.append(rows.where("id % 2 = 1"), path)
    return store.corpus_stats(spark.read.parquet(path)).select("n_texts", "n_words", "ready")


def region_lines(spark, d, encoding: str, before: str = ""):
    """The regions' names as one file of lines in an encoding, read back as a text."""
    path = scratch(spark)
    names = table(spark, d, "region").orderBy("r_regionkey").select(F.concat(F.lit(before), "r_name"))
    names.coalesce(1).write.option("encoding", encoding).text(path)
    written = [r.path for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    return files.read_texts(spark, written).select("ord", "text")


def pasted(spark, d):
    """Every turn of the conversations, pasted with the line ends of another system."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.concat("role", F.lit("\r\n"), F.regexp_replace("text", " ", "\r")).alias("text"))
    return files.paste(spark, turns).select("conv_id", "turn", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {
    "src_text": lambda s, d: region_lines(s, d, "UTF-8"), "src_local_enc": lambda s, d: region_lines(s, d, "windows-1251", "Регион "), "src_paste": pasted,
    "src_csv_auto": csv_auto, "src_csv_fixed": lambda s, d: tsv(s, d).select("lemma", F.col("rank").cast("long").alias("rank"), "pos"), "src_json_map_freq": json_map,
    "src_json_map_senti": json_senti, "src_json_list": json_list, "orc_convert_dict": convert, "snk_json_dict": versioned, "src_sqlite": appended,
}
_dict = f"with {DICT} select lemma, rank, pos from dict"
_short = f"with {DICT} select lemma, rank, case when pos like 'n%' then 'noun' else pos end as pos from (select lemma, rank, case pos when 'noun' then 'noun' when 'conj' then 'conj' else 'prep' end as pos from dict)"
_lines = lambda before: f"select 0::INT as ord, string_agg('{before}' || r_name || chr(10), '' order by r_regionkey) as text from region"
ORACLE = {
    "src_text": _lines(""), "src_local_enc": _lines("Регион "),
    "src_paste": "select conv_id, turn, t as text, length(t)::BIGINT as n_chars from (select conv_id, turn, regexp_replace(coalesce(role || chr(13) || chr(10) || replace(text, ' ', chr(13)), ''), '\\r\\n?', chr(10), 'g') as t from conversations)",
    "src_csv_auto": _dict, "src_csv_fixed": _short, "src_json_map_freq": _dict, "src_json_map_senti": f"with {VOCAB} select lemma, {SENTIMENTS}[length(lemma) % 3 + 1] as sentiment, {KINDS}[length(lemma) % 4 + 1] as stype, {PARTS}[length(lemma) % 2 + 1] as pos from (select distinct word as lemma from vocab)", "orc_convert_dict": _short,
    "src_json_list": f"with {VOCAB} select domain, word from vocab where domain = 'en'",
    "snk_json_dict": f"with {VOCAB} select domain, count(*) + case when domain = 'en' then 1 else 0 end as n from vocab group by domain",
    "src_sqlite": "select count(*) as n_texts, sum(len(regexp_extract_all(text, '\\p{L}+')))::BIGINT as n_words, sum(len(regexp_extract_all(text, '\\p{L}+'))) >= 500 and count(*) >= 3 as ready from documents",
}
