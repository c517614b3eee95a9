"""Queries on stores: logs made of documents and events, and the views of what holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.functions import constants as C
from lexiforge.operators import cache, store as S
from lexiforge.operators import tokens as T
from lexiforge.plans.shared import ANN, documents, sql_map, table, tokens

VERDICTS, CATEGORIES = ("exclude", "confirm", "restore"), ("archaic", "law", "vernacular", "other")


def annotation_log(spark, d):
    """One row per event: texts, lemmas and layers repeat, so later rows replace earlier ones."""
    e = table(spark, d, "events")
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), (i % len(names)).cast("int"))
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("t"), F.col("user_id") % 50).alias("text_hash"), F.col("event_type").alias("lemma"), pick(CATEGORIES[:3], F.col("event_id")).alias("layer"), pick(VERDICTS[:2], F.floor(F.col("event_id") / 7)).alias("verdict"), F.col("props").alias("context"), F.when(F.col("event_id") % 11 == 0, "delete").otherwise("put").alias("op"))


LOG = """lg as (select event_id as seq, 't' || (user_id % 50) as text_hash, event_type as lemma, ['archaic','law','vernacular'][event_id % 3 + 1] as layer, ['exclude','confirm'][(event_id // 7) % 2 + 1] as verdict, props as context, case when event_id % 11 = 0 then 'delete' else 'put' end as op from events),
cur as (select * from lg qualify row_number() over (partition by text_hash, lemma, layer order by seq desc) = 1), held as (select * from cur where op <> 'delete')"""


def cache_log(spark, d):
    """Events as uses of a cache: results of a user's requests are set and read, some are ended, once in a while all."""
    e = table(spark, d, "events")
    op = F.when(F.col("event_id") % 3001 == 3000, "clear").when(F.col("event_id") % 17 == 0, "invalidate").when(F.col("event_id") % 3 == 0, "get").otherwise("set")
    text = F.concat(F.lit(" request "), F.col("user_id"), F.lit("\n"))
    return e.select(F.col("event_id").alias("seq"), F.col("ts").alias("at"), op.alias("op"), cache.content_key(text).alias("key"), F.repeat("props", F.col("event_id").cast("int") % 9).alias("data"))


CACHE_DAYS, CACHE_BYTES = 8, 2000
CACHE = f"""cl as (select event_id as seq, ts, case when event_id % 3001 = 3000 then 'clear' when event_id % 17 = 0 then 'invalidate' when event_id % 3 = 0 then 'get' else 'set' end as op, md5('request ' || user_id) as key, repeat(props, event_id % 9) as data from events),
ck as (select key, max(seq) filter (op = 'set') as s, max(seq) filter (op = 'invalidate') as ended, max(ts) filter (op in ('set', 'get')) as used from cl group by 1),
live as (select ck.key, cl.data, used, strlen(cl.data) as size from ck join cl on cl.seq = s where s > coalesce(ended, -1) and s > coalesce((select max(seq) from cl where op = 'clear'), -1) and (select max(ts) from cl) - cl.ts < interval {CACHE_DAYS} day),
cs as (select *, sum(size) over (order by date_trunc('second', used) desc, key rows unbounded preceding) as total from live)"""


def dictionary_log(spark, d):
    """Documents' first words, some in capitals, as a user's dictionary."""
    docs = documents(spark, d)
    word = F.regexp_extract("text", r"\p{L}+", 0)
    return docs.select(F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.translate(word, S.ASCII_LOWER, S.ASCII_UPPER))).otherwise(word).alias("word"), F.get(F.array(*map(F.lit, CATEGORIES)), (F.col("doc_id") % 4).cast("int")).alias("category"), F.lit("put").alias("op"))


DICT_LOG = f"""dl as (select doc_id as seq, case when doc_id % 2 = 0 then ' ' || translate(regexp_extract(text, '\\p{{L}}+'), '{S.ASCII_LOWER}', '{S.ASCII_UPPER}') else regexp_extract(text, '\\p{{L}}+') end as word, ['archaic','law','vernacular','other'][doc_id % 4 + 1] as category from documents),
du as (select seq, trim(word) as word, category, translate(trim(word), '{S.ASCII_UPPER}', '{S.ASCII_LOWER}') as k from dl), dd as (select seq, word, category, k from du qualify row_number() over (partition by k, category order by seq desc) = 1)"""


def history(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.concat_ws(" ", F.upper("event_type"), F.col("user_id") % 3).alias("pattern"), (F.col("user_id") % 9).alias("result_count"), F.col("ts"))


HIST = "h as (select event_id as id, upper(event_type) || ' ' || (user_id % 3) as pattern, user_id % 9 as result_count, ts from events)"


def corpus(spark, d):
    t = tokens(spark, d)
    return S.corpus_rows(documents(spark, d), T.corpus_lemmas(t), F.col("source"))


CORPUS = f"{ANN}, corpus as (select doc_id as id, any_value(source) as domain, count(*) as word_count from ann group by doc_id)"


def after_delete(spark, d):
    log = annotation_log(spark, d)
    gone = S.tombstones(S.annotations(log), F.col("lemma") == "click", F.lit(1 << 40).cast("long"))
    return S.annotations(log.unionByName(gone.select(*log.columns)))


QUERIES = {
    "snk_cache": lambda s, d: cache.held(cache_log(s, d), CACHE_DAYS * 24 * 3600, CACHE_BYTES).select("key", "data", "size"),
    "snk_upsert_ann": lambda s, d: S.annotations(annotation_log(s, d)).select("text_hash", "lemma", "layer", "verdict", "seq"),
    "win_latest": lambda s, d: S.latest(annotation_log(s, d).drop("op"), ["text_hash", "lemma"]).select("text_hash", "lemma", "verdict", "seq"),
    "snk_deletes": lambda s, d: after_delete(s, d).select("text_hash", "lemma", "layer", "seq"),
    "orc_annotate_write": lambda s, d: after_delete(s, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n")),
    "agg_ann_stats": lambda s, d: S.annotation_stats(S.annotations(annotation_log(s, d))),
    "prs_annotation_list": lambda s, d: S.annotation_list(S.annotations(annotation_log(s, d)), 20).select("seq", "lemma", "context"),
    "snk_upsert_dict": lambda s, d: S.dictionary(dictionary_log(s, d)).select("word", "category", "seq"),
    "prs_user_dict_list": lambda s, d: S.dictionary_list(S.dictionary(dictionary_log(s, d))).select("word", "label"),
    "snk_history": lambda s, d: documents(s, d).select(*S.history_row("NOUN ADJ", 3, F.col("text"), F.date_format(F.lit("2024-01-02 03:04:05").cast("timestamp"), "yyyy-MM-dd HH:mm"), F.col("doc_id"))),
    "topk_recent": lambda s, d: S.recent(history(s, d), 100).select("id", "pattern", "result_count"),
    "win_unique_patterns": lambda s, d: S.unique_patterns(history(s, d), 5),
    "agg_hist_count": lambda s, d: history(s, d).agg(F.count(F.lit(1)).alias("n")),
    "scan_all_ordered": lambda s, d: history(s, d).orderBy(F.desc("id")).select("id", "pattern"),
    "snk_corpus_add": lambda s, d: corpus(s, d).select("id", "domain", "word_count"),
    "agg_corpus_stats": lambda s, d: S.corpus_stats(corpus(s, d)),
    "agg_corpus_words": lambda s, d: corpus(s, d).agg(F.sum("word_count").alias("n_words")),
    "prs_corpus_status": lambda s, d: corpus(s, d).groupBy("domain").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("word_count").alias("n_words")),
}

ORACLE = {
    "snk_cache": f"with {CACHE} select key, data, size from cs where total <= {CACHE_BYTES}",
    "snk_upsert_ann": f"with {LOG} select text_hash, lemma, layer, verdict, seq from held",
    "win_latest": f"with {LOG} select text_hash, lemma, verdict, seq from lg qualify row_number() over (partition by text_hash, lemma order by seq desc) = 1",
    "snk_deletes": f"with {LOG} select text_hash, lemma, layer, seq from held where lemma <> 'click'",
    "orc_annotate_write": f"with {LOG} select verdict, count(*) as n from held where lemma <> 'click' group by 1",
    "agg_ann_stats": f"with {LOG} select count(*) as total, count(*) filter (verdict = 'exclude') as excluded, count(*) filter (verdict = 'confirm') as confirmed from held",
    "prs_annotation_list": f"with {LOG} select seq, lemma, case when length(context) > 20 then substring(context, 1, 18) || '…' else context end as context from held",
    "snk_upsert_dict": f"with {DICT_LOG} select word, category, seq from dd",
    "prs_user_dict_list": f"with {DICT_LOG} select word, coalesce({sql_map({k: v for k, (v, _) in C.LAYERS.items()} | C.DOMAINS)}[category], category) as label from dd",
    "snk_history": "select doc_id as id, '2024-01-02 03:04' as ts, 'NOUN ADJ' as pattern, 3::BIGINT as result_count, substring(translate(text, chr(10), ' '), 1, 80) as text_snippet from documents",
    "topk_recent": f"with {HIST} select id, pattern, result_count from h order by id desc limit 100",
    "win_unique_patterns": f"with {HIST} select pattern, max(id) as last_id from h group by 1 order by 2 desc limit 5",
    "agg_hist_count": "select count(*) as n from events",
    "scan_all_ordered": f"with {HIST} select id, pattern from h",
    "snk_corpus_add": f"with {CORPUS} select * from corpus",
    "agg_corpus_stats": f"with {CORPUS} select count(*) as n_texts, sum(word_count)::BIGINT as n_words, max(id) as last_id, sum(word_count) >= 500 and count(*) >= 3 as ready, greatest(0, 500 - sum(word_count))::BIGINT as words_needed from corpus",
    "agg_corpus_words": f"with {CORPUS} select sum(word_count)::BIGINT as n_words from corpus",
    "prs_corpus_status": f"with {CORPUS} select domain, count(*) as n_texts, sum(word_count)::BIGINT as n_words from corpus group by 1",
}
