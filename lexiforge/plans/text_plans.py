"""Queries on texts alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.functions import constants as C, text as X
from lexiforge.operators import internet, metrics, reports
from lexiforge.operators.tokens import explode_words
from lexiforge.plans.shared import LATIN, MARKERS, SENT, SHORT, SLANG, TOK, WORD, documents, sql_list, table

DIV = f"{TOK}, forms as (select doc_id, lower(text) as form, count(*) as n, sum(length(text)) as letters from tok group by all)"
DIV_COLUMNS = "sum(n)::BIGINT as n_words, count(*) as n_types, (count(*) filter (n = 1))::BIGINT as n_hapax, sum(letters)::BIGINT as n_letters, count(*)::DOUBLE / sum(n)::DOUBLE as ttr, (count(*) filter (n = 1))::DOUBLE / sum(n)::DOUBLE as hapax_share, sum(letters)::DOUBLE / sum(n)::DOUBLE as avg_word_len"
SENT_NUMBERS = "select doc_id, len(lens)::BIGINT as k, coalesce(list_sum(lens), 0)::BIGINT as s, coalesce(list_sum(list_transform(lens, lambda x: x * x)), 0)::BIGINT as q from sent"


def diversity(spark, d):
    return metrics.lexical_diversity(documents(spark, d))


def sentences(spark, d):
    return metrics.sentence_stats(documents(spark, d))


def _marks(text: str, terms) -> str:
    """Whole words of a text that are in a list, without look-around: the text is split at other characters."""
    return f"len(list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w in {sql_list(terms)}))"


def style(spark, d):
    return metrics.style_markers(documents(spark, d), MARKERS)


def profile(spark, d):
    return internet.internet_profile(documents(spark, d), SLANG, SHORT)


INET_COUNTS = {
    "emoji": C.EMOJI, "emoticons": C.EMOTICON, "hashtags": C.HASHTAG, "mentions": C.MENTION, "urls": C.URL, "repeated_punct": C.REPEATED,
}
INET = "select doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}'))::BIGINT as {k}" for k, p in INET_COUNTS.items()) + f""",
    len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[А-ЯЁA-Z]{{4,}}')))::BIGINT as caps,
    {_marks('text', SLANG)}::BIGINT as slang, {_marks('text', SHORT)}::BIGINT as abbreviations,
    len(list_filter(string_split_regex(text, '{C.SENTENCE_GAP}'), lambda s: regexp_matches(s, '^\\p{{Ll}}')))::BIGINT as missing_caps,
    len(regexp_extract_all(text, '{WORD}'))::BIGINT as n_words from documents"""
INET_SCORE = f"select *, least(1.0, ({' + '.join(f'{k} * {w}::DOUBLE' for k, w in C.INTERNET_WEIGHTS.items())}) / greatest(n_words, 1) * 5) as score0 from ({INET})"
LEVEL = "case when round(score * 100, 1) >= 50 then 'high' when round(score * 100, 1) >= 25 then 'medium' when round(score * 100, 1) >= 10 then 'low' else 'minimal' end"

_volume = lambda n: f"case when {n} >= 500 then 'identification' when {n} >= 100 then 'diagnostic' else 'insufficient' end"
_report = lambda n: f"case when {n} >= 500 then 'fit' when {n} >= 200 then 'preliminary' else 'insufficient' end"
_n = f"len(regexp_extract_all(text, '{WORD}'))"


def contexts(spark, d):
    docs = documents(spark, d).withColumn("at", F.locate("the", F.lower("text"))).where("at > 0")
    at = F.col("at") - 1
    snip = lambda around, strip, name: X.snippet(F.col("text"), at, at + 3, around, strip).alias(name)
    return docs.select("doc_id", snip(45, True, "strat"), snip(45, False, "checker"), snip(50, True, "punct"), snip(40, False, "speller"))


def _snip(around: int, strip: bool) -> str:
    part = f"translate(substring(text, greatest(0, a - {around}) + 1, least(length(text), a + 3 + {around}) - greatest(0, a - {around})), chr(10), ' ')"
    part = f"regexp_replace({part}, '^\\s+|\\s+$', '', 'g')" if strip else part
    return f"(case when a - {around} > 0 then '…' else '' end) || {part} || (case when a + 3 + {around} < length(text) then '…' else '' end)"


def batch(spark, d):
    own = documents(spark, d).unionByName(documents(spark, d)).dropDuplicates(["doc_id"])
    return reports.batch_summary(metrics.lexical_diversity(own))


def letters(spark, d):
    docs = documents(spark, d)
    n = lambda p, name: X.word_count(F.col("text"), p).alias(name)
    return docs.select("doc_id", n(C.WORD, "words"), n(C.CYRILLIC, "cyrillic"), n(C.CYRILLIC_2, "cyrillic_2"), n(LATIN, "any_letters"))


def stats_rows(spark, d):
    rows = metrics.lexical_diversity(documents(spark, d))
    cells = F.array(*[F.struct(F.lit(i).cast("long").alias("ord"), F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for i, k in enumerate(("n_words", "n_types", "n_hapax"))])
    return rows.select("doc_id", F.inline(cells))


QUERIES = {
    "tok_regex": lambda s, d: explode_words(documents(s, d)).select("doc_id", F.col("tok_idx").cast("long").alias("tok_idx"), "text"),
    "tok_regex_variants": letters,
    "tok_live_count": lambda s, d: documents(s, d).select("doc_id", X.word_count(F.col("text")).alias("n_words")),
    "tok_sent_split": lambda s, d: documents(s, d).select("doc_id", F.posexplode(X.sentence_lengths(F.col("text"))).alias("i", "n")).select("doc_id", F.col("i").cast("long").alias("sent"), F.col("n").cast("long").alias("n_words")),
    "tok_sent_count2": lambda s, d: documents(s, d).select("doc_id", X.blank_free_sentences(F.col("text")).alias("n_sentences")),
    "agg_diversity": diversity,
    "agg_word_count": lambda s, d: diversity(s, d).select("doc_id", "n_words"),
    "agg_ttr": lambda s, d: diversity(s, d).select("doc_id", "n_types", "ttr"),
    "agg_avg_word_len": lambda s, d: diversity(s, d).select("doc_id", "n_letters", "avg_word_len"),
    "agg_hapax": lambda s, d: diversity(s, d).select("doc_id", "n_hapax", "hapax_share"),
    "agg_sentences": sentences,
    "agg_sent_count": lambda s, d: sentences(s, d).select("doc_id", "n_sentences"),
    "agg_sent_len": lambda s, d: sentences(s, d).select("doc_id", "mean_len"),
    "agg_sent_var": lambda s, d: sentences(s, d).select("doc_id", "var_len"),
    "agg_style_markers": style,
    "agg_inet_profile": lambda s, d: profile(s, d).drop("level").withColumn("score", F.round("score", 6)),
    "cls_inet": lambda s, d: profile(s, d).groupBy("level").agg(F.count(F.lit(1)).alias("n")),
    "snk_inet_text": lambda s, d: internet.profile_text(profile(s, d)),
    "agg_total_err_words": lambda s, d: documents(s, d).select("doc_id", X.word_count(F.col("text"), C.CYRILLIC).alias("total")),
    "cls_volume_main": lambda s, d: documents(s, d).select("doc_id", X.volume_label(X.word_count(F.col("text"))).alias("volume")),
    "cls_volume_report": lambda s, d: documents(s, d).select("doc_id", X.report_volume_label(X.word_count(F.col("text"))).alias("volume")),
    "prj_text_hash": lambda s, d: documents(s, d).select("doc_id", X.text_hash(F.col("text")).alias("text_hash")),
    "prj_cache_key": lambda s, d: documents(s, d).select("doc_id", X.cache_key(F.col("text")).alias("key")),
    "prj_first_last": lambda s, d: documents(s, d).select("doc_id", X.head(X.words(F.col("text")), 6).alias("first"), X.tail(X.words(F.col("text")), 6).alias("last")),
    "prj_context": contexts,
    "orc_set_tokens": lambda s, d: documents(s, d).select("doc_id", X.word_count(F.col("text")).alias("n_tokens"), X.one_line(F.col("text")).alias("snippet")),
    "src_batch": lambda s, d: documents(s, d).unionByName(documents(s, d)).dropDuplicates(["doc_id"]).select("doc_id", F.char_length("text").cast("long").alias("n")),
    "snk_batch_docx": batch,
    "agg_batch": lambda s, d: batch(s, d).select("doc_id", "n_words", "n_errors", "fit"),
    "prs_stats_rows": stats_rows,
    "snk_report_text": lambda s, d: reports.as_text(reports.full_report(documents(s, d), diversity(s, d), sentences(s, d))),
    "agg_inet_pages": lambda s, d: table(s, d, "pages").select("page_id", F.regexp_count("html", F.lit(C.URL)).cast("long").alias("urls"), F.regexp_count("html", F.lit(C.EMOTICON)).cast("long").alias("emoticons")),
}

ORACLE = {
    "tok_regex": f"with {TOK} select doc_id, tok_idx, text from tok",
    "tok_regex_variants": f"select doc_id, {_n}::BIGINT as words, len(regexp_extract_all(text, '{C.CYRILLIC}'))::BIGINT as cyrillic, len(regexp_extract_all(text, '{C.CYRILLIC_2}'))::BIGINT as cyrillic_2, len(regexp_extract_all(text, '{LATIN}'))::BIGINT as any_letters from documents",
    "tok_live_count": f"select doc_id, {_n}::BIGINT as n_words from documents",
    "tok_sent_split": f"with {SENT} select doc_id, unnest(range(len(lens)))::BIGINT as sent, unnest(lens)::BIGINT as n_words from sent",
    "tok_sent_count2": f"select doc_id, len(list_filter(string_split_regex(text, '{C.SENTENCE_END}'), lambda s: regexp_matches(s, '\\S')))::BIGINT as n_sentences from documents",
    "agg_diversity": f"with {DIV} select doc_id, {DIV_COLUMNS} from forms group by doc_id",
    "agg_word_count": f"with {DIV} select doc_id, sum(n)::BIGINT as n_words from forms group by doc_id",
    "agg_ttr": f"with {DIV} select doc_id, count(*) as n_types, count(*)::DOUBLE / sum(n)::DOUBLE as ttr from forms group by doc_id",
    "agg_avg_word_len": f"with {DIV} select doc_id, sum(letters)::BIGINT as n_letters, sum(letters)::DOUBLE / sum(n)::DOUBLE as avg_word_len from forms group by doc_id",
    "agg_hapax": f"with {DIV} select doc_id, (count(*) filter (n = 1))::BIGINT as n_hapax, (count(*) filter (n = 1))::DOUBLE / sum(n)::DOUBLE as hapax_share from forms group by doc_id",
    "agg_sentences": f"with {SENT} select doc_id, k as n_sentences, s as n_words, q as sum_squares, coalesce(s::DOUBLE / nullif(k, 0)::DOUBLE, 0.0) as mean_len, case when k > 1 then (q * k - s * s)::DOUBLE / (k * k)::DOUBLE else 0.0 end as var_len from ({SENT_NUMBERS})",
    "agg_sent_count": f"with {SENT} select doc_id, k as n_sentences from ({SENT_NUMBERS})",
    "agg_sent_len": f"with {SENT} select doc_id, coalesce(s::DOUBLE / nullif(k, 0)::DOUBLE, 0.0) as mean_len from ({SENT_NUMBERS})",
    "agg_sent_var": f"with {SENT} select doc_id, case when k > 1 then (q * k - s * s)::DOUBLE / (k * k)::DOUBLE else 0.0 end as var_len from ({SENT_NUMBERS})",
    "agg_style_markers": " union all ".join(f"select doc_id, '{g}' as grp, '{m}' as marker, {_marks('text', (m,))}::BIGINT as n from documents" for g, ms in MARKERS.items() for m in ms),
    "agg_inet_profile": f"select * exclude (score0), round(score0, 6) as score from ({INET_SCORE})",
    "cls_inet": f"select level, count(*) as n from (select {LEVEL} as level from (select score0 as score from ({INET_SCORE}))) group by level",
    "agg_total_err_words": f"select doc_id, len(regexp_extract_all(text, '{C.CYRILLIC}'))::BIGINT as total from documents",
    "cls_volume_main": f"select doc_id, {_volume(_n)} as volume from documents",
    "cls_volume_report": f"select doc_id, {_report(_n)} as volume from documents",
    "prj_text_hash": "select doc_id, sha256(text)[1:16] as text_hash from documents",
    "prj_cache_key": "select doc_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as key from documents",
    "prj_first_last": f"select doc_id, case when len(w) > 6 then array_to_string(w[1:6], ' ') || '...' else coalesce(array_to_string(w, ' '), '') end as first, case when len(w) > 6 then '...' || array_to_string(w[-6:], ' ') else '' end as last from (select doc_id, regexp_extract_all(text, '{WORD}') as w from documents)",
    "prj_context": f"select doc_id, {_snip(45, True)} as strat, {_snip(45, False)} as checker, {_snip(50, True)} as punct, {_snip(40, False)} as speller from (select doc_id, text, instr(lower(text), 'the') - 1 as a from documents) where a >= 0",
    "orc_set_tokens": f"select doc_id, {_n}::BIGINT as n_tokens, substring(translate(text, chr(10), ' '), 1, 80) as snippet from documents",
    "src_batch": "select doc_id, length(text)::BIGINT as n from documents",
    "snk_batch_docx": f"with {DIV} select doc_id, n_words, ttr, 0::BIGINT as n_errors, {_report('n_words')} as fit, {_volume('n_words')} as volume from (select doc_id, {DIV_COLUMNS} from forms group by doc_id)",
    "agg_batch": f"with {DIV} select doc_id, n_words, 0::BIGINT as n_errors, {_report('n_words')} as fit from (select doc_id, {DIV_COLUMNS} from forms group by doc_id)",
    "prs_stats_rows": f"with {DIV}, r as (select doc_id, {DIV_COLUMNS} from forms group by doc_id) " + " union all ".join(f"select doc_id, {i}::BIGINT as ord, '{k}' as key, {k}::VARCHAR as value from r" for i, k in enumerate(("n_words", "n_types", "n_hapax"))),
    "agg_inet_pages": f"select page_id, len(regexp_extract_all(html, '{C.URL}'))::BIGINT as urls, len(regexp_extract_all(html, '{C.EMOTICON}'))::BIGINT as emoticons from pages",
}
ORACLE["snk_inet_text"] = f"select doc_id, printf('score: %.1f%% - %s', round(score * 100, 1), {LEVEL})" + "".join(f" || chr(10) || '{k}: ' || {k}" for k in internet.FEATURES) + f" as report from (select *, score0 as score from ({INET_SCORE}))"
_METRICS = ("n_words", "n_types", "ttr", "hapax_share", "avg_word_len", "n_sentences", "mean_len", "var_len")
_HEAD, _TAIL = (f"case when len(w) > 6 then {long} else {short} end" for long, short in (("array_to_string(w[1:6], ' ') || '...'", "coalesce(array_to_string(w, ' '), '')"), ("'...' || array_to_string(w[-6:], ' ')", "''")))
_REPORT = f"""with {DIV}, {SENT}, r as (select doc_id, {DIV_COLUMNS} from forms group by doc_id),
    t as (select doc_id, k as n_sentences, coalesce(s::DOUBLE / nullif(k, 0)::DOUBLE, 0.0) as mean_len, case when k > 1 then (q * k - s * s)::DOUBLE / (k * k)::DOUBLE else 0.0 end as var_len from ({SENT_NUMBERS})),
    d as (select doc_id, regexp_extract_all(text, '{C.CYRILLIC}') as w from documents),
    rows0 as (select doc_id, 1 as section, 0 as ord, 'start' as key, {_HEAD} as value from d union all select doc_id, 1, 1, 'end', {_TAIL} from d where len(w) > 6
    """ + " ".join(f"union all select doc_id, 2, {i}, '{k}', round({k}::DOUBLE, 4)::VARCHAR from r join t using (doc_id)" for i, k in enumerate(_METRICS)) + f" union all select doc_id, 9, 0, 'volume', {_report('n_words')} from r)"
ORACLE["snk_report_text"] = f"{_REPORT} select doc_id, string_agg(section || '. ' || key || ': ' || value, chr(10) order by section, ord, key) as report from rows0 group by doc_id"
