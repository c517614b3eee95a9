"""Queries on annotated tokens, and on ordered events and turns as tag sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.functions import constants as C, text as X
from lexiforge.operators import metrics, patterns, reports
from lexiforge.operators import tokens as T
from lexiforge.plans.shared import ANN, SENT, TAGS, documents, rule_annotator, sql_list, sql_map, table, tokens

KINDS = ("VERB * NOUN", "PRON ADJ")
EVENT_TAGS = ["click", "error", "purchase", "signup", "view"]


def _events(spark, d):
    return table(spark, d, "events")


def event_bigrams(spark, d):
    return metrics.sequence_bigrams(_events(spark, d), "user_id", ["ts", "event_id"], "event_type")


EVENT_BG = """bg as (select user_id, event_type as p1, lead(event_type) over (partition by user_id order by ts, event_id) as p2 from events),
pairs as (select user_id, p1, p2, count(*) as n from bg where p2 is not null group by all),
freqs as (select *, (sum(n) over (partition by user_id))::BIGINT as total, n::DOUBLE / (sum(n) over (partition by user_id))::DOUBLE as freq from pairs)"""
TAG_BG = f"""{ANN}, bg as (select doc_id, upos as p1, lead(upos) over (partition by doc_id order by tok_idx) as p2 from ann),
pairs as (select doc_id, p1, p2, count(*) as n from bg where p2 is not null group by all),
freqs as (select *, (sum(n) over (partition by doc_id))::BIGINT as total, n::DOUBLE / (sum(n) over (partition by doc_id))::DOUBLE as freq from pairs)"""


def event_matches(spark, d):
    rows = _events(spark, d).withColumn("position", F.row_number().over(metrics.Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    kinds = sorted(r[0] for r in rows.select("event_type").distinct().collect())
    return patterns.matches(rows, [kinds[0], None, kinds[1]], key="user_id", tag="event_type", text="event_type", around=2).select("user_id", F.col("position").cast("long").alias("position"), "fragment", "context")


_kind = lambda i: f"(select event_type from (select distinct event_type from events order by 1) limit 1 offset {i})"
EVENT_MATCH = f"""with s as (select user_id, event_type as t, row_number() over (partition by user_id order by ts, event_id) - 1 as position from events),
w as (select *, lead(t, 1) over o as t1, lead(t, 2) over o as t2, string_agg(t, ' ') over (partition by user_id order by position rows between 2 preceding and 4 following) as context from s window o as (partition by user_id order by position))
select user_id, position, t || ' ' || t1 || ' ' || t2 as fragment, context from w where t = {_kind(0)} and t2 = {_kind(1)}"""


def matches(spark, d):
    return patterns.query(tokens(spark, d), KINDS[0]).select("doc_id", F.col("position").cast("long").alias("position"), "fragment", "tags", "context")


MATCH = f"""{ANN}, w as (select doc_id, tok_idx as position, text, upos, lead(text, 1) over o as x1, lead(text, 2) over o as x2, lead(upos, 1) over o as u1, lead(upos, 2) over o as u2,
    string_agg(text, ' ') over (partition by doc_id order by tok_idx rows between 5 preceding and 7 following) as context from ann window o as (partition by doc_id order by tok_idx))"""
_said = lambda u, x: f"{sql_map(C.UPOS_NAME)}[{u}] || ' (' || {x} || ')'"


def conversations(spark, d):
    return metrics.sequence_bigrams(table(spark, d, "conversations"), "conv_id", ["turn"], "role").select("conv_id", "p1", "p2", "n", "total", "freq")


def labelled(spark, d):
    return tokens(spark, d).select("doc_id", F.col("tok_idx").cast("long").alias("tok_idx"), "text", "upos", "pos_label")


def feats(spark, d):
    raw = F.when(F.col("tok_idx") % 3 == 0, "Case=Nom|Number=Sing|Variant=Short").when(F.col("tok_idx") % 3 == 1, "Tense=Past|VerbForm=Fin").otherwise("—")
    return tokens(spark, d).select("doc_id", F.col("tok_idx").cast("long").alias("tok_idx"), T.feats_text(raw).alias("feats"))


def punct_rule(spark, d):
    raw = documents(spark, d).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))).alias("tok_idx", "text"))
    raw = raw.select("*", F.lit(None).cast("string").alias("lemma"), F.lit("NOUN").alias("upos"), F.lit(None).cast("string").alias("pos_label"), F.expr("cast(map() as map<string,string>)").alias("feats"))
    return T.normalise(raw).groupBy("doc_id", "upos").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lemma").alias("lemmas"))


def morph(spark, d):
    return metrics.morph_stats(tokens(spark, d))


def _morph_sql(key: str, column: str) -> str:
    return f"select doc_id, '{C.FEATURES[key]}' as category, {sql_map({k: v.lower() for k, v in C.FEATURES.items()})}[{column}] as value, count(*) as n from ann where {column} is not null group by all"


MORPH = f"{ANN}, total as (select doc_id, count(*) as total from ann group by 1), v as ({' union all '.join(_morph_sql(k, c) for k, c in (('Case', 'f_case'), ('Number', 'f_number'), ('Tense', 'f_tense'), ('VerbForm', 'f_form')))})"


def coefficients(spark, d):
    return metrics.coefficients(tokens(spark, d)).withColumn("no", F.col("no").cast("long"))


def indices(spark, d):
    docs = documents(spark, d)
    return metrics.indices(rule_annotator(docs), metrics.sentence_stats(docs)).withColumn("no", F.col("no").cast("long"))


_c = lambda test: f"(count(*) filter ({test}))::BIGINT"
_l = lambda *names: "pos_label in " + sql_list(names)
_u = lambda *tags: "upos in " + sql_list(tags)
N = C.UPOS_NAME
LABEL_COUNTS = f"""select doc_id, count(*) as total, {_c(_l(N['PRON'], N['DET']))} as pron, {_c(_l(N['VERB'], N['AUX']))} as verb, {_c(_l(N['ADJ']))} as adj, {_c(_l(N['ADV']))} as adv,
    {_c(_l(N['NOUN'], N['PROPN']))} as noun, {_c(_l(C.PARTICIPLE))} as participle, {_c(_l(C.GERUND))} as gerund, {_c(_l(N['NUM']))} as num, {_c(_l(N['ADP']))} as prep, {_c(_l(N['PART']))} as particle,
    {_c(_l(N['CCONJ'], N['SCONJ']))} as conj, {_c("f_variant = 'Short'")} as short_adj, {_c("f_poss = 'Yes'")} as poss from ann group by doc_id"""
TAG_COUNTS = f"""select doc_id, count(*) as total, {_c(_u('NOUN', 'PROPN'))} as noun, {_c(_u('PROPN'))} as propn, {_c(_u('PRON'))} as pron, {_c(_u('PRON', 'DET'))} as pron_det, {_c(_u('VERB', 'AUX'))} as verb, {_c(_u('ADJ'))} as adj,
    {_c(_u('ADV'))} as adv, {_c(_u('NUM'))} as num, {_c(_u('ADP'))} as adp, {_c(_u('CCONJ', 'SCONJ'))} as conj, {_c(_u('ADJ', 'DET', 'PART'))} as adj_det_part, {_c(_u('ADP', 'CCONJ', 'SCONJ', 'PART', 'DET', 'INTJ'))} as func,
    {_c(_u('ADP', 'CCONJ', 'SCONJ', 'PART'))} as serv, {_c("upos = 'PRON' and lemma in " + sql_list(C.PERSONAL))} as pers, {_c("upos = 'ADV' and lemma in " + sql_list(C.PREDICATIVE))} as pred,
    {_c("f_tense = 'Pres'")} as pres, {_c("f_tense = 'Fut'")} as fut, {_c("f_tense = 'Past'")} as past, {_c("f_form = 'Part'")} as participle, {_c("f_form = 'Conv'")} as gerund,
    {_c("f_case = 'Nom' and upos <> 'ADJ'")} as nom, {_c("f_case = 'Gen' and upos <> 'ADJ'")} as gen, {_c("f_case is not null and upos <> 'ADJ'")} as cased from ann group by doc_id"""


def _ratio_sql(rows) -> str:
    return " union all ".join(f"select doc_id, {no}::BIGINT as no, ({a})::BIGINT as numerator, ({b})::BIGINT as denominator, ({a})::DOUBLE / nullif(({b})::DOUBLE, 0) as value from c" for no, a, b in rows)


SAE = f"with {ANN}, c as ({LABEL_COUNTS}) {_ratio_sql(metrics.COEFFICIENTS)}"
IDX = f"with {ANN}, {SENT}, c as (select t.*, greatest(coalesce(len(lens), 0), 1) as sentences from ({TAG_COUNTS}) t left join sent using (doc_id)) {_ratio_sql(metrics.INDICES)}"


def matrix(spark, d):
    return metrics.bigram_matrix(event_bigrams(spark, d), EVENT_TAGS, "user_id")


def searched(spark, d, q="Глаг"):
    return T.search_table(tokens(spark, d), q).select("doc_id", F.col("tok_idx").cast("long").alias("tok_idx"), "text", "pos_label")


QUERIES = {
    "tok_pos_label": labelled,
    "tok_feats_ru": feats,
    "tok_punct_rule": punct_rule,
    "tok_lemma": lambda s, d: T.with_dictionary_lemma(T.explode_words(documents(s, d)).select("doc_id", F.lower("text").alias("form")).distinct(), s.createDataFrame([("is", "be"), ("was", "be"), ("les", "le")], "form string, lemma string")).select("doc_id", "form", "lemma"),
    "tok_lemma_map": lambda s, d: T.lemma_map(tokens(s, d).withColumn("lemma", F.concat_ws("-", F.lower("text"), "tok_idx"))),
    "tok_thematic_lemmas": lambda s, d: T.thematic_lemmas(tokens(s, d)).select("doc_id", F.col("tok_idx").cast("long").alias("tok_idx"), "lemma"),
    "tok_corpus_lemmas": lambda s, d: T.corpus_lemmas(tokens(s, d)).select("doc_id", F.array_join("lemmas", " ").alias("lemmas")),
    "tok_morph_table": lambda s, d: T.morphology_table(tokens(s, d)).groupBy("doc_id", "pos_label", "feats").agg(F.count(F.lit(1)).alias("n")),
    "tok_tag_stanza": lambda s, d: T.annotate(documents(s, d)).groupBy("doc_id", "upos").agg(F.count(F.lit(1)).alias("n")),
    "tok_span_align": lambda s, d: T.align_spans(T.annotate(documents(s, d)), documents(s, d)),
    "flt_word": lambda s, d: T.only_words(tokens(s, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")),
    "flt_morph_search": searched,
    "agg_pos_freq": lambda s, d: metrics.tag_shares(tokens(s, d)).withColumn("rank", F.col("rank").cast("long")),
    "agg_lemma_ttr": lambda s, d: metrics.lemma_diversity(tokens(s, d)),
    "agg_content_function": lambda s, d: metrics.content_function(tokens(s, d)).select("doc_id", "n_content", "n_function", "content_function"),
    "agg_noun_verb": lambda s, d: metrics.content_function(tokens(s, d)).select("doc_id", "n_noun", "n_verb", "noun_verb"),
    "agg_pos_bigrams": lambda s, d: metrics.tag_bigrams(tokens(s, d)),
    "win_bigram": event_bigrams,
    "agg_role_bigrams": conversations,
    "topk_bigrams": lambda s, d: metrics.top_bigrams(metrics.tag_bigrams(tokens(s, d))).withColumn("rank", F.col("rank").cast("long")),
    "agg_bigram_matrix": matrix,
    "snk_heatmap": matrix,
    "snk_pie": lambda s, d: metrics.tag_shares(tokens(s, d)).where("share > 0").select("doc_id", "tag", "share"),
    "agg_morph_stats": morph,
    "prs_morph_bars": lambda s, d: reports.relative_bars(morph(s, d), ["doc_id", "category"], "n").select("doc_id", "category", "value", "bar"),
    "agg_sae20": coefficients,
    "agg_idx20": indices,
    "prs_index_rows": lambda s, d: indices(s, d).select("doc_id", "no", "numerator", F.when(F.col("value").isNull(), "—").otherwise(F.concat_ws("/", "numerator", "denominator")).alias("shown")),
    "win_pattern": matches,
    "win_position": lambda s, d: patterns.query(tokens(s, d), KINDS[1]).select("doc_id", F.col("position").cast("long").alias("position")),
    "win_context": event_matches,
    "orc_pattern_query": lambda s, d: patterns.query(tokens(s, d), "гл прил").groupBy("doc_id").agg(F.count(F.lit(1)).alias("result_count")),
    "win_ngram": lambda s, d: T.explode_words(documents(s, d)).select("doc_id", "tok_idx", *[F.lead(F.lower("text"), k).over(metrics.Window.partitionBy("doc_id").orderBy("tok_idx")).alias(f"w{k}") for k in range(3)]).where("w2 is not null").select("doc_id", F.concat_ws(" ", "w0", "w1", "w2").alias("gram")).groupBy("doc_id", "gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
    "win_first_seen": lambda s, d: T.explode_words(documents(s, d)).groupBy("doc_id", F.lower("text").alias("form")).agg(F.min("tok_idx").cast("long").alias("first_at"), F.count(F.lit(1)).alias("n")),
}

_top = "row_number() over (partition by doc_id order by n desc, p1, p2)"
ORACLE = {
    "tok_pos_label": f"with {ANN} select doc_id, tok_idx, text, upos, pos_label from ann",
    "tok_feats_ru": f"with {ANN} select doc_id, tok_idx, case tok_idx % 3 when 0 then 'Падеж: именительный; Число: единственное; Variant: Short' when 1 then 'Время: прошедшее; Форма глагола: финитная' else '—' end as feats from ann",
    "tok_punct_rule": f"with t as (select doc_id, unnest(regexp_extract_all(text, '[^\\s]+')) as text from documents), u as (select doc_id, case when regexp_matches(text, '{C.WORD}') then 'NOUN' else 'PUNCT' end as upos, case when regexp_matches(text, '{C.WORD}') then lower(text) else text end as lemma from t) select doc_id, upos, count(*) as n, count(distinct lemma) as lemmas from u group by all",
    "tok_lemma": f"with {ANN} select distinct doc_id, lemma as form, case lemma when 'is' then 'be' when 'was' then 'be' when 'les' then 'le' else lemma end as lemma from ann",
    "tok_lemma_map": f"with {ANN} select doc_id, lemma as form, lemma || '-' || max(tok_idx) as lemma from ann group by doc_id, ann.lemma",
    "tok_thematic_lemmas": f"with {ANN} select doc_id, tok_idx, lemma from ann where upos not in ('PUNCT', 'NUM')",
    "tok_corpus_lemmas": f"with {ANN} select doc_id, string_agg(lemma, ' ' order by tok_idx) as lemmas from ann group by doc_id",
    "tok_tag_stanza": f"with {ANN} select doc_id, 'X' as upos, count(*) as n from ann group by doc_id",
    "flt_word": f"with {ANN} select doc_id, count(*) as n from ann group by doc_id",
    "flt_morph_search": f"with {ANN} select doc_id, tok_idx, text, pos_label from ann where contains(lower(text), 'глаг') or contains(lemma, 'глаг') or contains(lower(pos_label), 'глаг')",
    "agg_pos_freq": f"with {ANN}, p as (select doc_id, pos_label as tag, count(*) as n from ann group by all) select doc_id, tag, n, n::DOUBLE / (sum(n) over (partition by doc_id))::DOUBLE as share, row_number() over (partition by doc_id order by n desc, tag) as rank from p",
    "agg_lemma_ttr": f"with {ANN}, p as (select doc_id, lemma, count(*) as n from ann group by all) select doc_id, sum(n)::BIGINT as n_words, count(*) as n_lemmas, {_c('n = 1')} as n_hapax, count(*)::DOUBLE / sum(n)::DOUBLE as lemma_ttr, {_c('n = 1')}::DOUBLE / sum(n)::DOUBLE as hapax_share from p group by doc_id",
    "agg_content_function": f"with {ANN}, p as (select doc_id, {_c(_l(*C.CONTENT_LABELS))} as n_content, {_c(_l(*C.FUNCTION_LABELS))} as n_function from ann group by doc_id) select *, n_content::DOUBLE / nullif(n_function::DOUBLE, 0) as content_function from p",
    "agg_noun_verb": f"with {ANN}, p as (select doc_id, {_c(_l(N['NOUN'], N['PROPN']))} as n_noun, {_c(_l(N['VERB'], N['AUX']))} as n_verb from ann group by doc_id) select *, n_noun::DOUBLE / nullif(n_verb::DOUBLE, 0) as noun_verb from p",
    "agg_pos_bigrams": f"with {TAG_BG} select doc_id, p1, p2, n, total, freq from freqs",
    "win_bigram": f"with {EVENT_BG} select user_id, p1, p2, n, total, freq from freqs",
    "agg_role_bigrams": "with bg as (select conv_id, role as p1, lead(role) over (partition by conv_id order by turn) as p2 from conversations), p as (select conv_id, p1, p2, count(*) as n from bg where p2 is not null group by all) select *, (sum(n) over (partition by conv_id))::BIGINT as total, n::DOUBLE / (sum(n) over (partition by conv_id))::DOUBLE as freq from p",
    "topk_bigrams": f"with {TAG_BG} select doc_id, p1, p2, n, total, freq, {_top} as rank from freqs qualify rank <= 20",
    "agg_bigram_matrix": f"with {EVENT_BG}, s as (select distinct user_id, p1 from (select user_id, p1 from freqs union all select user_id, p2 from freqs)) select s.user_id, s.p1, {', '.join(f'coalesce(sum(case when p2 = {chr(39)}{t}{chr(39)} then freq end), 0.0) as {chr(34)}{t}{chr(34)}' for t in EVENT_TAGS)} from s left join freqs f on s.user_id = f.user_id and s.p1 = f.p1 group by all",
    "snk_pie": f"with {ANN}, p as (select doc_id, pos_label as tag, count(*) as n from ann group by all) select doc_id, tag, n::DOUBLE / (sum(n) over (partition by doc_id))::DOUBLE as share from p",
    "agg_morph_stats": f"with {MORPH} select v.doc_id, category, value, n, n * 100 / total::DOUBLE as per_100 from v join total using (doc_id)",
    "prs_morph_bars": f"with {MORPH} select doc_id, category, value, floor(n / (max(n) over (partition by doc_id, category))::DOUBLE * 1000)::BIGINT as bar from v",
    "agg_sae20": SAE,
    "agg_idx20": IDX,
    "win_pattern": f"with {MATCH} select doc_id, position, text || ' ' || x1 || ' ' || x2 as fragment, {_said('upos', 'text')} || ' → ' || {_said('u1', 'x1')} || ' → ' || {_said('u2', 'x2')} as tags, context from w where upos = 'VERB' and u2 = 'NOUN'",
    "win_position": f"with {MATCH} select doc_id, position from w where upos = 'PRON' and u1 = 'ADJ'",
    "win_context": EVENT_MATCH,
    "orc_pattern_query": f"with {MATCH} select doc_id, count(*) as result_count from w where upos = 'VERB' and u1 = 'ADJ' group by doc_id",
    "win_ngram": f"with {ANN}, w as (select doc_id, lemma || ' ' || lead(lemma, 1) over o || ' ' || lead(lemma, 2) over o as gram from ann window o as (partition by doc_id order by tok_idx)) select doc_id, gram, count(*) as n from w where gram is not null group by all having count(*) > 1",
    "win_first_seen": f"with {ANN} select doc_id, lemma as form, min(tok_idx) as first_at, count(*) as n from ann group by doc_id, lemma",
}
ORACLE["snk_heatmap"] = ORACLE["agg_bigram_matrix"]
ORACLE["prs_index_rows"] = f"select doc_id, no, numerator, case when value is null then '—' else numerator || '/' || denominator end as shown from ({IDX})"
_FEATS = " , ".join(f"'{k}: ' || {c}" for k, c in (("Case", "f_case"), ("Number", "f_number"), ("Poss", "f_poss"), ("PronType", "f_type"), ("Tense", "f_tense"), ("Variant", "f_variant"), ("VerbForm", "f_form")))
ORACLE["tok_morph_table"] = f"with {ANN} select doc_id, pos_label, coalesce(nullif(concat_ws('; ', {_FEATS}), ''), '—') as feats, count(*) as n from ann group by all"
