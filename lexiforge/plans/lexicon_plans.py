"""Queries on dictionaries: frequency from the corpus itself, small sentiment and layer lexicons, languages as topics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lexiforge.functions import constants as C
from lexiforge.operators import lexicons as L
from lexiforge.operators import reports, store
from lexiforge.operators.tokens import explode_words
from lexiforge.plans.shared import ANN, TOK, WORD, documents, sql_list, sql_map, table

WORDS = 30_000
PER_DOMAIN = 300
DOMAINS = ["en", "de", "fr", "es", "law", "it", "science", "sports", "politics", "everyday"]
SENTI = "(values ('the','neutral','fact','Noun'), ('and','positive','opinion','Adj'), ('ti','negative','feeling','Adj'), ('les','positive','feeling','Noun'), ('und','negative','opinion','Verb'), ('que','positive','fact','Noun'), ('worthless','negative','opinion','Adj'), ('es','neutral','','Noun')) as t(lemma, sentiment, stype, pos)"
ENTRIES = "(values (0,'the','literary_standard',''), (1,'THE','vernacular','unknown'), (2,'and','archaic','dialectal'), (3,'idiot','obscene',''), (4,'moron','vernacular','obscene'), (5,'ti','youth_jargon',''), (6,'es','colloquial_reduced','euphemistic'), (7,'of','nonsense',''), (8,'und','general_jargon',''), (9,'les','youth_jargon',''), (10,'que','dialectal','')) as t(ord, surface, l1, l2)"
USER = "(values ('the', 'drug_jargon'), (' Ouea ', 'archaic'), ('and', 'law'), ('', 'archaic')) as t(word, category)"
WHITE, KEEP, KNOWN = ("les",), ("ti",), ("ti", "und")


def values(spark, inline):
    return spark.sql(f"select * from {inline}")


def words_of(spark, names, column="lemma"):
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


def dictionary(spark, d):
    """The corpus's most frequent words as (ord, lemma, rank, ipm, pos); rank among them, ipm over all words."""
    forms = explode_words(documents(spark, d)).groupBy(F.lower("text").alias("lemma")).agg(F.count(F.lit(1)).alias("n"))
    total = forms.agg(F.sum("n").alias("total"))
    top = forms.orderBy(F.desc("n"), "lemma").limit(WORDS)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "lemma")))
    pos = F.when(F.char_length("lemma") <= 2, "conj").when(F.char_length("lemma") == 3, "prep").otherwise("noun")
    return ranked.join(F.broadcast(total)).select(F.col("rank").alias("ord"), "lemma", "rank", (F.col("n") * 1e6 / F.col("total")).alias("ipm"), pos.alias("pos"))


DICT = f"""{TOK}, forms as (select lower(text) as lemma, count(*) as n from tok group by all),
dict as (select lemma, row_number() over (order by n desc, lemma) as rank, n * 1e6 / (select sum(n) from forms)::DOUBLE as ipm, case when length(lemma) <= 2 then 'conj' when length(lemma) = 3 then 'prep' else 'noun' end as pos from forms order by n desc, lemma limit {WORDS}),
f as (select doc_id, lower(text) as form, count(*) as n, min(tok_idx) as first_at from tok group by all),
band as (select f.*, coalesce(d.rank, 0) as rank, coalesce(d.ipm, 0.0) as ipm, coalesce(d.pos, '') as pos from f left join dict d on f.form = d.lemma),
fw as (select *, case when rank = 0 then 'absent' when rank <= 300 then 'nucleus' when rank <= 1500 then 'high' when rank <= 7000 then 'medium' when rank <= 30000 then 'low' else 'rare' end as band from band)"""


def freq_words(spark, d):
    return L.frequency_words(L.form_counts(documents(spark, d)), dictionary(spark, d))


def freq_profile(spark, d):
    out = L.frequency_profile(freq_words(spark, d))
    return out.withColumns({"avg_rank": F.round("avg_rank", 6), "avg_ipm": F.round("avg_ipm", 6), "content_avg_ipm": F.round("content_avg_ipm", 6)})


_bands = ", ".join(f"coalesce(sum(n) filter (band = '{b}'), 0)::BIGINT as {b}" for b in [*(b for b, _ in C.BANDS), "absent"])
PROFILE = f"""select doc_id, sum(n)::BIGINT as total, count(*) as n_forms, {_bands},
    coalesce(round(sum(rank * n) filter (rank > 0) / sum(n) filter (rank > 0), 6), 0.0) as avg_rank, coalesce(round(sum(ipm * n) filter (rank > 0) / sum(n) filter (rank > 0), 6), 0.0) as avg_ipm,
    coalesce(round(sum(ipm * n) filter (rank > 0 and band <> 'nucleus' and pos not in {sql_list(C.FUNCTION_POS)}) / sum(n) filter (rank > 0 and band <> 'nucleus' and pos not in {sql_list(C.FUNCTION_POS)}), 6), 0.0) as content_avg_ipm,
    (sum(n) - coalesce(sum(n) filter (band = 'nucleus'), 0))::BIGINT as content from fw group by doc_id"""


def _long(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def senti_words(spark, d):
    return L.sentiment_words(L.form_counts(documents(spark, d)), values(spark, SENTI))


def senti(spark, d):
    return L.sentiment_profile(senti_words(spark, d), documents(spark, d).select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("total")))


SENTI_WORDS = f"{TOK}, s as (select * from {SENTI}), sw as (select doc_id, lemma, sentiment, stype, pos, count(*) as n, min(tok_idx) as first_at from tok join s on lower(tok.text) = s.lemma group by all)"
SENTI_PROFILE = f"""with {SENTI_WORDS}, totals as (select doc_id, len(regexp_extract_all(text, '{WORD}'))::BIGINT as total from documents),
p as (select t.doc_id, total, coalesce(sum(n) filter (sentiment = 'positive'), 0)::BIGINT as positive, coalesce(sum(n) filter (sentiment = 'negative'), 0)::BIGINT as negative, coalesce(sum(n) filter (sentiment = 'neutral'), 0)::BIGINT as neutral, coalesce(sum(n), 0)::BIGINT as scored from totals t left join sw using (doc_id) group by all)
select *, coalesce((positive - negative)::DOUBLE / nullif(scored::DOUBLE, 0), 0.0) as balance, coalesce((positive + negative)::DOUBLE / nullif(total::DOUBLE, 0), 0.0) as emotionality, coalesce((scored * 100)::DOUBLE / nullif(total::DOUBLE, 0), 0.0) as coverage_pct,
    case when positive > negative then 'positive' when negative > positive then 'negative' else 'neutral' end as dominant from p"""


def vocab(spark, d):
    """The most frequent words of each language as the words of a topic."""
    n = explode_words(documents(spark, d), keep=("doc_id", "lang")).groupBy("lang", F.lower("text").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    no = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return n.withColumn("no", no).where(F.col("no") <= PER_DOMAIN).select(F.col("lang").alias("domain"), "word")


VOCAB = f"""{TOK}, wc as (select lang, lower(text) as word, count(*) as n from tok group by all), vocab as (select lang as domain, word from wc qualify row_number() over (partition by lang order by n desc, word) <= {PER_DOMAIN}),
idf as (select word, count(*) as df, ln((10 + 1) / (count(*) + 1)) + 1 as idf from vocab group by word),
cent as (select domain, v.word, idf, idf / sqrt(sum(idf * idf) over (partition by domain)) as weight from vocab v join idf using (word))"""
SCORES = f"""{VOCAB}, n as (select doc_id, lower(text) as word, count(*) as n from tok group by all), tot as (select doc_id, sum(n) as total from n group by 1),
h as (select n.doc_id, n.word, n.n / total::DOUBLE * idf as w from n join tot using (doc_id) join idf using (word)), norm as (select doc_id, sqrt(sum(w * w)) as norm from h group by 1),
per as (select doc_id, domain, sum(w * weight) as dot, sum(w) as tf_idf_sum, count(*) as match_count from h join cent using (word) group by all),
sc as (select t.doc_id, d.domain, coalesce(dot / norm, 0.0) as cosine, coalesce(tf_idf_sum, 0.0) as tf_idf_sum, coalesce(match_count, 0) as match_count from tot t cross join (select unnest({DOMAINS}) as domain) d left join per p on p.doc_id = t.doc_id and p.domain = d.domain left join norm on norm.doc_id = t.doc_id)"""


def scores(spark, d):
    return L.domain_scores(explode_words(documents(spark, d)).select("doc_id", F.col("text").alias("lemma")), vocab(spark, d), DOMAINS)


def layers(spark, d=None, user=True):
    entries = values(spark, ENTRIES).select("ord", "surface", F.filter(F.array("l1", "l2"), lambda x: x != "").alias("layers"))
    return L.build_layers(entries, words_of(spark, WHITE), words_of(spark, KEEP), words_of(spark, KNOWN, "surface"), values(spark, USER) if user else None)


_prio = sql_map({k: str(p) for k, (_, p) in C.LAYERS.items()})
LEX = f"""e as (select ord, surface, list_filter([l1, l2], lambda x: x in {sql_list(C.LAYERS)}) as ls from {ENTRIES}),
e1 as (select ord, lower(surface) as phrase, surface, list_sort(list_transform(ls, lambda x, i: [(100 - {_prio}[x]::INT)::VARCHAR, i::VARCHAR, x]))[1][3] as layer from e where len(ls) > 0),
e2 as (select ord, phrase, layer from e1 where not (phrase in {sql_list(WHITE)} or (phrase not in {sql_list(KEEP)} and surface in {sql_list(KNOWN)} and layer in {sql_list(C.FILTERABLE)}))),
u as (select 1000 as ord, lower(trim(word)) as phrase, category as layer from {USER} where category in {sql_list(C.LAYERS)} and trim(word) <> ''),
lex as (select phrase, arg_min(layer, (100 - {_prio}[layer]::INT) * 100000 + ord) as layer from (select * from e2 union all select * from u) group by phrase)"""
HITS = f"{TOK}, {LEX}, hits as (select doc_id, tok_idx, text as surface, lower(text) as lemma, layer from tok join lex on lower(text) = phrase)"


#: Two layers that an entry may name, some of them none that is known.
FIRST, SECOND = [*C.LAYERS, "nonsense"], [*C.LAYERS, "", "unknown"]


def entries(spark, d):
    """(ord, surface, layers): every spelling in the documents with layers that follow from its length and its first place, which is its ord."""
    seen = explode_words(documents(spark, d)).groupBy(F.col("text").alias("surface")).agg(F.min(F.col("doc_id") * (1 << 20) + F.col("tok_idx")).alias("ord"))
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), (i % len(names)).cast("int"))
    return seen.select("ord", "surface", F.filter(F.array(pick(FIRST, F.char_length("surface")), pick(SECOND, F.col("ord"))), lambda x: x != "").alias("layers"))


def corpus_layers(spark, d, user=True):
    """The lexicon of all those entries: German's frequent words are let through, English ones stay, words of the benchmark are plain; the user's are Spanish ones."""
    top = vocab(spark, d)
    plain = explode_words(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")).select(F.col("text").alias("surface"))
    of = lambda domain: top.where(F.col("domain") == domain).select(F.col("word").alias("lemma"))
    own = of("es").select(F.col("lemma").alias("word"), F.get(F.array(*map(F.lit, SECOND)), F.char_length("lemma") % len(SECOND)).alias("category"))
    return L.build_layers(entries(spark, d), of("de"), of("en"), plain, own if user else None)


ENTRY = f"""{VOCAB}, ent as (select text as surface, min(doc_id * 1048576 + tok_idx)::BIGINT as ord from tok group by 1),
e as (select ord, surface, lower(surface) as phrase, list_filter([{FIRST}[length(surface) % {len(FIRST)} + 1], {SECOND}[ord % {len(SECOND)} + 1]], lambda x: x in {sql_list(C.LAYERS)}) as ls from ent),
e1 as (select ord, surface, phrase, case when len(ls) > 0 then list_sort(list_transform(ls, lambda x, i: [(100 - {_prio}[x]::INT)::VARCHAR, i::VARCHAR, x]))[1][3] end as layer from e)"""
CORPUS_LEX = f"""{ENTRY}, known as (select distinct lower(unnest(regexp_extract_all(text, '{WORD}'))) as word from benchmark),
e2 as (select ord, phrase, layer from e1 where layer is not null and not (phrase in (select word from vocab where domain = 'de') or (phrase not in (select word from vocab where domain = 'en') and phrase in (select word from known) and layer in {sql_list(C.FILTERABLE)}))),
u as (select {1 << 62} as ord, word as phrase, {SECOND}[length(word) % {len(SECOND)} + 1] as layer from vocab where domain = 'es'),
all_of as (select * from e2 union all select * from u where layer in {sql_list(C.LAYERS)})"""
_best = f"arg_min(layer, [(100 - {_prio}[layer]::INT)::BIGINT, ord])"


def hits(spark, d):
    return L.layer_word_hits(documents(spark, d), layers(spark), WORD)


def exclusions(spark, d):
    log = documents(spark, d).select(F.substring(F.sha2("text", 256), 1, 16).alias("text_hash"), F.explode(F.array(F.lit("the"), F.lit("ti"))).alias("lemma"), F.col("doc_id").alias("seq"))
    log = log.select("*", F.when(F.col("lemma") == "the", "drug_jargon").otherwise("youth_jargon").alias("layer"), F.when(F.col("seq") % 3 == 0, "exclude").otherwise("confirm").alias("verdict"))
    return L.without_exclusions(hits(spark, d), documents(spark, d), store.annotations(log))


EXCLUDED = f"""{HITS}, lg as (select sha256(text)[1:16] as text_hash, doc_id as seq, case when doc_id % 3 = 0 then 'exclude' else 'confirm' end as verdict from documents), la as (select text_hash, arg_max(verdict, seq) as verdict from lg group by 1),
ex as (select doc_id from documents join la on sha256(text)[1:16] = text_hash where verdict = 'exclude'),
rest as (select * from hits where not (doc_id in (select doc_id from ex) and ((lemma = 'the' and layer = 'drug_jargon') or (lemma = 'ti' and layer = 'youth_jargon'))))"""


QUERIES = {
    "lex_freq_dedup": lambda s, d: L.best_by_ipm(dictionary(s, d).unionByName(dictionary(s, d).withColumns({"ipm": F.col("ipm") / 2, "pos": F.lit("verb")}))).select("lemma", F.col("rank").cast("long").alias("rank"), F.round("ipm", 6).alias("ipm"), "pos"),
    "lex_pos_short": lambda s, d: documents(s, d).select("doc_id", F.explode(F.array(*map(F.lit, ("spro", "adv", "S", "apro", "v.x", "intj", "zzzzz")))).alias("raw")).select("doc_id", "raw", L.short_pos(F.col("raw"), True).alias("shadowed"), L.short_pos(F.col("raw")).alias("fixed")),
    "join_freq": lambda s, d: _long(freq_words(s, d), "rank", "first_at").select("doc_id", "form", "n", "rank", "pos", "band"),
    "agg_band": lambda s, d: dictionary(s, d).groupBy(L.band(F.col("rank")).alias("band")).agg(F.count(F.lit(1)).alias("n")),
    "agg_freq_profile": freq_profile,
    "agg_freq_summary": lambda s, d: L.frequency_summary(L.frequency_profile(freq_words(s, d))),
    "topk_rarest": lambda s, d: _long(L.rarest(freq_words(s, d)), "rank", "no").select("doc_id", "form", "rank", "no"),
    "sort_absent": lambda s, d: L.absent(freq_words(s, d)).select("doc_id", "form", "n"),
    "sort_freq_words": lambda s, d: _long(L.frequency_table(freq_words(s, d)), "rank").select("doc_id", "form", "rank"),
    "flt_freq_table": lambda s, d: _long(L.frequency_table(freq_words(s, d), "low", "count_desc"), "rank").select("doc_id", "form", "rank", "n"),
    "prs_band_bars": lambda s, d: L.frequency_profile(freq_words(s, d)).select("doc_id", *[(F.col(b) * 100 / F.col("total")).alias(b) for b in ("nucleus", "high", "absent")]),
    "join_senti": lambda s, d: senti_words(s, d).select("doc_id", "lemma", "form", "sentiment", "stype", "n"),
    "agg_senti": senti,
    "cls_dominant": lambda s, d: senti(s, d).groupBy("dominant").agg(F.count(F.lit(1)).alias("n")),
    "cls_balance": lambda s, d: senti(s, d).select("doc_id", L.ratio(F.col("positive"), F.col("scored")).alias("x"), F.when(F.col("balance") > 0.1, "positive").when(F.col("balance") < -0.1, "negative").otherwise("even").alias("side")).select("doc_id", "side"),
    "agg_senti_types": lambda s, d: L.sentiment_types(senti_words(s, d)),
    "topk_senti": lambda s, d: _long(L.top_sentiment(senti_words(s, d), 2), "no").select("doc_id", "sentiment", "lemma", "n", "no"),
    "agg_idf": lambda s, d: L.idf(vocab(s, d), 10).withColumn("idf", F.round("idf", 9)),
    "agg_centroid": lambda s, d: L.centroids(vocab(s, d), 10).select("domain", "word", F.round("idf", 9).alias("idf"), F.round("weight", 9).alias("weight")),
    "join_thematic": lambda s, d: explode_words(documents(s, d)).select("doc_id", F.lower("text").alias("word")).join(L.small(vocab(s, d)), "word").groupBy("doc_id", "domain").agg(F.count(F.lit(1)).alias("n")),
    "agg_tfidf_cosine": lambda s, d: scores(s, d).select("doc_id", "domain", F.round("cosine", 6).alias("cosine"), F.round("tf_idf_sum", 6).alias("tf_idf_sum"), "match_count"),
    "topk_domains": lambda s, d: _long(L.top_domains(scores(s, d)), "no").select("doc_id", "domain", "no"),
    "prs_domain_table": lambda s, d: reports.domain_table(scores(s, d), L.top_domains(scores(s, d))).select("doc_id", "domain", "match_count", "top"),
    "prs_domain_bars": lambda s, d: reports.relative_bars(scores(s, d).withColumn("cosine", F.round("cosine", 6)), ["doc_id"], "cosine").select("doc_id", "domain", "bar"),
    "prs_domain_report": lambda s, d: reports.domain_report(scores(s, d), L.top_domains(scores(s, d))),
    "lex_user_inject_domain": lambda s, d: L.inject_domain_words(vocab(s, d), s.createDataFrame([("the", "de"), ("Novel ", "en"), ("x", "nowhere")], "word string, category string")),
    "lex_pick_layer": lambda s, d: entries(s, d).select("ord", "surface", L.pick_layer(F.col("layers")).alias("layer")),
    "lex_build": lambda s, d: corpus_layers(s, d, user=False).select("phrase", "layer"),
    "lex_user_inject_strat": lambda s, d: corpus_layers(s, d).select("phrase", "layer"),
    "lex_false_positive": lambda s, d: entries(s, d).select(F.lower("surface").alias("phrase")).distinct().join(corpus_layers(s, d, user=False), "phrase", "left_anti"),
    "lex_override": lambda s, d: L.override_hits(hits(s, d), words_of(s, ("ti", "the", "idiot"))).groupBy("layer").agg(F.count(F.lit(1)).alias("n")),
    "join_strat_word": lambda s, d: _long(hits(s, d), "tok_idx").select("doc_id", "tok_idx", "surface", "layer"),
    "sort_hits": lambda s, d: hits(s, d).select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("tok_idx", "layer", "surface")).cast("long").alias("no"), "surface", "layer"),
    "join_strat_phrase": lambda s, d: L.layer_hits(documents(s, d), layers(s), WORD),
    "agg_strat": lambda s, d: L.layer_summary(hits(s, d)).select("doc_id", "layer", "n", F.array_join("words", ",").alias("words")),
    "agg_strat_ratio": lambda s, d: L.marked_share(hits(s, d), documents(s, d), WORD),
    "join_exclusion": lambda s, d: exclusions(s, d).groupBy("doc_id", "layer").agg(F.count(F.lit(1)).alias("n")),
    "agg_strat_display": lambda s, d: L.layer_display(exclusions(s, d)),
    "prs_layer_bars": lambda s, d: L.layer_display(exclusions(s, d)).select("doc_id", "layer", F.floor("pct").alias("bar")),
    "flt_lexicon_search": lambda s, d: L.search(vocab(s, d), "word", " TH ").select("domain", "word"),
    "flt_lexicon_browse": lambda s, d: L.browse(vocab(s, d), "domain", "word").select("domain", "n", F.array_join("words", ",").alias("words")),
}

ORACLE = {
    "lex_freq_dedup": f"with {DICT} select lemma, rank, round(ipm, 6) as ipm, pos from dict",
    "lex_pos_short": "select doc_id, raw, shadowed, fixed from documents cross join (values ('spro','noun','pron'), ('adv','adj','adv'), ('S','noun','noun'), ('apro','adj','pron'), ('v.x','verb','verb'), ('intj','interj','interj'), ('zzzzz','zzzz','zzzz')) t(raw, shadowed, fixed)",
    "join_freq": f"with {DICT} select doc_id, form, n, rank, pos, band from fw",
    "agg_band": f"with {DICT} select case when rank <= 300 then 'nucleus' when rank <= 1500 then 'high' when rank <= 7000 then 'medium' else 'low' end as band, count(*) as n from dict group by 1",
    "agg_freq_profile": f"with {DICT} {PROFILE}",
    "agg_freq_summary": f"with {DICT} select doc_id, (absent * 100)::DOUBLE / total::DOUBLE as pct_absent, ((low + rare) * 100)::DOUBLE / total::DOUBLE as pct_rare, (n_forms * 100)::DOUBLE / total::DOUBLE as pct_types from ({PROFILE})",
    "topk_rarest": f"with {DICT} select doc_id, form, rank, row_number() over (partition by doc_id order by rank desc, first_at) as no from fw where rank > 0 qualify no <= 20",
    "sort_absent": f"with {DICT} select doc_id, form, n from fw where band = 'absent'",
    "sort_freq_words": f"with {DICT} select doc_id, form, rank from fw",
    "flt_freq_table": f"with {DICT} select doc_id, form, rank, n from fw where band = 'low'",
    "prs_band_bars": f"with {DICT} select doc_id, nucleus * 100 / total::DOUBLE as nucleus, high * 100 / total::DOUBLE as high, absent * 100 / total::DOUBLE as absent from ({PROFILE})",
    "join_senti": f"with {SENTI_WORDS} select doc_id, lemma, lemma as form, sentiment, stype, n from sw",
    "agg_senti": SENTI_PROFILE,
    "cls_dominant": f"select dominant, count(*) as n from ({SENTI_PROFILE}) group by 1",
    "cls_balance": f"select doc_id, case when balance > 0.1 then 'positive' when balance < -0.1 then 'negative' else 'even' end as side from ({SENTI_PROFILE})",
    "agg_senti_types": f"with {SENTI_WORDS}, t as (select doc_id, coalesce(sum(n) filter (stype = 'fact'), 0)::BIGINT as fact, coalesce(sum(n) filter (stype = 'opinion'), 0)::BIGINT as opinion, coalesce(sum(n) filter (stype = 'feeling'), 0)::BIGINT as feeling from sw group by 1) select *, fact + opinion + feeling as typed from t",
    "topk_senti": f"with {SENTI_WORDS} select doc_id, sentiment, lemma, n, row_number() over (partition by doc_id, sentiment order by n desc, first_at) as no from sw where sentiment <> 'neutral' qualify no <= 2",
    "agg_idf": f"with {VOCAB} select word, df, round(idf, 9) as idf from idf",
    "agg_centroid": f"with {VOCAB} select domain, word, round(idf, 9) as idf, round(weight, 9) as weight from cent",
    "join_thematic": f"with {VOCAB} select doc_id, domain, count(*) as n from tok join vocab on lower(tok.text) = vocab.word group by all",
    "agg_tfidf_cosine": f"with {SCORES} select doc_id, domain, round(cosine, 6) as cosine, round(tf_idf_sum, 6) as tf_idf_sum, match_count from sc",
    "topk_domains": f"with {SCORES}, q as (select *, greatest(0.02, max(cosine) over (partition by doc_id) * 0.25) as need from sc) select doc_id, domain, row_number() over (partition by doc_id order by cosine desc, domain) as no from (select * from q where cosine >= need) qualify no <= 3",
    "prs_domain_table": f"with {SCORES}, q as (select *, greatest(0.02, max(cosine) over (partition by doc_id) * 0.25) as need from sc), t as (select doc_id, domain from (select * from q where cosine >= need) qualify row_number() over (partition by doc_id order by cosine desc, domain) <= 3) select sc.doc_id, sc.domain, match_count, t.domain is not null as top from sc left join t on sc.doc_id = t.doc_id and sc.domain = t.domain",
    "prs_domain_bars": f"with {SCORES}, r as (select doc_id, domain, round(cosine, 6) as cosine from sc) select doc_id, domain, floor(cosine / greatest(max(cosine) over (partition by doc_id), 1e-9) * 1000)::BIGINT as bar from r",
    "lex_user_inject_domain": f"with {VOCAB} select domain, word from vocab union select 'de', 'the' union select 'en', 'novel'",
    "lex_pick_layer": f"with {ENTRY} select ord, surface, layer from e1",
    "lex_build": f"with {CORPUS_LEX} select phrase, {_best} as layer from e2 group by phrase",
    "lex_user_inject_strat": f"with {CORPUS_LEX} select phrase, {_best} as layer from all_of group by phrase",
    "lex_false_positive": f"with {CORPUS_LEX} select distinct phrase from e1 where phrase not in (select phrase from e2)",
    "lex_override": f"with {HITS} select layer, count(*) as n from hits where not (lemma in ('ti', 'the', 'idiot') and layer in {sql_list(C.FILTERABLE)}) group by 1",
    "join_strat_word": f"with {HITS} select doc_id, tok_idx, surface, layer from hits",
    "sort_hits": f"with {HITS} select doc_id, row_number() over (partition by doc_id order by tok_idx, layer, surface) as no, surface, layer from hits",
    "agg_strat": f"with {HITS} select doc_id, layer, count(*) as n, array_to_string(list_sort(list(distinct lower(surface))), ',') as words from hits group by doc_id, layer",
    "agg_strat_ratio": f"with {HITS}, t as (select doc_id, len(regexp_extract_all(text, '{WORD}'))::BIGINT as total from documents), p as (select doc_id, count(*) as n_hits, count(*) filter (layer <> '{C.LITERARY}') as n_marked from hits group by 1) select t.doc_id, total, coalesce(n_hits, 0) as n_hits, coalesce(n_marked, 0) as n_marked, coalesce(coalesce(n_hits, 0)::DOUBLE / nullif(total::DOUBLE, 0), 0.0) as marked_ratio from t left join p using (doc_id)",
    "join_exclusion": f"with {EXCLUDED} select doc_id, layer, count(*) as n from rest group by all",
    "agg_strat_display": f"with {EXCLUDED}, n as (select doc_id, layer, count(*) as n from rest group by all) select doc_id, layer, {sql_map({k: v for k, (v, _) in C.LAYERS.items()})}[layer] as label, n, n * 100 / (sum(n) over (partition by doc_id))::DOUBLE as pct from n",
    "prs_layer_bars": f"with {EXCLUDED}, n as (select doc_id, layer, count(*) as n from rest group by all) select doc_id, layer, floor(n * 100 / (sum(n) over (partition by doc_id))::DOUBLE)::BIGINT as bar from n",
    "flt_lexicon_search": f"with {VOCAB} select domain, word from vocab where contains(word, 'th')",
    "flt_lexicon_browse": f"with {VOCAB} select domain, count(*) as n, array_to_string(list_sort(list(word)), ',') as words from vocab group by 1",
}
#: A share of four places as reports write it; the smallest have an exponent.
_shown = lambda x: f"case when round({x}, 4) > 0 and round({x}, 4) < 0.001 then round({x} * 10000)::INT || '.0E-4' else round({x}, 4)::VARCHAR end"
ORACLE["prs_domain_report"] = f"""with {SCORES}, q as (select *, greatest(0.02, max(cosine) over (partition by doc_id) * 0.25) as need from sc),
    t as (select doc_id, domain, cosine, row_number() over (partition by doc_id order by cosine desc, domain) as no from (select * from q where cosine >= need) qualify no <= 3),
    rows0 as (select doc_id, 1 as section, no as ord, domain as key, {_shown('cosine')} as value from t union all select doc_id, 2, row_number() over (partition by doc_id order by cosine desc, domain) - 1, domain, {_shown('cosine')} from sc)
    select doc_id, string_agg(section || '. ' || key || ': ' || value, chr(10) order by section, ord, key) as report from rows0 group by doc_id"""
