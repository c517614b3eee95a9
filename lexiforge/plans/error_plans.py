"""Queries on error spans: a checker's and a speller's matches are made of places in the documents."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lexiforge.functions import constants as C, text as X
from lexiforge.operators import errors as R
from lexiforge.operators import punctuation as P
from lexiforge.operators.metrics import sentence_stats
from lexiforge.plans import rule_sql
from lexiforge.plans.shared import WORD, documents, sql_list, sql_map
from lexiforge.sources.shared import scratch

CATEGORIES = ("TYPOS", "grammar", "STYLE", "OTHER", "PUNCTUATION")
RULES = ("R0", "WHITESPACE_RULE", "R2", "R3", "DOUBLE_PUNCTUATION", "R5", "R6")


#: A match for so many characters of a text that are begun, and one at least.
EVERY = 400


def _places(spark, d):
    """(doc_id, text, k, i): texts of 60 characters or more by stretches k; i numbers what is found there."""
    docs = documents(spark, d).where(F.char_length("text") >= 60)
    return docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor(F.char_length("text") / EVERY).cast("int"))).alias("k")).withColumn("i", F.col("doc_id") + F.col("k"))


def checker_matches(spark, d):
    """Matches all over each text, at places that follow from its id; some are long and reach over others."""
    i, size = F.col("i"), F.char_length("text")
    pick = lambda names: F.get(F.array(*map(F.lit, names)), (i % len(names)).cast("int"))
    options = F.when(i % 3 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"))).when(i % 3 == 1, F.array(F.lit("x"))).otherwise(F.expr("cast(array() as array<string>)"))
    at = F.least(F.col("k") * EVERY + i * 37 % 350, size - 6).cast("int")
    found = _places(spark, d).withColumn("offset", at)
    length = F.least(F.when(i % 5 == 0, EVERY).otherwise(6), size - F.col("offset")).cast("int")
    return found.select("doc_id", pick(RULES).alias("rule_id"), pick(CATEGORIES).alias("category"), F.when(i % 2 == 0, "a message").alias("message"), "offset", length.alias("length"), options.alias("replacements"))


PLACES = f"m0 as (select *, doc_id + k as i from (select doc_id, text, unnest(range(length(text) // {EVERY} + 1)) as k from documents where length(text) >= 60))"
MATCHES = f"""{PLACES}, m1 as (select *, least(k * {EVERY} + i * 37 % 350, length(text) - 6) as a from m0), m2 as (select *, least(case when i % 5 = 0 then {EVERY} else 6 end, length(text) - a) as len from m1),
m as (select doc_id, text, {str(list(RULES))}[i % 7 + 1] as rule_id, {str(list(CATEGORIES))}[i % 5 + 1] as category, case when i % 2 = 0 then 'a message' end as message, a, len, case i % 3 when 0 then '→ a (или: b, c)' when 1 then '→ x' else 'Исправьте вручную' end as suggestion from m2),
lt as (select doc_id, coalesce({sql_map(C.CHECKER_CATEGORIES)}[upper(category)], 'LanguageTool') as error_type, coalesce(message, rule_id) as subtype, substring(text, a + 1, len) as fragment, suggestion, a as s, a + len as e, 'LT:' || rule_id as rule_ref, text from m where rule_id not in {sql_list(C.SKIPPED_RULES)})"""


def checker(spark, d):
    return R.from_checker(checker_matches(spark, d), documents(spark, d))


def speller_matches(spark, d):
    """Matches all over each text, of five letters each."""
    i = F.col("i")
    at = F.least(F.col("k") * EVERY + i * 53 % 390, F.char_length("text") - 5).cast("int")
    found = _places(spark, d).withColumn("pos", at)
    return found.select("doc_id", (i % 4).alias("code"), "pos", F.lit(5).alias("len"), F.substring(F.col("text"), F.col("pos") + 1, F.lit(5)).alias("word"), F.when(i % 2 == 0, F.array(F.lit("p"), F.lit("q"))).otherwise(F.array(F.lit("p"))).alias("s"))


def speller(spark, d):
    return R.from_speller(speller_matches(spark, d), documents(spark, d))


SPELLER = f"""{PLACES.replace('m0', 'n0')}, n1 as (select *, least(k * {EVERY} + i * 53 % 390, length(text) - 5) as s from n0),
sp as (select doc_id, coalesce(map([1,2,3], {str(list(C.SPELLER_CODES.values()))})[i % 4], '{C.SPELLER_CODES[1]}') as subtype, substring(text, s + 1, 5) as fragment, case when i % 2 = 0 then '→ p (или: q)' else '→ p' end as suggestion, s, s + 5 as e, text from n1)"""
_context = lambda n: f"(case when s > {n} then '…' else '' end) || translate(substring(text, greatest(0, s - {n}) + 1, least(length(text), e + {n}) - greatest(0, s - {n})), chr(10), ' ') || (case when e + {n} < length(text) then '…' else '' end)"


def totals(spark, d):
    return documents(spark, d).select("doc_id", X.word_count(F.col("text")).alias("total"))


SKILL = f"""{MATCHES}, un as (select distinct doc_id, error_type, subtype, regexp_replace(lower(fragment), '^\\s+|\\s+$', '', 'g') as f from lt), t as (select doc_id, len(regexp_extract_all(text, '{WORD}'))::BIGINT as total from documents)"""
_level = "case when total = 0 then 'нулевая' when round(errors * (200.0::DOUBLE / greatest(total, 1)), 1) < 4 then 'высокая' when round(errors * (200.0::DOUBLE / greatest(total, 1)), 1) <= 6 then 'средняя' else 'низкая' end"
USER = ("the", "and")


def user_filter(spark, d):
    return R.without_user_words(speller(spark, d).withColumn("fragment", F.regexp_extract("fragment", r"\p{L}+", 0)), spark.createDataFrame([(w,) for w in USER], "word string"))


def chunked(spark, d):
    return R.chunks(documents(spark, d), 500)


def answers(asked):
    """A service's answers (chunk_key, speller, checker): long words are unknown, a word after itself is repeated; some requests fail."""
    words = asked.select("chunk_key", F.posexplode(F.regexp_extract_all("chunk", F.lit(r"[^\p{L}]*\p{L}+"), F.lit(0))).alias("i", "piece"))
    order = Window.partitionBy("chunk_key").orderBy("i")
    words = words.withColumns({"word": F.regexp_extract("piece", r"\p{L}+$", 0), "end": F.sum(F.char_length("piece")).over(order).cast("int")})
    words = words.withColumns({"len": F.char_length("word"), "again": F.lower("word") == F.lag(F.lower("word")).over(order)})
    unknown = F.struct(F.lit(1).alias("code"), (F.col("end") - F.col("len")).alias("pos"), "len", "word", F.array(F.lower("word")).alias("s"))
    repeated = F.struct(F.lit("REPEATED_WORD").alias("rule_id"), F.lit("STYLE").alias("category"), F.lit("a repeated word").alias("message"), (F.col("end") - F.col("len")).alias("offset"), F.col("len").alias("length"), F.array("word").alias("replacements"))
    found = words.groupBy("chunk_key").agg(F.collect_list(F.when(F.col("len") >= LONG, unknown)).alias("speller"), F.collect_list(F.when(F.col("again"), repeated)).alias("checker"))
    return asked.select("chunk_key").join(found, "chunk_key", "left").where("left(chunk_key, 1) <> '0'")


LONG = 12


def kept_answers(spark, d):
    """The answers on all chunks, asked in two runs and kept in a table: the second run asks only what the first did not."""
    pieces, path = chunked(spark, d), scratch(spark)
    answers(R.requests(pieces.where("doc_id % 2 = 0"))).write.parquet(path)
    answers(R.requests(pieces, spark.read.parquet(path))).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def asked_speller(spark, d):
    found = R.answered_matches(answers(R.requests(chunked(spark, d))).select("chunk_key", F.col("speller").alias("matches")), chunked(spark, d), "pos")
    return R.from_speller(found, documents(spark, d))


def asked_checker(spark, d):
    found = R.answered_matches(answers(R.requests(chunked(spark, d))).select("chunk_key", F.col("checker").alias("matches")), chunked(spark, d), "offset")
    return R.from_checker(found, documents(spark, d))


def intervals(spark, d):
    return documents(spark, d).select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("start"), (F.col("doc_id") % 300).cast("int").alias("end")), F.struct(F.lit(50).alias("start"), F.lit(40).alias("end"))))).select("doc_id", "col.*")


def russian(spark, d):
    """Documents in Cyrillic letters, with words of the punctuation rules in place of common ones."""
    text = F.col("text")
    for old, new in (("the", "который"), ("and", "потому что"), ("for", "однако"), ("les", "который"), ("und", "так как")):
        text = F.regexp_replace(text, rf"\b{old}\b", new)
    text = F.regexp_replace(text, r"(?m)(^|(?<=\. ))(Is|In|Le|Der) ", "Конечно ")
    return documents(spark, d).select("doc_id", F.translate(text, "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшхыз").alias("text"))


TREE_TOKENS = "doc_id long, tok_idx int, sent_id int, token_id int, text string, upos string, pos_label string, head int, char_start int, char_end int"


def tree_rows(texts):
    """Rows of TREE_TOKENS, one by one, from (doc_id, text)."""
    import re

    word, stop = re.compile(r"[^\W\d_]+"), re.compile("[.!?]")
    labels = {3: ("VERB", C.GERUND), 5: ("VERB", C.PARTICIPLE)}
    for doc_id, text in texts:
        sent, no, end, text = 0, 0, 0, text or ""
        for i, m in enumerate(word.finditer(text)):
            start = m.start()
            if stop.search(text, end, start):
                sent, no = sent + 1, 0
            end, no = m.end(), no + 1
            yield (doc_id, i, sent, no, m[0], *labels.get(no % 7, ("NOUN", "Существительное")), no - 1 if no % 7 != 1 else 0, start, end)


def syntax_tokens(spark, d):
    """Words of those texts with places, sentences, and a tree that follows from their order: each hangs on the one before, but every few start anew."""

    def run(batches):
        # A batch of texts has hundreds of times as many tokens, which are never held together.
        return P.batched(tree_rows((i.as_py(), text.as_py()) for b in batches for i, text in zip(b.column(0), b.column(1))), TREE_TOKENS)

    return russian(spark, d).select("doc_id", "text").mapInArrow(run, TREE_TOKENS)


def on_trees(spark, d):
    return P.check_trees(syntax_tokens(spark, d), russian(spark, d))


GENERATED = "g as (select doc_id, least(1.0, greatest(0, doc_id % 300) / nullif(length(text), 0)::DOUBLE) as score from documents)"

QUERIES = {
    "prj_lt_map": lambda s, d: checker(s, d).select("doc_id", "error_type", "subtype", "fragment", "suggestion", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "rule_ref", "context"),
    "flt_lt_skip": lambda s, d: checker(s, d).groupBy("rule_ref").agg(F.count(F.lit(1)).alias("n")),
    "prj_speller_map": lambda s, d: speller(s, d).select("doc_id", "subtype", "fragment", "suggestion", F.col("start").cast("long").alias("start"), "context"),
    "flt_errors": lambda s, d: R.filtered(checker(s, d).unionByName(speller(s, d)), "LT", "Стилистическая").select("doc_id", "fragment"),
    "agg_error_dedup": lambda s, d: R.unique_errors(checker(s, d)).groupBy("doc_id", "error_type").agg(F.count(F.lit(1)).alias("n")),
    "agg_skill_level": lambda s, d: R.skills(checker(s, d), totals(s, d)).select("doc_id", "skill", "errors", "level"),
    "cls_skill": lambda s, d: R.skills(checker(s, d), totals(s, d)).groupBy("level").agg(F.count(F.lit(1)).alias("n")),
    "agg_general_skill": lambda s, d: R.general_skill(checker(s, d), totals(s, d)).select("doc_id", "errors"),
    "join_user_dict_filter": lambda s, d: user_filter(s, d).select("doc_id", "fragment"),
    "snk_highlight": lambda s, d: R.highlights(checker(s, d)).select("doc_id", F.col("start").cast("long").alias("start"), "error_type"),
    "snk_clipboard": lambda s, d: R.clipboard(speller(s, d)),
    "sort_errors": lambda s, d: checker(s, d).orderBy("doc_id", "start").select("doc_id", F.col("start").cast("long").alias("start")),
    "topk_errors": lambda s, d: R.top_errors(checker(s, d), 1).select("doc_id", "error_type", F.col("start").cast("long").alias("start")),
    "snk_error_text": lambda s, d: R.error_lines(checker(s, d)),
    "prj_chunk": chunked,
    "orc_lt_http_check": lambda s, d: asked_checker(s, d).select("doc_id", "start", "end", "fragment", "suggestion"),
    "src_ext_lt": lambda s, d: kept_answers(s, d).select("chunk_key", F.inline("checker")).select("chunk_key", "rule_id", "offset", "length"),
    "src_ext_speller": lambda s, d: kept_answers(s, d).select("chunk_key", F.inline("speller")).select("chunk_key", "pos", "word"),
    "orc_speller_check": lambda s, d: asked_speller(s, d).select("doc_id", "start", "end", "fragment", "suggestion"),
    "join_overlap_dedup": lambda s, d: R.keep_first_spans(checker(s, d)),
    "err_span_priority": lambda s, d: R.keep_first_spans(checker(s, d).unionByName(speller(s, d))),
    "set_error_union": lambda s, d: R.merge_in_stages(checker(s, d), speller(s, d), P.check_text(russian(s, d))),
    "set_rule_union": lambda s, d: P.check(russian(s, d)),
    "punct_kotory": lambda s, d: P.check_text(russian(s, d), ("kotory",)),
    "punct_adverse": lambda s, d: P.check_text(russian(s, d), ("adverse",)),
    "punct_compound": lambda s, d: P.check_text(russian(s, d), ("compound",)),
    "punct_intro": lambda s, d: P.check_text(russian(s, d), ("intro",)),
    "punct_gerund": lambda s, d: on_trees(s, d).where("rule_ref like 'PUNCT:DEEPR%'"),
    "punct_participle": lambda s, d: on_trees(s, d).where("rule_ref like 'PUNCT:PART%'"),
    "punct_all": lambda s, d: P.check(russian(s, d), syntax_tokens(s, d)),
    "join_subtree": lambda s, d: P.subtrees(syntax_tokens(s, d)),
    "join_head": lambda s, d: P.heads(syntax_tokens(s, d)).where(F.col("pos_label") == C.PARTICIPLE).select("doc_id", "tok_idx", "text", "head_text"),
    "orc_sentence_groups": lambda s, d: P.sentence_groups(syntax_tokens(s, d)).select("doc_id", "sent_id", F.size("tokens").cast("long").alias("n"), F.array_join(F.col("tokens.text"), " ").alias("words")),
    "punct_comma_probe": lambda s, d: P.probe_boundaries(documents(s, d)),
    "agg_ai_score": lambda s, d: R.generated_score(intervals(s, d), documents(s, d)),
    "cls_ai": lambda s, d: R.generated_score(intervals(s, d), documents(s, d)).select("doc_id", X.generated_label(F.col("score")).alias("level")),
    "cls_ai_interval": lambda s, d: R.generated_score(intervals(s, d), documents(s, d)).select("doc_id", X.interval_label(F.col("score")).alias("level")),
    "snk_skill_sentences": lambda s, d: sentence_stats(documents(s, d)).select("doc_id", X.report_volume_label(F.col("n_words")).alias("fit")),
}

#: Errors of both sources as rows in the order in which spans are kept.
_PRIORITY = "(case source " + " ".join(f"when '{k}' then {v}" for k, v in C.SOURCE_PRIORITY.items()) + " else 0 end)"
_LT_ROWS = f"select doc_id, error_type, subtype, fragment, subtype as description, suggestion, s, e, rule_ref, 'LT' as source, {_context(45)} as context from lt"
_SP_ROWS = f"select doc_id, 'Орфографическая' as error_type, subtype, fragment, subtype || ': «' || fragment || '»' as description, suggestion, s, e, '' as rule_ref, 'YASPELL' as source, {_context(40)} as context from sp"

_PU_ROWS = 'select doc_id, error_type, subtype, fragment, description, suggestion, start::BIGINT as s, "end"::BIGINT as e, rule_ref, source, context from pu'


def _kept(*sources: str) -> str:
    """Of rows with (s, e), those that overlap none kept before, source by source: each document is walked through in order, with the last start and furthest end of every stage."""
    stages = range(len(sources))
    rows = " union all ".join(f"select *, {k} as stage from ({x})" for k, x in enumerate(sources))
    state = "".join(f", ks{k}, ke{k}" for k in stages)
    step, passed = "w", "true"
    for k in stages:
        passed += f" and (stage > {k} or s >= ke{k} or e <= ks{k})"
        step = step if k else "(select w.doc_id, r.i, r.s, r.e, r.stage" + state + " from walk w join ranked r on r.doc_id = w.doc_id and r.i = w.i + 1)"
    # A span that a later stage drops has been kept by those before it.
    reached = [" and ".join(f"(stage > {j} or s >= ke{j} or e <= ks{j})" for j in range(k + 1)) + f" and stage <= {k}" for k in stages]
    moved = "".join(f", case when {reached[k]} then s else ks{k} end, case when {reached[k]} then greatest(ke{k}, e) else ke{k} end" for k in stages)
    start = "".join(f", -1::BIGINT as ks{k}, -1::BIGINT as ke{k}" for k in stages)
    return f"""rows0 as materialized ({rows}), ranked as materialized (select *, row_number() over (partition by doc_id order by s, -{_PRIORITY}, error_type, subtype, fragment, description, suggestion, e, rule_ref, source, context) as i from rows0),
    walk as (select doc_id, 0::BIGINT as i{start}, false as kept from (select distinct doc_id from ranked)
        union all select doc_id, i{moved}, {passed} from {step})
    select r.doc_id, error_type, subtype, fragment, description, suggestion, s::INT as start, e::INT as "end", rule_ref, source, context from ranked r join walk w using (doc_id, i) where kept"""


ORACLE = rule_sql.ORACLE | {
    "snk_error_text": f"with {MATCHES}, o as (select *, row_number() over (partition by doc_id, error_type order by s, e, fragment) as no from lt) select doc_id, error_type, count(*) as n, string_agg(no || '. «' || fragment || '» ' || subtype || ' → ' || suggestion, chr(10) order by no) filter (no <= 15) as report from o group by all",
    "join_overlap_dedup": f"with recursive {MATCHES}, {_kept(_LT_ROWS)}",
    "err_span_priority": f"with recursive {MATCHES}, {SPELLER}, {_kept(_LT_ROWS + ' union all ' + _SP_ROWS)}",
    "set_error_union": f"with recursive {MATCHES}, {SPELLER}, pu as ({rule_sql.TEXT_RULES}), {_kept(_LT_ROWS, _SP_ROWS, _PU_ROWS)}",
    "snk_skill_sentences": f"select doc_id, case when n >= 500 then 'fit' when n >= 200 then 'preliminary' else 'insufficient' end as fit from (select doc_id, len(regexp_extract_all(text, '{WORD}')) as n from documents)",
    "punct_comma_probe": "with p as (select doc_id, unnest(ps) as piece, generate_subscripts(ps, 1) - 1 as i, len(ps) as n, regexp_extract(text, '[^\\p{L}]*$') as tail from (select doc_id, text, regexp_extract_all(text, '[^\\p{L}]*\\p{L}+') as ps from documents)), g as (select *, regexp_extract(piece, '^[^\\p{L}]*') as l from p), r as (select *, coalesce(lead(l) over (partition by doc_id order by i), tail) as r from g) select doc_id, i::INT as i, regexp_matches(l, '[,;:.!?\\n—–(-][ \\t\\x{00a0}]*$') or (i = 0 and regexp_matches(l, '^[ \\t\\x{00a0}]*$')) as before, regexp_matches(r, '^[ \\t\\x{00a0}]*[,;:.!?\\n—–)-]') or (i + 1 = n and regexp_matches(r, '^[ \\t\\x{00a0}]*$')) as after from r",
    "prj_lt_map": f"with {MATCHES} select doc_id, error_type, subtype, fragment, suggestion, s::BIGINT as start, e::BIGINT as \"end\", rule_ref, {_context(45)} as context from lt",
    "flt_lt_skip": f"with {MATCHES} select rule_ref, count(*) as n from lt group by 1",
    "prj_speller_map": f"with {SPELLER} select doc_id, subtype, fragment, suggestion, s::BIGINT as start, {_context(40)} as context from sp",
    "flt_errors": f"with {MATCHES} select doc_id, fragment from lt where error_type = 'Стилистическая'",
    "agg_error_dedup": f"with {SKILL} select doc_id, error_type, count(*) as n from un group by all",
    "agg_skill_level": f"with {SKILL}, sk as (select unnest({str(list(C.SKILLS))}) as error_type, unnest({str(list(C.SKILLS.values()))}) as skill), n as (select doc_id, error_type, count(*) as errors from un group by all), r as (select t.doc_id, total, skill, coalesce(errors, 0) as errors from t cross join sk left join n on n.doc_id = t.doc_id and n.error_type = sk.error_type) select doc_id, skill, errors, {_level} as level from r",
    "cls_skill": f"with {SKILL}, sk as (select unnest({str(list(C.SKILLS))}) as error_type), n as (select doc_id, error_type, count(*) as errors from un group by all), r as (select t.doc_id, total, coalesce(errors, 0) as errors from t cross join sk left join n on n.doc_id = t.doc_id and n.error_type = sk.error_type) select {_level} as level, count(*) as n from r group by 1",
    "agg_general_skill": f"with {SKILL}, n as (select doc_id, count(*) as errors from un group by 1) select t.doc_id, coalesce(errors, 0) as errors from t left join n using (doc_id)",
    "join_user_dict_filter": f"with {SPELLER}, f as (select doc_id, regexp_extract(fragment, '\\p{{L}}+') as fragment from sp) select * from f where lower(fragment) not in {sql_list(USER)}",
    "snk_highlight": f"with {MATCHES} select doc_id, s::BIGINT as start, error_type from lt",
    "snk_clipboard": f"with {SPELLER} select doc_id, s::INT as start, 'Тип: Орфографическая' || chr(10) || 'Фрагмент: ' || fragment || chr(10) || 'Описание: ' || subtype || ': «' || fragment || '»' || chr(10) || 'Рекомендация: ' || suggestion as line from sp",
    "sort_errors": f"with {MATCHES} select doc_id, s::BIGINT as start from lt",
    "topk_errors": f"with {MATCHES}, o as (select *, row_number() over (partition by doc_id, error_type order by s, e, fragment) as no from lt) select doc_id, error_type, s::BIGINT as start from o where no = 1",
    "agg_ai_score": f"with {GENERATED} select doc_id, coalesce(score, 0.0) as score from g",
    "cls_ai": f"with {GENERATED} select doc_id, case when floor(score * 100) >= 70 then 'high' when floor(score * 100) >= 40 then 'moderate' when floor(score * 100) >= 15 then 'low' else 'human' end as level from g",
    "cls_ai_interval": f"with {GENERATED} select doc_id, case when score >= 0.7 then 'strong' when score >= 0.4 then 'medium' else 'weak' end as level from g",
}
