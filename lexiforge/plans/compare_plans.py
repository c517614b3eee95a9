"""Queries on pairs of documents: near ids of one source, and documents against benchmark texts by their order."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.functions.text import similarity_label
from lexiforge.operators import compare as K
from lexiforge.operators import metrics, reports
from lexiforge.plans.shared import ANN, SENT, documents, rule_annotator, tokens

WINDOW = 40


def pairs(spark, d):
    return K.nearby_pairs(documents(spark, d), "source", WINDOW)


def compared(spark, d):
    docs = documents(spark, d)
    return K.compare(pairs(spark, d), rule_annotator(docs), docs, rounded=False)


def _six(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


SERVICE = ("the", "and", "of")
PAIRS = f"pairs as (select a.doc_id as left_id, b.doc_id as right_id from documents a join documents b on a.source = b.source and b.doc_id > a.doc_id and b.doc_id - a.doc_id <= {WINDOW})"
LEMMAS = "lem as (select doc_id, lemma, count(*) as n from ann group by all), sizes as (select doc_id, count(*) as k from lem group by 1)"
JACCARD = f"""common as (select left_id, right_id, count(*) as n from pairs join lem a on a.doc_id = left_id join lem b on b.doc_id = right_id and b.lemma = a.lemma group by all),
jac as (select p.left_id, p.right_id, coalesce(c.n, 0) as n_common, coalesce(s1.k, 0) + coalesce(s2.k, 0) - coalesce(c.n, 0) as n_union, coalesce(coalesce(c.n, 0)::DOUBLE / nullif((coalesce(s1.k, 0) + coalesce(s2.k, 0) - coalesce(c.n, 0))::DOUBLE, 0), 0.0) as jaccard
    from pairs p left join common c using (left_id, right_id) left join sizes s1 on s1.doc_id = left_id left join sizes s2 on s2.doc_id = right_id)"""
SHARES = """pc as (select doc_id, pos_label as tag, count(*) as n from ann group by all), sh as (select doc_id, tag, n::DOUBLE / (sum(n) over (partition by doc_id))::DOUBLE as share from pc), tagged as (select distinct doc_id from sh),
lo as (select left_id, right_id, sum(least(a.share, b.share)) as m from pairs join sh a on a.doc_id = left_id join sh b on b.doc_id = right_id and a.tag = b.tag group by all),
pos as (select p.left_id, p.right_id, greatest(0.0, 1 - ((case when t1.doc_id is null then 0 else 1 end) + (case when t2.doc_id is null then 0 else 1 end) - 2 * coalesce(m, 0.0)) / 2) as pos_similarity from pairs p left join lo using (left_id, right_id) left join tagged t1 on t1.doc_id = left_id left join tagged t2 on t2.doc_id = right_id)"""
SYNTAX = """sl as (select doc_id, coalesce(list_sum(lens)::DOUBLE / nullif(len(lens), 0)::DOUBLE, 0.0) as mean_len from sent),
syn as (select left_id, right_id, greatest(0.0, 1 - abs(a.mean_len - b.mean_len) / greatest(a.mean_len, b.mean_len, 1.0)) as syntactic_similarity from pairs join sl a on a.doc_id = left_id join sl b on b.doc_id = right_id)"""
TTR = """tt as (select doc_id, count(*)::DOUBLE / sum(n)::DOUBLE as ttr from lem group by 1),
ttr as (select left_id, right_id, greatest(0.0, 1 - abs(coalesce(a.ttr, 0) - coalesce(b.ttr, 0)) / greatest(coalesce(a.ttr, 0), coalesce(b.ttr, 0), 0.01)) as ttr_similarity from pairs left join tt a on a.doc_id = left_id left join tt b on b.doc_id = right_id)"""
BIGRAM = """bg0 as (select doc_id, upos || ' ' || lead(upos) over (partition by doc_id order by tok_idx) as pair from ann), bg1 as (select doc_id, pair, count(*) as n from bg0 where pair is not null group by all),
bg as (select doc_id, pair, n::DOUBLE / (sum(n) over (partition by doc_id))::DOUBLE as f from bg1), nrm as (select doc_id, sqrt(sum(f * f)) as norm from bg group by 1),
dot as (select left_id, right_id, sum(a.f * b.f) as dot from pairs join bg a on a.doc_id = left_id join bg b on b.doc_id = right_id and a.pair = b.pair group by all),
big as (select p.left_id, p.right_id, coalesce(dot / (n1.norm * n2.norm), 0.0) as bigram_similarity from pairs p left join dot using (left_id, right_id) left join nrm n1 on n1.doc_id = left_id left join nrm n2 on n2.doc_id = right_id)"""
ALL = f"with {ANN}, {SENT}, {PAIRS}, {LEMMAS}, {JACCARD}, {SHARES}, {SYNTAX}, {TTR}, {BIGRAM}, parts as (select * from jac join pos using (left_id, right_id) join syn using (left_id, right_id) join ttr using (left_id, right_id) join big using (left_id, right_id)), whole as (select *, jaccard * 0.30::DOUBLE + pos_similarity * 0.20::DOUBLE + syntactic_similarity * 0.15::DOUBLE + ttr_similarity * 0.15::DOUBLE + bigram_similarity * 0.20::DOUBLE as overall from parts)"
VERDICT = "case when overall >= 0.7 then 'high' when overall >= 0.5 then 'medium' when overall >= 0.3 then 'low' else 'minimal' end"


def lemmas(spark, d):
    return K.lemma_counts(tokens(spark, d))


def sets(spark, d):
    l = lemmas(spark, d).groupBy("doc_id").agg(F.collect_set("lemma").alias("s"))
    p = pairs(spark, d)
    p = p.join(l.select(F.col("doc_id").alias("left_id"), F.col("s").alias("a")), "left_id").join(l.select(F.col("doc_id").alias("right_id"), F.col("s").alias("b")), "right_id")
    size = lambda c, name: F.size(c).cast("long").alias(name)
    return p.select("left_id", "right_id", size(F.array_intersect("a", "b"), "n_both"), size(F.array_union("a", "b"), "n_any"), size(F.array_except("a", "b"), "n_left"))


QUERIES = {
    "cmp_jaccard": lambda s, d: K.jaccard(pairs(s, d), lemmas(s, d)),
    "set_intersect": sets,
    "set_except": lambda s, d: K.jaccard(pairs(s, d), lemmas(s, d).where(~F.col("lemma").isin(*SERVICE))).select("left_id", "right_id", "n_common"),
    "cmp_pos_sim": lambda s, d: _six(K.tag_similarity(pairs(s, d), metrics.tag_shares(tokens(s, d))), "pos_similarity"),
    "cmp_syntax_sim": lambda s, d: K.syntax_similarity(pairs(s, d), metrics.sentence_stats(documents(s, d))),
    "cmp_ttr_sim": lambda s, d: K.ttr_similarity(pairs(s, d), metrics.lemma_diversity(tokens(s, d))),
    "cmp_bigram_cos": lambda s, d: _six(K.bigram_similarity(pairs(s, d), metrics.tag_bigrams(tokens(s, d)), rounded=False), "bigram_similarity"),
    "join_bigram_outer": lambda s, d: K.bigram_similarity(pairs(s, d), metrics.tag_bigrams(tokens(s, d)), rounded=False).select("left_id", "right_id", (F.col("bigram_similarity") > 0).alias("shared")),
    "cmp_common_lemmas": lambda s, d: K.common_lemmas(pairs(s, d), lemmas(s, d), 30, SERVICE).select("left_id", "right_id", F.array_join("common", " ").alias("common")),
    "topk_common": lambda s, d: K.common_lemmas(pairs(s, d), lemmas(s, d), 5, SERVICE).select("left_id", "right_id", F.array_join("common", " ").alias("common")),
    "cmp_overall": lambda s, d: _six(compared(s, d).select("left_id", "right_id", "overall"), "overall"),
    "cmp_pipeline": lambda s, d: _six(compared(s, d).drop("verdict"), "jaccard", "pos_similarity", "syntactic_similarity", "ttr_similarity", "bigram_similarity", "overall"),
    "cmp_verdict": lambda s, d: compared(s, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("n")),
    "cls_similarity": lambda s, d: K.jaccard(pairs(s, d), lemmas(s, d)).select("left_id", "right_id", similarity_label(F.col("jaccard")).alias("level")),
    "orc_compare": lambda s, d: compared(s, d).join(K.common_lemmas(pairs(s, d), lemmas(s, d), 30, SERVICE), ["left_id", "right_id"], "left").select("left_id", "right_id", "verdict", F.coalesce(F.size("common"), F.lit(0)).cast("long").alias("n_common")),
}

_svc = "('the', 'and', 'of')"
_common = lambda k: f"with {ANN}, {PAIRS}, {LEMMAS}, c as (select left_id, right_id, a.lemma, a.n + b.n as n from pairs join lem a on a.doc_id = left_id join lem b on b.doc_id = right_id and b.lemma = a.lemma where a.lemma not in {_svc}), r as (select *, row_number() over (partition by left_id, right_id order by n desc, lemma) as no from c) select left_id, right_id, string_agg(lemma, ' ' order by no) as common, count(*) as n_common from r where no <= {k} group by all"
ORACLE = {
    "cmp_jaccard": f"with {ANN}, {PAIRS}, {LEMMAS}, {JACCARD} select * from jac",
    "set_intersect": f"with {ANN}, {PAIRS}, {LEMMAS}, {JACCARD} select j.left_id, j.right_id, n_common as n_both, n_union as n_any, s1.k - n_common as n_left from jac j join sizes s1 on s1.doc_id = left_id join sizes s2 on s2.doc_id = right_id",
    "set_except": f"with {ANN}, {PAIRS}, {LEMMAS}, c as (select left_id, right_id, count(*) as n from pairs join lem a on a.doc_id = left_id join lem b on b.doc_id = right_id and b.lemma = a.lemma where a.lemma not in {_svc} group by all) select left_id, right_id, coalesce(n, 0) as n_common from pairs left join c using (left_id, right_id)",
    "cmp_pos_sim": f"with {ANN}, {PAIRS}, {SHARES} select left_id, right_id, round(pos_similarity, 6) as pos_similarity from pos",
    "cmp_syntax_sim": f"with {SENT}, {PAIRS}, {SYNTAX} select * from syn",
    "cmp_ttr_sim": f"with {ANN}, {PAIRS}, {LEMMAS}, {TTR} select * from ttr",
    "cmp_bigram_cos": f"with {ANN}, {PAIRS}, {BIGRAM} select left_id, right_id, round(bigram_similarity, 6) as bigram_similarity from big",
    "join_bigram_outer": f"with {ANN}, {PAIRS}, {BIGRAM} select left_id, right_id, bigram_similarity > 0 as shared from big",
    "cmp_common_lemmas": f"select left_id, right_id, common from ({_common(30)})",
    "topk_common": f"select left_id, right_id, common from ({_common(5)})",
    "cmp_overall": f"{ALL} select left_id, right_id, round(overall, 6) as overall from whole",
    "cmp_pipeline": f"{ALL} select left_id, right_id, round(jaccard, 6) as jaccard, round(pos_similarity, 6) as pos_similarity, round(syntactic_similarity, 6) as syntactic_similarity, round(ttr_similarity, 6) as ttr_similarity, round(bigram_similarity, 6) as bigram_similarity, round(overall, 6) as overall from whole",
    "cmp_verdict": f"{ALL} select {VERDICT} as verdict, count(*) as n from whole group by 1",
    "cls_similarity": f"with {ANN}, {PAIRS}, {LEMMAS}, {JACCARD} select left_id, right_id, case when jaccard >= 0.7 then 'high' when jaccard >= 0.5 then 'medium' when jaccard >= 0.3 then 'low' else 'minimal' end as level from jac",
}
_PARTS = ("overall", "jaccard", "pos_similarity", "syntactic_similarity", "ttr_similarity", "bigram_similarity")
COMPARED_ROWS = f"{ALL} " + " union all ".join(f"select left_id, right_id, {i} as ord, '{k}' as key, round(round({k}, 9), 3)::VARCHAR as value from whole" for i, k in enumerate(_PARTS)) + f" union all select left_id, right_id, {len(_PARTS)}, 'verdict', {VERDICT} from whole"
ORACLE["orc_compare"] = f"{ALL}, c as (select left_id, right_id, a.lemma from pairs join lem a on a.doc_id = left_id join lem b on b.doc_id = right_id and b.lemma = a.lemma where a.lemma not in {_svc}), cc as (select left_id, right_id, least(30, count(*)) as n from c group by all) select left_id, right_id, {VERDICT} as verdict, coalesce(n, 0)::BIGINT as n_common from whole left join cc using (left_id, right_id)"
