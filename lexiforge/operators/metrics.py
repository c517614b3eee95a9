"""Stylometric measures per document: diversity, sentences, tags, bigrams, ratios. Values are not rounded.

Everything is a grouped sum with a partial step before its shuffle. Where a measure needs distinct
words or lemmas per document, words are counted per (document, word) first, so that a long document is
spread over many groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexiforge.functions import constants as C
from lexiforge.functions.text import ratio, sentence_lengths, term_count
from lexiforge.operators.tokens import explode_words, only_words


def count_of(test: Column) -> Column:
    return F.sum(F.when(test, 1).otherwise(0)).cast("long")


def lexical_diversity(docs: DataFrame, pattern: str = C.WORD) -> DataFrame:
    """(doc_id, n_words, n_types, n_hapax, n_letters, ttr, hapax_share, avg_word_len); documents without words are left out."""
    forms = explode_words(docs, pattern).groupBy("doc_id", F.lower("text").alias("form")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("letters"))
    out = forms.groupBy("doc_id").agg(F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_types"), count_of(F.col("n") == 1).alias("n_hapax"), F.sum("letters").alias("n_letters"))
    return out.withColumns({"ttr": ratio(F.col("n_types"), F.col("n_words")), "hapax_share": ratio(F.col("n_hapax"), F.col("n_words")), "avg_word_len": ratio(F.col("n_letters"), F.col("n_words"))})


def lemma_diversity(tokens: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_lemmas, n_hapax, lemma_ttr, hapax_share); hapax lemmas are measured against words."""
    forms = only_words(tokens).groupBy("doc_id", F.lower("lemma").alias("lemma")).agg(F.count(F.lit(1)).alias("n"))
    out = forms.groupBy("doc_id").agg(F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_lemmas"), count_of(F.col("n") == 1).alias("n_hapax"))
    return out.withColumns({"lemma_ttr": ratio(F.col("n_lemmas"), F.col("n_words")), "hapax_share": ratio(F.col("n_hapax"), F.col("n_words"))})


def sentence_stats(docs: DataFrame, pattern: str = C.WORD) -> DataFrame:
    """(doc_id, n_sentences, n_words, sum_squares, mean_len, var_len): population variance, 0 with fewer than two sentences."""
    n = docs.select("doc_id", sentence_lengths(F.col("text"), pattern).alias("lens"))
    add = lambda f: F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + f(x.cast("long")))
    n = n.select("doc_id", F.size("lens").cast("long").alias("n_sentences"), add(lambda x: x).alias("n_words"), add(lambda x: x * x).alias("sum_squares"))
    k, s, q = F.col("n_sentences"), F.col("n_words"), F.col("sum_squares")
    return n.withColumns({"mean_len": F.coalesce(ratio(s, k), F.lit(0.0)), "var_len": F.when(k > 1, (q * k - s * s).cast("double") / (k * k).cast("double")).otherwise(0.0)})


def tag_shares(tokens: DataFrame, tag: str = "pos_label") -> DataFrame:
    """(doc_id, tag, n, share) with rank: most frequent first, then by name."""
    per = only_words(tokens).groupBy("doc_id", F.col(tag).alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("doc_id")
    return per.withColumn("share", ratio(F.col("n"), F.sum("n").over(own))).withColumn("rank", F.row_number().over(own.orderBy(F.desc("n"), "tag")))


def content_function(tokens: DataFrame) -> DataFrame:
    """(doc_id, n_content, n_function, content_function, n_noun, n_verb, noun_verb); a ratio over 0 is null, shown as ∞."""
    label = F.col("pos_label")
    out = only_words(tokens).groupBy("doc_id").agg(
        count_of(label.isin(*C.CONTENT_LABELS)).alias("n_content"), count_of(label.isin(*C.FUNCTION_LABELS)).alias("n_function"),
        count_of(label.isin(C.UPOS_NAME["NOUN"], C.UPOS_NAME["PROPN"])).alias("n_noun"), count_of(label.isin(C.UPOS_NAME["VERB"], C.UPOS_NAME["AUX"])).alias("n_verb"),
    )
    return out.withColumns({"content_function": ratio(F.col("n_content"), F.col("n_function")), "noun_verb": ratio(F.col("n_noun"), F.col("n_verb"))})


def style_markers(docs: DataFrame, groups: dict[str, tuple[str, ...]] = C.STYLE_MARKERS) -> DataFrame:
    """(doc_id, grp, marker, n) for every marker; all are counted in one pass over the text."""
    counts = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(m).alias("marker"), term_count(F.col("text"), m).alias("n")) for g, ms in groups.items() for m in ms])
    return docs.select("doc_id", F.inline(counts))


def sequence_bigrams(rows: DataFrame, key: str, order: list[str], tag: str) -> DataFrame:
    """(key, p1, p2, n, total, freq): adjacent tags of any ordered sequence."""
    after = F.lead(tag).over(Window.partitionBy(key).orderBy(*order))
    pairs = rows.select(key, F.col(tag).alias("p1"), after.alias("p2")).where("p2 is not null").groupBy(key, "p1", "p2").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(key))
    return pairs.withColumn("total", total).withColumn("freq", ratio(F.col("n"), F.col("total")))


def tag_bigrams(tokens: DataFrame, tag: str = "upos") -> DataFrame:
    """Adjacent tags of words; pairs run across sentence ends."""
    return sequence_bigrams(only_words(tokens), "doc_id", ["tok_idx"], tag)


def top_bigrams(bigrams: DataFrame, key: str = "doc_id", k: int = 20) -> DataFrame:
    """The k most frequent pairs of each key; ties by name."""
    return bigrams.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "p1", "p2"))).where(F.col("rank") <= k)


def bigram_matrix(bigrams: DataFrame, tags: list[str], key: str = "doc_id") -> DataFrame:
    """One row per (key, p1) with a column per tag, 0.0 where a pair is missing; a key has all its tags as rows."""
    seen = bigrams.select(key, F.explode(F.array("p1", "p2")).alias("p1")).distinct()
    wide = bigrams.groupBy(key, "p1").pivot("p2", tags).agg(F.sum("freq"))
    return seen.join(wide, [key, "p1"], "left").na.fill(0.0, tags)


def morph_stats(tokens: DataFrame) -> DataFrame:
    """(doc_id, category, value, n, per_100): how often a feature has a value, per 100 words."""
    names = {k: v for k, v in C.FEATURES.items() if v in C.MORPH_CATEGORIES}
    say = F.create_map(*[F.lit(x) for pair in C.FEATURES.items() for x in pair])
    # An entry without a name stands for the word itself, so that one pass counts words and values alike.
    word = F.array(F.struct(F.lit("").alias("key"), F.lit("").alias("value")))
    entries = F.concat(F.filter(F.map_entries(F.coalesce("feats", F.expr("cast(map() as map<string,string>)"))), lambda e: e["key"].isin(*names)), word)
    per = only_words(tokens).select("doc_id", F.inline(entries).alias("k", "v")).groupBy("doc_id", "k", "v").agg(F.count(F.lit(1)).alias("n"))
    total = F.max(F.when(F.col("k") == "", F.col("n"))).over(Window.partitionBy("doc_id"))
    per = per.withColumn("total", total).where("k <> ''")
    said = F.lower(F.coalesce(F.try_element_at(say, F.col("v")), F.col("v")))
    return per.groupBy("doc_id", say[F.col("k")].alias("category"), said.alias("value"), "total").agg(F.sum("n").alias("n")).select("doc_id", "category", "value", "n", (F.col("n") * 100 / F.col("total")).alias("per_100"))


def _ratios(counts: DataFrame, rows: list[tuple[int, str, str]]) -> DataFrame:
    """(doc_id, no, numerator, denominator, value) from one row of counts per document; both are SQL expressions."""
    cells = F.array(*[F.struct(F.lit(no).alias("no"), F.expr(a).cast("long").alias("numerator"), F.expr(b).cast("long").alias("denominator")) for no, a, b in rows])
    out = counts.select("doc_id", F.inline(cells))
    return out.withColumn("value", ratio(F.col("numerator"), F.col("denominator")))


def label_counts(tokens: DataFrame) -> DataFrame:
    """Counts per document that the 20 coefficients by label stand on."""
    label, feats = F.col("pos_label"), lambda k: F.try_element_at("feats", F.lit(k))
    name = C.UPOS_NAME
    of = lambda *labels: count_of(label.isin(*labels))
    return only_words(tokens).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total"), of(name["PRON"], name["DET"]).alias("pron"), of(name["VERB"], name["AUX"]).alias("verb"),
        of(name["ADJ"]).alias("adj"), of(name["ADV"]).alias("adv"), of(name["NOUN"], name["PROPN"]).alias("noun"), of(C.PARTICIPLE).alias("participle"),
        of(C.GERUND).alias("gerund"), of(name["NUM"]).alias("num"), of(name["ADP"]).alias("prep"), of(name["PART"]).alias("particle"),
        of(name["CCONJ"], name["SCONJ"]).alias("conj"), count_of((label == name["ADJ"]) & (feats("Variant") == "Short")).alias("short_adj"),
        count_of(F.col("upos").isin("PRON", "DET") & (feats("Poss") == "Yes")).alias("poss"), count_of((F.col("upos") == "PRON") & (feats("PronType") == "Prs")).alias("pers"),
    )


# The 20 coefficients by label, as numerator and denominator.
COEFFICIENTS = [
    (1, "pron", "total"), (2, "verb", "total"), (3, "adj", "total"), (4, "adv", "total"), (5, "short_adj", "adj"), (6, "poss", "pron"),
    (7, "adj", "noun"), (8, "pron", "adj"), (9, "noun", "verb"), (10, "pron", "verb"), (11, "num", "total"), (12, "prep", "total"),
    (13, "particle", "total"), (14, "conj", "total"), (15, "adv", "adj"), (16, "participle", "total"), (17, "gerund", "total"),
    (18, "verb", "adv"), (19, "adj + participle", "gerund"), (20, "adj + num", "total"),
]


def coefficients(tokens: DataFrame) -> DataFrame:
    """The 20 coefficients by label."""
    return _ratios(label_counts(tokens), COEFFICIENTS)


def tag_counts(tokens: DataFrame, sentences: DataFrame) -> DataFrame:
    """Counts per document that the 20 indices by tag stand on; sentences: (doc_id, n_sentences)."""
    tag, lemma = F.col("upos"), F.lower("lemma")
    has = lambda k, v: F.try_element_at("feats", F.lit(k)) == v
    of = lambda *tags: count_of(tag.isin(*tags))
    cased = tag.isin("NOUN", "PROPN", "PRON")
    counts = only_words(tokens, ("SYM",)).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total"), of("NOUN", "PROPN").alias("noun"), of("PROPN").alias("propn"), of("PRON").alias("pron"), of("PRON", "DET").alias("pron_det"),
        of("VERB", "AUX").alias("verb"), of("ADJ").alias("adj"), of("ADV").alias("adv"), of("NUM").alias("num"), of("ADP").alias("adp"), of("CCONJ", "SCONJ").alias("conj"),
        of("ADJ", "DET", "PART").alias("adj_det_part"), of("ADP", "CCONJ", "SCONJ", "PART", "DET", "INTJ").alias("func"), of("ADP", "CCONJ", "SCONJ", "PART").alias("serv"),
        count_of((tag == "PRON") & lemma.isin(*C.PERSONAL)).alias("pers"), count_of((tag == "ADV") & lemma.isin(*C.PREDICATIVE)).alias("pred"),
        count_of(has("Tense", "Pres")).alias("pres"), count_of(has("Tense", "Fut")).alias("fut"), count_of(has("Tense", "Past")).alias("past"),
        count_of(has("VerbForm", "Part")).alias("participle"), count_of(has("VerbForm", "Conv")).alias("gerund"),
        count_of(cased & has("Case", "Nom")).alias("nom"), count_of(cased & has("Case", "Gen")).alias("gen"), count_of(cased & F.map_contains_key("feats", "Case")).alias("cased"),
    )
    return counts.join(sentences.select("doc_id", "n_sentences"), "doc_id", "left").withColumn("sentences", F.greatest(F.coalesce("n_sentences", F.lit(0)), F.lit(1))).drop("n_sentences")


# The 20 indices by tag; the 7th needs semantic marking and has no value.
INDICES = [
    (1, "noun", "total"), (2, "pron_det", "total"), (3, "verb", "total"), (4, "pron", "func"), (5, "pers", "pron_det"), (6, "propn", "noun"),
    (7, "null", "null"), (8, "pres + fut", "past"), (9, "noun", "adj_det_part"), (10, "noun", "pron_det"), (11, "adj", "total"),
    (12, "participle", "total"), (13, "gerund", "total"), (14, "adv - pred", "total"), (15, "func", "sentences"),
    (16, "noun + adj + adv - pred + num + pron_det", "verb + pred"), (17, "serv", "total"), (18, "conj", "adp"), (19, "nom + gen", "cased"),
    (20, "verb + noun", "total"),
]


def indices(tokens: DataFrame, sentences: DataFrame) -> DataFrame:
    """The 20 indices by tag."""
    return _ratios(tag_counts(tokens, sentences), INDICES)
