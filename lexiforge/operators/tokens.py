"""The token table: annotators, tag and feature labels, lemma maps, spans, word tables.

Annotation itself is an input. An annotator is a function from documents (doc_id, text) to the token
table; regex_annotator is the one that needs no models: its lemma is the lower-cased word.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lexiforge.functions import constants as C
from lexiforge.functions.text import is_word, lookup, words

Annotator = Callable[[DataFrame], DataFrame]

TOKENS = (
    "doc_id long, tok_idx int, sent_id int, token_id int, text string, lemma string, upos string, pos_label string, "
    "feats map<string,string>, head int, deprel string, char_start int, char_end int"
)


def explode_words(docs: DataFrame, pattern: str = C.WORD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., tok_idx, text): one row per word."""
    return docs.select(*keep, F.posexplode(words(F.col("text"), pattern)).alias("tok_idx", "text"))


def regex_annotator(docs: DataFrame, pattern: str = C.WORD) -> DataFrame:
    """Words with their lower-cased form as lemma and no syntax; the fallback where there is no model."""
    return explode_words(docs, pattern).select(
        "doc_id", "tok_idx", F.lit(0).alias("sent_id"), (F.col("tok_idx") + 1).alias("token_id"), "text", F.lower("text").alias("lemma"),
        F.lit("X").alias("upos"), F.lit(C.UPOS_NAME["X"]).alias("pos_label"), F.expr("cast(map() as map<string,string>)").alias("feats"),
        F.lit(0).alias("head"), F.lit("").alias("deprel"), F.lit(0).alias("char_start"), F.lit(0).alias("char_end"),
    )


def annotate(docs: DataFrame, annotator: Annotator | None = None) -> DataFrame:
    """The token table of documents; a model-backed annotator brings its own mapInPandas or mapInArrow."""
    return normalise((annotator or regex_annotator)(docs))


def normalise(raw: DataFrame) -> DataFrame:
    """Rules that hold after any annotator: tokens without letters are punctuation, labels follow tag and form."""
    letters = F.col("text").rlike(C.WORD)
    upos = F.when(letters, F.coalesce("upos", F.lit("X"))).otherwise("PUNCT")
    return raw.select(
        *[c for c in raw.columns if c not in ("upos", "lemma", "pos_label", "feats")],
        F.when(letters, F.coalesce("lemma", F.lower("text"))).otherwise(F.col("text")).alias("lemma"),
        upos.alias("upos"),
        F.when(letters, F.col("feats")).otherwise(F.expr("cast(map() as map<string,string>)")).alias("feats"),
        pos_label(upos, F.col("feats")).alias("pos_label"),
    )


def pos_label(upos: Column, feats: Column) -> Column:
    """The Russian name of a tag; participles and gerunds are set apart from other verbs."""
    form = F.try_element_at(feats, F.lit("VerbForm"))
    return F.when((upos == "VERB") & (form == "Part"), C.PARTICIPLE).when((upos == "VERB") & (form == "Conv"), C.GERUND).otherwise(F.coalesce(lookup(C.UPOS_NAME, upos), upos))


def feats_map(conllu: Column) -> Column:
    """A CoNLL-U feature string as a map; empty for "_", "—" or null."""
    none = F.expr("cast(map() as map<string,string>)")
    return F.when(conllu.contains("="), F.str_to_map(conllu, F.lit("\\|"), F.lit("="))).otherwise(none)


def feats_text(conllu: Column) -> Column:
    """A CoNLL-U feature string in Russian: "Ключ: значение; Ключ2: значение2", or "—"."""
    say = lambda x: F.coalesce(lookup(C.FEATURES, x), x)
    pair = lambda p: F.when(p.contains("="), F.concat(say(F.substring_index(p, "=", 1)), F.lit(": "), say(F.regexp_extract(p, "=(.*)$", 1)))).otherwise(say(p))
    return F.when(conllu.isNull() | conllu.isin("", "—"), "—").otherwise(F.array_join(F.transform(F.split(conllu, "\\|"), pair), "; "))


def only_words(tokens: DataFrame, also_not: tuple[str, ...] = ()) -> DataFrame:
    """Tokens with a letter that are not punctuation."""
    return tokens.where(is_word(F.col("text"), F.col("upos")) & ~F.col("upos").isin(*also_not, "PUNCT"))


def lemma_map(tokens: DataFrame) -> DataFrame:
    """(doc_id, form, lemma): lower-cased; the last occurrence of a form decides."""
    return only_words(tokens).groupBy("doc_id", F.lower("text").alias("form")).agg(F.max_by(F.lower("lemma"), "tok_idx").alias("lemma"))


def with_dictionary_lemma(forms: DataFrame, dictionary: DataFrame, form: str = "form") -> DataFrame:
    """forms with the lemma that a dictionary (form, lemma) has, else the form itself in lower case."""
    known = dictionary.groupBy(F.lower("form").alias("_form")).agg(F.min("lemma").alias("_lemma"))
    out = forms.join(known, F.lower(form) == F.col("_form"), "left")
    return out.withColumn("lemma", F.coalesce("_lemma", F.lower(form))).drop("_form", "_lemma")


def thematic_lemmas(tokens: DataFrame) -> DataFrame:
    """Lemmas for topic profiles: no punctuation, no numerals."""
    return tokens.where(~F.col("upos").isin("PUNCT", "NUM")).select("doc_id", "tok_idx", F.lower("lemma").alias("lemma"))


def corpus_lemmas(tokens: DataFrame) -> DataFrame:
    """(doc_id, lemmas): the words' lemmas in order, their case kept. One array per document, as long as its text."""
    ordered = F.array_sort(F.collect_list(F.struct("tok_idx", "lemma")))
    return only_words(tokens).groupBy("doc_id").agg(F.transform(ordered, lambda x: x["lemma"]).alias("lemmas"))


def align_spans(tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, tok_idx, start, end) of word tokens in the text.

    Offsets that an annotator gave are used as they are. Otherwise a token is looked for from where the
    last one ended, then from the start; not found, it has none. That is a running state per document,
    so a document's tokens meet its text in one group; the text is sent once.
    """

    def run(own: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        low, at, out = (texts["text"].iloc[0] or "").lower() if len(texts) else "", 0, []
        for t in own.sort_values("tok_idx").itertuples():
            if t.char_start > 0 or t.char_end > 0:
                start, end = t.char_start, t.char_end
            else:
                word = t.text.lower()
                start = low.find(word, at)
                start = low.find(word) if start < 0 else start
                end = start + len(t.text)
            at = end if start >= 0 else at
            out.append((t.doc_id, t.tok_idx, *((start, end) if start >= 0 else (None, None))))
        return pd.DataFrame(out, columns=["doc_id", "tok_idx", "start", "end"]).astype({"start": "Int32", "end": "Int32"})

    own = only_words(tokens).select("doc_id", "tok_idx", "text", F.coalesce("char_start", F.lit(0)).alias("char_start"), F.coalesce("char_end", F.lit(0)).alias("char_end"))
    return own.groupBy("doc_id").cogroup(docs.select("doc_id", "text").groupBy("doc_id")).applyInPandas(run, "doc_id long, tok_idx int, start int, end int")


def morphology_table(tokens: DataFrame) -> DataFrame:
    """Words with lemma, label and features, as listed to a reader."""
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("feats")), lambda e: F.concat_ws(": ", e["key"], e["value"])), "; ")
    return only_words(tokens).select("doc_id", "tok_idx", "text", "lemma", "pos_label", F.when(F.size("feats") > 0, shown).otherwise("—").alias("feats"))


def search_table(table: DataFrame, query: str) -> DataFrame:
    """Rows whose text, lemma or label contains the query, whatever its case; a blank query keeps all."""
    q = query.strip().lower()
    hit = lambda c: F.lower(c).contains(q)
    return table if not q else table.where(hit("text") | hit("lemma") | hit("pos_label"))
