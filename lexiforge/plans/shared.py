"""What the plans share: tables, a rule-based annotator for tables without annotation, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiforge.functions import constants as C
from lexiforge.operators.tokens import explode_words, pos_label

WORD = C.WORD
LATIN = r"\p{L}+"
TAGS = ("NOUN", "VERB", "ADJ", "PRON", "ADP", "ADV", "DET", "CCONJ", "PART", "PROPN", "AUX", "NUM")
MARKERS = {"en": ("the", "and", "that", "with"), "de": ("und", "der", "nicht"), "fr": ("les", "des", "que"), "es": ("los", "que", "para")}
SLANG = ("the", "and", "ti", "es")
SHORT = ("th", "er", "es")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def rule_annotator(docs: DataFrame) -> DataFrame:
    """Tokens whose tag and features follow from a word's length and place: annotation for tables that have none."""
    n, at, tag = F.char_length("text"), F.col("tok_idx"), F.col("upos")
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i)
    nominal = tag.isin("NOUN", "PROPN", "PRON", "ADJ")
    feats = [
        ("Case", F.when(nominal, pick(("Nom", "Gen", "Acc"), n % 3))), ("Number", F.when(nominal, pick(("Sing", "Plur"), n % 2))),
        ("Tense", F.when(tag.isin("VERB", "AUX"), pick(("Past", "Pres", "Fut"), at % 3))), ("VerbForm", F.when(tag == "VERB", pick(("Fin", "Part", "Conv"), (at + n) % 3))),
        ("Variant", F.when((tag == "ADJ") & (at % 4 == 0), "Short")), ("Poss", F.when((tag == "DET") & (at % 2 == 0), "Yes")), ("PronType", F.when(tag == "PRON", "Prs")),
    ]
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in feats]), lambda e: e["value"].isNotNull())
    out = explode_words(docs, keep=("doc_id", "lang")).withColumn("upos", pick(TAGS, n % len(TAGS))).withColumn("feats", F.map_from_entries(entries))
    return out.withColumns({"lemma": F.lower("text"), "pos_label": pos_label(F.col("upos"), F.col("feats"))})


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_annotator(documents(spark, sf_dir))


def sql_list(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


def sql_array(values) -> str:
    return "[" + sql_list(values)[1:-1] + "]"


def sql_map(mapping: dict) -> str:
    return "map(" + sql_array(mapping) + ", " + sql_array(mapping.values()) + ")"


#: Words of documents, then with the same rules as rule_annotator.
TOK = f"tok as (select doc_id, lang, source, unnest(ws) as text, unnest(range(len(ws)))::BIGINT as tok_idx from (select doc_id, lang, source, regexp_extract_all(text, '{WORD}') as ws from documents))"
ANN = f"""{TOK}, ann0 as (select *, lower(text) as lemma, {sql_array(TAGS)}[length(text) % {len(TAGS)} + 1] as upos, length(text) as n from tok),
ann1 as (select *, case when upos in ('NOUN','PROPN','PRON','ADJ') then ['Nom','Gen','Acc'][n % 3 + 1] end as f_case, case when upos in ('NOUN','PROPN','PRON','ADJ') then ['Sing','Plur'][n % 2 + 1] end as f_number,
    case when upos in ('VERB','AUX') then ['Past','Pres','Fut'][tok_idx % 3 + 1] end as f_tense, case when upos = 'VERB' then ['Fin','Part','Conv'][(tok_idx + n) % 3 + 1] end as f_form,
    case when upos = 'ADJ' and tok_idx % 4 = 0 then 'Short' end as f_variant, case when upos = 'DET' and tok_idx % 2 = 0 then 'Yes' end as f_poss, case when upos = 'PRON' then 'Prs' end as f_type from ann0),
ann as (select *, case when f_form = 'Part' then '{C.PARTICIPLE}' when f_form = 'Conv' then '{C.GERUND}' else {sql_map(C.UPOS_NAME)}[upos] end as pos_label from ann1)"""
SENT = f"sent as (select doc_id, list_filter(list_transform(string_split_regex(text, '{C.SENTENCE_END}'), lambda s: len(regexp_extract_all(s, '{WORD}'))), lambda n: n > 0) as lens from documents)"
