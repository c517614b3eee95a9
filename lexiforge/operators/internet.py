"""Marks of internet communication per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexiforge.functions import constants as C
from lexiforge.functions.text import internet_label, whole_word, word_count

FEATURES = tuple(C.INTERNET_WEIGHTS)


def listed_words(text: Column, terms: tuple[str, ...]) -> Column:
    """Whole-word places of listed terms. A term with a hyphen does not hide its parts, so those are counted apart."""
    plain = [t for t in terms if t.isalpha()]
    total = F.regexp_count(F.lower(text), F.lit(whole_word(plain))) if plain else F.lit(0)
    for t in terms:
        if not t.isalpha():
            total = total + F.regexp_count(F.lower(text), F.lit(whole_word((t,))))
    return total


def features(text: Column, slang: tuple[str, ...] = C.SLANG, abbreviations: tuple[str, ...] = C.ABBREVIATIONS) -> dict[str, Column]:
    """Counts by name. Capitals are words of four or more; a sentence misses its capital if it starts in lower case."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    found = {
        "emoji": count(C.EMOJI), "emoticons": count(C.EMOTICON), "hashtags": count(C.HASHTAG), "mentions": count(C.MENTION), "urls": count(C.URL),
        "caps": count(r"(?U)\b[А-ЯЁA-Z]{4,}\b"), "slang": listed_words(text, slang), "abbreviations": listed_words(text, abbreviations),
        "repeated_punct": count(C.REPEATED), "missing_caps": F.size(F.filter(F.split(text, "(?U)" + C.SENTENCE_GAP), lambda s: s.rlike(r"^\p{Ll}"))),
    }
    return {k: v.cast("long") for k, v in found.items()}


def internet_profile(docs: DataFrame, slang: tuple[str, ...] = C.SLANG, abbreviations: tuple[str, ...] = C.ABBREVIATIONS) -> DataFrame:
    """(doc_id, the ten counts, n_words, score, level): score is 5 times the weighted count per word, at most 1."""
    own = docs.select("doc_id", *[v.alias(k) for k, v in features(F.col("text"), slang, abbreviations).items()], word_count(F.col("text")).alias("n_words"))
    weighted = sum((F.col(k) * w for k, w in C.INTERNET_WEIGHTS.items()), F.lit(0.0))
    score = F.least(F.lit(1.0), weighted / F.greatest("n_words", F.lit(1)) * 5)
    return own.withColumn("score", score).withColumn("level", internet_label(F.col("score")))


def feature_map(profile: DataFrame) -> DataFrame:
    """The ten counts as a map, beside the score."""
    return profile.select("doc_id", "score", F.create_map(*[x for k in FEATURES for x in (F.lit(k), F.col(k))]).alias("features"))


def profile_text(profile: DataFrame) -> DataFrame:
    """(doc_id, report): the profile in lines."""
    lines = [F.format_string("%s: %d", F.lit(k), F.col(k)) for k in FEATURES]
    return profile.select("doc_id", F.concat_ws("\n", F.format_string("score: %.1f%% - %s", F.round(F.col("score") * 100, 1), F.col("level")), *lines).alias("report"))
