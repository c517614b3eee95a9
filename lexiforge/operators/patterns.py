"""Tag pattern queries: "VERB * NOUN" over the words of a document.

A star stands for exactly one word. Matches may overlap and run across sentence ends; tokens without
letters are no words, even when a pattern asks for punctuation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexiforge.functions import constants as C
from lexiforge.functions.text import lookup


def normalise_tag(tag: str) -> str | None:
    """A tag, short name or full Russian name as a tag; None if there is no such tag."""
    name = tag.strip().upper()
    by_name = {v.upper(): k for k, v in C.UPOS_NAME.items()}
    return name if name in C.UPOS else C.TAG_ALIASES.get(name, by_name.get(name))


def parse(pattern: str) -> list[str | None] | None:
    """One tag per part, None for a star; None for all if a part is unknown or there is none."""
    tags = [(part == "*", normalise_tag(part)) for part in pattern.split()]
    return [None if star else tag for star, tag in tags] if tags and all(star or tag for star, tag in tags) else None


def word_sequence(tokens: DataFrame) -> DataFrame:
    """Tokens with letters and their place among them, from 0, within a document."""
    words = tokens.where(F.col("text").rlike(C.WORD))
    return words.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("tok_idx")) - 1)


def matches(rows: DataFrame, pattern: list[str | None], key: str = "doc_id", order: str = "position", tag: str = "upos", text: str = "text", around: int = 5) -> DataFrame:
    """(key, position, fragment, tags, context) of each match in ordered rows of any kind.

    Each row looks ahead as far as the pattern is long; the context is a window of rows around it.
    """
    n = len(pattern)
    own = Window.partitionBy(key).orderBy(order)
    ahead = lambda c, j: F.lead(c, j).over(own) if j else F.col(c)
    test = reduce(Column.__and__, [ahead(tag, j) == t for j, t in enumerate(pattern) if t is not None], ahead(order, n - 1).isNotNull())
    near = lambda low, high: F.array_join(F.collect_list(text).over(own.rowsBetween(low, high)), " ")
    said = [F.concat(F.coalesce(lookup(C.UPOS_NAME, ahead(tag, j)), ahead(tag, j)), F.lit(" ("), ahead(text, j), F.lit(")")) for j in range(n)]
    out = rows.select(key, F.col(order).alias("position"), test.alias("hit"), near(0, n - 1).alias("fragment"), F.concat_ws(" → ", *said).alias("tags"), near(-around, n - 1 + around).alias("context"))
    return out.where("hit").drop("hit")


def query(tokens: DataFrame, pattern: str) -> DataFrame:
    """Matches of a pattern string; one that cannot be read is an error."""
    parsed = parse(pattern)
    if parsed is None:
        raise ValueError(f"not a pattern of known tags: {pattern!r}")
    return matches(word_sequence(tokens), parsed)
