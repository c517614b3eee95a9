"""Column functions over text: words, sentences, snippets, hashes, threshold labels. All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lexiforge.functions import constants as C


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken, name = {c.lower() for c in df.columns}, f"_lf_{stem}"
    while name in taken:
        name += "_"
    return name


def words(text: Column, pattern: str = C.WORD) -> Column:
    """Runs of letters, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def word_count(text: Column, pattern: str = C.WORD) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def sentence_lengths(text: Column, pattern: str = C.WORD, end: str = C.SENTENCE_END) -> Column:
    """Words in each sentence that has any."""
    return F.filter(F.transform(F.split(text, end), lambda s: F.regexp_count(s, F.lit(pattern))), lambda n: n > 0)


def blank_free_sentences(text: Column) -> Column:
    """Sentences that are not blank, whether or not they have words."""
    return F.size(F.filter(F.split(text, C.SENTENCE_END), lambda s: F.length(F.regexp_replace(s, r"(?U)\s+", "")) > 0)).cast("long")


def is_word(text: Column, upos: Column, pattern: str = C.WORD) -> Column:
    return text.rlike(pattern) & (upos != "PUNCT")


def quoted(term: str) -> str:
    """A literal term as a pattern."""
    return "".join(f"\\{c}" if not (c.isalnum() or c in " _") else c for c in term)


def whole_word(terms: list[str] | tuple[str, ...]) -> str:
    """A pattern for any of the terms that no word character touches; longer terms are tried first."""
    return r"(?U)(?<!\w)(?:" + "|".join(quoted(t) for t in sorted(terms, key=len, reverse=True)) + r")(?!\w)"


def term_count(text: Column, term: str) -> Column:
    """Places where the term stands as a whole word, whatever its case."""
    return F.regexp_count(F.lower(text), F.lit(whole_word((term,)))).cast("long")


def snippet(text: Column, start: Column, end: Column, around: int, strip: bool = True) -> Column:
    """The stretch from start to end with its surroundings on one line, marked where text was left out."""
    low, high = F.greatest(F.lit(0), start - around), F.least(F.char_length(text), end + around)
    part = F.translate(F.substring(text, low + 1, high - low), "\n", " ")
    part = F.regexp_replace(part, r"(?U)^\s+|\s+$", "") if strip else part
    return F.concat(F.when(low > 0, "…").otherwise(""), part, F.when(high < F.char_length(text), "…").otherwise(""))


def text_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def cache_key(text: Column) -> Column:
    return F.md5(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def head(words_: Column, k: int) -> Column:
    """The first k words, with dots if there are more."""
    return F.when(F.size(words_) > k, F.concat(F.array_join(F.slice(words_, 1, k), " "), F.lit("..."))).otherwise(F.array_join(words_, " "))


def tail(words_: Column, k: int) -> Column:
    return F.when(F.size(words_) > k, F.concat(F.lit("..."), F.array_join(F.slice(words_, -k, k), " "))).otherwise("")


def one_line(text: Column, size: int = 80) -> Column:
    return F.substring(F.translate(text, "\n", " "), 1, size)


def lookup(table: dict, key: Column) -> Column:
    """The table's value for the key, null if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def ladder(value: Column, steps: list[tuple[float, str]], below: str, strict: bool = False) -> Column:
    """The label of the first step that the value reaches (or passes, if strict)."""
    out = None
    for least, label in steps:
        test = value > least if strict else value >= least
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(below)


def volume_label(n: Column) -> Column:
    """Fitness of a text for identification by its length, as shown with an analysis."""
    return ladder(n, [(500, "identification"), (100, "diagnostic")], "insufficient")


def report_volume_label(n: Column) -> Column:
    """The other scale, which reports use."""
    return ladder(n, [(500, "fit"), (200, "preliminary")], "insufficient")


def similarity_label(x: Column) -> Column:
    return ladder(x, [(0.7, "high"), (0.5, "medium"), (0.3, "low")], "minimal")


def internet_label(score: Column) -> Column:
    return ladder(F.round(score * 100, 1), [(50, "high"), (25, "medium"), (10, "low")], "minimal")


def generated_label(score: Column) -> Column:
    """On the whole per cent, cut off."""
    return ladder(F.floor(score * 100), [(70, "high"), (40, "moderate"), (15, "low")], "human")


def interval_label(score: Column) -> Column:
    return ladder(score, [(0.7, "strong"), (0.4, "medium")], "weak")


def balance_label(x: Column) -> Column:
    return F.when(x > 0.1, "positive").when(x < -0.1, "negative").otherwise("even")


def dominant_label(positive: Column, negative: Column) -> Column:
    return F.when(positive > negative, "positive").when(negative > positive, "negative").otherwise("neutral")


def skill_label(errors: Column, total: Column) -> Column:
    """Errors per 200 words, rounded to one decimal first."""
    rate = skill_rate(errors, total)
    return F.when(total == 0, "нулевая").when(rate < 4, "высокая").when(rate <= 6, "средняя").otherwise("низкая")


def skill_rate(errors: Column, total: Column) -> Column:
    return F.round(errors * (F.lit(200) / F.greatest(total, F.lit(1))), 1)


def band(rank: Column) -> Column:
    """Frequency band of a rank; 0 or null is absent."""
    out = F.when(F.coalesce(rank, F.lit(0)) == 0, "absent")
    return reduce(lambda acc, b: acc.when(rank <= b[1], b[0]), C.BANDS, out).otherwise("rare")


def rounded(x: Column, places: int) -> Column:
    """To so many places, halves of the shifted value away from zero. round() itself looks at the value's decimal digits, so 527 / 800 becomes 0.6588 there and 0.6587 here, as in SQL elsewhere."""
    return F.round(x.cast("double") * 10.0**places) / 10.0**places


def number_text(x: Column, places: int) -> Column:
    """A number rounded to so many places as text without an exponent, with one digit behind the point at least."""
    value = rounded(x, places)
    plain = F.regexp_replace(value.cast(f"decimal(38,{places})").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(F.abs(value) < 1e15, F.when(value == 0, "0.0").otherwise(plain)).otherwise(value.cast("string"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
