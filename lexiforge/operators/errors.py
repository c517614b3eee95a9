"""Error spans: from checkers' matches, merged in stages, filtered, counted into skills.

errors: (doc_id, error_type, subtype, fragment, description, suggestion, start, end, rule_ref, source, context)
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexiforge.functions import constants as C
from lexiforge.functions.text import fresh, lookup, skill_label, skill_rate, snippet
from lexiforge.operators.lexicons import small

COLUMNS = ["doc_id", "error_type", "subtype", "fragment", "description", "suggestion", "start", "end", "rule_ref", "source", "context"]


def advice(options: Column, otherwise: str) -> Column:
    """The first suggestion, and up to two more in brackets."""
    more = F.when(F.size(options) > 1, F.concat(F.lit(" (или: "), F.array_join(F.slice(options, 2, 2), ", "), F.lit(")"))).otherwise("")
    return F.when(F.size(options) > 0, F.concat(F.lit("→ "), F.get(options, F.lit(0)), more)).otherwise(otherwise)


def from_checker(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """Errors from (doc_id, rule_id, category, message, offset, length, replacements); white-space rules are left out."""
    both = matches.where(~F.coalesce("rule_id", F.lit("")).isin(*C.SKIPPED_RULES)).join(docs.select("doc_id", "text"), "doc_id")
    start, end = F.col("offset"), F.col("offset") + F.col("length")
    said = F.when(F.coalesce("message", F.lit("")) != "", F.col("message"))
    return both.select(
        "doc_id", F.coalesce(lookup(C.CHECKER_CATEGORIES, F.upper("category")), F.lit("LanguageTool")).alias("error_type"),
        F.coalesce(F.substring(said, 1, 80), "rule_id").alias("subtype"), F.substring(F.col("text"), start + 1, F.col("length")).alias("fragment"),
        F.coalesce(said, "rule_id").alias("description"), advice(F.col("replacements"), "Исправьте вручную").alias("suggestion"), start.cast("int").alias("start"), end.cast("int").alias("end"),
        F.concat(F.lit("LT:"), "rule_id").alias("rule_ref"), F.lit("LT").alias("source"), snippet(F.col("text"), start, end, 45, False).alias("context"),
    )


def from_speller(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """Errors from (doc_id, code, pos, len, word, s)."""
    both = matches.join(docs.select("doc_id", "text"), "doc_id")
    label, start, end = F.coalesce(lookup(C.SPELLER_CODES, F.col("code").cast("int")), F.lit(C.SPELLER_CODES[1])), F.col("pos"), F.col("pos") + F.col("len")
    return both.select(
        "doc_id", F.lit("Орфографическая").alias("error_type"), label.alias("subtype"), F.col("word").alias("fragment"),
        F.concat(label, F.lit(": «"), "word", F.lit("»")).alias("description"), advice(F.col("s"), "Проверьте написание").alias("suggestion"),
        start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit("").alias("rule_ref"), F.lit("YASPELL").alias("source"), snippet(F.col("text"), start, end, 40, False).alias("context"),
    )


def chunks(docs: DataFrame, size: int = 2000, ends: tuple[str, ...] = (".", "!", "?", "\n")) -> DataFrame:
    """(doc_id, no, offset, chunk): texts cut for services that take so many characters.

    A cut comes after the last of the first kind of end that lies in the chunk's second half, else at
    its size. Where each chunk starts depends on the last one, so texts are cut in Python.
    """

    def run(frames):
        for pdf in frames:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                at, no, text = 0, 0, text or ""
                while True:
                    room = text[at : at + size]
                    if len(text) - at <= size:
                        cut = len(room)
                    else:
                        places = ((room.rfind(e), len(e)) for e in ends)
                        cut = next((p + n for p, n in places if p > size // 2 and p + n <= size), size)
                    out.append((doc_id, no, at, room[:cut]))
                    at, no = at + cut, no + 1
                    if at >= len(text):
                        break
            yield pd.DataFrame(out, columns=["doc_id", "no", "offset", "chunk"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, no int, offset int, chunk string")


def content_key(chunk: Column) -> Column:
    return F.sha2(F.coalesce(chunk, F.lit("")), 256)


def requests(pieces: DataFrame, answered: DataFrame | None = None) -> DataFrame:
    """(chunk_key, chunk): what to ask a service, each content once, without those that `answered` (chunk_key, ...) has.

    Chunks are told apart before they are shuffled, so a chunk that many texts share is no hot key.
    """
    asked = pieces.select(content_key(F.col("chunk")).alias("chunk_key"), F.coalesce("chunk", F.lit("")).alias("chunk")).groupBy("chunk_key").agg(F.first("chunk").alias("chunk"))
    return asked if answered is None else asked.join(answered.select("chunk_key").distinct(), "chunk_key", "left_anti")


def answered_matches(answers: DataFrame, pieces: DataFrame, start: str) -> DataFrame:
    """Matches in whole texts (doc_id, ...) from a service's answers (chunk_key, matches: array of structs with `start`).

    An answer stands for every chunk of its content, so it is kept and joined again for texts that come
    later. A chunk whose answer is null (the service failed) or missing has no matches, and moves none of
    those after it; of a key's answers one with matches counts. Chunk texts are not moved.
    """
    one = answers.where("matches is not null").groupBy("chunk_key").agg(F.first("matches").alias("matches"))
    at = pieces.select("doc_id", F.col("offset").alias("_lf_at"), content_key(F.col("chunk")).alias("chunk_key"))
    found = at.join(one, "chunk_key").select("doc_id", "_lf_at", F.inline("matches"))
    return found.withColumn(start, (F.col(start) + F.col("_lf_at")).cast("int")).drop("_lf_at")


def _swept(stages: int, columns: list[str], doc: str, stage: str):
    """Batches of ordered rows, of those with a place only the ones that overlap none kept before."""

    def run(batches):
        # A stage's furthest end and last start among the spans it kept; they go on from batch to batch.
        now, starts, ends = None, [-1] * stages, [-1] * stages
        for batch in batches:
            held = []
            for d, s, e, first in zip(*(batch.column(c).to_pylist() for c in (doc, "start", "end", stage))):
                if d != now:
                    now, starts, ends = d, [-1] * stages, [-1] * stages
                kept = True
                if s is not None and e is not None and (s or e):
                    for k in range(first, stages):
                        if s < ends[k] and e > starts[k]:
                            kept = False
                            break
                        starts[k], ends[k] = s, max(ends[k], e)
                held.append(kept)
            yield batch.filter(pa.array(held, pa.bool_())).select(columns)

    return run


def merge_in_stages(*sources: DataFrame) -> DataFrame:
    """Errors of sources joined one after the other; after each, those go that overlap one kept before.

    Spans are taken by start, then by the source's priority; one dropped early never comes back. Kept spans
    are disjoint and come in order, so the furthest end and the last start among them tell whether the next
    one overlaps: an empty span at the very start of a kept one does not. A span of a later source passes
    fewer stages, so one sweep over all spans in order, with a pair of numbers per stage, gives all stages.
    Spans are sorted within partitions and stream through; no document is held at once, however many it has.

    Defined cases: spans at (0, 0) and those without a start or end take no part and stay; errors without a
    document belong to one; repeated rows overlap each other unless they are empty; no errors give none.
    """
    columns = sources[0].columns
    doc, stage, rank = (fresh(sources[0], stem) for stem in ("doc", "stage", "rank"))
    union = reduce(lambda a, b: a.unionByName(b), [x.select(*columns, F.lit(k).alias(stage)) for k, x in enumerate(sources)])
    order = [F.col(c) for c in columns if c not in ("doc_id", "start")]
    # A text stands for the document in Python, so that any type of id will do; the order is by the id itself.
    tagged = union.withColumn(rank, -F.coalesce(lookup(C.SOURCE_PRIORITY, F.col("source")), F.lit(0))).withColumn(doc, F.col("doc_id").cast("string"))
    # Dealt by that text: dealt by doc_id, rows of joins on doc_id would stay where they are, and adaptive execution may
    # then split a document, or cut the partitions of each source in another way, as nothing above asks for it whole.
    placed = tagged.repartition(doc).sortWithinPartitions("doc_id", "start", rank, *order)
    return placed.mapInArrow(_swept(len(sources), columns, doc, stage), union.select(columns).schema)


def keep_first_spans(errors: DataFrame) -> DataFrame:
    """Errors that overlap none kept before, by start, then by the source's priority."""
    return merge_in_stages(errors)


def without_user_words(errors: DataFrame, user_words: DataFrame) -> DataFrame:
    """Errors whose fragment is no word of the user's dictionary, in any category."""
    known = small(user_words.select(F.lower(F.trim("word")).alias("_w")).distinct())
    return errors.join(known, F.lower(F.trim("fragment")) == F.col("_w"), "left_anti")


def filtered(errors: DataFrame, source: str = "all", error_type: str = "all") -> DataFrame:
    """By source and type; a rule reference of the checker counts as the checker, whatever the source."""
    shown = F.when((F.col("source") == "REGEX") & F.col("rule_ref").startswith("LT:"), "LT").otherwise(F.col("source"))
    out = errors if source == "all" else errors.where(shown == source)
    return out if error_type == "all" else out.where(F.col("error_type") == error_type)


def unique_errors(errors: DataFrame) -> DataFrame:
    """One error per type, subtype and fragment of a document, the first by position."""
    form = F.lower(F.regexp_replace("fragment", r"(?U)^\s+|\s+$", ""))
    first = Window.partitionBy("doc_id", "error_type", "subtype", form).orderBy("start", "end", "rule_ref")
    return errors.withColumn("_no", F.row_number().over(first)).where("_no = 1").drop("_no")


def skills(errors: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc_id, skill, errors, rate, level) for all five skills of every document; totals: (doc_id, total)."""
    per = unique_errors(errors).withColumn("skill", lookup(C.SKILLS, F.col("error_type"))).where("skill is not null").groupBy("doc_id", "skill").agg(F.count(F.lit(1)).alias("errors"))
    every = totals.select("doc_id", "total", F.explode(F.array(*[F.lit(s) for s in C.SKILLS.values()])).alias("skill"))
    out = every.join(per, ["doc_id", "skill"], "left").na.fill(0, ["errors"])
    return out.select("doc_id", "skill", "errors", skill_rate(F.col("errors"), F.col("total")).alias("rate"), skill_label(F.col("errors"), F.col("total")).alias("level"))


def general_skill(errors: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc_id, errors, rate, level) over unique errors of all types."""
    per = unique_errors(errors).groupBy("doc_id").agg(F.count(F.lit(1)).alias("errors"))
    out = totals.join(per, "doc_id", "left").na.fill(0, ["errors"])
    return out.select("doc_id", "errors", skill_rate(F.col("errors"), F.col("total")).alias("rate"), skill_label(F.col("errors"), F.greatest("total", F.lit(1))).alias("level"))


def top_errors(errors: DataFrame, k: int = 15) -> DataFrame:
    """The first k errors of each type, by position."""
    own = Window.partitionBy("doc_id", "error_type").orderBy("start", "end", "fragment")
    return errors.withColumn("no", F.row_number().over(own)).where(F.col("no") <= k)


def error_lines(errors: DataFrame, k: int = 15) -> DataFrame:
    """(doc_id, error_type, n, report): up to k errors of each type in lines."""
    n = errors.groupBy("doc_id", "error_type").agg(F.count(F.lit(1)).alias("n"))
    line = F.concat(F.col("no").cast("string"), F.lit(". «"), "fragment", F.lit("» "), "description", F.when(F.coalesce("suggestion", F.lit("")) != "", F.concat(F.lit(" → "), "suggestion")).otherwise(""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", line.alias("line")))), lambda x: x["line"]), "\n")
    return n.join(top_errors(errors, k).groupBy("doc_id", "error_type").agg(text.alias("report")), ["doc_id", "error_type"])


def clipboard(errors: DataFrame) -> DataFrame:
    """(doc_id, start, line): an error as labelled text."""
    label = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit("")))
    return errors.select("doc_id", "start", F.concat_ws("\n", label("Тип", "error_type"), label("Фрагмент", "fragment"), label("Описание", "description"), label("Рекомендация", "suggestion")).alias("line"))


def highlights(errors: DataFrame) -> DataFrame:
    return errors.where("start < end").select("doc_id", "start", "end", "error_type")


def generated_score(intervals: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, score): share of a text that intervals of generated text cover; overlaps count twice, at most 1."""
    covered = intervals.groupBy("doc_id").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("start"))).alias("covered"))
    out = docs.select("doc_id", F.char_length("text").alias("size")).join(covered, "doc_id", "left")
    return out.select("doc_id", F.coalesce(F.least(F.lit(1.0), F.col("covered") / F.nullif(F.col("size"), F.lit(0))), F.lit(0.0)).alias("score"))
