"""Secret scans over an incremental blob ledger, in DataFrame functions alone.

Every version of a document is content-addressed by the SHA-256 of its text. The ledger has one row per
scan of a blob: which rule versions ran and what they found. A run scans, for each distinct blob, only
the rule versions that the ledger does not hold for it, and findings are joined back to every path
(doc_id) with that content, so that thousands of copies cost one scan.

Defined cases: a null text counts as empty and has no findings; repeated rows each get their findings;
a null doc_id keeps its row; extra columns are ignored by the scan and kept by redaction.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexiforge.llm.common import cut, table


@dataclass(frozen=True)
class Rule:
    """pattern: Java and RE2 alike; group and at_least: what must be how long, else the match is dropped.

    mark: a string that any match contains, looked for first because that is cheaper; None if there is none.
    """

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 1
    mark: str | None = None
    version: int = 1

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The base kinds and their order.
BASE = (
    Rule("assign", "(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, at_least=6),
    Rule("access", "AKIA[A-Z0-9]+", at_least=20, mark="AKIA"),
    Rule("hex", "[0-9a-f]{24,}", at_least=24),
)
#: Kinds that this scanner adds: signed web tokens, private key headers, code host and chat tokens.
ADDED = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", mark="eyJ"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", mark="PRIVATE KEY-----"),
    Rule("forge", "gh[oprsu]_[A-Za-z0-9]{36,}", mark="gh"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", mark="xox"),
)
RULES = BASE + ADDED

FINDINGS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob string, rules array<string>, findings {FINDINGS}"
_NONE = f"cast(array() as {FINDINGS})"
_NO_MARKS = "cast(array() as array<struct<kind:string,gap:int,len:int,good:boolean>>)"
#: Redaction cuts a text into chunks of so many code points first, so that no cut walks through the whole text.
CHUNK = 1024


def marks(text: Column, rule: Rule) -> Column:
    """One rule's matches in order: rule id, length of the stretch before each, its own, and whether it is long enough.

    A match's group is read from the match alone: no pattern looks beyond what it matches.
    """
    pattern = F.lit(rule.pattern)
    part = lambda m: F.char_length(m if rule.group == 0 else F.regexp_extract(m, rule.pattern, rule.group))
    one = F.zip_with(
        F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda gap, m: F.struct(F.lit(rule.id).alias("kind"), F.char_length(gap).alias("gap"), F.char_length(m).alias("len"), (part(m) >= rule.at_least).alias("good")),
    )
    there = text.rlike(rule.pattern)
    return F.when(text.contains(rule.mark) & there if rule.mark else there, F.filter(one, lambda x: x["len"].isNotNull())).otherwise(F.expr(_NO_MARKS))


def placed(marked: DataFrame) -> DataFrame:
    """(blob, findings) of (blob, marks) with any: each match lies behind all gaps and matches of its rule before it.

    A running sum over rows, so the work is in proportion to the matches however many a text has.
    """
    one = marked.where(F.size("marks") > 0).select("blob", F.posexplode("marks").alias("turn", "m")).select("blob", "turn", "m.*")
    before = Window.partitionBy("blob", "kind").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before).cast("int")).where("good")
    return one.groupBy("blob").agg(F.collect_list(F.struct("kind", (F.col("end") - F.col("len")).alias("start"), "end")).alias("findings"))


def versions(docs: DataFrame) -> DataFrame:
    """(doc_id, blob): the paths of each content."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("blob"))


def scan_unseen(docs: DataFrame, paths: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger rows that this run adds: one for each blob with rule versions that the ledger lacks.

    The text of one path stands for its blob. Joining it by doc_id and blob moves every text at
    most once and leaves no hot key, however many copies a blob has.
    """
    wanted = F.array(*[F.lit(r.id) for r in rules])
    chosen = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if ledger is None:
        chosen = chosen.withColumn("todo", wanted)
    else:
        known = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("known"))
        chosen = chosen.join(known, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("known", F.expr("cast(array() as array<string>)")))).where(F.size("todo") > 0)
    chosen = chosen.select("blob", "todo", F.coalesce("doc_id", F.lit(-(2**63))).alias("path"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    at_hand = texts.withColumn("blob", F.sha2("text", 256)).join(chosen, ["path", "blob"])
    ran = F.concat(*[F.when(F.array_contains("todo", r.id), marks(F.col("text"), r)).otherwise(F.expr(_NO_MARKS)) for r in rules])
    seen = cut(at_hand.select("blob", F.col("todo").alias("rules"), ran.alias("marks")).dropDuplicates(["blob"]))
    return seen.select("blob", "rules").join(placed(seen), "blob", "left").select("blob", "rules", F.coalesce("findings", F.expr(_NONE)).alias("findings"))


def findings_by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, findings) of the blobs in which these rule versions found something, by start, then kind as listed.

    A blob may have several ledger rows, one for each run that added rules.
    """
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.id), F.lit(i))])
    one = ledger.select("blob", F.explode("findings").alias("f")).where(F.col("f.kind").isin([r.id for r in rules]))
    keyed = F.struct("f.start", rank[F.col("f.kind")].alias("rank"), "f.end", F.substring_index("f.kind", "@", 1).alias("kind"))
    whole = one.groupBy("blob").agg(F.array_sort(F.collect_set(keyed)).alias("all"))
    return whole.select("blob", F.transform("all", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("findings"))


def findings_by_path(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, findings) for every path; of the ledger only what the given rule versions found."""
    per_blob = cut(findings_by_blob(ledger, rules))
    return paths.join(per_blob, "blob", "left").select("doc_id", "blob", F.coalesce("findings", F.expr(_NONE)).alias("findings"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings by path, ledger with this run's rows)."""
    paths = cut(versions(docs))
    new = cut(scan_unseen(docs, paths, ledger, rules))
    full = new if ledger is None else ledger.unionByName(new)
    return findings_by_path(paths, full, rules), full


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = [r.kind for r in BASE]
    return found.select("doc_id", *map(count, base), F.sha2(joined(F.filter("findings", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def stretches(per_blob: DataFrame) -> DataFrame:
    """(blob, keep, last) of (blob, findings): what to keep, as (from, to), before each stretch of overlapping findings, and where the last ends."""
    one = per_blob.select("blob", F.posexplode("findings").alias("turn", "f")).select("blob", "turn", "f.start", "f.end")
    sooner = Window.partitionBy("blob").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("from", F.coalesce(F.max("end").over(sooner), F.lit(0)))
    keep = F.when(F.col("start") >= F.col("from"), F.struct("from", F.col("start").alias("to")))
    return one.groupBy("blob").agg(F.array_sort(F.collect_list(keep)).alias("keep"), F.max("end").alias("last"))


def redacted(text: Column, keep: Column, last: Column) -> Column:
    """text with <secret> after each kept stretch, and all that follows the last finding."""

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        first, final = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
        between = F.when(final - first > 1, F.array_join(F.slice(chunks, first + 2, final - first - 1), "")).otherwise("")
        apart = F.concat(F.get(chunks, first).substr(a % CHUNK + 1, F.lit(CHUNK)), between, F.get(chunks, final).substr(F.lit(1), b - final * CHUNK))
        return F.when(b <= a, "").when(first == final, F.get(chunks, first).substr(a % CHUNK + 1, b - a)).otherwise(apart)

    # The chunks are bound to a lambda's variable, so that they are cut once for a text.
    chunks = F.array(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))
    size = F.char_length(text)
    whole = lambda c: F.concat(F.array_join(F.transform(keep, lambda x: F.concat(piece(c, x["from"], x["to"]), F.lit("<secret>"))), ""), piece(c, last, size))
    return F.get(F.transform(chunks, whole), F.lit(0))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every secret replaced by <secret> and n_chars, where there is one, brought up to date."""
    paths = cut(versions(docs))
    per_blob = cut(stretches(findings_by_blob(scan_unseen(docs, paths))))
    path = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_lf_path")
    named = per_blob.select(F.col("blob").alias("_lf_blob"), F.col("keep").alias("_lf_keep"), F.col("last").alias("_lf_last"))
    hit = cut(paths.select(path, F.col("blob").alias("_lf_blob")).distinct().join(named, "_lf_blob"))
    whole = docs.select("*", path, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("_lf_blob")).join(hit, ["_lf_path", "_lf_blob"], "left")
    hidden = F.col("_lf_last").isNotNull()
    whole = whole.withColumn("text", F.when(hidden, redacted(F.col("text"), F.col("_lf_keep"), F.col("_lf_last"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        whole = whole.withColumn("n_chars", F.when(hidden, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return whole.select(docs.columns)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = scan(table(spark, sf_dir, "documents"))
    return digest(found)


def _sql_spans(rule: Rule) -> str:
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(text, {pattern})) + 1), lambda i: struct_pack(
        start := list_sum(list_transform(string_split_regex(text, {pattern})[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(text, {pattern})[1:i-1], lambda x: length(x))), 0),
        rank := {RULES.index(rule)},
        stop := list_sum(list_transform(string_split_regex(text, {pattern})[1:i], lambda x: length(x))) + list_sum(list_transform(regexp_extract_all(text, {pattern})[1:i], lambda x: length(x))),
        kind := '{rule.kind}',
        size := length(regexp_extract_all(text, {pattern}, {rule.group})[i]))), lambda x: x.size >= {rule.at_least})"""


_SHOWN = "lambda x: x.kind || ':' || x.start::BIGINT || ':' || x.stop::BIGINT"
OP10_SQL = f"""
with found as (
    select doc_id, list_sort({' || '.join(map(_sql_spans, RULES))}) as s
    from (select doc_id, coalesce(text, '') as text from documents)
)
select doc_id,
    {', '.join(f"len(list_filter(s, lambda x: x.kind = '{r.kind}'))::BIGINT as n_{r.kind}" for r in BASE)},
    sha256(coalesce(array_to_string(list_transform(list_filter(s, lambda x: x.rank < {len(BASE)}), {_SHOWN}), ','), '')) as base_sha256,
    coalesce(array_to_string(list_transform(s, {_SHOWN}), ','), '') as spans
from found
"""
