"""Dictionaries and the profiles that stand on them: frequency, sentiment, topics, style layers.

Text is counted by form before any dictionary is joined, so a join sees each form of a document once.
A dictionary is broadcast only when its rows, counted or given, are at most BROADCAST_ROWS; otherwise
Spark is free to shuffle it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexiforge.functions import constants as C
from lexiforge.functions.text import band, dominant_label, lookup, ratio, snippet
from lexiforge.operators.metrics import count_of
from lexiforge.operators.tokens import explode_words

BROADCAST_ROWS = 500_000


def small(dictionary: DataFrame, rows: int | None = None) -> DataFrame:
    """The dictionary, broadcast if it is small; counting stops just beyond the bound."""
    rows = dictionary.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(dictionary) if rows <= BROADCAST_ROWS else dictionary


def form_counts(docs: DataFrame, pattern: str = C.WORD, lemmas: DataFrame | None = None) -> DataFrame:
    """(doc_id, form, n, first_at, lemma): lemma from (doc_id, form, lemma), else the form."""
    forms = explode_words(docs, pattern).groupBy("doc_id", F.lower("text").alias("form")).agg(F.count(F.lit(1)).alias("n"), F.min("tok_idx").alias("first_at"))
    if lemmas is None:
        return forms.withColumn("lemma", F.col("form"))
    return forms.join(lemmas.select("doc_id", "form", F.lower("lemma").alias("lemma")), ["doc_id", "form"], "left").withColumn("lemma", F.coalesce("lemma", "form"))


def join_dictionary(forms: DataFrame, dictionary: DataFrame, values: list[str], rows: int | None = None) -> DataFrame:
    """forms with the dictionary's values for the lemma, or else for the form; null where it has neither."""
    table = small(dictionary.select("lemma", F.struct(*values).alias("_v")), rows)
    out = forms.join(table.withColumnsRenamed({"lemma": "_l", "_v": "_by_lemma"}), F.col("lemma") == F.col("_l"), "left").drop("_l")
    out = out.join(table.withColumnsRenamed({"lemma": "_l", "_v": "_by_form"}), F.col("form") == F.col("_l"), "left").drop("_l")
    return out.withColumn("_v", F.coalesce("_by_lemma", "_by_form")).drop("_by_lemma", "_by_form").select("*", *[F.col(f"_v.{v}").alias(v) for v in values]).drop("_v")


# Frequency ------------------------------------------------------------------------------------------


def best_by_ipm(records: DataFrame) -> DataFrame:
    """One row per lemma of (ord, lemma, rank, ipm, pos): the most frequent, the first of equals."""
    return records.groupBy("lemma").agg(F.min_by(F.struct("rank", "ipm", "pos"), F.struct((-F.col("ipm")).alias("a"), F.col("ord").alias("b"))).alias("v")).select("lemma", "v.*")


def short_pos(raw: Column, shadowed: bool = False) -> Column:
    """Short name of a dictionary's part of speech by its prefix.

    With shadowed, "s" and "a" are tried before the longer prefixes that start with them, as a table in
    that order does; without, the longest prefix decides.
    """
    # Prefixes and short names, in the order in which they are tried.
    table = {"s": "noun", "a": "adj", "v": "verb", "adv": "adv", "spro": "pron", "apro": "pron", "advpro": "pron", "num": "num", "anum": "num", "conj": "conj", "prep": "prep", "part": "part", "intj": "interj", "s.prop": "noun"}
    x = F.lower(F.trim(raw))
    order = list(table) if shadowed else sorted(table, key=len, reverse=True)
    out = F.when(x.startswith(order[0]), table[order[0]])
    for p in order[1:]:
        out = out.when(x.startswith(p), table[p])
    return out.otherwise(F.substring(x, 1, 4))


def frequency_words(forms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(doc_id, form, lemma, n, first_at, rank, ipm, pos, band); a form that the dictionary lacks has rank 0."""
    out = join_dictionary(forms, dictionary, ["rank", "ipm", "pos"])
    out = out.withColumns({"rank": F.coalesce("rank", F.lit(0)), "ipm": F.coalesce("ipm", F.lit(0.0)), "pos": F.coalesce("pos", F.lit(""))})
    return out.withColumn("band", band(F.col("rank")))


def frequency_profile(words: DataFrame) -> DataFrame:
    """Band histogram and means per document; content words are all beyond the nucleus."""
    n, known = F.col("n"), F.col("rank") > 0
    content = known & (F.col("band") != "nucleus") & ~F.lower("pos").isin(*C.FUNCTION_POS)
    over = lambda value, test: F.sum(F.when(test, value * n)) / F.sum(F.when(test, n))
    bands = [F.sum(F.when(F.col("band") == b, n).otherwise(0)).cast("long").alias(b) for b in [*(b for b, _ in C.BANDS), "absent"]]
    out = words.groupBy("doc_id").agg(
        F.sum("n").cast("long").alias("total"), F.count(F.lit(1)).alias("n_forms"), *bands,
        F.coalesce(over(F.col("rank"), known), F.lit(0.0)).alias("avg_rank"), F.coalesce(over(F.col("ipm"), known), F.lit(0.0)).alias("avg_ipm"),
        F.coalesce(over(F.col("ipm"), content), F.lit(0.0)).alias("content_avg_ipm"),
    )
    return out.withColumn("content", F.col("total") - F.col("nucleus"))


def frequency_summary(profile: DataFrame) -> DataFrame:
    share = lambda a: ratio(a * 100, F.col("total"))
    return profile.select("doc_id", share(F.col("absent")).alias("pct_absent"), share(F.col("low") + F.col("rare")).alias("pct_rare"), share(F.col("n_forms")).alias("pct_types"))


def rarest(words: DataFrame, k: int = 20) -> DataFrame:
    """The k forms of each document with the highest ranks; ties in order of first use."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("rank"), "first_at")
    return words.where("rank > 0").withColumn("no", F.row_number().over(order)).where(F.col("no") <= k)


def absent(words: DataFrame) -> DataFrame:
    """Forms that the dictionary lacks, most frequent first."""
    return words.where("band = 'absent'").orderBy("doc_id", F.desc("n"), "first_at")



def frequency_table(words: DataFrame, only: str = "all", order: str = "rank_asc") -> DataFrame:
    """Rows of one band, or all, in one of four orders; absent words come last by rank."""
    keys = {
        "rank_asc": [F.when(F.col("rank") > 0, F.col("rank")).otherwise(10_000_000)], "rank_desc": [F.desc("rank")],
        "alpha": [F.col("form")], "count_desc": [F.desc("n")],
    }
    return (words if only == "all" else words.where(F.col("band") == only)).orderBy("doc_id", *keys[order], "first_at")


# Sentiment ------------------------------------------------------------------------------------------


def sentiment_words(forms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, lemma, form, sentiment, stype, pos, n, first_at): the first form of a lemma sets all but the count."""
    found = join_dictionary(forms, lexicon, ["sentiment", "stype", "pos"]).where("sentiment is not null")
    out = found.groupBy("doc_id", "lemma").agg(F.min_by(F.struct("form", "sentiment", "stype", "pos"), "first_at").alias("v"), F.sum("n").cast("long").alias("n"), F.min("first_at").alias("first_at"))
    return out.select("doc_id", "lemma", "v.*", "n", "first_at")


def sentiment_profile(words: DataFrame, totals: DataFrame) -> DataFrame:
    """Counts, balance, emotionality, coverage and dominant side; totals: (doc_id, total) for every document."""
    of = lambda s: F.sum(F.when(F.col("sentiment") == s, F.col("n")).otherwise(0)).cast("long").alias(s)
    per = words.groupBy("doc_id").agg(of("positive"), of("negative"), of("neutral"), F.sum("n").cast("long").alias("scored"))
    out = totals.select("doc_id", "total").join(per, "doc_id", "left").na.fill(0, ["positive", "negative", "neutral", "scored"])
    p, n = F.col("positive"), F.col("negative")
    return out.withColumns({
        "balance": F.coalesce(ratio(p - n, F.col("scored")), F.lit(0.0)), "emotionality": F.coalesce(ratio(p + n, F.col("total")), F.lit(0.0)),
        "coverage_pct": F.coalesce(ratio(F.col("scored") * 100, F.col("total")), F.lit(0.0)), "dominant": dominant_label(p, n),
    })


def sentiment_types(words: DataFrame) -> DataFrame:
    """(doc_id, fact, opinion, feeling, typed): words by type among those that have one."""
    of = lambda t: F.sum(F.when(F.lower("stype") == t, F.col("n")).otherwise(0)).cast("long").alias(t)
    return words.groupBy("doc_id").agg(of("fact"), of("opinion"), of("feeling")).withColumn("typed", F.col("fact") + F.col("opinion") + F.col("feeling"))


def top_sentiment(words: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent positive and negative lemmas of each document."""
    order = Window.partitionBy("doc_id", "sentiment").orderBy(F.desc("n"), "first_at")
    return words.where("sentiment <> 'neutral'").withColumn("no", F.row_number().over(order)).where(F.col("no") <= k)


# Topics ---------------------------------------------------------------------------------------------


def inject_domain_words(vocab: DataFrame, user: DataFrame) -> DataFrame:
    """(domain, word) with a user's words added where they are new to a known domain."""
    known = vocab.select("domain").distinct()
    added = user.select(F.col("category").alias("domain"), F.lower(F.trim("word")).alias("word")).where("word <> ''").join(known, "domain", "left_semi")
    return vocab.select("domain", "word").unionByName(added).distinct()


def idf(vocab: DataFrame, n_domains: int) -> DataFrame:
    """(word, df, idf) with idf = ln((N + 1) / (df + 1)) + 1; N counts declared domains, empty ones too."""
    return vocab.select("domain", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log((F.lit(n_domains) + 1) / (F.col("df") + 1)) + 1)


def centroids(vocab: DataFrame, n_domains: int) -> DataFrame:
    """(domain, word, idf, weight): each domain's idf vector and the same at unit length."""
    own = vocab.select("domain", "word").distinct().join(idf(vocab, n_domains), "word")
    norm = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy("domain")))
    return own.select("domain", "word", "idf", (F.col("idf") / norm).alias("weight"))


def domain_scores(lemmas: DataFrame, vocab: DataFrame, domains: list[str], examples: int = 8) -> DataFrame:
    """(doc_id, domain, cosine, tf_idf_sum, match_count, examples) for every document and domain.

    lemmas: (doc_id, lemma). Frequencies count all lemmas; the norm counts those of any domain.
    """
    n = len(domains)
    counts = lemmas.where("trim(lemma) <> ''").groupBy("doc_id", F.lower("lemma").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("doc_id").agg(F.sum("n").alias("total"))
    weights = small(centroids(vocab, n).groupBy("word").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("domain", "weight")).alias("in")))
    hits = counts.join(weights, "word").join(total, "doc_id").withColumn("w", F.col("n") / F.col("total") * F.col("idf"))
    norms = hits.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    per = hits.select("doc_id", "word", "w", F.inline("in")).groupBy("doc_id", "domain").agg(
        F.sum(F.col("w") * F.col("weight")).alias("dot"), F.sum("w").alias("tf_idf_sum"), F.count(F.lit(1)).alias("match_count"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("k"), "word"))), 1, examples), lambda x: x["word"]).alias("examples"),
    )
    every = total.select("doc_id", F.explode(F.array(*map(F.lit, domains))).alias("domain"))
    out = every.join(per, ["doc_id", "domain"], "left").join(norms, "doc_id", "left")
    return out.select("doc_id", "domain", F.coalesce(F.col("dot") / F.col("norm"), F.lit(0.0)).alias("cosine"), F.coalesce("tf_idf_sum", F.lit(0.0)).alias("tf_idf_sum"), F.coalesce("match_count", F.lit(0)).alias("match_count"), F.coalesce("examples", F.expr("cast(array() as array<string>)")).alias("examples"))


def top_domains(scores: DataFrame, least: float = 0.02, share: float = 0.25, most: int = 3) -> DataFrame:
    """Up to three domains per document that reach a quarter of the best cosine and the floor."""
    own = Window.partitionBy("doc_id")
    out = scores.withColumn("_need", F.greatest(F.lit(least), F.max("cosine").over(own) * share)).where(F.col("cosine") >= F.col("_need"))
    return out.withColumn("no", F.row_number().over(own.orderBy(F.desc("cosine"), "domain"))).where(F.col("no") <= most).drop("_need")


# Style layers ---------------------------------------------------------------------------------------


def priority(layer: Column) -> Column:
    return lookup({k: p for k, (_, p) in C.LAYERS.items()}, layer)


def pick_layer(layers: Column) -> Column:
    """The known layer of highest priority, the first of equals; null if none is known."""
    known = F.filter(layers, lambda x: priority(x).isNotNull())
    keyed = F.transform(known, lambda x, i: F.struct((-priority(x)).alias("p"), i.alias("i"), x.alias("layer")))
    return F.get(F.array_sort(keyed), F.lit(0))["layer"]


def build_layers(entries: DataFrame, whitelist: DataFrame | None = None, keeplist: DataFrame | None = None, known: DataFrame | None = None, user: DataFrame | None = None, lemmas: DataFrame | None = None) -> DataFrame:
    """(phrase, layer, n_words) from entries (ord, surface, layers).

    A single word is dropped if its lemma is whitelisted; if it is in the keeplist it stays; else, in
    the layers that the filter covers, it is dropped if `known` (surface) lists it as a plain word. Of
    several entries for a lemma the highest priority wins, then the first. A user's words (word,
    category) come last and pass no filter. lemmas: (form, lemma); a form it lacks is its own lemma.
    """
    def lemma_of(rows: DataFrame) -> DataFrame:
        parts = rows.select("ord", "surface", "layer", "own", F.posexplode(F.split(F.trim("surface"), r"(?U)\s+")).alias("i", "part"))
        parts = parts.where((F.size(F.split(F.trim("surface"), r"(?U)\s+")) == 1) | F.col("part").rlike(f"^{C.CYRILLIC_2}$|^\\p{{L}}{{2,}}$"))
        if lemmas is not None:
            parts = parts.join(small(lemmas.select(F.lower("form").alias("_f"), "lemma")), F.lower("part") == F.col("_f"), "left").withColumn("lemma", F.coalesce("lemma", F.lower("part")))
        else:
            parts = parts.withColumn("lemma", F.lower("part"))
        return parts.groupBy("ord", "surface", "layer", "own").agg(F.array_sort(F.collect_list(F.struct("i", "lemma"))).alias("w")).select("ord", "surface", "layer", "own", F.array_join(F.transform("w", lambda x: x["lemma"]), " ").alias("phrase"), F.size("w").alias("n_words"))

    rows = entries.select("ord", "surface", pick_layer(F.col("layers")).alias("layer"), F.lit(False).alias("own")).where("layer is not null")
    if user is not None:
        mine = user.where(priority(F.col("category")).isNotNull() & (F.trim("word") != ""))
        rows = rows.unionByName(mine.select((F.monotonically_increasing_id() + (1 << 62)).alias("ord"), F.lower(F.trim("word")).alias("surface"), F.col("category").alias("layer"), F.lit(True).alias("own")))
    rows = lemma_of(rows)
    mark = lambda d, c, name: rows.join(small(d.select(F.lower(c).alias(name)).distinct()), F.lower("phrase" if name != "_known" else "surface") == F.col(name), "left")
    for d, c, name in ((whitelist, "lemma", "_white"), (keeplist, "lemma", "_keep"), (known, "surface", "_known")):
        rows = mark(d, c, name) if d is not None else rows.withColumn(name, F.lit(None).cast("string"))
    plain = F.col("_white").isNotNull() | (F.col("_keep").isNull() & F.col("_known").isNotNull() & F.col("layer").isin(*C.FILTERABLE))
    rows = rows.where(F.col("own") | (F.col("n_words") > 1) | ~plain)
    best = rows.groupBy("phrase").agg(F.min_by(F.struct("layer", "n_words"), F.struct((-priority(F.col("layer"))).alias("p"), "ord")).alias("v"))
    return best.select("phrase", "v.*")


def override_hits(hits: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Hits without those of a covered layer whose lemma is whitelisted."""
    return hits.join(small(whitelist.select(F.lower("lemma").alias("_w"), F.explode(F.array(*map(F.lit, C.FILTERABLE))).alias("_l"))), (F.lower("lemma") == F.col("_w")) & (F.col("layer") == F.col("_l")), "left_anti")


def layer_word_hits(docs: DataFrame, layers: DataFrame, pattern: str = C.CYRILLIC_2) -> DataFrame:
    """(doc_id, tok_idx, surface, lemma, layer): words found on their own."""
    one = small(layers.where("n_words = 1").select(F.col("phrase").alias("lemma"), "layer"))
    return explode_words(docs, pattern).withColumn("lemma", F.lower("text")).join(one, "lemma").select("doc_id", "tok_idx", F.col("text").alias("surface"), "lemma", "layer")


def layer_hits(docs: DataFrame, layers: DataFrame, pattern: str = C.CYRILLIC_2, around: int = 45) -> DataFrame:
    """(doc_id, surface, lemma, layer, start, end, context): words, then phrases of 2 to 5 words.

    A phrase counts only if none of its words has been used, shorter phrases first, from the left. That
    order is a state per document, so it runs over each document in Python; spans count code points.
    The lexicon is sent along, and therefore must be small; a larger one is refused.
    """
    import re

    rows = layers.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError(f"a layer lexicon of over {BROADCAST_ROWS} entries cannot be sent to every task")
    table = docs.sparkSession.sparkContext.broadcast({r["phrase"]: r["layer"] for r in rows})

    def run(frames):
        word = re.compile(pattern)
        for pdf in frames:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                known, text = table.value, text or ""
                found = [(m.group(), m.group().lower(), m.start(), m.end()) for m in word.finditer(text)]
                used: set[int] = set()
                for size in range(1, 6):
                    for i in range(len(found) - size + 1):
                        part = found[i : i + size]
                        layer = known.get(" ".join(p[1] for p in part))
                        if layer is None or (size > 1 and any(j in used for j in range(i, i + size))):
                            continue
                        used.update(range(i, i + size))
                        out.append((doc_id, " ".join(p[0] for p in part), " ".join(p[1] for p in part), layer, part[0][2], part[-1][3]))
            yield pd.DataFrame(out, columns=["doc_id", "surface", "lemma", "layer", "start", "end"])

    hits = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, surface string, lemma string, layer string, start int, end int")
    return hits.join(docs.select("doc_id", "text"), "doc_id").select(*hits.columns, snippet(F.col("text"), F.col("start"), F.col("end"), around).alias("context"))


def layer_summary(hits: DataFrame) -> DataFrame:
    """(doc_id, layer, n, words): hits and distinct lower-cased surfaces per layer."""
    return hits.groupBy("doc_id", "layer").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.lower("surface"))).alias("words"))


def marked_share(hits: DataFrame, docs: DataFrame, pattern: str = C.CYRILLIC_2) -> DataFrame:
    """(doc_id, n_hits, n_marked, total, marked_ratio): the ratio counts literary hits, n_marked does not."""
    total = docs.select("doc_id", F.regexp_count("text", F.lit(pattern)).cast("long").alias("total"))
    per = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hits"), count_of(F.col("layer") != C.LITERARY).alias("n_marked"))
    out = total.join(per, "doc_id", "left").na.fill(0, ["n_hits", "n_marked"])
    return out.withColumn("marked_ratio", F.coalesce(ratio(F.col("n_hits"), F.col("total")), F.lit(0.0)))


def without_exclusions(hits: DataFrame, docs: DataFrame, annotations: DataFrame) -> DataFrame:
    """Hits that no annotation excludes; annotations: the latest per (text_hash, lemma, layer)."""
    from lexiforge.functions.text import text_hash

    keyed = hits.join(docs.select("doc_id", text_hash(F.col("text")).alias("text_hash")), "doc_id")
    return keyed.join(annotations.where("verdict = 'exclude'").select("text_hash", "lemma", "layer"), ["text_hash", "lemma", "layer"], "left_anti").select(*hits.columns)


def layer_display(hits: DataFrame) -> DataFrame:
    """(doc_id, layer, label, n, pct): share of a layer among a document's remaining hits."""
    n = hits.groupBy("doc_id", "layer").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    return n.select("doc_id", "layer", lookup({k: v for k, (v, _) in C.LAYERS.items()}, F.col("layer")).alias("label"), "n", (F.col("n") * 100 / total).alias("pct"))


def browse(lexicon: DataFrame, group: str, word: str) -> DataFrame:
    """(group, n, words): a dictionary by group, sorted; for the small dictionaries that people read."""
    return lexicon.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(word)).alias("words"))


def search(lexicon: DataFrame, word: str, query: str, without: Column | None = None) -> DataFrame:
    """Entries whose word contains the query, by word."""
    rows = lexicon.where(F.col(word).contains(query.strip().lower()))
    return (rows if without is None else rows.where(~without)).orderBy(word)
