"""Hand-derived Russian cases."""

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import constants as C, text as X
from lexiforge.operators import compare, errors, internet, lexicons as L, metrics, patterns, punctuation as P, store
from lexiforge.operators import tokens as T

TOKENS = "doc_id long, tok_idx int, sent_id int, token_id int, text string, lemma string, upos string, feats map<string,string>, head int, char_start int, char_end int"
T1 = "Он читал новую книгу. Он устал."
T2 = "Она читала книгу."


def tokens(spark, *texts):
    """texts: (doc_id, [(text, lemma, upos)])."""
    rows = [(d, i, 0, i + 1, t, l, u, {}, 0, 0, 0) for d, ws in texts for i, (t, l, u) in enumerate(ws)]
    out = spark.createDataFrame(rows, TOKENS)
    return out.withColumn("pos_label", T.pos_label(F.col("upos"), F.col("feats")))


W1 = [("Он", "он", "PRON"), ("читал", "читать", "VERB"), ("новую", "новый", "ADJ"), ("книгу", "книга", "NOUN"), ("Он", "он", "PRON"), ("устал", "устать", "VERB")]
W2 = [("Она", "она", "PRON"), ("читала", "читать", "VERB"), ("книгу", "книга", "NOUN")]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_frequency_profile(spark):
    d = spark.createDataFrame([("и", 1, 36209.75, "misc"), ("он", 4, 18972.22, "pron"), ("она", 15, 6958.95, "pron"), ("весь", 24390, 1.91, "noun")], "lemma string, rank int, ipm double, pos string")
    words = L.frequency_words(L.form_counts(docs(spark, "Он и она, и весь мир")), d)
    p = L.frequency_profile(words).first()
    assert (p.total, p.nucleus, p.low, p.absent, p.content) == (6, 4, 1, 1, 2)
    assert p.avg_rank == pytest.approx(4882.2) and p.avg_ipm == pytest.approx(19670.516, abs=1e-3) and p.content_avg_ipm == pytest.approx(1.91)
    assert L.rarest(words).first().form == "весь" and [r.form for r in L.absent(words).collect()] == ["мир"]


def test_internet_profile(spark):
    p = internet.internet_profile(docs(spark, "ЛОЛ!! это норм :) #мем @друг 12:30")).first()
    assert {k: p[k] for k in internet.FEATURES} == {"emoji": 0, "emoticons": 2, "hashtags": 1, "mentions": 1, "urls": 0, "caps": 0, "slang": 3, "abbreviations": 0, "repeated_punct": 1, "missing_caps": 1}
    assert p.n_words == 5 and p.score == 1.0


def test_topics(spark):
    v = spark.createDataFrame([("A", "a"), ("A", "b"), ("B", "b"), ("B", "c")], "domain string, word string")
    lemmas = spark.createDataFrame([(0, w) for w in "abbx"], "doc_id long, lemma string")
    s = L.domain_scores(lemmas, v, ["A", "B", *"CDEFGHIJ"])
    got = {r.domain: r for r in s.collect()}
    assert got["A"].cosine == pytest.approx(0.9445508949) and got["B"].cosine == pytest.approx(0.5582805866)
    assert got["A"].tf_idf_sum == pytest.approx(1.8258285151) and got["B"].match_count == 1 and got["C"].cosine == 0.0
    assert [r.domain for r in L.top_domains(s).orderBy("no").collect()] == ["A", "B"]


def test_diversity_sentences_bigrams(spark):
    t = tokens(spark, (0, W1))
    m = metrics.lemma_diversity(t).first()
    assert (m.n_words, m.n_lemmas, m.n_hapax) == (6, 5, 4)
    s = metrics.sentence_stats(docs(spark, T1, "", "нет конца", "!!! ... ?")).orderBy("doc_id").collect()
    assert (s[0].n_sentences, s[0].mean_len, s[0].var_len) == (2, 3.0, 1.0) and (s[1].n_sentences, s[1].var_len) == (0, 0.0) and s[2].n_sentences == 1 and s[3].n_sentences == 0
    b = {(r.p1, r.p2): r.n for r in metrics.tag_bigrams(t).collect()}
    assert b == {("PRON", "VERB"): 2, ("VERB", "ADJ"): 1, ("ADJ", "NOUN"): 1, ("NOUN", "PRON"): 1}


def test_comparison(spark):
    pairs = spark.createDataFrame([(0, 1), (0, 0)], "left_id long, right_id long")
    t = tokens(spark, (0, W1), (1, W2))
    got = {r.right_id: r for r in compare.compare(pairs, t, docs(spark, T1, T2)).collect()}
    r = got[1]
    assert (r.jaccard, r.pos_similarity, r.syntactic_similarity, r.ttr_similarity) == pytest.approx((1 / 3, 0.833333, 1.0, 0.833333), abs=1e-5)
    assert r.bigram_similarity == pytest.approx(0.534522, abs=1e-5) and r.overall == pytest.approx(0.648571, abs=1e-5) and r.verdict == "medium"
    assert got[0].overall == pytest.approx(1.0)
    assert compare.common_lemmas(pairs, compare.lemma_counts(t)).where("right_id = 1").first().common == ["книга", "читать"]


def test_staged_dedup(spark):
    schema = "doc_id long, start int, end int, source string, fragment string"
    lt = spark.createDataFrame([(0, 5, 10, "LT", "A"), (0, 8, 12, "LT", "B"), (0, 0, 0, "LT", "none")], schema)
    punct = spark.createDataFrame([(0, 3, 6, "PUNCT", "Q")], schema)
    assert sorted(r.fragment for r in errors.merge_in_stages(lt, punct).collect()) == ["Q", "none"]
    once = errors.keep_first_spans(lt.unionByName(punct))
    assert sorted(r.fragment for r in once.collect()) == ["B", "Q", "none"]
    assert sorted(map(tuple, errors.keep_first_spans(once).collect())) == sorted(map(tuple, once.collect()))


def test_sweep_equals_one_stage_after_the_other(spark):
    """Random spans of three sources, empty and unplaced ones, null ids and clashing names: the sweep gives what stages give one by one."""
    import random

    rng = random.Random(3)
    schema = "doc_id string, start int, end int, source string, fragment string, _lf_stage int, _lf_doc string"
    names = [("LT",), ("YASPELL", "LT"), ("PUNCT", "REGEX", None)]
    rows = [[(rng.choice(["a", "b", None]), a := rng.choice([0, *range(60)]), a + rng.choice([0, 0, 1, 4, 9]) if a else rng.choice([0, 3]), rng.choice(n), f"{k}{i}", i, "x") for i in range(120)] for k, n in enumerate(names)]
    rows[1] += [("a", None, 4, "LT", "no start", 1, None), ("b", 7, None, "LT", "no end", 2, None)]
    frames = [spark.createDataFrame(r, schema) for r in rows]

    def kept(spans):
        out, last = [], {}
        for r in sorted(spans, key=lambda r: (r[1] or 0, -C.SOURCE_PRIORITY.get(r[3], 0), r[2] or 0, r[3] or "", r[4])):
            a, b = last.get(r[0], (-1, -1))
            if r[1] is None or r[2] is None or r[1] == r[2] == 0:
                out.append(r)
            elif r[1] >= b or r[2] <= a:
                out.append(r)
                last[r[0]] = r[1], max(b, r[2])
        return out

    want = kept(kept(kept(rows[0]) + rows[1]) + rows[2])
    got = errors.merge_in_stages(*frames)
    assert got.columns == frames[0].columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert 20 < len(want) < 300 and errors.merge_in_stages(frames[0].where("false")).count() == 0


def test_one_document_with_many_spans(spark):
    """200 000 spans of one document, half of them over others, in seconds; Arrow batches end among them."""
    import time

    spans = spark.range(200_000).selectExpr("1L as doc_id", "cast(id * 5 as int) as start", "cast(id * 5 + 7 as int) as end", "'LT' as source", "cast(id as string) as fragment")
    begun = time.monotonic()
    got = errors.keep_first_spans(spans).agg({"*": "count", "start": "sum"}).first()
    assert sorted(got) == [100_000, sum(range(0, 1_000_000, 10))] and time.monotonic() - begun < 30


def test_answers_by_content(spark):
    """A chunk that texts share is asked once, a failed or unknown one moves none after it, and what is known is not asked again."""
    cut = [["Aaaa.", " Bbbb."], [" Bbbb."], [""], ["Aaaa.", " Cccc.", " Bbbb."]]
    rows = [(i, no, sum(map(len, text[:no])), chunk) for i, text in enumerate(cut) for no, chunk in enumerate(text)]
    pieces = spark.createDataFrame([*rows, (9, 0, 0, None)], "doc_id long, no int, offset int, chunk string")
    asked = errors.requests(pieces)
    assert sorted(r.chunk for r in asked.collect()) == ["", " Bbbb.", " Cccc.", "Aaaa."]
    key = {r.chunk: r.chunk_key for r in asked.collect()}
    schema = "chunk_key string, matches array<struct<pos int, len int>>"
    answers = spark.createDataFrame([(key["Aaaa."], [(0, 4)]), (key[" Cccc."], None), (key[" Bbbb."], None), (key[" Bbbb."], [(1, 2), (3, 2)])], schema)
    got = errors.answered_matches(answers, pieces, "pos")
    assert sorted(map(tuple, got.collect())) == [(0, 0, 4), (0, 6, 2), (0, 8, 2), (1, 1, 2), (1, 3, 2), (3, 0, 4), (3, 12, 2), (3, 14, 2)]
    assert sorted(r.chunk for r in errors.requests(pieces, answers).collect()) == [""]
    assert errors.requests(pieces.where("false")).count() == 0 and errors.answered_matches(answers.where("false"), pieces, "pos").count() == 0


def test_probe_and_groups(spark):
    """Every boundary of random texts gets what the tests on a text and a place say; sentences hold their tokens in order."""
    import random
    import re

    from lexiforge.operators import punctuation

    rng = random.Random(4)
    texts = ["".join(rng.choices("аб ,.;\n\t\u00a0()—-!1_", k=rng.randint(0, 40))) for _ in range(150)] + [None, "", "  слово  ", "1"]
    got = {(r.doc_id, r.i): (r.before, r.after) for r in punctuation.probe_boundaries(docs(spark, *texts)).collect()}
    want = {(d, i): (punctuation.punctuated_before(t, m.start()), punctuation.punctuated_after(t, m.end())) for d, t in enumerate(texts) for i, m in enumerate(re.finditer(r"[^\W\d_]+", t or ""))}
    assert got == want and len(want) > 300
    rows = [(0, 0, 1, "b"), (0, 0, 0, "a"), (0, 1, 2, "c"), (None, 0, 0, "d"), (None, 0, 0, "d")]
    groups = punctuation.sentence_groups(spark.createDataFrame(rows, "doc_id long, sent_id int, tok_idx int, text string")).collect()
    assert sorted(((r.doc_id, r.sent_id, "".join(t.text for t in r.tokens)) for r in groups), key=repr) == [(0, 0, "ab"), (0, 1, "c"), (None, 0, "dd")]


def test_patterns(spark):
    t = tokens(spark, (0, W1))
    at = lambda p: sorted(r.position for r in patterns.query(t, p).collect())
    assert at("PRON VERB") == [0, 4] and at("VERB * NOUN") == [1] and at("гл прил") == [1] and at("PUNCT") == [] and len(at("*")) == 6
    assert patterns.query(t, "VERB * NOUN").first().fragment == "читал новую книгу"
    assert patterns.parse("NOUN FOO") is None and patterns.parse("") is None and patterns.parse("имя собственное") is None
    with pytest.raises(ValueError):
        patterns.query(t, "NOUN FOO")


def test_skill_scale(spark):
    rows = spark.createDataFrame([(0, 100), (2, 100), (3, 100), (4, 100), (0, 0)], "e int, w int").select(X.skill_rate(F.col("e"), F.col("w")).alias("r"), X.skill_label(F.col("e"), F.col("w")).alias("l")).collect()
    assert [(r.r, r.l) for r in rows] == [(0.0, "высокая"), (4.0, "средняя"), (6.0, "средняя"), (8.0, "низкая"), (0.0, "нулевая")]


def test_store_keys(spark):
    log = spark.createDataFrame([(1, "Слово", "x", "put"), (2, "слово", "x", "put"), (3, "Word", "x", "put"), (4, "word", "x", "put")], "seq long, word string, category string, op string")
    assert sorted(r.word for r in store.dictionary(log).collect()) == ["word", "Слово", "слово"]


def test_whole_words_and_offsets(spark):
    n = lambda text, term: spark.createDataFrame([(text,)], "t string").select(X.term_count(F.col("t"), term)).first()[0]
    assert n("сток ок", "ок") == 1 and n("ОДНАКО", "однако") == 1 and n("в общем-то, в общем", "в общем") == 2
    layers = spark.createDataFrame([("ab", "obscene", 1)], "phrase string, layer string, n_words int")
    h = L.layer_hits(docs(spark, "\U0001f600 ab"), layers, r"[a-z]{2,}").first()
    assert (h.start, h.end) == (2, 4)


def test_phrases_are_greedy(spark):
    layers = spark.createDataFrame([("бы", "vernacular", 1), ("как бы", "archaic", 2), ("так сказать", "archaic", 2), ("сказать вот так", "obscene", 3)], "phrase string, layer string, n_words int")
    h = L.layer_hits(docs(spark, "как бы так сказать вот так"), layers).orderBy("start").collect()
    assert [(r.surface, r.layer) for r in h] == [("бы", "vernacular"), ("так сказать", "archaic")]


@pytest.mark.parametrize(("text", "rules"), [
    ("Дом который построили.", ["KOTORY"]), ("Дом, который построили.", []), ("Дом в котором жили.", ["KOTORY"]), ("Дом, в котором жили.", []), ("Который час?", []),
    ("Он устал однако пришёл.", ["ADVERSE"]), ("Он устал, однако пришёл.", []), ("Он ушёл потому что устал.", ["COMPOUND"]), ("Потому что устал.", []),
    ("Конечно он придёт.", ["INTRO"]), ("Конечно, он придёт.", []), ("", []), ("abc 123", []),
])
def test_punctuation_rules(spark, text, rules):
    got = P.check_text(docs(spark, text)).collect()
    assert [r.rule_ref.split(":")[1] for r in got] == rules
    assert all(text[r.start : r.end] for r in got)


def test_clauses_on_trees(spark):
    """«Он шёл напевая песню домой»: the gerund hangs on the verb and has an object."""
    text = "Он шёл напевая песню домой"
    words = [("Он", 2, "PRON", {}), ("шёл", 0, "VERB", {}), ("напевая", 2, "VERB", {"VerbForm": "Conv"}), ("песню", 3, "NOUN", {}), ("домой", 2, "ADV", {})]
    rows, at = [], 0
    for i, (w, head, tag, feats) in enumerate(words):
        at = text.index(w, at)
        rows.append((0, i, 0, i + 1, w, w.lower(), tag, feats, head, at, at + len(w)))
    t = spark.createDataFrame(rows, TOKENS).withColumn("pos_label", T.pos_label(F.col("upos"), F.col("feats")))
    got = {r.rule_ref: (r.start, r.end) for r in P.check(docs(spark, text), t).collect()}
    span = (text.index("напевая"), text.index("песню") + 5)
    assert got == {"PUNCT:DEEPR_BEFORE": span, "PUNCT:DEEPR_AFTER": span}
    assert {r.member for r in P.subtrees(t).where("token_id = 2").collect()} == {1, 2, 3, 4, 5}


def test_subtree_survives_loops():
    assert P.subtree(1, {1: [2], 2: [3], 3: [1]}) == {1, 2, 3}


def test_features(spark):
    f = spark.createDataFrame([("Case=Nom|Number=Sing|Variant=Short",), ("—",), (None,)], "f string").select(T.feats_text(F.col("f"))).collect()
    assert [r[0] for r in f] == ["Падеж: именительный; Число: единственное; Variant: Short", "—", "—"]
    assert C.UPOS_NAME["NOUN"] == "Существительное"


def test_rules_take_time_in_proportion():
    """Many matches in one long text: each looks at its surroundings only."""
    import time

    text = "дом в котором жили и дом который построили потому что так надо " * 4000
    began = time.process_time()
    found = [x for rule in P.TEXT_RULES.values() for x in rule(text)]
    assert len(found) == 12_000 and time.process_time() - began < 10
    assert [x[5:7] for x in P.relative_clauses("а, зав который")] == [(2, 14)]


def test_spans_are_found_forward(spark):
    t = tokens(spark, (0, [("Он", "он", "PRON"), ("он", "он", "PRON"), ("нет", "нет", "ADV"), ("Он", "он", "PRON")])).drop("pos_label")
    t = t.where("lemma <> 'нет'").unionByName(t.where("lemma = 'нет'").withColumn("text", F.lit("мимо")))
    got = {r.tok_idx: (r.start, r.end) for r in T.align_spans(t, docs(spark, "Он и он")).collect()}
    assert got == {0: (0, 2), 1: (5, 7), 2: (None, None), 3: (0, 2)}


def test_report_numbers_are_rounded_and_written_as_in_sql(spark):
    """527 / 800 is a little below 0.65875; small and large numbers have no exponent."""
    import duckdb

    from lexiforge.operators import reports

    pairs = [(527, 800), (3873, 800), (3, 3165), (1, 10**5), (0, 1), (12345678, 1), (10**9, 7), (-527, 800), (10001, 10**4), (5, 0)]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", metrics.ratio(F.col("a"), F.col("b")).alias("x"))
    got = {(r.a, r.b): r.t for r in rows.select("a", "b", reports.number(F.col("x")).alias("t")).collect()}
    want = {(a, b): duckdb.execute("select coalesce(round(?::DOUBLE / nullif(?, 0)::DOUBLE, 4)::VARCHAR, '∞')", [a, b]).fetchone()[0] for a, b in pairs}
    assert got == want and got[527, 800] == "0.6587" and got[3, 3165] == "0.0009" and got[12345678, 1] == "12345678.0"


def test_spans_of_joined_sources_meet_however_partitions_are_cut(spark):
    """Both sources come from joins on doc_id, of unlike sizes; each document's spans are swept together all the same."""
    small = {"spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1"}
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        texts = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("слово "), 300).alias("text"))
        marks = spark.range(2000).select((F.col("id") % 200).alias("doc_id"), (F.floor(F.col("id") / 200) * 40).cast("int").alias("at"))
        lt = errors.from_checker(marks.select("doc_id", F.lit("R0").alias("rule_id"), F.lit("TYPOS").alias("category"), F.lit("m" * 70).alias("message"), F.col("at").alias("offset"), F.lit(30).alias("length"), F.array(F.lit("a")).alias("replacements")), texts)
        sp = errors.from_speller(marks.where("at < 120").select("doc_id", F.lit(1).alias("code"), (F.col("at") + 10).alias("pos"), F.lit(5).alias("len"), F.lit("w").alias("word"), F.array(F.lit("p")).alias("s")), texts)
        kept = errors.keep_first_spans(lt.unionByName(sp)).groupBy("source").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert {r["source"]: r["count"] for r in kept} == {"LT": 2000}


def test_tokens_and_errors_leave_in_batches_of_fixed_size(spark):
    """A task reads no further text than its next batch of rows needs, and sentences that cross batches stay whole."""
    from lexiforge.plans import error_plans

    read, text = [], "слово " * 7000 + "."

    def texts():
        for i in range(3):
            read.append(i)
            yield i, text

    found = P.batched(error_plans.tree_rows(texts()), error_plans.TREE_TOKENS)
    assert next(found).num_rows == P.ROWS and read == [0]
    assert max(b.num_rows for b in found) == P.ROWS and read == [0, 1, 2]
    rows = list(error_plans.tree_rows([(5, text), (6, "а б. в г д, е ё ж з и к")]))
    t = spark.createDataFrame(rows, error_plans.TREE_TOKENS).repartition(4)
    got = [tuple(r) for r in P.subtrees(t).collect()]
    assert len(got) == len(set(got)) and {m for d, _, i, m in got if (d, i) == (5, 6994)} == set(range(6994, 7001))
    docs = spark.createDataFrame([(5, text), (6, "а б. в г д, е ё ж з и к"), (7, None)], "doc_id long, text string")
    want = [(d, *x) for d, s in ((5, text), (6, "а б. в г д, е ё ж з и к")) for n in sorted({r[2] for r in rows if r[0] == d}) for x in P.clauses(s, [P._TOKEN(r[0], r[2], r[1], r[3], r[7], *r[4:7], *r[8:]) for r in rows if (r[0], r[2]) == (d, n)])]
    assert sorted(map(tuple, P.check_trees(t, docs).collect())) == sorted(want) and len(want) > 3000


def test_a_profile_is_sent_once_to_the_cells_of_its_pairs(spark):
    """Pairs within and across blocks equal plain sets; no row of a join stands for a pair and a key."""
    import random

    rng = random.Random(3)
    ids = [0, 1, 2, compare.BLOCK - 1, compare.BLOCK, compare.BLOCK + 1, 5 * compare.BLOCK, 7 * compare.BLOCK]
    bags = {i: {w: rng.randint(1, 9) for w in rng.sample(["я", "ё", "Z", "b", "а", "\U0001f600", "ж ж", "c"], rng.randint(0, 6))} for i in ids}
    two = [(a, b) for a in ids for b in ids if a < b] + [(ids[0], ids[1]), (3, 4), (None, 1), (ids[7], ids[0])]
    long = spark.createDataFrame([(i, w, n) for i, bag in bags.items() for w, n in bag.items()] + [(0, None, 5)], "doc_id long, lemma string, n long")
    for kind in ("long", "string"):
        pairs = spark.createDataFrame(two, "left_id long, right_id long").selectExpr(f"cast(left_id as {kind}) left_id", f"cast(right_id as {kind}) right_id")
        own = long.withColumn("doc_id", F.col("doc_id").cast(kind))
        got = {(int(r.left_id), int(r.right_id)): r.common for r in compare.common_lemmas(pairs, own, 3, ("c",)).collect()}
        want = {}
        for a, b in two:
            both = [w for w in bags.get(a, {}) if w in bags.get(b, {}) and w != "c"]
            if both:
                want[a, b] = sorted(both, key=lambda w: (-bags[a][w] - bags[b][w], w))[:3]
        assert got == want and len(want) > 10
    plan = compare.jaccard(pairs, own)._jdf.queryExecution().optimizedPlan().toString()
    assert "lemma" in plan and not any("Join" in line and "lemma" in line for line in plan.splitlines())
