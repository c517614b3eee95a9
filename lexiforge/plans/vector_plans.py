"""Queries on vectors and small models; the words of a vector are its id spelled in letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.operators import compare, learning, neighbours as V, reports, subwords, topics
from lexiforge.operators import tokens as T
from lexiforge.plans.shared import documents, table, tokens
from lexiforge.sources.shared import scratch

K = 5
LIMIT = 0.35


def vectors(spark, d):
    """(word, vec, label): ids in letters, so that they count as words."""
    e = table(spark, d, "embeddings")
    return e.select(F.concat(F.lit("w"), F.translate(F.col("vec_id").cast("string"), "0123456789", "abcdefghij")).alias("word"), F.col("embedding").alias("vec"), "label", "vec_id")


VEC = "v as (select 'w' || translate(vec_id::VARCHAR, '0123456789', 'abcdefghij') as word, embedding::DOUBLE[] as x, label, vec_id from embeddings)"
PAIR = f"""{VEC}, u as (select word, label, vec_id, x, sqrt(list_sum(list_transform(x, lambda a: a * a))) as n from v),
p as (select a.word as query, b.word as neighbour, list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) / (a.n * b.n) as similarity from u a join u b on a.word <> b.word where {{where}}),
r as (select *, row_number() over (partition by query order by round(similarity, 12) desc, neighbour) as no from p qualify no <= {{k}})"""


def binary(spark, d):
    """The vectors written as one binary file, part by part, and read again in ranges of its bytes."""
    import numpy as np
    import pyarrow as pa

    from lexiforge.sources import vector_files
    from lexiforge.sources.office import place

    path, rows = scratch(spark), vectors(spark, d).select("word", "vec")
    count, dim = rows.count(), rows.select(F.size("vec")).first()[0]

    def as_bytes(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([vector_files.row_bytes(b.column(0).to_pylist(), x)])], ["rows"])

    store, at = place(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(at) as f:
        f.write(f"{count} {dim}\n".encode())
        for part in rows.mapInArrow(as_bytes, "rows binary").toLocalIterator():
            f.write(part["rows"])
    return vector_files.read_vectors(spark, path, 50_000).select("word", F.posexplode("vec").alias("i", "x")).select("word", F.col("i").cast("long").alias("i"), "x")


def vocab(spark, d):
    return vectors(spark, d).select(F.concat(F.lit("d"), F.col("label").cast("string")).alias("domain"), "word", "vec_id").where("vec_id % 3 <> 0").select("domain", "word")


def expanded(spark, d):
    return V.expand_domains(vocab(spark, d), vectors(spark, d).select("word", "vec"), V.TOP, LIMIT)


EXPAND = f"""{VEC}, voc as (select 'd' || label as domain, word from v where vec_id % 3 <> 0), seeds as (select domain, word from voc qualify row_number() over (partition by domain order by word) <= {V.SEEDS}), sq as (select distinct word from seeds where length(word) >= 3),
u as (select word, x, sqrt(list_sum(list_transform(x, lambda a: a * a))) as n from v), p as (select a.word as query, b.word as neighbour, list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) / (a.n * b.n) as similarity from u a join sq on sq.word = a.word join u b on a.word <> b.word),
r as (select * from p qualify row_number() over (partition by query order by round(similarity, 12) desc, neighbour) <= 20), added as (select distinct domain, neighbour as word from seeds join r on seeds.word = r.query where similarity >= {LIMIT} and length(neighbour) >= 3 and length(seeds.word) >= 3 except select domain, word from voc)"""


def near(spark, d):
    v = vectors(spark, d)
    return V.nearest(v.where("vec_id % 20 = 0").select("word", "vec"), v.select("word", "vec"), K)


def tagged(spark, d):
    v = vectors(spark, d).select(F.concat("word", F.when(F.col("vec_id") % 2 == 0, "_NOUN").otherwise("_VERB")).alias("word"), "vec", "vec_id")
    seeds = vectors(spark, d).where("vec_id % 20 = 0").select("word")
    return V.similar_tagged(seeds, v.select("word", "vec"), K, -1.0)


def means(spark, d):
    """Each label as a document of its vectors' words, the word of an even id twice."""
    v = vectors(spark, d)
    lemmas = v.select(F.col("label").cast("long").alias("doc_id"), F.col("word").alias("lemma"), F.explode(F.sequence(F.lit(1), F.when(F.col("vec_id") % 2 == 0, 2).otherwise(1))))
    return V.mean_vectors(lemmas.select("doc_id", "lemma"), v.select("word", "vec"))


MEANS = f"{VEC}, c as (select label::BIGINT as doc_id, unnest(range(len(x))) as i, unnest(x) as x, case when vec_id % 2 = 0 then 2 else 1 end as n from v), m as (select doc_id, i, sum(x * n) / sum(n) as x from c group by all)"


def vec_sim(spark, d):
    m = means(spark, d)
    ids = m.select("doc_id")
    pairs = ids.select(F.col("doc_id").alias("left_id")).withColumn("right_id", F.col("left_id") + 1).join(ids.select(F.col("doc_id").alias("right_id")), "right_id", "left_semi")
    return compare.vector_similarity(pairs, m).withColumn("vector_similarity", F.round("vector_similarity", 6))


def annotations(spark, d):
    """Labelled documents as annotations: quality is the verdict, the whole text its context."""
    both = documents(spark, d).join(table(spark, d, "labels"), "doc_id")
    return both.select(F.col("lang").alias("layer"), F.when(F.col("quality") == 1, "confirm").otherwise("exclude").alias("verdict"), F.col("text").alias("context"), F.regexp_extract("text", r"\p{L}+", 0).alias("lemma"), "doc_id")


def predicted(spark, d):
    rows = annotations(spark, d)
    return learning.false_positives(rows, learning.train_annotator(rows)).select("doc_id", "layer", "verdict", "p_exclude", "false_positive")


def corpus(spark, d):
    return T.corpus_lemmas(tokens(spark, d))


def halves(spark, d):
    """The corpus in two halves that arrive one after the other."""
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    return corpus(spark, d).where(half == 0), corpus(spark, d).where(half == 1)


def loaded(spark, d):
    """Vectors of a model that was saved and loaded, of its words and of forms that it has not seen."""
    model, path = subwords.train(corpus(spark, d)), scratch(spark)
    subwords.save(spark, model, path)
    model = subwords.load(spark, path)
    words = tokens(spark, d).select(F.explode(F.array(F.col("lemma"), F.concat("lemma", F.lit("s")))).alias("word")).distinct()
    return subwords.vectors_of(words, model)


def continued(spark, d):
    """A model of the first half that was saved, loaded and trained on with the second."""
    (old, new), path = halves(spark, d), scratch(spark)
    subwords.save(spark, subwords.train(old), path)
    return subwords.vector_table(spark, subwords.train(new, subwords.load(spark, path)))


def updated_topics(spark, d):
    """Topics of the first half, saved, loaded and moved by the second alone."""
    (old, new), path = halves(spark, d), scratch(spark)
    topics.save(spark, topics.update(old), path)
    return topics.update(new, topics.load(spark, path))


def grown_by_subwords(spark, d):
    """Dictionaries of frequent words by language, grown by a model of the corpus."""
    from lexiforge.plans.lexicon_plans import vocab as by_language

    return subwords.expand_domains(by_language(spark, d), subwords.train(corpus(spark, d)))


QUERIES = {
    "src_vec_pq": lambda s, d: vectors(s, d).select("vec_id", F.round(F.aggregate(V.unit(F.col("vec")), F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm")),
    "src_vec_bin": binary,
    "topk_neighbors": lambda s, d: near(s, d).select("query", "neighbour", F.col("no").cast("long").alias("no")),
    "ml_similar": lambda s, d: near(s, d).select("query", "neighbour", F.round("similarity", 6).alias("similarity")),
    "ml_neighbors_navec": lambda s, d: near(s, d).where(F.col("similarity") >= LIMIT).select("query", "neighbour"),
    "ml_neighbors_rusvec": lambda s, d: tagged(s, d).select("query", "neighbour", F.col("no").cast("long").alias("no")),
    "ml_expand_domain": expanded,
    "set_vocab_diff": lambda s, d: expanded(s, d).where("domain = 'd1'"),
    "ml_expand_all": lambda s, d: V.expansion_counts(expanded(s, d)),
    "prs_expand_table": lambda s, d: V.expansion_counts(expanded(s, d)).select("domain", "added"),
    "agg_mean_vector": lambda s, d: means(s, d).select("doc_id", F.posexplode("vec").alias("i", "x")).select("doc_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x")),
    "cmp_vec_sim": vec_sim,
    "ml_ctx_features": lambda s, d: annotations(s, d).select("doc_id", F.array_join(learning.context_bag(F.col("context"), F.col("lemma")), " ").alias("bag")),
    "ml_annotator_gate": lambda s, d: learning.gate(annotations(s, d)),
    "ml_annotator_train": predicted,
    "ml_annotator_predict": lambda s, d: predicted(s, d).groupBy("layer", "false_positive").agg(F.count(F.lit(1)).alias("n")),
    "ml_embed_train": continued,
    "ml_embed_load": loaded,
    "ml_expand_ft": grown_by_subwords,
    "ml_lda_update": lambda s, d: topics.topic_words(s, updated_topics(s, d)),
    "topk_topic_words": lambda s, d: topics.topic_words(s, topics.update(corpus(s, d))),
    "ml_lda_topics": lambda s, d: topics.topics_of(corpus(s, d), topics.update(corpus(s, d))),
    "prs_expand_bars": lambda s, d: reports.relative_bars(V.expansion_counts(expanded(s, d)).withColumn("g", F.lit(1)), ["g"], "added").select("domain", "bar"),
}

_near = PAIR.format(where="a.vec_id % 20 = 0", k=K)
ORACLE = {
    "src_vec_pq": f"with {VEC} select vec_id, 1.0::DOUBLE as norm from v",
    "src_vec_bin": "select 'w' || translate(vec_id::VARCHAR, '0123456789', 'abcdefghij') as word, unnest(range(len(embedding)))::BIGINT as i, unnest(embedding) as x from embeddings",
    "topk_neighbors": f"with {_near} select query, neighbour, no from r",
    "ml_similar": f"with {_near} select query, neighbour, round(similarity, 6) as similarity from r",
    "ml_neighbors_navec": f"with {_near} select query, neighbour from r where similarity >= {LIMIT}",
    "ml_expand_domain": f"with {EXPAND} select domain, word from added",
    "set_vocab_diff": f"with {EXPAND} select domain, word from added where domain = 'd1'",
    "ml_expand_all": f"with {EXPAND} select domain, count(*) as added from added group by 1",
    "prs_expand_bars": f"with {EXPAND}, c as (select domain, count(*) as added from added group by 1) select domain, floor(added / (max(added) over ())::DOUBLE * 1000)::BIGINT as bar from c",
    "agg_mean_vector": f"with {MEANS} select doc_id, i, round(x, 6) as x from m",
    "cmp_vec_sim": f"with {MEANS}, n as (select doc_id, sqrt(sum(x * x)) as n from m group by 1) select a.doc_id as left_id, b.doc_id as right_id, round(least(1.0, greatest(0.0, sum(a.x * b.x) / (any_value(na.n) * any_value(nb.n)))), 6) as vector_similarity from m a join m b on b.doc_id = a.doc_id + 1 and a.i = b.i join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id group by all",
    "ml_ctx_features": "with a as (select doc_id, coalesce(text, '') as context, regexp_extract(text, '\\p{L}+') as lemma from documents join labels using (doc_id)) select doc_id, array_to_string(list_filter(regexp_extract_all(lower(context), '[а-яёА-ЯЁa-zA-Z]+'), lambda w: w <> lower(lemma)) || ['TARGET_' || lower(lemma)], ' ') as bag from a",
    "ml_annotator_gate": "with a as (select lang as layer, quality = 1 as y from documents join labels using (doc_id)) select layer, count(*) as n, count(distinct y) as n_classes, (select count(*) from a) >= 10 and count(*) >= 6 and count(distinct y) = 2 as trained from a group by 1",
}
ORACLE["prs_expand_table"] = ORACLE["ml_expand_all"]
# Every word has one tag, so the tagged vectors have the same neighbours.
ORACLE["ml_neighbors_rusvec"] = ORACLE["topk_neighbors"]
