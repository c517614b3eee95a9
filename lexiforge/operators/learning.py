"""A small trainable model: the annotation filter. Word vectors are in subwords, topics in topics."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

# Annotations needed for all layers and for each, and the sureness from which a hit is left out.
LEAST_ALL, LEAST_PER_LAYER, SURE = 10, 6, 0.72
CONTEXT_WORD = "[а-яёА-ЯЁa-zA-Z]+"


def context_bag(context: Column, lemma: Column) -> Column:
    """Words of a context but the target itself, then a token that names the target."""
    words = F.regexp_extract_all(F.lower(F.coalesce(context, F.lit(""))), F.lit(CONTEXT_WORD), F.lit(0))
    return F.concat(F.filter(words, lambda w: w != F.lower(lemma)), F.array(F.concat(F.lit("TARGET_"), F.lower(lemma))))


def gate(annotations: DataFrame) -> DataFrame:
    """(layer, n, n_classes, trained): a layer needs enough annotations of both verdicts, and all layers together too."""
    n = annotations.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.col("verdict") == "exclude").alias("n_classes"))
    total = annotations.agg(F.count(F.lit(1)).alias("total"))
    return n.join(F.broadcast(total)).select("layer", "n", "n_classes", ((F.col("total") >= LEAST_ALL) & (F.col("n") >= LEAST_PER_LAYER) & (F.col("n_classes") == 2)).alias("trained"))


def train_annotator(annotations: DataFrame, max_features: int = 500) -> dict[str, PipelineModel]:
    """A classifier per layer that the gate lets through: log term counts of words and word pairs, idf, balanced classes."""
    layers = [r["layer"] for r in gate(annotations).where("trained").orderBy("layer").collect()]
    models = {}
    for layer in layers:
        rows = annotations.where(F.col("layer") == layer).select(context_bag(F.col("context"), F.col("lemma")).alias("words"), F.when(F.col("verdict") == "exclude", 0.0).otherwise(1.0).alias("label"))
        n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        weight = F.when(F.col("label") == 0.0, sum(n.values()) / (2 * n[0.0])).otherwise(sum(n.values()) / (2 * n[1.0]))
        stages = [
            NGram(n=2, inputCol="words", outputCol="pairs"), SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"),
            CountVectorizer(vocabSize=max_features, inputCol="terms", outputCol="counts"), IDF(inputCol="counts", outputCol="weighted"),
            Normalizer(inputCol="weighted", outputCol="features"), LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=100, regParam=0.01),
        ]
        models[layer] = Pipeline(stages=stages).fit(rows.withColumn("weight", weight))
    return models


def false_positives(hits: DataFrame, models: dict[str, PipelineModel], sure: float = SURE) -> DataFrame:
    """hits with p_exclude (null for layers without a model) and false_positive."""
    parts = []
    for layer, model in models.items():
        own = hits.where(F.col("layer") == layer).withColumn("words", context_bag(F.col("context"), F.col("lemma")))
        parts.append(model.transform(own).select(*hits.columns, vector_to_array("probability")[0].alias("p_exclude")))
    rest = hits.where(~F.col("layer").isin(*models)) if models else hits
    out = rest.withColumn("p_exclude", F.lit(None).cast("double"))
    for p in parts:
        out = out.unionByName(p)
    return out.withColumn("false_positive", F.coalesce(F.col("p_exclude") > sure, F.lit(False)))


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def to_vector(vec: Column) -> Column:
    return array_to_vector(F.transform(vec, lambda x: x.cast("double")))
