"""The corpus as a stream: texts that arrive are annotated, appended, and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiforge.operators.store import corpus_rows, corpus_stats
from lexiforge.operators.tokens import Annotator, annotate, corpus_lemmas

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def arriving(spark: SparkSession, folder: str, schema: str = DOCUMENTS, per_trigger: int = 1) -> DataFrame:
    """Documents of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def accumulate(docs: DataFrame, corpus: str, checkpoint: str, annotator: Annotator | None = None, on_ready=None) -> StreamingQuery:
    """Append each batch to the corpus; a batch that is run again replaces its own folder, so nothing counts twice.

    on_ready(corpus) is called after a batch once the corpus is large enough to train on.
    """

    def add(batch: DataFrame, no: int) -> None:
        rows = corpus_rows(batch.select("doc_id", "text"), corpus_lemmas(annotate(batch.select("doc_id", "text"), annotator)))
        rows.write.mode("overwrite").parquet(f"{corpus}/batch={no}")
        if on_ready is not None:
            whole = batch.sparkSession.read.parquet(corpus)
            if corpus_stats(whole).first()["ready"]:
                on_ready(whole)

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def word_rates(docs: DataFrame, ts: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(start, end, n_docs, n_words) per window of event time, for batch and stream alike."""
    words = F.regexp_count("text", F.lit("[A-Za-zА-Яа-яЁё]+")).cast("long")
    timed = docs.withWatermark(ts, late) if docs.isStreaming else docs
    out = timed.groupBy(F.window(ts, window)).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(words).alias("n_words"))
    return out.select("window.start", "window.end", "n_docs", "n_words")
