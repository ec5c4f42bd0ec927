"""Incremental indexing: a stream of documents merged into a data set, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiweave.operators.index import index_documents
from lexiweave.plans.dataset import Dataset


def merge_batch(dataset: Dataset, whitelist: DataFrame) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: new documents and their links are stored once each, however often a batch comes."""

    def merge(batch: DataFrame, _: int) -> None:
        dataset.merge("documents", batch, ["corpus_id", "doc_id"])
        dataset.merge("doc_ngram", index_documents(batch, whitelist), ["corpus_id", "doc_id", "ngram_id"])

    return merge


def index_stream(stream: DataFrame, dataset: Dataset, whitelist: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Index a stream of documents (corpus_id, doc_id, title, content, ...) into ``dataset``."""
    writer = stream.writeStream.foreachBatch(merge_batch(dataset, whitelist)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per window of event time and key, late rows within ``late`` included; for streams and tables alike."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
