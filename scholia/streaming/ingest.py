"""Streaming ingest: each micro-batch of documents is cleaned, chunked and put in
place of the documents' earlier chunks, in a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scholia.operators import chunking, clean
from scholia.sources.store import Change, Store


def chunks_of(docs: DataFrame, key: str) -> DataFrame:
    cleaned = clean.clean(docs.select(key, "text"))
    return chunking.chunk(cleaned.select(key, F.col("cleaned_text").alias("text")), key)


def take_in(store: Store, docs: DataFrame, source: str, batch: int, version: str | None = None) -> int:
    """Put a batch of documents in place of their earlier chunks; one whose new version has
    none loses those it had. Of several versions in a batch the one with the largest
    `version` column counts, of equal ones the largest text. A batch that was taken
    in before changes nothing."""
    by = [c for c in (version, "text") if c]
    docs = docs.groupBy(store.key).agg(F.max(F.struct(*by)).alias("_last")).select(store.key, F.col("_last.text").alias("text"))
    return store.commit(Change("chunks", chunks_of(docs, store.key), docs.select(store.key)), applied=(source, batch))


def ingest_stream(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, key: str = "doc_id", version: str | None = None) -> StreamingQuery:
    """Take in Parquet files as they come, into the table chunks of the store `out`."""
    docs = spark.readStream.schema(schema).parquet(folder)
    store = Store(spark, out, key)

    def write(batch: DataFrame, number: int) -> None:
        take_in(store, batch, checkpoint, number, version)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
