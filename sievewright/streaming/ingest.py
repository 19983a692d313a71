"""Records as a stream: term frequencies of new records are appended to the index tables batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index, dictionary, postings, term_frequencies, zone_terms


def append_records(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's records and zone terms under ``path``. A batch's folder is named by its number and
    overwritten when it is tried again, so a restart never adds a record twice."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/listings/batch={number}")
        zone_terms(batch).write.mode("overwrite").parquet(f"{path}/zoned/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refreshed(spark, path: str) -> Index:
    """The index over all batches so far: document frequencies and weights are those of the whole."""
    listings = spark.read.parquet(f"{path}/listings").drop("batch")
    zoned = spark.read.parquet(f"{path}/zoned").drop("batch")
    n = listings.count()
    tf = term_frequencies(zoned)
    terms = dictionary(tf, n)
    return Index(listings, zoned, tf, terms, postings(tf, terms), n)
