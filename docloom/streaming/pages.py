"""Streams of pages: each micro-batch of whole documents is preprocessed as a batch would be; no state crosses batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import preprocess
from ..sources.readers import DOCUMENT, exploded


def preprocessed_stream(spark: SparkSession, source: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends preprocessed documents to Parquet as JSON documents come into a folder. A repeated batch overwrites itself."""
    documents = spark.readStream.schema(DOCUMENT).option("multiLine", True).json(source)

    def write(batch: DataFrame, number: int) -> None:
        pages = exploded(batch).where("error is null").select("doc_id", "page_index", "text")
        preprocess(pages).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
