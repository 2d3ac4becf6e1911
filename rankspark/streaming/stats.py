"""Collection statistics kept up to date from a stream of documents, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rankspark.functions.text import index_tokens


def document_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def term_statistics_stream(docs: DataFrame, sink: str, checkpoint: str, doc_id: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Append per micro-batch ``term, tf, df, batch`` to ``sink``; each batch is written to its own folder, so that a
    batch that is run again replaces itself. A document counts once per batch it comes in."""

    def add(batch: DataFrame, n: int) -> None:
        words = batch.dropDuplicates([doc_id]).select(doc_id, F.explode(index_tokens(F.col(text))).alias("term"))
        per_doc = words.groupBy(doc_id, "term").agg(F.count(F.lit(1)).alias("tf"))
        per_doc.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_term_statistics(spark: SparkSession, sink: str) -> DataFrame:
    """``term, tf, df`` summed over all batches."""
    return spark.read.schema("term string, tf bigint, df bigint, batch bigint").parquet(sink).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", ts: str = "ts", key: str = "event_type") -> DataFrame:
    """``window_start, key, n`` in tumbling windows; rows later than ``late`` are let go when streaming."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
