"""Structured Streaming: the inbox of new documents and usage in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..sources.files import Files
from ..sources.readers import RAW


def watch_inbox(spark: SparkSession, folder: str, store: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Adds each new delivery of a folder of parquet files to a store. A delivery whose key or content is known already is
    left out; the checkpoint and a batch column make a repeated batch harmless."""

    def add(batch: DataFrame, number: int) -> None:
        new = batch.select("*", T.content_hash(T.collapse(F.col("markdown"))).alias("hash")).where(T.word_count(F.col("markdown")) >= 5)
        new = new.dropDuplicates(["source", "source_id"]).dropDuplicates(["hash"])
        if Files(spark, store).exists():
            known = spark.read.parquet(store).where(F.col("batch") != number)
            new = new.join(known.select("source", "source_id"), ["source", "source_id"], "left_anti").join(known.select("hash"), "hash", "left_anti")
        new.select("source", "source_id", "category", "markdown", "hash").write.mode("overwrite").parquet(f"{store}/batch={number}")

    stream = spark.readStream.schema(RAW).parquet(folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="30 seconds")).start()


def usage_windows(events: DataFrame, late: str = "2 hours", length: str = "1 hour") -> DataFrame:
    """Counts and sums by user in windows of event time, final once the watermark has passed them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def land_scores(scores: DataFrame, store: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Scores (judgment_id, doc_no, score, note) as they arrive: those that stand are kept, a document gets a score only
    once, and what landed before a stop stays. A batch that runs again writes the same rows to the same place."""

    def land(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = batch.where("score is not null").groupBy("judgment_id", "doc_no").agg(F.min(F.struct("score", "note")).alias("f")).select("judgment_id", "doc_no", "f.score", "f.note")
        if Files(spark, store).exists():
            known = spark.read.parquet(store).where(F.col("batch") != number).select("judgment_id", "doc_no")
            first = first.join(known, ["judgment_id", "doc_no"], "left_anti")
        first.write.mode("overwrite").parquet(f"{store}/batch={number}")

    stream = scores.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="10 seconds")).start()
