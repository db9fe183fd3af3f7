"""Pages that arrive as a stream: the latest state of every address, kept up to date without state in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from siftlake.functions.text import collapse
from siftlake.functions.urls import canonical_url


def page_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet files of pages as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def states(rows: DataFrame) -> DataFrame:
    """run_id, key, last_fetch, page_id, digest: the latest state of each address and run among the rows, aggregated before it is shuffled."""
    r = rows.select("run_id", "fetched_at", "page_id", canonical_url(F.coalesce("url", "final_url")).alias("key"), F.xxhash64(collapse(F.col("text"))).alias("d"))
    last = F.max(F.struct("fetched_at", "page_id", "d")).alias("s")
    return r.where("key is not null").groupBy("run_id", "key").agg(last).select("run_id", "key", F.col("s.fetched_at").alias("last_fetch"), F.col("s.page_id").alias("page_id"), F.col("s.d").alias("digest"))


def keep_states(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes the states of each micro-batch to a log in the folder, until what is there has been read.

    A batch has a folder of its own, which is written anew if the batch is repeated, so each row counts once. The stream
    keeps no state: late rows of any age are merged when the log is read.
    """
    write = lambda batch, i: states(batch).write.mode("overwrite").parquet(f"{folder}/batch={i}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_states(spark: SparkSession, folder: str) -> DataFrame:
    """run_id, key, last_fetch, page_id, digest: the log's latest state of each address and run."""
    last = F.max(F.struct("last_fetch", "page_id", "digest")).alias("s")
    return spark.read.parquet(folder).groupBy("run_id", "key").agg(last).select("run_id", "key", "s.last_fetch", "s.page_id", "s.digest")
