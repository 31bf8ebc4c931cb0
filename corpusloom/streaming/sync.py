"""Incremental upkeep of an index from a stream of chunks.

Each micro-batch writes its rows to a partition of its own, named after the batch, and replaces that partition if it
is run again, so a retried batch leaves no row twice. Readers take the newest row of each key. Compaction folds the
partitions into one table at a new place; nothing is changed where it is being read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def chunk_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """JSON lines of chunks as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def sync_stream(chunks: DataFrame, index_path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Takes up what has arrived and stops; run again with the same checkpoint, it goes on where it stopped.

    Rows without a key are left out. A key that comes twice in a batch counts once, with the greatest row by hash.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        row = F.struct(*[F.col(f"`{c}`") for c in batch.columns])
        once = batch.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.xxhash64(F.to_json(row))).alias("r"))
        once.select("r.*").write.mode("overwrite").parquet(f"{index_path}/batch={batch_id:012d}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, index_path: str, key: str = "id") -> DataFrame:
    """The newest row of each key; older ones are dropped by an aggregation with partial maxima."""
    rows = spark.read.option("mergeSchema", "true").parquet(index_path)
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "batch"])
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, "batch").alias("r")).select("r.*")


def compact(spark: SparkSession, index_path: str, target: str, key: str = "id") -> None:
    """The current rows as one batch of an index at another place, numbered like the newest batch that it holds."""
    newest = spark.read.parquet(index_path).agg(F.max("batch").alias("b")).first()["b"]
    current(spark, index_path, key).write.mode("overwrite").parquet(f"{target}/batch={int(newest):012d}")
