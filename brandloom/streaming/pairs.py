"""Scoring and ranking over a stream of candidate-pair files.

Scoring has no state. The best N of everything seen so far are the best N of
the last best N and the new batch's best N, so each batch only merges N rows
into a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from brandloom.operators.ranking import W_EDIT, W_JW, rank, score_pairs
from brandloom.sources.tables import PAIRS, SCORED


def read_pairs(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(PAIRS).option("maxFilesPerTrigger", files).parquet(folder)


def score_stream(pairs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append scored pairs as Parquet, once each, until the files are read."""
    return score_pairs(pairs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_top(before: DataFrame | None, batch: DataFrame, top: int, w_jw: float = W_JW, w_edit: float = W_EDIT) -> DataFrame:
    """The best of both; a pair that is in both counts once."""
    rows = batch.select("root_a", "root_b", "jw", "edit_sim")
    rows = rows if before is None else rows.unionByName(before.select(*rows.columns))
    return rank(rows.distinct(), top, w_jw, w_edit)


def top_stream(pairs: DataFrame, folder: str, checkpoint: str, top: int = 50) -> StreamingQuery:
    """Keep the best `top` pairs of a stream in folder/batch=N, the last being current.

    A batch that runs again after a failure rewrites its own folder from the
    one before, so nothing counts twice.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(SCORED).parquet(f"{folder}/batch={number - 1}") if number else None
        merge_top(before, score_pairs(batch), top).coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return pairs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
