"""Keep the live vectors of an index from a stream of inserts and deletions, and recompute truth for every version.

The update log is (seq, op, vec_id, embedding), op being 'insert' or 'delete'.  Each micro-batch writes a new version of the table and
then moves the pointer to it, so that a batch that is run again after a failure writes the same version again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.knn import exact_knn

LOG = "seq bigint, op string, vec_id bigint, embedding array<float>"


def apply_updates(live: DataFrame, updates: DataFrame) -> DataFrame:
    """live(vec_id, embedding) after the last update of each vector."""
    last = Window.partitionBy("vec_id").orderBy(F.col("seq").desc())
    final = updates.withColumn("_r", F.row_number().over(last)).where("_r = 1")
    kept = live.join(final.select("vec_id"), "vec_id", "left_anti").select("vec_id", "embedding")
    return kept.unionByName(final.where("op = 'insert'").select("vec_id", "embedding"))


def version_path(folder: str, version: int) -> str:
    return f"{folder}/version={version}"


def maintain(spark: SparkSession, log: DataFrame, base: DataFrame, folder: str, checkpoint: str, on_version: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start the maintenance of `folder` from a streaming log; version 0 is the base, batch b makes version b + 1."""
    base.select("vec_id", "embedding").write.mode("overwrite").parquet(version_path(folder, 0))

    def step(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(version_path(folder, number))
        apply_updates(before, batch).write.mode("overwrite").parquet(version_path(folder, number + 1))
        if on_version:
            on_version(spark.read.parquet(version_path(folder, number + 1)), number + 1)

    return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def truth_of(queries: DataFrame, k: int, out: str) -> Callable[[DataFrame, int], None]:
    """A callback that writes the exact neighbours of each version."""

    def write(live: DataFrame, version: int) -> None:
        exact_knn(live, queries, k).write.mode("overwrite").parquet(f"{out}/version={version}")

    return write
