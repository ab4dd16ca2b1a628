"""Change events from a stream of snapshot deliveries.

Micro-batches of deliveries trigger a recomputation of the snapshots they
touch. The changes of a repository are replaced as a whole: its partition holds
a row without issue as well, so that one without changes is replaced, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.snapshot_diff import snapshot_changes


def stream_changes(spark: SparkSession, deliveries: DataFrame, issues_path: str, deliveries_path: str, out: str, checkpoint: str) -> StreamingQuery:
    """``out`` is partitioned by repo; a batch rewrites only repositories in it.

    Read it with :func:`read_changes`.
    """

    def batch(rows: DataFrame, _: int) -> None:
        touched = rows.select("repo_id").distinct()
        known = spark.read.parquet(deliveries_path).join(touched, "repo_id", "left_semi")
        content = spark.read.parquet(issues_path).join(known.select("delivery_id").distinct(), "delivery_id", "left_semi")
        changes = snapshot_changes(content, known)
        mark = touched.select(*[(F.col("repo_id") if c == "repo_id" else F.lit(None)).cast(changes.schema[c].dataType).alias(c) for c in changes.columns])
        changes.unionByName(mark).withColumn("repo", F.col("repo_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(out)

    return deliveries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_changes(spark: SparkSession, out: str) -> DataFrame:
    """The changes written so far, one row each."""
    return spark.read.parquet(out).where("issue_id IS NOT NULL").drop("repo")
