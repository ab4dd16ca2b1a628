from datetime import datetime

from lithoscope.streaming.snapshots import read_changes, stream_changes

EVIDENCE = "array<struct<id: string, rule: string, message: string, measurements: array<struct<name: string, value: double, threshold: double, unit: string>>, locations: array<struct<path: string, line: bigint, symbol: string>>>>"


def test_stream(spark, tmp_path):
    d, i, out = (str(tmp_path / x) for x in ("deliveries", "issues", "out"))
    kind = "delivery_id bigint, repo_id bigint, snapshot_no bigint, delivered_at timestamp"
    at = datetime(2024, 1, 1)
    spark.createDataFrame([(1, 1, 1, at), (2, 1, 2, at)], kind).write.parquet(d)
    spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "b", None), (3, "c", None)], f"delivery_id bigint, issue_id string, evidence {EVIDENCE}").write.parquet(i)

    def run():
        rows = spark.readStream.schema(kind).parquet(d)
        stream_changes(spark, rows, i, d, out, str(tmp_path / "state")).awaitTermination()
        return {(r.repo_id, r.snapshot_no, r.issue_id, r.change) for r in read_changes(spark, out).collect()}

    first = {(1, 2, "a", "removed"), (1, 2, "b", "added")}
    assert run() == first
    spark.createDataFrame([(3, 1, 3, at)], kind).write.mode("append").parquet(d)
    assert run() == first | {(1, 3, "c", "added")}
    # later deliveries of both snapshots with the content of the first: nothing changed after all
    late = datetime(2024, 2, 1)
    spark.createDataFrame([(4, "a", None), (5, "a", None)], f"delivery_id bigint, issue_id string, evidence {EVIDENCE}").write.mode("append").parquet(i)
    spark.createDataFrame([(4, 1, 2, late), (5, 1, 3, late)], kind).write.mode("append").parquet(d)
    assert run() == set()
