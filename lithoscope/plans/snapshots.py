"""Queries over issue snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.snapshot_diff import snapshot_changes
from ..session import read_table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(read_table(spark, sf_dir, "issue_snapshots"), read_table(spark, sf_dir, "snapshot_deliveries"))


def p2_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_found(spark, sf_dir).groupBy("repo_id", "change").agg(F.count("*").alias("n"))


_FOUND = """
WITH last AS (
  SELECT repo_id, snapshot_no, delivery_id FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, snapshot_no
      ORDER BY delivered_at DESC, delivery_id DESC) rn FROM snapshot_deliveries) WHERE rn = 1),
snaps AS (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY snapshot_no) o FROM last),
content AS (
  SELECT s.repo_id, s.snapshot_no, s.o, i.issue_id,
    list_sort(list(DISTINCT CASE WHEN coalesce(len(i.evidence), 0) = 0 THEN '' ELSE
      list_sort(list_transform(i.evidence, lambda e: struct_pack(id := e.id, rule := e.rule, message := e.message,
        m := list_sort(e.measurements), l := list_sort(e.locations))))::VARCHAR END)) c
  FROM issue_snapshots i JOIN snaps s USING (delivery_id) GROUP BY 1, 2, 3, 4),
later AS (SELECT c.*, p.snapshot_no prev FROM content c JOIN snaps p ON p.repo_id = c.repo_id AND p.o = c.o - 1),
earlier AS (SELECT c.repo_id, c.issue_id, c.c, n.snapshot_no FROM content c
  JOIN snaps n ON n.repo_id = c.repo_id AND n.o = c.o + 1),
found AS (
  SELECT coalesce(a.repo_id, b.repo_id) repo_id, coalesce(a.snapshot_no, b.snapshot_no) snapshot_no,
    coalesce(a.issue_id, b.issue_id) issue_id,
    CASE WHEN b.repo_id IS NULL THEN 'added' WHEN a.repo_id IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM later a FULL OUTER JOIN earlier b
    ON a.repo_id = b.repo_id AND a.snapshot_no = b.snapshot_no AND a.issue_id = b.issue_id
  WHERE a.c IS DISTINCT FROM b.c OR a.repo_id IS NULL OR b.repo_id IS NULL)
"""

QUERIES = {"p2_found": p2_found, "p2_change_counts": p2_change_counts}
SQL = {
    "p2_found": _FOUND + "SELECT repo_id, snapshot_no, issue_id, change FROM found",
    "p2_change_counts": _FOUND + "SELECT repo_id, change, count(*) n FROM found GROUP BY 1, 2",
}
