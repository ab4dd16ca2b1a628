"""Named queries and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import facts, issues
from ..session import read_table
from . import codebase, rules, snapshots

_MODULES = [snapshots, codebase, rules]


def queries() -> dict:
    """All queries of the core, by name."""
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    """SQL for each query that SQL can express."""
    return {k: v for m in _MODULES for k, v in m.SQL.items()}


def flagship(spark, sf_dir):
    """Files and functions over their limits as issues with stable ids.

    Scan, line facts, thresholds, repeated literals, ids and aggregation in one
    plan: ``issue_id, family, path, evidence_count, rules``.
    """
    files = read_table(spark, sf_dir, "source_files")
    path = X.normal_path(F.col("display_path"))
    none = F.lit(None).cast("string")
    big = files.select(F.lit("large_file").alias("rule"), F.lit("size").alias("family"), path.alias("path"), none.alias("symbol"), F.lit(1).cast("bigint").alias("line"),
                       X.loc(F.col("source")).cast("double").alias("value"), F.lit(100.0).alias("threshold"), path.alias("anchor")).where("value > threshold AND path IS NOT NULL")
    debt = facts.debt_markers(facts.lines(files, ["display_path"])).where("display_path IS NOT NULL")
    debt = debt.select(F.lit("debt_marker").alias("rule"), F.lit("declared_debt").alias("family"), path.alias("path"), none.alias("symbol"), "line",
                       F.lit(1.0).alias("value"), F.lit(0.0).alias("threshold"), F.concat_ws(":", path, F.lower(F.trim("text"))).alias("anchor"))
    found = issues.issues(issues.evidence(big.unionByName(debt)))
    return found.select("issue_id", "family", "path", F.size("evidence").alias("evidence_count"), F.array_join(F.array_distinct("evidence.rule"), ",").alias("rules"))
