"""Detections -> evidence -> issues -> report, suppression and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_id

# Rank of a coverage status.
STATUS_RANK = {"observed": 3, "partial": 2, "not_applicable": 1, "unsupported": 0}


def evidence(detections: DataFrame, namespace: str = "lithoscope") -> DataFrame:
    """Adds the ids of evidence and issue.

    ``detections``: rule, family, path, symbol, line, value, threshold, anchor.
    Prose, numbers and order never enter an id.
    """
    subject = F.concat_ws("#", "path", "symbol")
    return detections.withColumns(
        {
            "evidence_id": stable_id("re6-", F.lit(namespace), F.col("rule"), F.col("anchor")),
            "issue_id": stable_id("ri6-", F.lit(namespace), F.col("family"), subject),
        }
    )


def issues(rows: DataFrame) -> DataFrame:
    """One issue for each (family, subject) with its evidence, ordered by id.

    Evidence that repeats by (rule, anchor) is kept once, the one that sorts
    last by path, line and value.
    """
    once = rows.groupBy("issue_id", "family", "rule", "anchor").agg(F.max(F.struct("path", "line", "value", "symbol", "threshold", "evidence_id")).alias("e"))
    return once.groupBy("issue_id", "family").agg(
        F.min("e.path").alias("path"),
        F.array_sort(F.collect_list(F.struct("e.evidence_id", "rule", "e.line", "e.value", "e.threshold"))).alias("evidence"),
    )


def suppress(rows: DataFrame, suppressions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, counts of the suppressed by rule).

    A suppression names a path, a rule or null for any, and a scope: ``file``,
    ``line`` (that line) or ``next`` (the line below it).
    """
    s = suppressions.select(F.col("path").alias("s_path"), F.col("rule").alias("s_rule"), "scope", F.col("line").alias("s_line"))
    tagged = rows.withColumn("__row", F.struct(*rows.columns))
    met = (
        (F.col("path") == F.col("s_path"))
        & (F.col("s_rule").isNull() | (F.col("rule") == F.col("s_rule")))
        & ((F.col("scope") == "file") | ((F.col("scope") == "line") & (F.col("line") == F.col("s_line"))) | ((F.col("scope") == "next") & (F.col("line") == F.col("s_line") + 1)))
    )
    kept = tagged.join(s, met, "left_anti").drop("__row")
    dropped = tagged.join(s, met, "left_semi").groupBy("rule").agg(F.count("*").alias("suppressed"))
    return kept, dropped


def baseline_counts(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """``status`` (new, resolved, unchanged) and ``n`` between two issue sets."""
    a = after.select(*keys).distinct().withColumn("in_after", F.lit(True))
    b = before.select(*keys).distinct().withColumn("in_before", F.lit(True))
    joined = a.join(b, keys, "full_outer")
    status = F.when(F.col("in_before").isNull(), "new").when(F.col("in_after").isNull(), "resolved").otherwise("unchanged")
    return joined.select(*keys, status.alias("status"))


def rank(status: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv])
    return F.try_element_at(pairs, status)


def regressions(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose coverage status fell, or that are gone."""
    b = before.select(*keys, F.col("status").alias("before"))
    a = after.select(*keys, F.col("status").alias("after"))
    return b.join(a, keys, "left").where(F.col("after").isNull() | (rank(F.col("after")) < rank(F.col("before"))))


def coverage(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """``language, files, failures, status`` of the scanned files.

    ``parsed``: file_id, failed. Without a parse result a language is
    unsupported; with failures it is partial.
    """
    joined = files.select("file_id", "language").join(parsed.select("file_id", "failed"), "file_id", "left")
    stats = joined.groupBy("language").agg(F.count("*").alias("files"), F.count("failed").alias("parsed"), F.count_if("failed").alias("failures"))
    status = F.when(F.col("parsed") == 0, "unsupported").when((F.col("failures") > 0) | (F.col("parsed") < F.col("files")), "partial").otherwise("observed")
    return stats.select("language", "files", "failures", status.alias("status"))


def integrity_errors(report: DataFrame) -> DataFrame:
    """Issues that break the contract: repeated ids, no evidence, evidence owned twice."""
    empty = report.where(F.coalesce(F.size("evidence"), F.lit(0)) <= 0).select("issue_id", F.lit("no_evidence").alias("error"))
    twice = report.groupBy("issue_id").agg(F.count("*").alias("n")).where("n > 1").select("issue_id", F.lit("repeated_id").alias("error"))
    owned = report.select("issue_id", F.explode("evidence.evidence_id").alias("e")).distinct()
    shared = owned.groupBy("e").agg(F.count("*").alias("n"), F.min("issue_id").alias("issue_id")).where("n > 1").select("issue_id", F.lit("shared_evidence").alias("error"))
    return empty.unionByName(twice).unionByName(shared.distinct())
