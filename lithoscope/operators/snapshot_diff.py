"""Differences between consecutive full snapshots of a keyed table.

The content of every row is reduced to a canonical digest inside the JVM, so
only ``(group, ordinal, key, digest)`` is shuffled. Each snapshot takes part
twice: as the later side at its own ordinal and as the earlier side at the next
one. Both sides are range-partitioned by ``(group, ordinal, key)`` and sorted;
a two-pointer merge streams over every range and emits typed changes. All rows
of one key fall into one range, however many rows the group has, so a group
that holds a third of the table is spread over many ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package


def canonical(column: Column, kind: T.DataType) -> Column:
    """``column`` with every list inside it sorted; repeats are kept."""
    if isinstance(kind, T.ArrayType):
        if _has_list(kind.elementType):
            column = F.transform(column, lambda e: canonical(e, kind.elementType))
        return F.sort_array(column)
    if isinstance(kind, T.StructType) and _has_list(kind):
        whole = F.struct(*[canonical(column[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(column.isNotNull(), whole)
    return column


def _has_list(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_list(f.dataType) for f in kind.fields)
    return isinstance(kind, T.ArrayType)


def content_digest(column: Column, kind: T.DataType) -> Column:
    """128-bit digest of a value, blind to list order; null equals empty."""
    body = F.to_json(F.struct(canonical(column, kind).alias("v")))
    if isinstance(kind, T.ArrayType):
        body = F.when(column.isNull() | (F.size(column) == 0), F.lit("{}")).otherwise(body)
    return F.unhex(F.md5(body))


def latest_deliveries(deliveries: DataFrame) -> DataFrame:
    """One row per snapshot: its last delivery and its ordinal in the group.

    Ties of ``delivered_at`` go to the larger ``delivery_id``. Rows without a
    repository or number name no snapshot and are left out.
    """
    key = ["repo_id", "snapshot_no"]
    last = (
        deliveries.where(F.col("repo_id").isNotNull() & F.col("snapshot_no").isNotNull())
        .groupBy(*key)
        .agg(F.max(F.struct("delivered_at", "delivery_id"))["delivery_id"].alias("delivery_id"))
    )
    # collected numbers per repository are bounded by its count of snapshots
    numbers = (
        last.groupBy("repo_id")
        .agg(F.sort_array(F.collect_list("snapshot_no")).alias("nos"))
        .select("repo_id", F.posexplode("nos").alias("ordinal", "snapshot_no"), F.size("nos").alias("n"), "nos")
        .select(
            "repo_id", "snapshot_no", F.col("ordinal").cast("int").alias("ordinal"),
            F.get("nos", F.col("ordinal") + 1).alias("next_no"),
        )
    )
    return last.join(numbers, key)


def merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two-pointer merge over rows sorted by (repo_id, later_no, issue_id, side)."""
    names = ["repo_id", "snapshot_no", "issue_id", "change"]
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        n = table.num_rows
        if n < 2:
            held = table
            continue
        table = table.combine_chunks()
        # the last row may still meet its partner in the next batch
        same, later, digests = _neighbours(table)
        cut = n if n >= 2 and same[n - 2] else n - 1
        yield from _emit(table, same, later, digests, cut, names)
        held = table.slice(cut)
    if held is not None and held.num_rows:
        table = held.combine_chunks()
        same, later, digests = _neighbours(table)
        yield from _emit(table, same, later, digests, table.num_rows, names)


def _neighbours(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = table.num_rows
    repo = table["repo_id"].to_numpy()
    number = table["snapshot_no"].to_numpy()
    issue = np.array(table["issue_id"].to_pylist(), dtype=object)
    later = table["later"].to_numpy()
    digests = np.array(table["digest"].to_pylist(), dtype=object)
    same = np.zeros(n, dtype=bool)
    if n > 1:
        same[:-1] = (repo[1:] == repo[:-1]) & (number[1:] == number[:-1]) & (issue[1:] == issue[:-1])
    return same, later, digests


def _emit(table, same, later, digests, cut, names) -> Iterator[pa.RecordBatch]:
    n = table.num_rows
    second = np.r_[False, same[:-1]]  # the later side of a pair
    change = np.empty(n, dtype=object)
    alone = ~same & ~second
    change[alone & later] = "added"
    change[alone & ~later] = "removed"
    pair = np.flatnonzero(same)
    differs = digests[pair] != digests[pair + 1] if len(pair) else np.zeros(0, bool)
    change[pair[differs.astype(bool)]] = "changed"
    keep = np.flatnonzero(np.array([c is not None for c in change[:cut]]))
    if len(keep):
        out = table.select(names[:3]).take(pa.array(keep))
        yield from out.append_column("change", pa.array(change[keep].tolist(), pa.string())).to_batches()


def snapshot_changes(issues: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Added, removed and changed issues between neighbouring snapshots.

    Result: ``repo_id, snapshot_no`` (the later one), ``issue_id, change``. A
    snapshot's content is that of its last delivery alone and may be empty; the
    first snapshot of a repository yields nothing. Repeated rows, list order,
    null against empty evidence and all other columns don't count; differing
    rows of one issue inside a delivery are compared as a set. A null issue_id
    is an identity of its own. Issues of unknown deliveries belong to no
    snapshot. Empty inputs give an empty result.
    """
    ship_package(issues.sparkSession)
    kind = issues.schema["evidence"].dataType
    rows = issues.select("delivery_id", "issue_id", content_digest(F.col("evidence"), kind).alias("digest"))
    content = (
        rows.join(latest_deliveries(deliveries), "delivery_id")
        .groupBy("repo_id", "ordinal", "snapshot_no", "next_no", "issue_id")
        .agg(F.collect_set("digest").alias("digests"))
        .select(
            "repo_id", "ordinal", "snapshot_no", "next_no", "issue_id",
            F.array_join(F.sort_array(F.transform("digests", F.hex)), "").alias("digest"),
        )
    )
    sides = content.select(
        "repo_id", "issue_id", "digest",
        F.explode(
            F.array(
                F.struct(F.when(F.col("ordinal") > 0, F.col("snapshot_no")).alias("no"), F.lit(True).alias("later")),
                F.struct(F.col("next_no").alias("no"), F.lit(False).alias("later")),
            )
        ).alias("side"),
    ).select("repo_id", F.col("side.no").alias("snapshot_no"), "issue_id", F.col("side.later").alias("later"), "digest")
    key = ["repo_id", "snapshot_no", "issue_id"]
    return (
        sides.where(F.col("snapshot_no").isNotNull())
        .repartitionByRange(*key)
        .sortWithinPartitions(*key, "later")
        .mapInArrow(merge_sorted, "repo_id bigint, snapshot_no bigint, issue_id string, change string")
    )
