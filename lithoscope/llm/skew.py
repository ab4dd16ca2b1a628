"""Joins in which no key of many rows meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: most hot keys that are broadcast; more of them are joined with salt
BROADCAST_ROWS, SALTS = 500_000, 16


def hot_rows(rows: DataFrame, hot: DataFrame, on: list[str], salt: str) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` without the keys of ``hot``, and those with them joined to it.

    ``hot`` is a written table of one row for each key of many rows. It is
    broadcast up to BROADCAST_ROWS keys; beyond, both sides are salted by a hash
    of the column ``salt``. Without hot keys the second part is None.
    """
    amount = hot.count()
    if amount == 0:
        return rows, None
    if amount <= BROADCAST_ROWS:
        return rows.join(F.broadcast(hot.select(*on)), on, "left_anti"), rows.join(F.broadcast(hot), on)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
    wide = hot.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    both = [*on, "__salt"]
    return salted.join(wide.select(*both), both, "left_anti").drop("__salt"), salted.join(wide, both).drop("__salt")


def hot_join(rows: DataFrame, keyed: DataFrame, on: list[str], salt: str, size: str, most: int) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row for each key.

    Keys whose ``size`` exceeds ``most``, at most one for every ``most`` rows,
    don't bring their rows together.
    """
    hot = written(keyed.where(F.col(size) > most), "hot-keys")
    cold, split = hot_rows(rows, hot, on, salt)
    joined = cold.join(keyed.where(F.col(size) <= most), on)
    return joined if split is None else joined.unionByName(split)
