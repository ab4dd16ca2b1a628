"""Threshold, grouping and lookup operators over metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Limits of the presets.
PRESETS = {
    "balanced": {"file_lines": 800, "directory_files": 40, "loc": 80, "complexity": 15, "nesting_depth": 4, "parameter_count": 5, "type_lines": 250, "type_members": 30, "functions": 40, "density": 12, "small_percent": 70, "literals": 12, "clumps": 4},
    "strict": {"file_lines": 600, "directory_files": 30, "loc": 60, "complexity": 12, "nesting_depth": 3, "parameter_count": 4, "type_lines": 200, "type_members": 25, "functions": 35, "density": 10, "small_percent": 65, "literals": 8, "clumps": 3},
    "relaxed": {"file_lines": 1200, "directory_files": 60, "loc": 120, "complexity": 20, "nesting_depth": 5, "parameter_count": 6, "type_lines": 400, "type_members": 45, "functions": 60, "density": 18, "small_percent": 80, "literals": 20, "clumps": 6},
}
# The rule that each function metric raises.
FUNCTION_RULES = {"loc": "long_function", "complexity": "complex_function", "nesting_depth": "deep_nesting", "parameter_count": "many_parameters"}


def limits(preset: str = "balanced", **explicit: int) -> dict[str, int]:
    """A preset with explicit keys laid over it; unknown keys are an error."""
    unknown = set(explicit) - set(PRESETS["balanced"])
    if preset not in PRESETS or unknown:
        raise ValueError(f"unknown preset or keys: {preset}, {sorted(unknown)}")
    return PRESETS[preset] | explicit


def exceeded(rows: DataFrame, keep: list[str], thresholds: dict[str, tuple[str, int]]) -> DataFrame:
    """One row for each metric strictly above its threshold.

    ``thresholds`` maps a column to (rule, limit). Null metrics exceed nothing.
    """
    checks = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.col(c).cast("bigint").alias("value"), F.lit(limit).cast("bigint").alias("threshold"))
        for c, (rule, limit) in thresholds.items()
    ])
    return rows.select(*keep, F.explode(F.filter(checks, lambda x: x["value"] > x["threshold"])).alias("x")).select(*keep, "x.*")


def either_exceeded(rows: DataFrame, first: tuple[str, int], second: tuple[str, int]) -> DataFrame:
    """Rows where one of two metrics is above its limit; both stay attached."""
    return rows.where((F.col(first[0]) > first[1]) | (F.col(second[0]) > second[1]))


def proliferation(functions: DataFrame, group: list[str], file_lines: Column, limit: dict[str, int]) -> DataFrame:
    """Files with too many, too dense and mostly small functions.

    Density per 100 lines is rounded up, the share of small ones down.
    """
    small = (F.col("loc") <= 5) & (F.col("complexity") <= 1) & (F.col("parameter_count") <= 3)
    stats = functions.groupBy(*group).agg(F.count("*").alias("functions"), F.count_if(small).alias("small"), file_lines.alias("lines"))
    density = F.ceil(F.col("functions") * 100 / F.greatest("lines", F.lit(1))).cast("bigint")
    percent = F.floor(F.col("small") * 100 / F.col("functions")).cast("bigint")
    return stats.withColumns({"density": density, "small_percent": percent}).where(
        (F.col("functions") > limit["functions"]) & (F.col("density") > limit["density"]) & (F.col("small_percent") > limit["small_percent"])
    )


def repeated(occurrences: DataFrame, key: str, least: int, files: int = 1) -> DataFrame:
    """Keys that occur at least ``least`` times in at least ``files`` files.

    Counts come from map-side aggregation; 0 turns the rule off.
    """
    if least == 0:
        return occurrences.select(key, F.lit(0).cast("bigint").alias("occurrences"), F.lit(0).cast("bigint").alias("files")).limit(0)
    return (
        occurrences.groupBy(key)
        .agg(F.count("*").alias("occurrences"), F.countDistinct("file_id").alias("files"))
        .where((F.col("occurrences") >= least) & (F.col("files") >= files))
    )


def naming_drift(files: DataFrame, least_files: int = 4) -> DataFrame:
    """Folders whose file names mix styles; lower case is neutral.

    ``dominant`` is the most frequent style, the last by name on ties; without
    one of at least two files and half of the styled ones all are outliers.
    """
    styled = files.select("folder", T.naming_style(F.col("stem")).alias("style"))
    per = styled.groupBy("folder", "style").agg(F.count("*").alias("n"))
    named = F.col("style") != "lowercase"
    whole = per.groupBy("folder").agg(
        F.sum("n").alias("files"), F.sum(F.when(named, F.col("n"))).alias("styled"), F.count_if(named).alias("styles"),
        F.max(F.when(named, F.struct("n", "style"))).alias("top"),
    )
    clear = (F.col("top.n") >= 2) & (F.col("top.n") * 2 >= F.col("styled"))
    return whole.where((F.col("files") >= least_files) & (F.col("styles") >= 2)).select(
        "folder", "files", "styles", F.when(clear, F.col("top.style")).alias("dominant"),
        F.when(clear, F.col("styled") - F.col("top.n")).otherwise(F.col("styled")).alias("outliers"),
    )


def churn(changes: DataFrame, most: int) -> DataFrame:
    """Commits, lines, authors and weight of each file.

    ``changes``: commit, author, path, added, deleted. Commits whose changes
    in scope exceed ``most`` lines count for nothing.
    """
    size = changes.groupBy("commit").agg(F.sum(F.coalesce("added", F.lit(0)) + F.coalesce("deleted", F.lit(0))).alias("size"))
    kept = changes.join(size.where(F.col("size") <= most).select("commit"), "commit")
    return kept.groupBy("path").agg(
        F.countDistinct("commit").alias("commits"), F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted"),
        F.countDistinct("author").alias("authors"),
    ).withColumn("recent_weighted", F.col("added") + F.col("deleted"))


def innermost(points: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """For each point the span that holds its line and starts last.

    ``points``: key, point_id, line; ``spans``: key, name, line, loc. A span
    covers [line, line + loc). A span belongs to the two neighbouring dyadic
    cells, of the smallest power of two not below its length, that cover it, and
    a point to its cell of every size: the range join is an equi-join on key,
    size and cell, with two rows for a span however long it is.
    """
    s = spans.where("line IS NOT NULL AND loc > 0").select(
        *key, F.col("name"), F.col("line").alias("first"), (F.col("line") + F.col("loc")).alias("end"),
        F.ceil(F.log2(F.col("loc"))).cast("int").alias("size"),
    )
    low = F.expr("shiftright(first, size)")
    s = s.withColumn("cell", F.explode(F.array_distinct(F.array(low, F.expr("shiftright(end - 1, size)")))))
    # only sizes that spans have; at most 63 rows
    sizes = s.groupBy(*key).agg(F.collect_set("size").alias("sizes"))
    p = points.where("line IS NOT NULL").join(sizes, key).withColumn("size", F.explode("sizes")).withColumn("cell", F.expr("shiftright(line, size)")).drop("sizes")
    met = p.join(s, [*key, "size", "cell"]).where((F.col("line") >= F.col("first")) & (F.col("line") < F.col("end")))
    return met.groupBy("point_id").agg(F.max(F.struct("first", "name")).alias("m")).select(
        "point_id", F.col("m.name").alias("symbol"), F.col("m.first").alias("symbol_line")
    )


def ordinal_of_line(rows: DataFrame) -> DataFrame:
    """Ordinal of an equal normalised line up to this one within the file."""
    text = F.regexp_replace(F.trim("text"), "[ \t]+", " ")
    text = F.when(text == "", "empty").otherwise(text)
    w = Window.partitionBy("file_id", "anchor").orderBy("line")
    return rows.select("file_id", "line", text.alias("anchor")).withColumn("ordinal", F.row_number().over(w).cast("bigint"))
