"""Value-flow operators over call edges: relays, fan-out, bypasses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def simple_paths(edges: DataFrame, sources: DataFrame, most_hops: int) -> DataFrame:
    """``path`` arrays of simple paths from ``sources``, of 1..``most_hops`` edges.

    Breadth-first by equi-joins; a round is written before the next one.
    """
    e = edges.select("src", "dst").where("src <> dst").distinct()
    front = sources.select(F.array("node").alias("path"), F.col("node").alias("at"))
    found = None
    for _ in range(most_hops):
        front = (
            front.join(e, front["at"] == e["src"])
            .where(~F.array_contains("path", F.col("dst")))
            .select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
        )
        front = written(front, "paths")
        found = front if found is None else found.union(front)
    return found.select("path", (F.size("path") - 1).cast("bigint").alias("hops"))


def truncated(edges: DataFrame, sources: DataFrame, most_hops: int, probe: int = 16) -> DataFrame:
    """``node`` of sources from which a simple path of ``most_hops`` edges could go on.

    Only nodes with a walk of the missing length ahead are followed. Up to
    ``probe`` paths of a source in a round settle most sources; a path found is
    proof, so only sources without one are searched in full.
    """
    e = written(edges.select("src", "dst").where("src <> dst").distinct(), "flow-edges")
    ahead = [written(e.select(F.col("src").alias("node")).distinct(), "ahead")]  # [k]: nodes with a walk of k + 1 edges
    for _ in range(most_hops):
        further = e.join(ahead[-1].withColumnRenamed("node", "dst"), "dst", "left_semi")
        ahead.append(written(further.select(F.col("src").alias("node")).distinct(), "ahead"))

    def search(start: DataFrame, most: int | None) -> DataFrame:
        front = start.select(F.array("node").alias("path"), F.col("node").alias("at"))
        for k in range(most_hops):
            front = (
                front.join(e, front["at"] == e["src"])
                .where(~F.array_contains("path", F.col("dst")))
                .join(ahead[most_hops - 1 - k].withColumnRenamed("node", "dst"), "dst", "left_semi")
                .select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
            )
            if most:
                order = Window.partitionBy(F.get("path", F.lit(0))).orderBy(F.xxhash64("path"), "path")
                front = front.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")
            front = written(front, "probe")
            if front.isEmpty():
                break
        return front.select(F.get("path", F.lit(0)).alias("node")).distinct()

    near = written(sources.join(ahead[most_hops], "node", "left_semi").select("node").distinct(), "near")
    if near.isEmpty():
        return near
    proven = written(search(near, probe), "truncated")
    rest = near.join(proven, "node", "left_anti")
    return proven if rest.isEmpty() else proven.union(search(rest, None))


def reached(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``source, node``: all nodes that calls from each source lead to, at any distance."""
    e = written(edges.select("src", "dst").where("src <> dst").distinct(), "flow-edges")
    front = sources.select(F.col("node").alias("source"), "node").distinct()
    found = None
    while True:
        front = front.join(e, front["node"] == e["src"]).select("source", F.col("dst").alias("node")).distinct()
        if found is not None:
            front = front.join(found, ["source", "node"], "left_anti")
        front = written(front, "reached")
        if front.isEmpty():
            return front if found is None else found
        found = front if found is None else found.union(front)


def relays(paths: DataFrame, modules: DataFrame, least_hops: int, least_modules: int) -> DataFrame:
    """The longest relay of each source that meets both minima (inclusive).

    Ties go to more module changes, then to the last path by order.
    """
    steps = paths.withColumn("key", F.xxhash64("path")).select("key", "path", "hops", F.posexplode("path").alias("at", "node"))
    named = steps.join(modules, "node").groupBy("key", "path", "hops").agg(F.array_sort(F.collect_list(F.struct("at", "module"))).alias("m"))
    changes = F.aggregate(
        F.sequence(F.lit(1), F.size("m") - 1), F.lit(0).cast("bigint"),
        lambda s, i: s + (F.get("m", i)["module"] != F.get("m", i - 1)["module"]).cast("bigint"),
    )
    rated = named.withColumn("module_hops", changes).where((F.col("hops") >= least_hops) & (F.col("module_hops") >= least_modules))
    best = rated.groupBy(F.get("path", F.lit(0)).alias("source")).agg(F.max(F.struct("hops", "module_hops", "path")).alias("b"))
    return best.select("source", "b.hops", "b.module_hops", F.array_join("b.path", ">").alias("witness"))


def fan_out(paths: DataFrame, sinks: DataFrame, modules: DataFrame, least_sinks: int, least_modules: int) -> DataFrame:
    """Sources that reach many sinks in many modules, by paths."""
    ends = paths.select(F.get("path", F.lit(0)).alias("source"), F.element_at("path", -1).alias("node")).distinct()
    return reached_fan_out(ends, sinks, modules, least_sinks, least_modules)


def reached_fan_out(ends: DataFrame, sinks: DataFrame, modules: DataFrame, least_sinks: int, least_modules: int) -> DataFrame:
    """The same by distinct pairs ``source, node``."""
    met = ends.join(sinks.select("node"), "node").join(modules, "node")
    return met.groupBy("source").agg(F.countDistinct("node").alias("sinks"), F.countDistinct("module").alias("modules")).where(
        (F.col("sinks") >= least_sinks) & (F.col("modules") >= least_modules)
    )


def bypasses(paths: DataFrame, protected: DataFrame, sinks: DataFrame, adapters: DataFrame) -> DataFrame:
    """Protected sources whose shortest path to a sink touches no adapter."""
    pairs = paths.select(F.get("path", F.lit(0)).alias("source"), F.element_at("path", -1).alias("sink"), "path", "hops")
    pairs = pairs.join(protected.select(F.col("node").alias("source")), "source").join(sinks.select(F.col("node").alias("sink")), "sink")
    short = pairs.groupBy("source", "sink").agg(F.min(F.struct("hops", "path")).alias("s")).select("source", "sink", "s.hops", "s.path")
    touched = short.select("source", "sink", F.explode("path").alias("node")).join(adapters.select("node"), "node").select("source", "sink").distinct()
    return short.join(touched, ["source", "sink"], "left_anti").select("source", "sink", "hops", F.array_join("path", ">").alias("witness"))
