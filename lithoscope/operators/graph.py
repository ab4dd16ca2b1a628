"""Graph operators over edge tables ``(src, dst)``.

Iterations exchange only labels; each round is written to the shared folder,
and nothing but a count comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import nearest_rank
from ..session import written


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, fan_in, fan_out, degree`` of all nodes, zero degrees included."""
    e = edges.distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    every = ends.union(nodes.select("node", F.lit(0), F.lit(0)))
    return every.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out")).withColumn("degree", F.col("fan_in") + F.col("fan_out"))


def hubs(nodes: DataFrame, edges: DataFrame, least_nodes: int = 8, least_degree: int = 6) -> DataFrame:
    """Nodes with a degree of at least ``least_degree`` and twice the nearest-rank p75."""
    d = degrees(nodes, edges)
    # the histogram of degrees, not the degrees, is gathered
    spread = d.groupBy("degree").agg(F.count("*").alias("n")).orderBy("degree")
    base = spread.agg(F.array_sort(F.collect_list(F.struct("degree", "n"))).alias("h"), F.sum("n").alias("total"))
    at = F.ceil((F.col("total") - 1) * 0.75)
    p75 = F.aggregate(
        "h", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(-1).cast("bigint").alias("v")),
        lambda s, x: F.struct(
            (s["seen"] + x["n"]).alias("seen"), F.when((s["v"] < 0) & (s["seen"] + x["n"] > at), x["degree"]).otherwise(s["v"]).cast("bigint").alias("v")
        ),
    )["v"]
    least = base.select(F.greatest(F.lit(1), p75 * 2).cast("bigint").alias("least"), "total")
    return (
        d.crossJoin(F.broadcast(least))  # a single row
        .where((F.col("total") >= least_nodes) & (F.col("degree") >= least_degree) & (F.col("degree") >= F.col("least")))
        .select("node", "fan_in", "fan_out", "degree")
    )


def reach(edges: DataFrame, forward: bool = True) -> DataFrame:
    """``node, reached``: transitive pairs without the node itself, by doubling.

    Closure grows quadratically by nature: meant for module graphs, whose
    number of nodes doesn't follow the data. The rounds end when nothing is new.
    """
    e = edges.select("src", "dst") if forward else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    pairs = written(e.distinct(), "reach")
    n = pairs.count()
    while True:
        longer = pairs.join(pairs.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        pairs = written(pairs.union(longer).distinct(), "reach")
        m = pairs.count()
        if m == n:
            break
        n = m
    return pairs.select(F.col("src").alias("node"), F.col("dst").alias("reached")).where("node <> reached")


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: strongly connected components of size > 1.

    Forward-backward colouring: nodes take the smallest id that reaches them;
    within a colour, those that reach the colour's root are its component. They
    leave the graph and the rest goes on; nodes without an edge in or out are
    trimmed first.
    """
    left = written(edges.where("src <> dst").distinct(), "scc-edges")
    found = None
    while True:
        while True:  # trim
            n = left.count()
            left = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(
                left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"
            ).select("src", "dst")
            left = written(left, "scc-edges")
            if left.count() == n:
                break
        if n == 0:
            break
        color = written(left.select(F.col("src").alias("node")).distinct().withColumn("color", F.col("node")), "scc-color")
        while True:
            seen = left.join(color.withColumnRenamed("node", "src"), "src").groupBy("dst").agg(F.min("color").alias("near"))
            nxt = written(
                color.join(seen.withColumnRenamed("dst", "node"), "node", "left").select("node", F.least("color", F.coalesce("near", "color")).alias("color"), F.col("color").alias("was")),
                "scc-color",
            )
            color = nxt.select("node", "color")
            if nxt.where("color <> was").limit(1).count() == 0:
                break
        c = color
        inside = written(
            left.join(c.withColumnsRenamed({"node": "src", "color": "a"}), "src").join(c.withColumnsRenamed({"node": "dst", "color": "b"}), "dst").where("a = b").select("src", "dst", "a"),
            "scc-inside",
        )
        back = written(c.where("node = color").select("node", "color"), "scc-back")
        n = -1
        while True:
            more = inside.join(back.select(F.col("node").alias("dst"), F.col("color").alias("a")), ["dst", "a"]).select(F.col("src").alias("node"), F.col("a").alias("color"))
            back = written(back.union(more).distinct(), "scc-back")
            m = back.count()
            if m == n:
                break
            n = m
        found = back if found is None else found.union(back)
        gone = back.select("node")
        left = written(
            left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"),
            "scc-edges",
        )
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    size = found.groupBy("color").agg(F.count("*").alias("n")).where("n > 1")
    return found.join(size, "color").select("node", F.col("color").alias("component"))


def cycle_density(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``component, nodes, edges, density``: edges inside, as an integer percent."""
    e = edges.where("src <> dst").distinct()
    inner = (
        e.join(members.withColumnsRenamed({"node": "src", "component": "a"}), "src").join(members.withColumnsRenamed({"node": "dst", "component": "b"}), "dst").where("a = b")
        .groupBy(F.col("a").alias("component")).agg(F.count("*").alias("edges"))
    )
    size = members.groupBy("component").agg(F.count("*").alias("nodes"))
    whole = F.col("nodes") * (F.col("nodes") - 1)
    return size.join(inner, "component").withColumn("density", F.floor((F.col("edges") * 200 + whole) / (whole * 2)).cast("bigint"))


def depth(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``component, depth``: longest path in the condensation, in edges.

    Nodes outside any component stand for themselves. The condensation has no
    cycle, so the rounds end after the longest path.
    """
    e = edges.where("src <> dst").distinct()
    m = members
    name = lambda df, c: df.join(m.withColumnsRenamed({"node": c, "component": f"{c}_c"}), c, "left").withColumn(c, F.coalesce(f"{c}_c", c)).drop(f"{c}_c")
    dag = written(name(name(e, "src"), "dst").where("src <> dst").select("src", "dst").distinct(), "dag")
    nodes = dag.select(F.col("src").alias("component")).union(dag.select("dst")).distinct()
    level = written(nodes.withColumn("depth", F.lit(0).cast("bigint")), "depth")
    while True:
        up = dag.join(level.withColumnRenamed("component", "dst"), "dst").groupBy(F.col("src").alias("component")).agg((F.max("depth") + 1).alias("up"))
        nxt = written(level.join(up, "component", "left").select("component", F.greatest("depth", F.coalesce("up", F.lit(0))).alias("depth"), F.col("depth").alias("was")), "depth")
        level = nxt.select("component", "depth")
        if nxt.where("depth <> was").limit(1).count() == 0:
            break
    return level


__all__ = ["components", "cycle_density", "degrees", "depth", "hubs", "nearest_rank", "reach"]
