import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lithoscope.llm import quantiles as Q
from lithoscope.llm import queries

SHARES = {"p10": 0.1, "p50": 0.5, "p99": 0.99}


def rank_error(values, v, share):
    values = np.sort(values)
    r = max(1, int(np.ceil(share * len(values))))
    low, high = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
    return max(0, low + 1 - r, r - high) / len(values)


@pytest.mark.parametrize("kind", ["random", "sorted", "ties", "tail"])
def test_bound_of_merged_summaries(kind):
    rng = np.random.default_rng(1)
    n = 600_000
    x = {"random": rng.normal(size=n), "sorted": np.arange(n, dtype=float), "ties": rng.integers(0, 5, n).astype(float), "tail": rng.pareto(0.5, n)}[kind]
    whole = Q.Summary()
    for part in np.array_split(x, 7):
        s = Q.Summary()
        for block in np.array_split(part, 5):
            s.add(block)
        for level, n_, err, buffer in s.rows():
            whole.combine(level, n_, err, buffer)
    assert whole.n == n and whole.err / n < 0.005
    slack = (whole.err + Q.FAN ** max(whole.levels)) / n
    for share, v in zip(SHARES.values(), whole.at(list(SHARES.values()))):
        assert rank_error(x, v, share) <= slack < 0.005


def test_operator(spark):
    rows = [(k, float(i)) for k in ("a", "b", None) for i in range(101)] + [("a", None), ("c", None), ("d", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("n", F.lit("clash")).withColumn("level", F.lit(1))
    days = Q.summarise(df, ["g"], "v")
    got = {r.g: (r.n, r.p50, r.rank_error) for r in Q.percentiles(days, ["g"], SHARES).collect()}
    assert got == {k: (101, 50.0, 0.0) for k in ("a", "b", None)}
    whole = Q.combine(days.withColumn("all", F.lit("x")), ["all"], salted=4)
    r = Q.percentiles(whole, ["all"], SHARES).first()
    assert (r.n, r.p50) == (303, 50.0)
    assert Q.percentiles(Q.summarise(df.limit(0), ["g"], "v"), ["g"], SHARES).count() == 0


def test_hot_group(spark):
    df = spark.range(400_000).select((F.col("id") % 3 == 0).cast("string").alias("g"), (F.col("id") * 7919 % 400_000).alias("v"))
    for r in Q.percentiles(Q.summarise(df, ["g"], "v"), ["g"], SHARES).collect():
        assert abs(r.p50 / 400_000 - 0.5) < 0.005 and 0 < r.rank_error < 0.005


def test_hot_key_of_many_tasks(spark, monkeypatch):
    """Two million values of one key from many tasks go through a salted stage."""
    monkeypatch.setattr(Q, "UNSALTED_TASKS", 8)
    n = 2_000_000
    df = spark.range(0, n, 1, 12).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % n).alias("v"))
    days = Q.summarise(df, ["g"], "v")
    assert "pmod" in days._jdf.queryExecution().toString()
    r = Q.percentiles(days, ["g"], SHARES).first()
    assert r.n == n and 0 < r.rank_error < 0.005
    for name, share in SHARES.items():
        assert abs(r[name] / n - share) <= r.rank_error


def test_groupings_with_day(spark, monkeypatch):
    rows = [(f, r, d, "loc", v) for f in ("a", None) for r in (1, 2) for d in ("x", "y") for v in (1, 2, 3)]
    kinds = "family string, repo_id bigint, day string, metric string, value bigint"
    monkeypatch.setattr(queries, "_measures", lambda *_: spark.createDataFrame(rows, kinds))
    got = Counter(r.grouping for r in queries.p1_percentiles(spark, "").collect())
    assert got == {"family": 2, "repo": 2, "day": 2, "family_repo": 4, "all": 1, "family_day": 4, "repo_day": 4, "family_repo_day": 8}
    assert {(r.grouping, r.groups, r.within) for r in queries.p1_bound_check_day(spark, "").collect()} == {("family_day", 4, True), ("repo_day", 4, True), ("family_repo_day", 8, True)}


def test_many_groups_in_bounded_memory(spark, monkeypatch):
    """100,000 groups of one task take a small share of an executor's memory."""
    steps = []
    kind = type(spark.range(1))
    for name in ("mapInArrow", "mapInPandas"):
        real = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda self, f, *a, _real=real, _name=name: steps.append((_name, f)) or _real(self, f, *a))
    n = 100_000
    Q.combine(Q.summarise(spark.createDataFrame([("a", 1.0)], "g string, v double"), ["g"], "v"), ["g"])
    keys = [f"k{i}" for i in range(n)]
    values = pa.table({"g": keys, "__v": np.arange(n, dtype=float)})
    rows = pa.table({"g": keys, "level": pa.array(np.zeros(n), pa.int32()), "n": np.ones(n, dtype=np.int64), "err": np.zeros(n), "buffer": pa.array([[1.0]] * n)})
    assert len(steps) == 4
    for (name, step), table in zip(steps, [values, *[rows] * 3]):
        batches = table.to_batches(max_chunksize=10_000)
        parts = iter(batches if name == "mapInArrow" else [b.to_pandas() for b in batches])
        tracemalloc.start()
        count = sum(map(len, step(parts)))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert count == n and peak < 40e6


def test_merges_held_in_parts(spark, monkeypatch):
    """Groups that are cut by what a task holds at once are whole in the end."""
    monkeypatch.setattr(Q, "HELD_VALUES", 5_000)
    monkeypatch.setattr(Q, "SENT_VALUES", 300)
    n = 120_000
    tables = []
    for g, size in (("a", 5), ("b", n), (None, 900), ("d", 40_000)):
        summary = Q.Summary()
        summary.add(np.arange(size, dtype=float))
        tables += [(g, *r) for r in summary.rows()]
    tables += [(g, 0, 1, 0.0, np.array([1.0])) for g in ("a", "d", "e")]
    tables.sort(key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    cols = dict(zip(("g", "level", "n", "err", "buffer"), zip(*tables)))
    table = pa.table({"g": pa.array(cols["g"]), "level": pa.array(cols["level"], pa.int32()), "n": pa.array(cols["n"], pa.int64()), "err": pa.array(cols["err"]), "buffer": pa.array([list(b) for b in cols["buffer"]])})
    merged = [b for groups in Q._whole(iter(table.to_batches(max_chunksize=1)), ["g"]) for b in groups.summaries(["g"])]
    got = {}
    for groups in Q._whole(iter(merged), ["g"]):
        for r in groups.percentiles(["g"], SHARES).to_pylist():
            assert r["g"] not in got
            got[r["g"]] = r
    assert {k: r["n"] for k, r in got.items()} == {"a": 6, "b": n, None: 900, "d": 40_001, "e": 1}
    assert got["a"]["p50"] == 1.0 and got[None]["p99"] == 890.0 and got[None]["rank_error"] == 0.0
    assert all(abs(got["b"][k] / n - share) <= got["b"]["rank_error"] < 0.005 for k, share in SHARES.items())
