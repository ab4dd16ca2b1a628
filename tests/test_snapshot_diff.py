import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lithoscope.operators.snapshot_diff import snapshot_changes

EVIDENCE = (
    "array<struct<id: string, rule: string, message: string, measurements: array<struct<name: string, value: double, threshold: double, unit: string>>, "
    "locations: array<struct<path: string, line: bigint, symbol: string>>>>"
)
ISSUES = f"delivery_id bigint, repo_id bigint, snapshot_no bigint, issue_id string, title string, digest string, evidence {EVIDENCE}"
DELIVERIES = "delivery_id bigint, repo_id bigint, snapshot_no bigint, delivered_at timestamp, later string"


def canonical(value):
    if isinstance(value, list):
        return tuple(sorted((canonical(v) for v in value), key=repr))
    if isinstance(value, tuple):
        return tuple(canonical(v) for v in value)
    return value


def brute(issues, deliveries):
    last = {}
    for d, repo, no, at, _ in deliveries:
        if repo is None or no is None:
            continue
        if (repo, no) not in last or (at, d) > last[repo, no]:
            last[repo, no] = (at, d)
    content = {}
    for key, (_, d) in last.items():
        content[key] = {}
        for row in issues:
            if row[0] == d:
                content[key].setdefault(row[3], set()).add(canonical(row[6] or []))
    out = set()
    for repo in {r for r, _ in last}:
        numbers = sorted(n for r, n in last if r == repo)
        for a, b in zip(numbers, numbers[1:]):
            x, y = content[repo, a], content[repo, b]
            for i in x.keys() | y.keys():
                if i not in x:
                    out.add((repo, b, i, "added"))
                elif i not in y:
                    out.add((repo, b, i, "removed"))
                elif x[i] != y[i]:
                    out.add((repo, b, i, "changed"))
    return out


def item(rng):
    return (
        rng.choice(["e1", "e2", None]), rng.choice(["r1", None]), "m",
        rng.choice([None, [], [("loc", 1.0, None, "n"), ("cc", 2.0, 3.0, None)], [("cc", 2.0, 3.0, None), ("loc", 1.0, None, "n")]]),
        rng.choice([None, [("a.py", None, "f"), ("b.py", 2, None)], [("b.py", 2, None), ("a.py", None, "f")]]),
    )


def test_against_brute_force(spark):
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    deliveries, issues = [], []
    d = 0
    for repo in range(1, 6):
        for no in sorted(rng.sample(range(2, 20), 6)):
            for _ in range(rng.choice([1, 1, 2])):
                d += 1
                deliveries.append((d, repo, no, start + timedelta(hours=rng.randrange(50)), "x"))
                if rng.random() < 0.15:
                    continue  # an empty snapshot
                for i in range(8):
                    if rng.random() < 0.7:
                        row = (d, repo, no, rng.choice([f"i{i}", f"i{i}", None]), "t", "clash", rng.choice([None, [], [item(rng)], [item(rng), item(rng)]]))
                        issues += [row] * rng.choice([1, 1, 2])
    deliveries.append((999, None, 3, start, "x"))
    issues.append((12345, 1, 1, "orphan", "t", "c", []))
    got = snapshot_changes(spark.createDataFrame(issues, ISSUES), spark.createDataFrame(deliveries, DELIVERIES))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(issues, deliveries)


def test_empty_tables(spark):
    i, d = spark.createDataFrame([], ISSUES), spark.createDataFrame([], DELIVERIES)
    assert snapshot_changes(i, d).count() == 0
    assert snapshot_changes(i, d).columns == ["repo_id", "snapshot_no", "issue_id", "change"]


def test_one_issue_over_many_batches(spark):
    """The merge keeps its place where Arrow batches end."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        d = spark.range(40).select((F.col("id") + 1).alias("delivery_id"), F.lit(1).cast("bigint").alias("repo_id"), F.col("id").alias("snapshot_no"), F.current_timestamp().alias("delivered_at"))
        i = d.select("delivery_id", "repo_id", "snapshot_no", F.lit("x").alias("issue_id"), F.lit(None).cast(EVIDENCE).alias("evidence")).where("snapshot_no % 10 <> 5")
        got = sorted((r.snapshot_no, r.change) for r in snapshot_changes(i, d).collect())
        assert got == sorted([(n, "removed") for n in (5, 15, 25, 35)] + [(n, "added") for n in (6, 16, 26, 36)])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
