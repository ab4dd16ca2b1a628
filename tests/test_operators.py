import random

import pytest
from pyspark.sql import functions as F

from lithoscope.functions import text as X
from lithoscope.operators import facts, flow, graph, issues, metrics
from lithoscope.plans import codebase


def values(spark, exprs):
    row = spark.range(1).select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).first()
    return list(row)


def test_scalars(spark):
    s = F.lit
    got = values(spark, [
        X.normal_path(s("a\\b//./c.py")), X.naming_style(s("fooBar")), X.naming_style(s("foo_bar_test")), X.loc(s("a\nb\n")), X.loc(s("")), X.loc(s(None).cast("string")),
        X.name_words(s("parseHTTPQueries")), X.normal_line(s("  X1 = 'a'  ")), X.language(s("x/y.MJS")), X.is_test(s("a/tests/b.py")), X.is_test(s("a/test_b.py")), X.is_test(s("a/contest.py")),
        X.nearest_rank(F.array(*map(s, [4, 1, 3, 2])), 0.75), X.rounded_percent(s(1), s(3)), X.under(s("a/b/c"), F.array(s("a/b"))), X.under(s("a/bc"), F.array(s("a/b"))),
    ])
    assert got == ["a/b/c.py", "camelCase", "snake_case", 2, 0, 0, ["parse", "http", "query"], 'x# = "a"', "javascript", True, True, False, 4, 33, True, False]


def closure(edges):
    r = set(edges)
    while True:
        more = {(a, d) for a, b in r for c, d in edges if b == c} - r
        if not more:
            return r
        r |= more


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_graph_against_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(20)}
    df = spark.createDataFrame(sorted(edges), "src bigint, dst bigint")
    plain = {e for e in edges if e[0] != e[1]}
    full = closure(plain)
    members = {(r.node, r.component) for r in graph.components(df).collect()}
    want = {}
    for n in range(14):
        mates = {m for m in range(14) if (n, m) in full and (m, n) in full}
        if len(mates) > 1:
            want[n] = frozenset(mates)
    got = {}
    for n, c in members:
        got.setdefault(c, set()).add(n)
    assert {frozenset(v) for v in got.values()} == set(want.values())
    reach = {(r.node, r.reached) for r in graph.reach(df).collect()}
    assert reach == {(a, b) for a, b in full if a != b}
    name = {n: min(m) for n, m in want.items()}
    dag = {(name.get(a, a), name.get(b, b)) for a, b in plain} - {(x, x) for x in range(14)}
    dag = {e for e in dag if e[0] != e[1]}

    def longest(n):
        return max([0] + [1 + longest(b) for a, b in dag if a == n])

    depths = {r.component: r.depth for r in graph.depth(df, graph.components(df)).collect()}
    least = {c: min(v) for c, v in got.items()}
    assert {least.get(c, c): d for c, d in depths.items()} == {n: longest(n) for n in {x for e in dag for x in e}}


def test_empty_graph(spark):
    e = spark.createDataFrame([], "src bigint, dst bigint")
    assert graph.components(e).count() == 0
    assert graph.hubs(e.select(F.col("src").alias("node")), e).count() == 0


def test_flow(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("d", "a")], "src string, dst string")
    source = spark.createDataFrame([("a",)], "node string")
    sink = spark.createDataFrame([("d",)], "node string")
    modules = spark.createDataFrame([(x, x) for x in "abcd"], "node string, module string")
    paths = flow.simple_paths(e, source, 4)
    assert sorted(map(tuple, [r.path for r in paths.collect()])) == [("a", "b"), ("a", "b", "c"), ("a", "b", "c", "d"), ("a", "d")]
    assert [tuple(r) for r in flow.relays(paths, modules, 3, 3).collect()] == [("a", 3, 3, "a>b>c>d")]
    assert flow.relays(paths, modules, 4, 2).count() == 0
    assert [r.hops for r in flow.bypasses(paths, source, sink, spark.createDataFrame([("b",)], "node string")).collect()] == [1]
    assert flow.bypasses(paths, source, sink, sink).count() == 0
    assert flow.fan_out(paths, modules, modules, 3, 3).count() == 1


def test_issues_and_suppression(spark):
    rows = spark.createDataFrame(
        [("long", "size", "a.py", "f", 3, 90.0, 80.0, "k1"), ("long", "size", "a.py", "f", 9, 95.0, 80.0, "k1"), ("deep", "size", "a.py", "f", 3, 5.0, 4.0, "k2"), ("long", "size", "b.py", None, 1, 81.0, 80.0, "k3")],
        "rule string, family string, path string, symbol string, line int, value double, threshold double, anchor string",
    )
    found = {r.path: r for r in issues.issues(issues.evidence(rows)).collect()}
    assert len(found) == 2 and len(found["a.py"].evidence) == 2
    assert {e.line for e in found["a.py"].evidence if e.rule == "long"} == {9}
    s = spark.createDataFrame([("a.py", "deep", "file", None), ("b.py", None, "next", 0), ("a.py", "long", "line", 9)], "path string, rule string, scope string, line int")
    kept, dropped = issues.suppress(rows, s)
    assert [r.line for r in kept.collect()] == [3]
    assert {r.rule: r.suppressed for r in dropped.collect()} == {"deep": 1, "long": 2}
    report = issues.issues(issues.evidence(rows))
    assert issues.integrity_errors(report).count() == 0
    assert issues.integrity_errors(report.union(report)).where("error = 'repeated_id'").count() == 2
    a = spark.createDataFrame([("x",), ("y",)], "id string")
    b = spark.createDataFrame([("y",), ("z",)], "id string")
    assert {r.id: r.status for r in issues.baseline_counts(a, b, ["id"]).collect()} == {"x": "resolved", "y": "unchanged", "z": "new"}


def test_coverage(spark):
    f = spark.createDataFrame([(1, "py"), (2, "py"), (3, "go"), (4, "sql")], "file_id bigint, language string")
    p = spark.createDataFrame([(1, False), (2, True), (3, False)], "file_id bigint, failed boolean")
    got = {r.language: r.status for r in issues.coverage(f, p).collect()}
    assert got == {"py": "partial", "go": "observed", "sql": "unsupported"}
    before = spark.createDataFrame([("py", "observed"), ("go", "observed"), ("x", "partial")], "language string, status string")
    after = spark.createDataFrame([("py", "partial"), ("go", "observed")], "language string, status string")
    assert {r.language for r in issues.regressions(before, after, ["language"]).collect()} == {"py", "x"}


def test_facts(spark):
    src = "import x\n# TODO one\ndef used(a, b):\n    return used2(a)\ndef spare(self, aa, bb, cc):\n    pass\ntry:\n    pass\nexcept ValueError:\n    s = \"long literal\"\n"
    f = spark.createDataFrame([(1, src), (2, None), (3, "")], "file_id bigint, source string")
    assert facts.lines(f).count() == 10
    assert facts.debt_markers(facts.lines(f)).count() == 1
    assert {r.name for r in facts.unused_functions(f).collect()} == {"used", "spare"}
    assert [r.literal for r in facts.literals(f).collect()] == ["long literal"]
    assert facts.error_patterns(f).count() == 1
    assert [r.clump for r in facts.data_clumps(facts.definitions(f), 1).collect()] == ["aa, bb, cc"]
    assert [r.module for r in facts.imports(f).collect()] == ["x"]


def test_shape_overlap_against_brute_force(spark):
    rng = random.Random(4)
    shapes = [(i, f"T{i}", sorted(rng.sample("abcdefgh", rng.randrange(3, 7)))) for i in range(40)]
    got = {(r.shape_a, r.shape_b) for r in facts.shape_overlaps(spark.createDataFrame(shapes, "file_id bigint, type_name string, fields array<string>")).collect()}
    kinds = sorted({tuple(s) for *_, s in shapes})
    want = set()
    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            c = len(set(a) & set(b))
            if c >= 3 and c >= 0.75 * max(len(a), len(b)):
                want.add(tuple(sorted([",".join(a), ",".join(b)])))
    assert got == want


def test_metrics(spark):
    m = spark.createDataFrame([("f", 100, 3, None), ("g", 80, 16, 9)], "name string, loc int, complexity int, parameter_count int")
    got = metrics.exceeded(m, ["name"], {"loc": ("long", 80), "complexity": ("complex", 15), "parameter_count": ("params", 5)})
    assert sorted((r.name, r.rule) for r in got.collect()) == [("f", "long"), ("g", "complex"), ("g", "params")]
    with pytest.raises(ValueError):
        metrics.limits("balanced", unknown=3)
    points = spark.createDataFrame([("p", 1, 70), ("p", 2, 5), ("p", 3, 500)], "path string, point_id int, line bigint")
    spans = spark.createDataFrame([("p", "outer", 1, 200), ("p", "inner", 64, 10), ("p", "none", None, 3)], "path string, name string, line bigint, loc bigint")
    assert {r.point_id: r.symbol for r in metrics.innermost(points, spans, ["path"]).collect()} == {1: "inner", 2: "outer"}
    c = spark.createDataFrame([("c1", "x", "a", 5, None), ("c1", "x", "b", 1, 1), ("c2", "y", "a", 900, 0)], "commit string, author string, path string, added int, deleted int")
    assert {r.path: (r.commits, r.recent_weighted) for r in metrics.churn(c, 100).collect()} == {"a": (1, 5), "b": (1, 2)}


def test_flow_beyond_the_hops(spark, monkeypatch):
    chain = lambda s, n: [(f"{s}:{i}", f"{s}:{i + 1}") for i in range(n)]
    rows = chain("six", 6) + chain("eight", 8) + chain("nine", 9) + chain("loop", 3) + [("loop:3", "loop:1")]
    rows += [("wide:0", "six:1"), ("wide:0", "nine:1"), ("nine:2", "nine:1")]
    e = spark.createDataFrame(rows, "src string, dst string")
    outs, ins = {a for a, _ in rows}, {b for _, b in rows}
    source = spark.createDataFrame([(x,) for x in sorted(outs - ins)], "node string")
    sink = spark.createDataFrame([(x,) for x in sorted(ins - outs)], "node string")
    modules = spark.createDataFrame([(x, x) for x in sorted(outs | ins)], "node string, module string")
    assert {r.node for r in flow.truncated(e, source, 8, 1).collect()} == {"nine:0", "wide:0"}
    monkeypatch.setattr(codebase, "_flow", lambda *_: (e, source, sink, modules))
    assert {r.source: r.hops for r in codebase.flow_relays(spark, "").collect()} == {"six:0": 6, "eight:0": 8, "loop:0": 3}
    assert {r.source for r in codebase.flow_truncated(spark, "").collect()} == {"nine:0", "wide:0"}
    assert [tuple(r) for r in codebase.flow_fan_out(spark, "").collect()] == [("wide:0", 2, 2)]
