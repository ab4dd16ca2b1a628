import ast
import itertools
import random
import re

from lithoscope.operators import functions as Fn
from lithoscope.operators import projects as P


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_against_table():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        for share in (0.5, 0.85, 0.9):
            need = -(-int(round(share * 1000)) * (len(a) + len(b)) // 2000)
            assert Fn.lcs_similar(a, b, share) == (lcs(a, b) >= need)


def test_leaders():
    items = [(0, list("aaaa")), (1, list("aaab")), (2, list("zzzz")), (3, list("aaaa"))]
    assert Fn.leaders(items, 0.75, 2) == [[0, 1, 3]]


def test_scan_python_like_ast(spark):
    src = "import x\n\nclass A:\n    def f(self, a, b=1):\n        '''def no(): pass'''\n        for i in a:\n            if i and b:\n                return [\n    1]\n        return 2\n\nasync def g():\n    pass\n"
    got = {n: (line, loc, c, d, p) for n, line, loc, c, d, p, _ in Fn.scan(src, "python")}
    tree = {n.name: (n.lineno, n.end_lineno - n.lineno + 1) for n in ast.walk(ast.parse(src)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
    assert {n: v[:2] for n, v in got.items()} == tree
    assert got["f"][2:] == (4, 2, 2) and got["g"][2:] == (1, 0, 0)


def test_scan_braces_and_clones(spark):
    js = "function f(a, b) { if (a) { while (b) { g('}') } } return 1 }\nfunction h(x, y) { if (x) { while (y) { k(\"q\") } } return 22 }\n// function no() {\n"
    got = Fn.scan(js, "javascript")
    assert [(n, c, d, p) for n, _, _, c, d, p, _ in got] == [("f", 3, 2, 2), ("h", 3, 2, 2)]
    df = spark.createDataFrame([(1, "a.js", js), (2, "b.js", None), (3, "c.txt", js)], "file_id bigint, path string, source string")
    groups = Fn.clone_groups(Fn.function_facts(df), 5).collect()
    assert [(g.functions, g.files) for g in groups] == [(2, 1)]


def test_imports(spark):
    i = spark.createDataFrame([("src/a.ts", "./b"), ("src/x/c.ts", "../b"), ("src/a.ts", "./gone"), ("src/a.ts", "lodash"), ("src/a.ts", "./dir")], "src string, module string")
    f = spark.createDataFrame([("src/b.js",), ("src/b.ts",), ("src/dir/index.js",)], "path string")
    got = {(r.src, r.module): r.dst for r in P.resolve_imports(i, f).collect()}
    assert got == {("src/a.ts", "./b"): "src/b.ts", ("src/x/c.ts", "../b"): "src/b.ts", ("src/a.ts", "./gone"): None, ("src/a.ts", "./dir"): "src/dir/index.js"}


def test_globs():
    cases = [("src", "src/a/b.py", True), ("src", "srcx", False), ("src/*.py", "src/a.py", True), ("src/*.py", "src/a/b.py", False), ("**/test_?.py", "a/b/test_1.py", True), ("**/x", "x", True), ("a/**", "a/b/c", True)]
    for pattern, path, want in cases:
        assert bool(re.match(P.glob_regex(pattern), path)) == want, (pattern, path)


def test_assets(spark):
    g = ["%032x" % i for i in range(4)]
    rows = [("Assets/a.cs", ""), ("Assets/a.cs.meta", f"guid: {g[0]}\n"), ("Assets/b.cs", ""), ("Assets/c.cs.meta", f"x: 1\nguid: {g[0]}\n"), ("s.unity", f"m_Script: {{guid: {g[1]}}}\nm_Tex: {{guid: {g[2]}}}\nm: guid: {g[0]}\n")]
    df = spark.createDataFrame(rows, "path string, source string")
    assert {(r.path, r.problem) for r in P.side_files(df.where("path like 'Assets%'")).collect()} == {("Assets/b.cs", "missing_meta"), ("Assets/c.cs", "orphan_meta")}
    ids = P.guids(df.where("path like '%.meta'"))
    assert [r.n for r in P.duplicate_guids(ids).collect()] == [2]
    assert {(r.guid, r.rule) for r in P.broken_references(df.where("path = 's.unity'"), ids).collect()} == {(g[1], "missing_script"), (g[2], "broken_asset_reference")}
    a = spark.createDataFrame([("A", ["B", "X"], False), ("B", [], True)], "name string, references array<string>, editor boolean")
    assert {(r.reference, r.resolved, r.crosses) for r in P.assembly_references(a).collect()} == {("B", True, True), ("X", False, False)}


def test_behaviours_and_docs(spark):
    bad = "using UnityEditor;\nvoid Start() { x.OnHit += H; }\nvoid Update() { GameObject.Find(\"a\"); }\n"
    ok = "void Start() { GameObject.Find(\"a\"); x.E += h; x.E -= h; }\nvoid Update() { }\n"
    df = spark.createDataFrame([("A/B.cs", bad), ("C.cs", ok), ("D.cs", None)], "path string, source string")
    got = {(r.path, r.rule) for r in P.behaviour_findings(df).collect()}
    assert got == {("A/B.cs", r) for r in ("unbalanced_event_subscription", "editor_api_in_runtime", "expensive_frame_call")}
    docs = spark.createDataFrame([("guide", "Install and RUN it")], "role string, source string")
    assert {(r.role, r.term) for r in P.missing_terms(docs, [("guide", "run"), ("guide", "config"), ("schema", "id")]).collect()} == {("guide", "config"), ("schema", "id")}


def test_happy_path(spark):
    f = spark.createDataFrame([(1, "def test_a(): assert x\n" * 3), (2, "def test_a(): assert error\n" * 3)], "file_id bigint, source string")
    cases = spark.createDataFrame([(i, n) for i, n in itertools.product((1, 2), range(3))], "file_id bigint, line bigint")
    assert [r.file_id for r in P.happy_path_only(cases, f).collect()] == [1]


def test_calls(spark):
    src = "def f(a):\n    g(a)\n    h(1)\n    return f2\n\ndef g(x):\n    return g(x - 1) + \"no(\"\n"
    assert Fn.scan_calls(src, "python") == [("f", 1, ["g", "h"]), ("g", 6, ["g"])]
    files = spark.createDataFrame([(1, 7, "a.py", src), (2, 7, "b.py", "def h(): pass\n"), (3, 7, "c.py", "def h(): pass\n"), (4, None, "d.py", "def k():\n    g()\n")], "file_id bigint, repo_id bigint, path string, source string")
    edges, left = Fn.call_edges(Fn.call_names(files), Fn.function_facts(files, streams=True), files)
    assert {(r.src, r.dst) for r in edges.collect()} == {("1:f", "1:g"), ("1:g", "1:g")}
    assert {r.reason: r.n for r in left.collect()} == {"ambiguous": 1, "none": 1}
