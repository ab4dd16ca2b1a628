"""Rules over names, keys, folders and imports on small fixtures."""

from pyspark.sql import functions as F

from lithoscope.functions import text as X
from lithoscope.operators import drift, graph, imports

FILES = "repo_id bigint, display_path string, source string, is_test boolean, path string"


def table(spark, rows):
    return spark.createDataFrame([(r, p, s, t, "clash") for r, p, s, t in rows], FILES)


def test_words(spark):
    names = ["loadUserConfig", "HTTPServer2Client", "parse_entries", "a-b/c", "process", "ABC", "x1Y", ""]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.w for r in rows.select(drift.identifier_words(F.col("n")).alias("w")).collect()]
    assert got == [["load", "user", "config"], ["httpserver2", "client"], ["parse", "entry"], ["a", "b", "c"], ["proces"], ["abc"], ["x1", "y"], []]
    lines = {
        "export const loadIt = (a) => a": "loadIt", "pub async fn load_it<T>(x: T) {": None, "pub fn load_it(x: u8) {": "load_it", "func (r *R) Load(a int) {": "Load", "func Load() {": "Load",
        "\tdef load(self):": "load", "class Loader(Base):": "Loader", "class Loader {": "Loader", "// fn x()": None, "x = 1 # def y()": None, "let a = 3": None, "const f = function () {": "f", "function run() {": "run",
    }
    rows = spark.createDataFrame(list(lines.items()), "l string, w string")
    assert all(r.got == r.w for r in rows.select("l", "w", drift.callable_name(F.col("l")).alias("got")).collect())
    stems = {"HTTPServerMain": ["server"], "user_store.test": ["user", "store"], "parseXMLFile": ["parse", "file"], "ab": []}
    rows = spark.createDataFrame(list(stems), "string").toDF("s")
    assert {r.s: r.w for r in rows.select("s", X.folder_words(F.col("s")).alias("w")).collect()} == stems


def test_concepts(spark):
    rows = [(1, f"src/m{i}.py", f"def parse_user_record_{'x' * i}():\n    pass\ndef parseUserRecord(a):\n    pass\n", False) for i in range(2)]
    rows += [(1, "src/utils/io.py", "def read_matrix():\n    pass\n", False), (1, "lib/helper.py", "def makeReadMatrix(a):\n  pass\nclass ReadMatrix:\n  pass\n", None)]
    rows += [(1, "tests/test_a.py", "def make_mock_account():\n  pass\n", True), (1, "tests/test_b.py", "def fake_account_tests():\n  pass\nfixture_account = 1\ndef sample_account():\n  pass\n", True)]
    rows += [(2, "src/m9.py", "def parseUserRecord(): pass", False), (2, None, "def parse_user_record(): pass", False), (2, "src/x.py", None, False)]
    f = table(spark, rows)
    named = drift.callables(f, ["repo_id"])
    assert [tuple(r) for r in drift.parallel_implementations(named, ["repo_id"], 2).collect()] == [(1, "parse user record", 4, 2)]
    assert [tuple(r) for r in drift.shadowed_abstractions(f, ["repo_id"]).collect()] == [(1, "read matrix", 3, 2)]
    assert [(r.key, r.occurrences, r.files) for r in drift.fixture_factories(f, ["repo_id"], 1).collect()] == []
    assert drift.shadowed_abstractions(f.limit(0), ["repo_id"]).count() == 0


def test_fixture_factories(spark):
    rows = [(1, f"tests/{p}_test.py", "def make_mock_account():\n  pass\n", True) for p in ("a", "b")] + [(1, "tests/c_test.py", "def account_builder():\n  pass\n", True)]
    got = {(r.key, r.occurrences, r.files) for r in drift.fixture_factories(table(spark, rows), ["repo_id"], 2).collect()}
    assert got == {("make account", 2, 2)}


def test_config_keys(spark):
    long = "x" * 20_000
    rows = [(1, f"src/m{i}.ts", f'const a = "/api/users"; // "/no/comment"\nlet b = process.env.API_TOKEN_X\nstatic SERVICE_URL = 1\nfetch(\'{long}\')\n', False) for i in range(3)]
    rows += [(1, "src/t.ts", 'x("/api/users")', True), (2, "src/u.ts", 'x("/api/users", "/a b/c", "/one", "NO_WORD", "plain")', False)]
    got = {tuple(r) for r in drift.config_keys(table(spark, rows), ["repo_id"]).collect()}
    assert got == {(1, "/api/users", 3, 3), (1, "SERVICE_URL", 3, 3)}


def test_generic_buckets(spark):
    rows = [(1, f"src/utils/{n}.py", "x = 1", False) for n in ("dates", "money", "parcel", "queue")]
    rows += [(1, f"src/core/{n}.py", "x = 1", False) for n in ("dates", "money", "parcel", "queue")]
    many = "\n".join(f"def {chr(97 + i) * 4}_{chr(98 + i) * 5}(): pass" for i in range(20))
    rows += [(1, "src/app/helpers.py", many, False), (1, "src/app/other.py", many, False)]
    got = {tuple(r) for r in drift.generic_buckets(table(spark, rows), ["repo_id"], 16).collect()}
    assert got == {(1, "src/utils", "folder", 4, 4), (1, "src/app/helpers.py", "file", 39, 1)}


def test_boundary_bypasses(spark):
    call = 'x = 1\nfetch("/a")\n// fetch(\ny = "fetch("\nrequests.get(u)\n'
    rows = [(1, "crates/a/src/client.ts", call, False)] + [(1, f"crates/a/src/m{i}.ts", call, False) for i in range(3)]
    rows += [(1, "crates/b/src/m.ts", call, False), (1, "crates/a/scripts/m.ts", call, False), (1, "crates/a/src/m4.test.ts", call, True)]
    got = [tuple(r) for r in drift.boundary_bypasses(table(spark, rows), ["repo_id"]).collect()]
    assert got == [(1, "HTTP", 6, 3)]
    assert drift.boundary_bypasses(table(spark, rows[1:]), ["repo_id"]).count() == 0


def edges(spark, rows, by=("repo_id",)):
    f = spark.createDataFrame([(r, p, s) for r, p, s in rows], "repo_id bigint, path string, source string")
    return imports.resolved(imports.specifiers(f, list(by)), f.select("repo_id", "path"), list(by))


def test_import_cycle(spark):
    e = edges(spark, [(1, "src/a.ts", "import { x } from './b'\n"), (1, "src/b.ts", "export * from \"./a\"\nconst c = require('./gone')\nimport z from 'lib'\n"), (2, "src/b.ts", "")])
    got = {(r.src, r.specifier, r.dst) for r in e.collect()}
    assert got == {("src/a.ts", "./b", "src/b.ts"), ("src/b.ts", "./a", "src/a.ts"), ("src/b.ts", "./gone", None), ("src/b.ts", "lib", None)}
    assert {r.specifier for r in e.where(imports.unresolved(e)).collect()} == {"./gone"}
    g = e.where("dst IS NOT NULL").select("src", "dst")
    r = graph.cycle_density(g, graph.components(g)).first()
    assert (r.nodes, r.edges, r.density) == (2, 2, 100)
    degree = {x.node: (x.fan_in, x.fan_out) for x in graph.degrees(g.select(F.col("src").alias("node")), g).collect()}
    assert degree == {"src/a.ts": (1, 1), "src/b.ts": (1, 1)}


def test_other_imports(spark):
    e = edges(spark, [
        (1, "App.vue", "<template>import x from './no'</template>\n<script>\nimport W from './Widget.vue'\n</script>\n"), (1, "Widget.vue", "<script lang=\"ts\"></script>"),
        (1, "pkg/sub/m.py", "from . import sibling\nfrom ..core.types import T\nfrom os import path\n# from . import no\n"), (1, "pkg/sub/sibling.py", ""), (1, "pkg/core.py", ""),
        (1, "src/lib.rs", "mod plain;\npub(crate) mod deep;\n#[path = \"odd/name.rs\"]\n\n#[cfg(x)]\nmod other;\nmod gone;\n// mod no;\nmod inline { }\n"),
        (1, "src/plain.rs", "mod child;\n"), (1, "src/deep/mod.rs", ""), (1, "src/odd/name.rs", ""), (1, "src/plain/child.rs", ""),
        (1, "web/x/y/z/q.js", "import a from '../../../../lib/a'\nimport b from './'\n"), (1, "lib/a/index.js", ""), (1, "c/m.c", "#include \"n.h\"\n#include <stdio.h>\n"), (1, "c/n.h", ""),
    ])
    got = {(r.src, r.specifier): r.dst for r in e.collect()}
    assert got == {
        ("App.vue", "./Widget.vue"): "Widget.vue", ("pkg/sub/m.py", ".sibling"): "pkg/sub/sibling.py", ("pkg/sub/m.py", "..core.types"): "pkg/core.py",
        ("src/lib.rs", "plain"): "src/plain.rs", ("src/lib.rs", "deep"): "src/deep/mod.rs", ("src/lib.rs", "odd/name.rs"): "src/odd/name.rs", ("src/lib.rs", "gone"): None,
        ("src/plain.rs", "child"): "src/plain/child.rs", ("web/x/y/z/q.js", "../../../../lib/a"): "lib/a/index.js", ("web/x/y/z/q.js", "./"): None, ("c/m.c", "n.h"): "c/n.h",
    }


def test_folding_and_tests(spark):
    paths = {"a/b/../c": "a/c", "a/../../b": "../b", "./a/./b": "a/b", "/a/../b": "/b", "/".join(["x"] * 9 + [".."] * 9 + ["y"]): "y", "a//b": "a/b"}
    rows = spark.createDataFrame(list(paths.items()), "p string, w string")
    assert all(r.got == r.w for r in rows.select("p", "w", X.folded_path(F.col("p")).alias("got")).collect())
    tests = ["src/tests.rs", "test_a.py", "a_test.go", "a_tests.rs", "x.test.ts", "x.spec.js", "Assets/EditMode/A.cs", "unit-tests/a.py", "my_tests/a.c"]
    none = ["testing/a.py", "conftest.py", "Test_a.py", "a_test.js", "a_tests.py", "contest.rs", None]
    rows = spark.createDataFrame([(p,) for p in tests + none], "p string")
    got = {r.p: r.t for r in rows.select("p", X.is_test(F.col("p")).alias("t")).collect()}
    assert all(got[p] for p in tests) and not any(got[p] for p in none)


def test_simple_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "d"), ("c", "e")], "src string, dst string")
    assert {tuple(r.members) for r in imports.simple_cycles(e).collect()} == {("a", "b"), ("a", "b", "c")}
    assert imports.simple_cycles(e.limit(0)).count() == 0


def test_long_chain(spark):
    """Neither reach nor depth stops after a number of rounds."""
    n = 80
    e = spark.createDataFrame([(i, i + 1) for i in range(n)], "src bigint, dst bigint")
    none = spark.createDataFrame([], "node bigint, component bigint")
    assert graph.depth(e, none).agg(F.max("depth")).first()[0] == n
    assert graph.reach(e).count() == n * (n + 1) // 2


def test_dyadic_range_join(spark):
    from lithoscope.operators import metrics

    spans = spark.createDataFrame([(1, "whole", 1, 900_000), (1, "part", 10, 50), (1, "inner", 12, 1), (2, "other", 1, 5), (1, None, 5, None)], "k bigint, name string, line bigint, loc bigint")
    points = spark.createDataFrame([(1, i, l) for i, l in enumerate([1, 9, 10, 12, 13, 59, 60, 900_000, 900_001])] + [(2, 100, 6), (3, 101, 1)], "k bigint, point_id bigint, line bigint")
    got = {r.point_id: r.symbol for r in metrics.innermost(points, spans, ["k"]).collect()}
    assert got == {0: "whole", 1: "whole", 2: "part", 3: "inner", 4: "part", 5: "part", 6: "whole", 7: "whole"}


def test_shell_functions():
    from lithoscope.operators.functions import scan, scan_calls

    source = "# f() {\nhelper() {\n  echo \"if { $1\"\n}\nfunction run {\n  if [ -n \"$1\" ] && helper a; then\n    for x in b; do\n      helper \"$x\" | other\n    done\n  fi\n}\n"
    got = [(n, line, loc, complexity, nesting) for n, line, loc, complexity, nesting, *_ in scan(source, "bash")]
    assert got == [("helper", 2, 3, 1, 0), ("run", 5, 7, 4, 2)]
    assert [(n, c) for n, _, c in scan_calls(source, "bash")] == [("helper", ["echo"]), ("run", ["helper", "other"])]
