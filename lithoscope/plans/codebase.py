"""Rule queries over the tables of a scanned corpus, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import facts, flow, functions, graph, issues, metrics, projects, similarity
from ..session import read_table, written

LIMITS = metrics.limits("balanced")
#: calls a relay is followed over; a source with longer ones has no relay, as its longest isn't known
FLOW_HOPS = 8
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return wrap


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "source_files")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "function_metrics")


# Shared SQL: normal paths and the lines of a source.
_NORMAL = "regexp_replace(regexp_replace(replace({0}, chr(92), '/'), '/+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g')"
_LINES = """
l AS (SELECT file_id, u.n AS line, CASE WHEN suffix(u.t, chr(13)) THEN left(u.t, length(u.t) - 1) ELSE u.t END AS "text"
  FROM (SELECT file_id, unnest(generate_series(1, len(p))) AS n, unnest(p) AS t FROM (
    SELECT file_id, string_split(CASE WHEN suffix(source, chr(10)) THEN left(source, length(source) - 1) ELSE source END, chr(10)) p
    FROM source_files WHERE source IS NOT NULL AND source <> '')) u)
"""


@query(f"""
SELECT file_id, {_NORMAL.format('display_path')} AS path,
  len(string_split(source, chr(10))) - CASE WHEN source = '' OR suffix(source, chr(10)) THEN 1 ELSE 0 END AS loc, 200 AS threshold
FROM source_files WHERE source IS NOT NULL
  AND len(string_split(source, chr(10))) - CASE WHEN source = '' OR suffix(source, chr(10)) THEN 1 ELSE 0 END > 200
""")
def large_file(spark, sf_dir):
    rows = _files(spark, sf_dir).select("file_id", X.normal_path(F.col("display_path")).alias("path"), X.loc(F.col("source")).alias("loc"))
    return rows.where("loc > 200").withColumn("threshold", F.lit(200))


@query(f"WITH {_LINES} SELECT file_id, line, lower(trim(\"text\")) AS marker FROM l WHERE regexp_matches(ltrim(\"text\"), '^(//|#|/\\*|\\*|<!--)') AND regexp_matches(lower(\"text\"), 'todo|fixme')")
def debt_marker(spark, sf_dir):
    return facts.debt_markers(facts.lines(_files(spark, sf_dir))).select("file_id", "line", F.lower(F.trim("text")).alias("marker"))


@query(f"""
WITH p AS (SELECT repo_id, regexp_replace({_NORMAL.format('display_path')}, '/?[^/]*$', '') d FROM source_files WHERE display_path IS NOT NULL)
SELECT repo_id, CASE WHEN d = '' THEN '.' ELSE d END AS folder, count(*) AS files FROM p GROUP BY 1, 2 HAVING count(*) > 3
""")
def large_directory(spark, sf_dir):
    folder = X.parent(X.normal_path(F.col("display_path")))
    rows = _files(spark, sf_dir).where("display_path IS NOT NULL").groupBy("repo_id", folder.alias("folder")).agg(F.count("*").alias("files"))
    return rows.where("files > 3")


@query(f"""
WITH p AS (SELECT {_NORMAL.format('display_path')} p FROM source_files WHERE display_path IS NOT NULL),
s AS (SELECT split_part(p, '/', 1) AS folder, regexp_replace(regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\\.[^.]*$', ''), '([._-](test|tests|spec))$', '') s FROM p),
t AS (SELECT folder, CASE WHEN regexp_full_match(s, '[a-z0-9]+') THEN 'lowercase' WHEN regexp_full_match(s, '[a-z0-9]+(_[a-z0-9]+)+') THEN 'snake_case'
  WHEN regexp_full_match(s, '[a-z0-9]+(-[a-z0-9]+)+') THEN 'kebab-case' WHEN regexp_full_match(s, '[a-z][a-z0-9]*([A-Z][a-z0-9]*)+') THEN 'camelCase'
  WHEN regexp_full_match(s, '([A-Z][a-z0-9]*)+') THEN 'PascalCase' WHEN regexp_full_match(s, '[A-Z0-9]+(_[A-Z0-9]+)*') THEN 'UPPER_CASE' ELSE 'mixed' END st FROM s),
g AS (SELECT folder, st, count(*) n FROM t GROUP BY 1, 2),
r AS (SELECT folder, sum(n)::BIGINT files, coalesce(sum(n) FILTER (st <> 'lowercase'), 0)::BIGINT styled, count(*) FILTER (st <> 'lowercase') styles FROM g GROUP BY 1),
b AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY n DESC, st DESC) k FROM g WHERE st <> 'lowercase')
SELECT r.folder, files, styles, CASE WHEN b.n >= 2 AND b.n * 2 >= styled THEN b.st END AS dominant,
  CASE WHEN b.n >= 2 AND b.n * 2 >= styled THEN styled - b.n ELSE styled END AS outliers
FROM r JOIN b ON b.folder = r.folder AND k = 1 WHERE files >= 4 AND styles >= 2
""")
def file_naming_drift(spark, sf_dir):
    p = X.normal_path(F.col("display_path"))
    rows = _files(spark, sf_dir).where("display_path IS NOT NULL").select(F.split(p, "/")[0].alias("folder"), X.stem(p).alias("stem"))
    return metrics.naming_drift(rows)


@query("""
SELECT run_id, path, name, line, rule, value, threshold FROM (
  SELECT run_id, path, name, line, 'long_function' AS rule, loc AS value, 80 AS threshold FROM function_metrics
  UNION ALL SELECT run_id, path, name, line, 'complex_function', complexity, 15 FROM function_metrics
  UNION ALL SELECT run_id, path, name, line, 'deep_nesting', nesting_depth, 4 FROM function_metrics
  UNION ALL SELECT run_id, path, name, line, 'many_parameters', parameter_count, 5 FROM function_metrics) WHERE value > threshold
""")
def function_limits(spark, sf_dir):
    limits = {c: (rule, LIMITS[c]) for c, rule in metrics.FUNCTION_RULES.items()}
    return metrics.exceeded(_metrics(spark, sf_dir), ["run_id", "path", "name", "line"], limits)


@query("SELECT run_id, path, name, line, loc, member_count FROM type_metrics WHERE loc > 250 OR member_count > 30")
def large_type(spark, sf_dir):
    rows = metrics.either_exceeded(read_table(spark, sf_dir, "type_metrics"), ("loc", LIMITS["type_lines"]), ("member_count", LIMITS["type_members"]))
    return rows.select("run_id", "path", "name", "line", "loc", "member_count")


@query("""
WITH g AS (SELECT run_id, path, count(*) AS functions, count(*) FILTER (loc <= 5 AND complexity <= 1 AND parameter_count <= 3) AS small, coalesce(sum(loc), 0)::BIGINT AS lines
  FROM function_metrics GROUP BY 1, 2)
SELECT *, CAST(ceil(functions * 100 / greatest(lines, 1)) AS BIGINT) AS density, CAST(floor(small * 100 / functions) AS BIGINT) AS small_percent FROM g
WHERE functions > 1 AND ceil(functions * 100 / greatest(lines, 1)) > 3 AND floor(small * 100 / functions) > 10
""")
def function_proliferation(spark, sf_dir):
    limit = LIMITS | {"functions": 1, "density": 3, "small_percent": 10}  # files here hold few functions
    return metrics.proliferation(_metrics(spark, sf_dir), ["run_id", "path"], F.coalesce(F.sum("loc"), F.lit(0)), limit)


@query(f"""
WITH {_LINES}, s AS (SELECT file_id, unnest(regexp_extract_all("text", '"([^"\\\\]*)"', 1)) AS literal FROM l
  WHERE NOT regexp_matches(ltrim("text"), '^(import|from|export|use|using|package|require)\\b'))
SELECT literal, count(*) AS occurrences, count(DISTINCT file_id) AS files FROM s WHERE strlen(literal) >= 5 GROUP BY 1 HAVING count(*) >= 12 AND count(DISTINCT file_id) >= 2
""")
def repeated_literal(spark, sf_dir):
    return metrics.repeated(facts.literals(_files(spark, sf_dir)), "literal", LIMITS["literals"], files=2)


@query(f"""
WITH {_LINES}, e AS (SELECT file_id, trim(regexp_replace(regexp_replace(regexp_replace(lower("text"), '[0-9]', '#', 'g'), '[''"`]', '"', 'g'), '[ \t]+', ' ', 'g')) AS pattern
  FROM l WHERE regexp_matches(ltrim("text"), '^(except\\b|\\}} *catch\\b|catch\\b|if err != nil)|Err\\([a-z_]*\\) *=>'))
SELECT pattern, count(*) AS occurrences, count(DISTINCT file_id) AS files FROM e GROUP BY 1 HAVING count(*) >= 1
""")
def repeated_error_pattern(spark, sf_dir):
    return metrics.repeated(facts.error_patterns(_files(spark, sf_dir)), "pattern", 1)


_MODULE = """
m AS (SELECT file_id, line, coalesce(nullif(regexp_extract(t, '^from ([A-Za-z0-9_.]+) import', 1), ''), nullif(regexp_extract(t, '^import .*from "([^"]+)"', 1), ''),
  nullif(regexp_extract(t, '^import ([A-Za-z0-9_.]+);?$', 1), ''), nullif(regexp_extract(t, '^use ([A-Za-z0-9_:]+)', 1), ''), nullif(regexp_extract(t, '^using ([A-Za-z0-9_.]+);', 1), '')) AS module
  FROM (SELECT file_id, line, ltrim("text") t FROM l))
"""


@query(f"WITH {_LINES}, {_MODULE} SELECT file_id, count(*) AS imports FROM m WHERE module IS NOT NULL GROUP BY 1 HAVING count(*) > 4")
def import_heavy_file(spark, sf_dir):
    return facts.imports(_files(spark, sf_dir)).groupBy("file_id").agg(F.count("*").alias("imports")).where("imports > 4")


def _module_edges(spark, sf_dir) -> DataFrame:
    """Edges from a file's folder to the first word of what it imports."""
    p = X.normal_path(F.col("display_path"))
    owner = _files(spark, sf_dir).where("display_path IS NOT NULL").select("file_id", F.lower(F.element_at(F.split(X.parent(p), "/"), -1)).alias("src"))
    target = F.lower(F.regexp_extract("module", "^(?:crate::|\\./|\\.\\./)*([A-Za-z0-9]+)", 1))
    used = facts.imports(_files(spark, sf_dir)).select("file_id", target.alias("dst")).where("dst <> ''")
    return used.join(owner, "file_id").where("src <> dst AND src <> '.'").select("src", "dst").distinct()


_EDGES = f"""
{_LINES}, {_MODULE},
o AS (SELECT file_id, lower(list_extract(string_split(d, '/'), -1)) src FROM (
  SELECT file_id, CASE WHEN d = '' THEN '.' ELSE d END d FROM (SELECT file_id, regexp_replace({_NORMAL.format('display_path')}, '/?[^/]*$', '') d FROM source_files WHERE display_path IS NOT NULL))),
e AS (SELECT src, dst FROM (SELECT file_id, lower(regexp_extract(module, '^(?:crate::|\\./|\\.\\./)*([A-Za-z0-9]+)', 1)) dst FROM m WHERE module IS NOT NULL)
  JOIN o USING (file_id) WHERE dst <> '' AND src <> dst AND src <> '.' GROUP BY 1, 2)
"""


@query(f"WITH {_EDGES} SELECT src, dst FROM e")
def module_edges(spark, sf_dir):
    return _module_edges(spark, sf_dir)


def _trade_edges(spark, sf_dir, least: int) -> DataFrame:
    """Customer nation -> supplier nation with at least ``least`` lines."""
    nation = lambda t, k, n: read_table(spark, sf_dir, t).select(k, F.col(n).cast("bigint").alias(n))
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    lines = lines.join(nation("supplier", "s_suppkey", "s_nationkey"), lines["l_suppkey"] == F.col("s_suppkey"))
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    orders = orders.join(nation("customer", "c_custkey", "c_nationkey"), orders["o_custkey"] == F.col("c_custkey"))
    both = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).where("c_nationkey <> s_nationkey")
    return both.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("n")).where(F.col("n") >= least).select("src", "dst")


_TRADE = """e AS (SELECT CAST(c_nationkey AS BIGINT) src, CAST(s_nationkey AS BIGINT) dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2 HAVING count(*) >= {0}),
r AS (SELECT src node, dst reached FROM e UNION SELECT r.node, e.dst FROM r JOIN e ON e.src = r.reached),
c AS (SELECT a.node, least(min(a.reached), a.node) AS component FROM r a JOIN r b ON a.node = b.reached AND a.reached = b.node WHERE a.node <> a.reached GROUP BY a.node)"""


@query("WITH RECURSIVE " + _TRADE.format(120) + " SELECT node, component FROM c")
def trade_cycle(spark, sf_dir):
    found = graph.components(_trade_edges(spark, sf_dir, 120))
    return found.join(found.groupBy("component").agg(F.min("node").alias("m")), "component").select("node", F.col("m").alias("component"))


@query("WITH RECURSIVE " + _TRADE.format(120) + """, k AS (SELECT component, count(*) n FROM c GROUP BY 1),
i AS (SELECT x.component, count(*) m FROM e JOIN c x ON src = x.node JOIN c y ON dst = y.node WHERE x.component = y.component GROUP BY 1)
SELECT k.component, n AS nodes, m AS edges, CAST(floor((m * 200 + n * (n - 1)) / (n * (n - 1) * 2)) AS BIGINT) AS density FROM k JOIN i USING (component)""")
def trade_cycle_density(spark, sf_dir):
    e = _trade_edges(spark, sf_dir, 120)
    found = graph.components(e)
    named = found.join(found.groupBy("component").agg(F.min("node").alias("m")), "component").select("node", F.col("m").alias("component"))
    return graph.cycle_density(e, named)


@query("WITH RECURSIVE " + _TRADE.format(150) + " SELECT node, count(*) AS reachable FROM r WHERE node <> reached GROUP BY 1")
def trade_reach(spark, sf_dir):
    return graph.reach(_trade_edges(spark, sf_dir, 150)).groupBy("node").agg(F.count("*").alias("reachable"))


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


_DEGREES = f"WITH {_EDGES}, d AS (SELECT node, sum(i)::BIGINT fan_in, sum(o)::BIGINT fan_out, (sum(i) + sum(o))::BIGINT AS degree FROM (SELECT src node, 0 i, 1 o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY 1)"


@query(_DEGREES + " SELECT node, fan_in, fan_out, degree FROM d")
def dependency_degrees(spark, sf_dir):
    e = _module_edges(spark, sf_dir)
    return graph.degrees(_nodes(e), e)


@query(_DEGREES + """, p AS (SELECT count(*) n, list_extract(list_sort(list(degree)), CAST(ceil((count(*) - 1) * 0.75) AS BIGINT) + 1) p75 FROM d)
SELECT node, fan_in, fan_out, degree FROM d, p WHERE n >= 8 AND degree >= 6 AND degree >= greatest(1, 2 * p75)""")
def dependency_hub(spark, sf_dir):
    e = _module_edges(spark, sf_dir)
    return graph.hubs(_nodes(e), e)


_CLOSURE = f"WITH RECURSIVE {_EDGES}, r AS (SELECT src node, dst reached FROM e UNION SELECT r.node, e.dst FROM r JOIN e ON e.src = r.reached)"


@query(_CLOSURE + " SELECT node, count(*) AS reachable FROM r WHERE node <> reached GROUP BY 1")
def dependency_reach(spark, sf_dir):
    return graph.reach(_module_edges(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("reachable"))


@query(_CLOSURE + """, c AS (SELECT a.node, min(least(a.reached, a.node)) AS component FROM r a JOIN r b ON a.node = b.reached AND a.reached = b.node WHERE a.node <> a.reached GROUP BY 1)
SELECT node, component FROM c""")
def dependency_cycle(spark, sf_dir):
    # the colour of a component is some member; its smallest one names it here
    c = graph.components(_module_edges(spark, sf_dir))
    return c.join(c.groupBy("component").agg(F.min("node").alias("m")), "component").select("node", F.col("m").alias("component"))


@query(_CLOSURE + """, c AS (SELECT a.node, min(least(a.reached, a.node)) AS component FROM r a JOIN r b ON a.node = b.reached AND a.reached = b.node WHERE a.node <> a.reached GROUP BY 1),
g AS (SELECT DISTINCT coalesce(x.component, src) AS src, coalesce(y.component, dst) AS dst FROM e LEFT JOIN c x ON x.node = src LEFT JOIN c y ON y.node = dst),
d AS (SELECT src, dst FROM g WHERE src <> dst), p AS (SELECT src, dst, 1 AS n FROM d UNION SELECT p.src, d.dst, n + 1 FROM p JOIN d ON d.src = p.dst),
k AS (SELECT src AS component FROM d UNION SELECT dst FROM d)
SELECT component, CAST(coalesce(max(n), 0) AS BIGINT) AS depth FROM k LEFT JOIN p ON p.src = component GROUP BY 1""")
def dependency_depth(spark, sf_dir):
    e = _module_edges(spark, sf_dir)
    c = graph.components(e)
    named = c.join(c.groupBy("component").agg(F.min("node").alias("m")), "component").select("node", F.col("m").alias("component"))
    return graph.depth(e, named)


@query(f"""
WITH {_LINES}, f AS (SELECT file_id, line, regexp_extract("text", '(?:^|[ \t])(?:def|fn|func|function) ([A-Za-z_][A-Za-z0-9_]*)', 1) AS name FROM l),
d AS (SELECT * FROM f WHERE name <> '' AND name NOT IN ('main', 'init', 'setup', 'teardown') AND NOT regexp_matches(name, '^(test_|Test|__)')),
u AS (SELECT name, count(*) uses FROM (SELECT unnest(regexp_extract_all(source, '([A-Za-z_][A-Za-z0-9_]*)', 1)) AS name FROM source_files) GROUP BY 1),
h AS (SELECT name, count(*) heads FROM d GROUP BY 1)
SELECT d.file_id, d.line, d.name FROM d JOIN h USING (name) JOIN u USING (name) WHERE uses <= heads
""")
def unused_function(spark, sf_dir):
    return facts.unused_functions(_files(spark, sf_dir))


@query(f"""
WITH {_LINES}, f AS (SELECT file_id, regexp_extract("text", '(?:^|[ \t])(?:def|fn|func|function) ([A-Za-z_][A-Za-z0-9_]*)', 1) AS name,
  regexp_extract("text", '(?:def|fn|func|function) [A-Za-z_][A-Za-z0-9_]*(?:<[^>]*>)?\\(([^)]*)\\)', 1) AS params FROM l),
n AS (SELECT file_id, list_sort(list_distinct(list_filter(list_transform(string_split(params, ','), lambda p: regexp_extract(trim(p), '^([A-Za-z_][A-Za-z0-9_]*)', 1)),
  lambda p: length(p) > 1 AND p NOT IN ('self', 'cls', 'this', 'mut')))) ns FROM f WHERE name <> '')
SELECT array_to_string(ns, ', ') AS clump, count(*) AS functions, count(DISTINCT file_id) AS files FROM n WHERE len(ns) >= 2 GROUP BY 1 HAVING count(*) >= 2
""")
def data_clump(spark, sf_dir):
    return facts.data_clumps(facts.definitions(_files(spark, sf_dir)), 2, 2)


@query(f"""
WITH {_LINES}, c AS (SELECT file_id, count(*) cases FROM l JOIN source_files f USING (file_id) WHERE f.is_test
  AND regexp_matches(ltrim("text"), '^(def test_|func Test|it\\(|test\\(|#\\[test\\]|@Test|\\[Test\\]|\\[Fact\\])') GROUP BY 1)
SELECT count(DISTINCT f.file_id) AS test_files, count(DISTINCT c.file_id) AS with_cases, coalesce(sum(cases), 0)::BIGINT AS cases FROM source_files f LEFT JOIN c USING (file_id) WHERE f.is_test
""")
def test_case_counts(spark, sf_dir):
    files = _files(spark, sf_dir)
    cases = facts.test_cases(files).groupBy("file_id").agg(F.count("*").alias("cases"))
    return files.where("is_test").select("file_id").join(cases, "file_id", "left").agg(
        F.countDistinct("file_id").alias("test_files"), F.countDistinct(F.when(F.col("cases").isNotNull(), F.col("file_id"))).alias("with_cases"),
        F.coalesce(F.sum("cases"), F.lit(0)).alias("cases"),
    )


@query(r"""
WITH b AS (SELECT file_id, unnest(regexp_extract_all(source, '(?:struct|interface|type|class) ([A-Za-z_][A-Za-z0-9_]*)(?: struct)? \{\r?\n([^{}]*)\}', 2)) AS body FROM source_files),
f AS (SELECT file_id, list_sort(list_distinct(regexp_extract_all(body, '(?m)^[ \t]*(?:pub |private |public |readonly )*([A-Za-z_][A-Za-z0-9_]*)[?]?[: ]', 1))) fs FROM b)
SELECT array_to_string(fs, ',') AS shape, count(*) AS types, count(DISTINCT file_id) AS files FROM f WHERE len(fs) >= 3 GROUP BY 1 HAVING count(*) >= 2
""")
def duplicate_type_shape(spark, sf_dir):
    shapes = facts.type_fields(_files(spark, sf_dir))
    return metrics.repeated(shapes.withColumn("shape", F.array_join("fields", ",")), "shape", 2).withColumnRenamed("occurrences", "types")


@query(r"""
WITH b AS (SELECT file_id, unnest(regexp_extract_all(source, '(?:struct|interface|type|class) ([A-Za-z_][A-Za-z0-9_]*)(?: struct)? \{\r?\n([^{}]*)\}', 2)) AS body FROM source_files),
f AS (SELECT DISTINCT list_sort(list_distinct(regexp_extract_all(body, '(?m)^[ \t]*(?:pub |private |public |readonly )*([A-Za-z_][A-Za-z0-9_]*)[?]?[: ]', 1))) fs FROM b),
k AS (SELECT fs FROM f WHERE len(fs) >= 3)
SELECT array_to_string(least(a.fs, b.fs), ',') AS shape_a, array_to_string(greatest(a.fs, b.fs), ',') AS shape_b, len(list_intersect(a.fs, b.fs)) AS common, greatest(len(a.fs), len(b.fs)) AS longer
FROM k a JOIN k b ON a.fs < b.fs WHERE len(list_intersect(a.fs, b.fs)) >= 3 AND len(list_intersect(a.fs, b.fs)) >= 0.4 * greatest(len(a.fs), len(b.fs))
""")
def shape_overlap(spark, sf_dir):
    return facts.shape_overlaps(facts.type_fields(_files(spark, sf_dir)), 0.4)


@query("""
WITH c AS (SELECT run_id AS commit, repo_id AS author, path, loc AS added, nesting_depth AS deleted FROM function_metrics),
s AS (SELECT commit, sum(coalesce(added, 0) + coalesce(deleted, 0)) sz FROM c GROUP BY 1)
SELECT path, count(DISTINCT commit) AS commits, coalesce(sum(added), 0)::BIGINT AS added, coalesce(sum(deleted), 0)::BIGINT AS deleted, count(DISTINCT author) AS authors,
  (coalesce(sum(added), 0) + coalesce(sum(deleted), 0))::BIGINT AS recent_weighted
FROM c JOIN s USING (commit) WHERE sz <= 20000 GROUP BY 1
""")
def churn(spark, sf_dir):
    changes = _metrics(spark, sf_dir).select(
        F.col("run_id").alias("commit"), F.col("repo_id").alias("author"), "path", F.col("loc").alias("added"), F.col("nesting_depth").alias("deleted")
    )
    return metrics.churn(changes, 20000)


@query("""
WITH p AS (SELECT DISTINCT run_id, family, name AS type_name, line FROM type_metrics WHERE line IS NOT NULL AND family IS NOT NULL),
f AS (SELECT run_id, family, name, line, loc FROM function_metrics WHERE line IS NOT NULL AND loc > 0),
j AS (SELECT p.*, f.name AS symbol, f.line AS symbol_line, row_number() OVER (PARTITION BY p.run_id, p.family, p.type_name, p.line ORDER BY f.line DESC, f.name DESC) k
  FROM p JOIN f ON p.run_id = f.run_id AND p.family = f.family AND p.line >= f.line AND p.line < f.line + f.loc)
SELECT run_id, family, type_name, line, symbol, symbol_line FROM j WHERE k = 1
""")
def innermost_symbol(spark, sf_dir):
    types = read_table(spark, sf_dir, "type_metrics").where("line IS NOT NULL AND family IS NOT NULL").select("run_id", "family", F.col("name").alias("type_name"), "line").distinct()
    points = types.withColumn("point_id", F.struct("run_id", "family", "type_name", "line"))
    found = metrics.innermost(points.select("run_id", "family", "point_id", "line"), _metrics(spark, sf_dir), ["run_id", "family"])
    return found.select("point_id.*", "symbol", "symbol_line")


@query(f"""
WITH {_LINES}, a AS (SELECT file_id, line, CASE WHEN t = '' THEN 'empty' ELSE t END AS anchor FROM (SELECT file_id, line, regexp_replace(trim("text"), '[ \t]+', ' ', 'g') t FROM l))
SELECT file_id, max(ordinal) AS most, count(*) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY file_id, anchor ORDER BY line) AS ordinal FROM a) GROUP BY 1
""")
def line_anchors(spark, sf_dir):
    rows = metrics.ordinal_of_line(facts.lines(_files(spark, sf_dir)))
    return rows.groupBy("file_id").agg(F.max("ordinal").alias("most"), F.count("*").alias("lines"))


def _detections(spark, sf_dir) -> DataFrame:
    e = read_table(spark, sf_dir, "issue_snapshots").select("repo_id", "family", F.col("subject.path").alias("path"), F.col("subject.symbol").alias("symbol"), F.explode("evidence").alias("e"))
    first = F.get("e.measurements", F.lit(0))
    return e.select(
        F.coalesce("family", F.lit("unknown")).alias("family"), F.coalesce("path", F.lit("")).alias("path"), "symbol", F.col("e.rule").alias("rule"),
        F.array_min(F.transform("e.locations", lambda x: x["line"])).alias("line"), first["value"].alias("value"), first["threshold"].alias("threshold"),
        F.coalesce("e.id", F.lit("")).alias("anchor"),
    ).where("rule IS NOT NULL")


_DETECT = """
d AS (SELECT coalesce(family, 'unknown') family, coalesce(subject.path, '') path, subject.symbol AS symbol, e.rule AS rule, coalesce(e.id, '') anchor
  FROM (SELECT family, subject, unnest(evidence) AS e FROM issue_snapshots) WHERE e.rule IS NOT NULL),
i AS (SELECT *, 'ri6-' || substr(sha256('lithoscope' || chr(0) || family || chr(0) || concat_ws('#', path, symbol) || chr(0)), 1, 20) AS issue_id,
  're6-' || substr(sha256('lithoscope' || chr(0) || rule || chr(0) || anchor || chr(0)), 1, 20) AS evidence_id FROM d)
"""


@query(f"WITH {_DETECT} SELECT issue_id, family, min(path) AS path, count(DISTINCT (rule, anchor)) AS evidence_count, min(evidence_id) AS first_evidence FROM i GROUP BY 1, 2")
def issue_aggregation(spark, sf_dir):
    found = issues.issues(issues.evidence(_detections(spark, sf_dir)))
    return found.select("issue_id", "family", "path", F.size("evidence").cast("bigint").alias("evidence_count"), F.get("evidence.evidence_id", F.lit(0)).alias("first_evidence"))


@query(f"WITH {_DETECT} SELECT count(DISTINCT issue_id) AS issue_count, count(DISTINCT (issue_id, rule, anchor)) AS evidence_count, count(DISTINCT rule) AS rules FROM i")
def report_summary(spark, sf_dir):
    found = issues.issues(issues.evidence(_detections(spark, sf_dir)))
    rules = found.select("issue_id", F.explode("evidence.rule").alias("rule"))
    return rules.agg(F.countDistinct("issue_id").alias("issue_count"), F.count("*").alias("evidence_count"), F.countDistinct("rule").alias("rules"))


@query("""
WITH s AS (SELECT path, rule, CASE WHEN hash_ % 2 = 0 THEN 'file' ELSE 'line' END AS scope, line FROM (SELECT path, CASE WHEN complexity > 20 THEN NULL ELSE 'long_function' END AS rule, line % 2 AS hash_, line FROM function_metrics WHERE complexity > 12)),
d AS (SELECT run_id, path, name, line, rule FROM (SELECT run_id, path, name, line, 'long_function' AS rule FROM function_metrics WHERE loc > 40
  UNION ALL SELECT run_id, path, name, line, 'complex_function' FROM function_metrics WHERE complexity > 12))
SELECT d.rule, count(*) AS suppressed FROM d WHERE EXISTS (SELECT 1 FROM s WHERE s.path = d.path AND (s.rule IS NULL OR s.rule = d.rule) AND (s.scope = 'file' OR s.line = d.line)) GROUP BY 1
""")
def suppressed_rules(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    s = m.where("complexity > 12").select(
        "path", F.when(F.col("complexity") > 20, F.lit(None)).otherwise(F.lit("long_function")).alias("rule"),
        F.when(F.col("line") % 2 == 0, "file").otherwise("line").alias("scope"), "line",
    )
    d = metrics.exceeded(m, ["run_id", "path", "name", "line"], {"loc": ("long_function", 40), "complexity": ("complex_function", 12)})
    return issues.suppress(d, s)[1]


@query("""
WITH last AS (SELECT repo_id, snapshot_no, delivery_id, row_number() OVER (PARTITION BY repo_id, snapshot_no ORDER BY delivered_at DESC, delivery_id DESC) r FROM snapshot_deliveries),
o AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY snapshot_no DESC) k FROM last WHERE r = 1),
a AS (SELECT DISTINCT o.repo_id, issue_id FROM issue_snapshots i JOIN o USING (delivery_id) WHERE k = 1),
b AS (SELECT DISTINCT o.repo_id, issue_id FROM issue_snapshots i JOIN o USING (delivery_id) WHERE k = 2)
SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, CASE WHEN b.repo_id IS NULL THEN 'new' WHEN a.repo_id IS NULL THEN 'resolved' ELSE 'unchanged' END AS status, count(*) AS n
FROM a FULL OUTER JOIN b ON a.repo_id = b.repo_id AND a.issue_id = b.issue_id GROUP BY 1, 2
""")
def baseline_comparison(spark, sf_dir):
    d = read_table(spark, sf_dir, "snapshot_deliveries")
    last = d.groupBy("repo_id", "snapshot_no").agg(F.max(F.struct("delivered_at", "delivery_id"))["delivery_id"].alias("delivery_id"))
    newest = last.groupBy("repo_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("snapshot_no", "delivery_id")), asc=False), 1, 2).alias("two"))
    ends = newest.select("repo_id", F.posexplode("two").alias("k", "s")).select(F.col("repo_id").alias("repo"), "k", "s.delivery_id")
    rows = read_table(spark, sf_dir, "issue_snapshots").select("delivery_id", "issue_id").join(ends, "delivery_id").select(F.col("repo").alias("repo_id"), "k", "issue_id")
    compared = issues.baseline_counts(rows.where("k = 1").drop("k"), rows.where("k = 0").drop("k"), ["repo_id", "issue_id"])
    return compared.groupBy("repo_id", "status").agg(F.count("*").alias("n"))


_STATUS = "CASE WHEN parse_failures IS NULL THEN 'unsupported' WHEN parse_failures > 0 THEN 'partial' ELSE 'observed' END"


@query(f"""
WITH r AS (SELECT DISTINCT repo_id, run_id, lower(analysis) AS analysis, started_at, {_STATUS} AS status FROM scan_runs),
k AS (SELECT *, row_number() OVER (PARTITION BY repo_id, analysis ORDER BY started_at DESC, run_id DESC) n FROM r),
c AS (SELECT a.repo_id, a.analysis, b.status AS before, a.status AS after FROM k a JOIN k b ON a.repo_id = b.repo_id AND a.analysis = b.analysis AND a.n = 1 AND b.n = 2)
SELECT repo_id, analysis, before, after FROM c
WHERE (CASE after WHEN 'observed' THEN 3 WHEN 'partial' THEN 2 ELSE 0 END) < (CASE before WHEN 'observed' THEN 3 WHEN 'partial' THEN 2 ELSE 0 END)
""")
def coverage_regression(spark, sf_dir):
    status = F.when(F.col("parse_failures").isNull(), "unsupported").when(F.col("parse_failures") > 0, "partial").otherwise("observed")
    runs = read_table(spark, sf_dir, "scan_runs").select("repo_id", "run_id", F.lower("analysis").alias("analysis"), "started_at", status.alias("status")).distinct()
    # runs of one repository are few
    k = runs.withColumn("n", F.row_number().over(Window.partitionBy("repo_id", "analysis").orderBy(F.desc("started_at"), F.desc("run_id"))))
    newest, before = k.where("n = 1"), k.where("n = 2")
    return issues.regressions(before.join(newest.select("repo_id", "analysis"), ["repo_id", "analysis"], "left_semi"), newest, ["repo_id", "analysis"])


@query("""
SELECT repo_id, lower(trim(repo_name)) AS repo_name, 'rw5-' || substr(sha256(coalesce(workspace_identity, lower(trim(repo_name))) || chr(0)), 1, 20) AS workspace,
  coalesce(source_revision, '') AS revision FROM repositories
""")
def repository_identity(spark, sf_dir):
    name = F.lower(F.trim("repo_name"))
    return read_table(spark, sf_dir, "repositories").select(
        "repo_id", name.alias("repo_name"), X.stable_id("rw5-", F.coalesce("workspace_identity", name)).alias("workspace"), F.coalesce("source_revision", F.lit("")).alias("revision")
    )


_COMPAT = "legacy|deprecated|compat|fallback|shim|obsolete"


_DOC_LINES = _LINES.replace("source_files", "(SELECT doc_id AS file_id, text AS source FROM documents)")


@query(f"WITH {_DOC_LINES}, c AS (SELECT file_id, count(DISTINCT line) AS marker_lines FROM l WHERE regexp_matches(lower(\"text\"), '{_COMPAT}') GROUP BY 1) SELECT file_id, marker_lines FROM c WHERE marker_lines >= 1")
def compatibility_markers(spark, sf_dir):
    texts = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("source"))
    rows = facts.lines(texts).where(F.lower("text").rlike(_COMPAT))
    return rows.groupBy("file_id").agg(F.countDistinct("line").alias("marker_lines")).where("marker_lines >= 1")


# Calls that belong behind a boundary, by kind.
BOUNDARY_CALLS = {"log": "console\\.|log\\.|logger\\.|info!", "http": "fetch\\(|requests\\.|http\\.", "file": "open\\(|fs\\.|File\\."}


@query(f"WITH {_LINES} " + " UNION ALL ".join(
    f"SELECT '{k}' AS kind, count(*) AS lines, count(DISTINCT file_id) AS files FROM l WHERE regexp_matches(\"text\", '{p}') HAVING count(*) >= 4 AND count(DISTINCT file_id) >= 3" for k, p in BOUNDARY_CALLS.items()))
def boundary_calls(spark, sf_dir):
    kinds = F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in BOUNDARY_CALLS.items()])
    rows = facts.lines(_files(spark, sf_dir)).select("file_id", "line", F.explode(F.array_compact(kinds)).alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("lines"), F.countDistinct("file_id").alias("files")).where("lines >= 4 AND files >= 3")


@query(f"""
WITH {_LINES}, f AS (SELECT file_id, regexp_extract("text", '(?:^|[ \t])(?:def|fn|func|function) ([A-Za-z_][A-Za-z0-9_]*)', 1) AS name FROM l),
w AS (SELECT file_id, list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') ws FROM f WHERE name <> ''),
k AS (SELECT file_id, array_to_string(list_sort(list_distinct(list_transform(ws, lambda x: CASE WHEN length(x) > 4 AND suffix(x, 'ies') THEN left(x, length(x) - 3) || 'y' WHEN length(x) > 4 AND suffix(x, 's') THEN left(x, length(x) - 1) ELSE x END))), '_') AS concept, len(ws) n FROM w)
SELECT concept, count(*) AS occurrences, count(DISTINCT file_id) AS files FROM k WHERE n >= 2 GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT file_id) >= 2
""")
def parallel_implementation(spark, sf_dir):
    words = X.name_words(F.col("name"))
    keyed = facts.definitions(_files(spark, sf_dir)).where(F.size(words) >= 2).select("file_id", F.array_join(F.array_sort(F.array_distinct(words)), "_").alias("concept"))
    return metrics.repeated(keyed, "concept", 3, files=2)


@query(f"""
WITH p AS (SELECT run_id, {_NORMAL.format('display_path')} p FROM source_files WHERE display_path IS NOT NULL)
SELECT CASE WHEN regexp_matches(lower(regexp_extract(p, '\\.([^./]+)$', 1)), '^(js|mjs)$') THEN 'javascript' WHEN regexp_matches(p, '\\.ts$') THEN 'typescript' WHEN regexp_matches(p, '\\.py$') THEN 'python'
  WHEN regexp_matches(p, '\\.rs$') THEN 'rust' WHEN regexp_matches(p, '\\.cs$') THEN 'csharp' WHEN regexp_matches(p, '\\.(sh|bash)$') THEN 'bash' ELSE regexp_extract(p, '\\.([^./]+)$', 1) END AS "language",
  count(*) AS files, count(*) FILTER (len(list_filter(string_split(lower(p), '/'), lambda x: x IN ('test', 'tests', '__tests__', 'spec', 'specs', 'editmode', 'playmode') OR suffix(x, '_tests') OR suffix(x, '-tests'))) > 0
    OR regexp_matches(regexp_extract(p, '([^/]*)$', 1), '^tests[.]rs$|^test_|[.]test[.]|[.]spec[.]|_test[.](go|py|rs)$|_tests[.]rs$')) AS tests FROM p GROUP BY 1
""")
def language_inventory(spark, sf_dir):
    p = X.normal_path(F.col("display_path"))
    rows = _files(spark, sf_dir).where("display_path IS NOT NULL").select(X.language(p).alias("language"), X.is_test(p).alias("t"))
    return rows.groupBy("language").agg(F.count("*").alias("files"), F.count_if("t").alias("tests"))


def _calls(spark, sf_dir):
    files = _files(spark, sf_dir)
    facts_ = functions.function_facts(files, streams=True).select("file_id", "name", "language")
    return functions.call_edges(functions.call_names(files), facts_, files)


@query()
def call_edges(spark, sf_dir):
    return _calls(spark, sf_dir)[0]


@query()
def unresolved_calls(spark, sf_dir):
    """Coverage of the call graph: why calls are bound to no function."""
    return _calls(spark, sf_dir)[1]


def _flow(spark, sf_dir):
    e = written(_calls(spark, sf_dir)[0].where("src <> dst"), "calls")
    outs, ins = e.select(F.col("src").alias("node")).distinct(), e.select(F.col("dst").alias("node")).distinct()
    sources = outs.join(ins, "node", "left_anti")
    modules = _nodes(e).withColumn("module", F.split("node", ":")[0])
    return e, sources, ins.join(outs, "node", "left_anti"), modules


@query()
def flow_relays(spark, sf_dir):
    e, sources, _, modules = _flow(spark, sf_dir)
    cut = flow.truncated(e, sources, FLOW_HOPS)
    return flow.relays(flow.simple_paths(e, sources.join(cut, "node", "left_anti"), FLOW_HOPS), modules, 2, 1)


@query()
def flow_truncated(spark, sf_dir):
    """Sources with paths of more hops than are followed; ``flow_relays`` leaves them out."""
    e, sources, _, _ = _flow(spark, sf_dir)
    return flow.truncated(e, sources, FLOW_HOPS).withColumnRenamed("node", "source")


@query()
def flow_fan_out(spark, sf_dir):
    e, sources, sinks, modules = _flow(spark, sf_dir)
    return flow.reached_fan_out(flow.reached(e, sources), sinks, modules, 2, 1)


@query()
def scanned_functions(spark, sf_dir):
    """Facts of a lexical scan of every file."""
    return functions.function_facts(_files(spark, sf_dir)).drop("digest")


@query()
def clone_groups(spark, sf_dir):
    return functions.clone_groups(functions.function_facts(_files(spark, sf_dir)), 40)


@query(f"""
WITH p AS (SELECT repo_id, {_NORMAL.format('display_path')} p FROM source_files WHERE display_path IS NOT NULL),
s AS (SELECT repo_id, regexp_replace(p, '/?[^/]*$', '') d, regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\\.[^.]*$', '') s FROM p),
w AS (SELECT repo_id, CASE WHEN d = '' THEN '.' ELSE d END AS folder,
  unnest(string_split(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '[_.-]', ' ', 'g'), '([^ ])([A-Z])', '\\1 \\2', 'g'), '([^ ])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9 ]', '', 'g')), ' ')) AS word FROM s)
SELECT repo_id, folder, count(DISTINCT word) AS concepts FROM w WHERE length(word) > 2 AND word NOT IN ('mod', 'lib', 'main', 'test') GROUP BY 1, 2 HAVING count(DISTINCT word) > 4
""")
def directory_drift(spark, sf_dir):
    """At the least limit the rule accepts, as folders here are small."""
    rows = _files(spark, sf_dir).where("display_path IS NOT NULL").select("repo_id", X.normal_path(F.col("display_path")).alias("path"))
    return projects.folder_concepts(rows, 4, ["repo_id"])


@query("""
WITH c AS (SELECT repo_id, coalesce(family, 'unknown') AS family, count(*) AS files, count(*) FILTER (is_test) AS tests, count(source) AS readable FROM source_files GROUP BY 1, 2)
SELECT repo_id, family, files, tests, CASE WHEN readable = 0 THEN 'unsupported' WHEN readable < files THEN 'partial' ELSE 'observed' END AS status FROM c
""")
def coverage_by_family(spark, sf_dir):
    c = _files(spark, sf_dir).groupBy("repo_id", F.coalesce("family", F.lit("unknown")).alias("family")).agg(
        F.count("*").alias("files"), F.count_if("is_test").alias("tests"), F.count("source").alias("readable")
    )
    status = F.when(F.col("readable") == 0, "unsupported").when(F.col("readable") < F.col("files"), "partial").otherwise("observed")
    return c.select("repo_id", "family", "files", "tests", status.alias("status"))


@query("""
SELECT run_id, any_value(scanned_files) AS reported_files, any_value(function_count) AS reported_functions, any_value(c) AS metric_rows
FROM (SELECT DISTINCT run_id, scanned_files, function_count FROM scan_runs) JOIN (SELECT run_id, count(*) c FROM function_metrics GROUP BY 1) USING (run_id) GROUP BY 1
""")
def run_totals(spark, sf_dir):
    runs = read_table(spark, sf_dir, "scan_runs").select("run_id", "scanned_files", "function_count").distinct()
    counted = _metrics(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("metric_rows"))
    return runs.join(counted, "run_id").groupBy("run_id").agg(
        F.first("scanned_files").alias("reported_files"), F.first("function_count").alias("reported_functions"), F.first("metric_rows").alias("metric_rows")
    )


@query()
def similar_functions(spark, sf_dir):
    """Leader groups of functions with similar normalised streams.

    Order is that of the first function with a stream (file, line).
    """
    scanned = functions.function_facts(_files(spark, sf_dir).where("NOT coalesce(is_test, false)"), streams=True)
    f = written(scanned.where("tokens >= 80").select("file_id", "line", "language", "digest", "tokens", "stream"), "functions")
    pairs = similarity.similar_streams(f, 0.85, 80)
    place = f.groupBy("digest").agg(F.min(F.col("file_id") * 1_000_000 + F.col("line")).alias("ord"), F.count("*").alias("functions"))
    named = pairs.join(place.select(F.col("digest").alias("a"), F.col("ord").alias("x")), "a").join(place.select(F.col("digest").alias("b"), F.col("ord").alias("y")), "b")
    groups = similarity.leader_groups(place, named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), 2)
    return groups.join(place.withColumnRenamed("ord", "member"), "member").groupBy("leader").agg(F.count("*").alias("streams"), F.sum("functions").alias("functions"))
