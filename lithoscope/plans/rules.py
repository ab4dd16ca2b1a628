"""Rules over names, keys, folders and imports, by repository, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import drift, graph, imports, metrics
from ..session import read_table, written
from .codebase import _LINES, _NORMAL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BY = ["repo_id"]


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return wrap


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a file delivered again under another id is one file of its path
    return read_table(spark, sf_dir, "source_files").select("repo_id", "display_path", "source", "is_test")


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_SING = "CASE WHEN length({0}) > 4 AND suffix({0}, 'ies') THEN left({0}, length({0}) - 3) || 'y' WHEN length({0}) > 4 AND suffix({0}, 's') THEN left({0}, length({0}) - 1) ELSE {0} END"
_ONE = _SING.format("w")


def _words(x: str) -> str:
    return (
        f"list_transform(list_filter(string_split(regexp_replace(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g'), ' '), "
        f"lambda w: w <> ''), lambda w: {_ONE})"
    )


def _path_words(x: str) -> str:
    return f"flatten(list_transform(list_filter(string_split({x}, '/'), lambda p: p <> ''), lambda p: {_words(chr(40) + 'regexp_replace(p, ' + chr(39) + chr(92) + '.[^.]*$' + chr(39) + ', ' + chr(39) * 2 + '))')}))"


def _useful(w: str) -> str:
    return f"length({w}) > 2 AND NOT list_contains({_sql_list(drift.STOP_WORDS)}, {w}) AND NOT regexp_matches({w}, '^[0-9]+$')"


def _key(words: str, stop: list[str], most: int) -> str:
    # the first words in order, each once
    kept = f"list_filter(list_transform({words}, lambda w: {_ONE}), lambda w: {_useful('w')} AND NOT list_contains({_sql_list(stop)}, w))"
    return f"array_to_string(list_slice(list_filter({kept}, lambda w, i: list_position({kept}, w) = i), 1, {most}), ' ')"


_ROWS = f"""
{_LINES},
r AS (SELECT f.repo_id, f.file_id, {_NORMAL.format('f.display_path')} AS path, coalesce(f.is_test, false) AS is_test FROM source_files f WHERE display_path IS NOT NULL AND source IS NOT NULL),
k AS (SELECT repo_id, path, is_test, line, regexp_extract("text", '^(.*?)(?:$|//|#)', 1) AS code FROM r JOIN l USING (file_id))
"""
_CALLABLES = rf"""
{_ROWS},
t AS (SELECT repo_id, path, is_test, line, regexp_replace(regexp_replace(regexp_replace(code, '^\s+|\s+$', '', 'g'), '^(export )+', ''), '^(pub )*(async )*', '') AS t FROM k),
c AS (SELECT repo_id, path, is_test, line, coalesce(nullif(regexp_extract(t, '^func (?:\s*\([^)]*\))?\s*([A-Za-z_][A-Za-z0-9_-]*)\s*(?:\(|$)', 1), ''),
  nullif(regexp_extract(t, '^(?:def|fn|function) \s*([A-Za-z_][A-Za-z0-9_-]*)\s*(?:\(|$)', 1), ''), nullif(regexp_extract(t, '^class \s*([A-Za-z_][A-Za-z0-9_-]*)\s*(?:[(:{{]|$)', 1), ''),
  CASE WHEN contains(t, '=>') OR contains(t, 'function') THEN nullif(regexp_extract(t, '^(?:const|let|var) \s*([A-Za-z_][A-Za-z0-9_-]*)\s*(?:[=:]|$)', 1), '') END) AS name FROM t)
"""


def _grouped(rows: str, least: int) -> str:
    return f"""SELECT repo_id, key, count(DISTINCT (path, line, name)) AS occurrences, count(DISTINCT path) AS files FROM ({rows}) WHERE key <> ''
GROUP BY 1, 2 HAVING count(DISTINCT (path, line, name)) >= {least} AND count(DISTINCT path) >= 2"""


def _any(words: str, wanted: list[str]) -> str:
    return f"list_has_any({words}, {_sql_list(wanted)})"


@query(_grouped(
    f"SELECT repo_id, path, coalesce(line, -1) AS line, name, {_key(_words('name'), drift.CAPABILITY_STOP, 4)} AS key FROM function_metrics "
    f"WHERE name IS NOT NULL AND path IS NOT NULL AND NOT coalesce(is_test, false) AND {_any(_words('name'), drift.CAPABILITY_WORDS)}", 3
).replace("WHERE key <> ''", "WHERE contains(key, ' ')"))
def parallel_capability(spark, sf_dir):
    """Capabilities implemented in several files of a repository."""
    named = read_table(spark, sf_dir, "function_metrics").select("repo_id", "path", F.coalesce("line", F.lit(-1)).alias("line"), "name", "is_test")
    return drift.parallel_implementations(named, BY)


@query(f"WITH {_CALLABLES} " + _grouped(
    f"SELECT repo_id, path, line, name, {_key(_words('name'), drift.HELPER_STOP, 3)} AS key FROM c WHERE name IS NOT NULL AND NOT is_test AND {_any(_path_words('path'), drift.HELPER_WORDS)}", 3))
def shadowed_abstraction(spark, sf_dir):
    return drift.shadowed_abstractions(_files(spark, sf_dir), BY)


@query(f"WITH {_CALLABLES} " + _grouped(
    f"SELECT repo_id, path, line, name, {_key(f'list_concat({_words(chr(110) + chr(97) + chr(109) + chr(101))}, list_filter({_path_words(chr(112) + chr(97) + chr(116) + chr(104))}, lambda w: NOT list_contains({_sql_list(drift.BUCKET_WORDS)}, w)))', drift.FIXTURE_WORDS, 3)} AS key "
    f"FROM c WHERE name IS NOT NULL AND is_test AND {_any(_words('name'), drift.FIXTURE_WORDS)}", 3))
def fixture_factory_drift(spark, sf_dir):
    return drift.fixture_factories(_files(spark, sf_dir), BY)


@query(rf"""WITH {_ROWS},
q AS (SELECT repo_id, path, line, unnest(list_concat(
  list_transform(regexp_extract_all(code, '("(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''|`(?:[^`\\]|\\.)*`)'), lambda s: substr(s, 2, length(s) - 2)),
  CASE WHEN regexp_matches(lower(code), 'const |static |const_|public const') THEN regexp_split_to_array(code, '[^A-Za-z0-9_]') ELSE [] END)) AS key FROM k WHERE NOT is_test)
""" + _grouped(f"""SELECT *, key AS name FROM q WHERE length(key) >= 4 AND (starts_with(key, '/') AND length(key) - length(replace(key, '/', '')) >= 2 AND NOT contains(key, ' ')
  OR NOT starts_with(key, '/') AND regexp_matches(key, '^[A-Z0-9_]+$') AND contains(key, '_') AND list_has_any(string_split(lower(key), '_'), {_sql_list(drift.KEY_WORDS)}))""", 3))
def config_key_drift(spark, sf_dir):
    return drift.config_keys(_files(spark, sf_dir), BY)


@query()
def generic_bucket_drift(spark, sf_dir):
    """Tested against brute force on a fixture."""
    return drift.generic_buckets(_files(spark, sf_dir), BY)


@query()
def adapter_boundary_bypass(spark, sf_dir):
    """Tested against brute force on a fixture."""
    return drift.boundary_bypasses(_files(spark, sf_dir), BY)


def _imports(spark, sf_dir) -> DataFrame:
    """Resolved imports of all files of known families."""
    files = read_table(spark, sf_dir, "source_files").select("repo_id", X.normal_path(F.col("display_path")).alias("path"), "source").where("path IS NOT NULL")
    # of a path delivered more than once, one text
    files = files.groupBy("repo_id", "path").agg(F.max("source").alias("source"))
    return imports.resolved(imports.specifiers(files, BY), files.select("repo_id", "path"), BY)


@query()
def import_resolution(spark, sf_dir):
    """Specifiers, edges and unresolved local imports by repository and family."""
    found = _imports(spark, sf_dir)
    return found.groupBy("repo_id", "family").agg(
        F.count("*").alias("specifiers"), F.count("dst").alias("resolved"), F.count_if(imports.unresolved(found)).alias("unresolved")
    )


def _edges(spark, sf_dir) -> DataFrame:
    place = lambda c: F.concat_ws(":", F.coalesce(F.col("repo_id").cast("string"), F.lit("")), c)
    return written(_imports(spark, sf_dir).where("dst IS NOT NULL AND dst <> src").select(place("src").alias("src"), place("dst").alias("dst")).distinct(), "file-edges")


@query()
def file_dependency_cycle(spark, sf_dir):
    """Cycles of files that import each other, with their density."""
    e = _edges(spark, sf_dir)
    found = graph.components(e)
    named = written(found.join(found.groupBy("component").agg(F.min("node").alias("m")), "component").select("node", F.col("m").alias("component")), "file-cycles")
    return graph.cycle_density(e, named)


@query()
def file_dependency_degrees(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graph.degrees(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), e)


def _per_preset(column: str) -> str:
    return " ".join(f"WHEN '{k}' THEN {v[column]}" for k, v in metrics.PRESETS.items())


_PRESET_VALUES = ", ".join(f"('{k}')" for k in metrics.PRESETS)


@query(f"""
WITH p AS (SELECT * FROM (VALUES {_PRESET_VALUES}) v(preset)),
f AS (SELECT 'large_file' AS rule, len(string_split(source, chr(10))) - CASE WHEN source = '' OR suffix(source, chr(10)) THEN 1 ELSE 0 END AS v FROM source_files WHERE source IS NOT NULL),
m AS (SELECT 'long_function' AS rule, loc AS v FROM function_metrics UNION ALL SELECT 'complex_function', complexity FROM function_metrics
  UNION ALL SELECT 'deep_nesting', nesting_depth FROM function_metrics UNION ALL SELECT 'many_parameters', parameter_count FROM function_metrics UNION ALL SELECT * FROM f),
t AS (SELECT preset, rule, v, CASE rule WHEN 'large_file' THEN CASE preset {_per_preset('file_lines')} END WHEN 'long_function' THEN CASE preset {_per_preset('loc')} END
  WHEN 'complex_function' THEN CASE preset {_per_preset('complexity')} END WHEN 'deep_nesting' THEN CASE preset {_per_preset('nesting_depth')} END ELSE CASE preset {_per_preset('parameter_count')} END END AS threshold FROM m CROSS JOIN p)
SELECT preset, rule, CAST(threshold AS BIGINT) AS threshold, count(*) AS findings, max(v)::BIGINT AS largest FROM t WHERE v > threshold GROUP BY 1, 2, 3
""")
def findings_by_preset(spark, sf_dir):
    """How many functions and files exceed the limits of each preset."""
    rows = read_table(spark, sf_dir, "function_metrics").select(F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("limit"), F.col(c).alias("v")) for c, rule in metrics.FUNCTION_RULES.items()
    ])).alias("m")).select("m.*")
    files = read_table(spark, sf_dir, "source_files").where("source IS NOT NULL").select(F.lit("large_file").alias("rule"), F.lit("file_lines").alias("limit"), X.loc(F.col("source")).alias("v"))
    # a value meets the limits of three presets, in its own row
    limits = F.create_map(*[x for k, v in metrics.PRESETS.items() for x in (F.lit(k), F.create_map(*[y for c, n in v.items() for y in (F.lit(c), F.lit(n))]))])
    each = rows.unionByName(files).select("rule", "limit", "v", F.explode(limits).alias("preset", "limits"))
    over = each.select("preset", "rule", F.try_element_at("limits", F.col("limit")).cast("bigint").alias("threshold"), "v").where("v > threshold")
    return over.groupBy("preset", "rule", "threshold").agg(F.count("*").alias("findings"), F.max("v").alias("largest"))
