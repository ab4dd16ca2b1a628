"""Facts read from the text of source files, one generator for each kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def lines(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``line`` (from 1) and ``text`` of every source line."""
    keep = keep or ["file_id"]
    return files.select(*keep, F.posexplode(T.source_lines(F.col("source"))).alias("at", "text")).select(
        *keep, (F.col("at") + 1).cast("bigint").alias("line"), "text"
    )


def debt_markers(rows: DataFrame) -> DataFrame:
    """Comment-looking lines that hold a todo or fixme."""
    body = F.ltrim(F.col("text"))
    comment = body.rlike("^(//|#|/\\*|\\*|<!--)")
    return rows.where(comment & F.lower("text").rlike("todo|fixme"))


def literals(files: DataFrame, least: int = 5) -> DataFrame:
    """``file_id, literal``: quoted strings of at least ``least`` bytes on one line.

    Lines that import something hold module names and are left out.
    """
    rows = lines(files).where(~F.ltrim("text").rlike("^(import|from|export|use|using|package|require)\\b"))
    found = rows.select("file_id", "line", F.explode(F.regexp_extract_all("text", F.lit('"([^"\\\\]*)"'), 1)).alias("literal"))
    return found.where(F.octet_length("literal") >= least)


def imports(files: DataFrame) -> DataFrame:
    """``file_id, line, module`` of import lines of the known languages."""
    rows = lines(files)
    t = F.ltrim("text")
    module = F.coalesce(
        F.nullif(F.regexp_extract(t, "^from ([A-Za-z0-9_.]+) import", 1), F.lit("")),
        F.nullif(F.regexp_extract(t, "^import .*from \"([^\"]+)\"", 1), F.lit("")),
        F.nullif(F.regexp_extract(t, "^import ([A-Za-z0-9_.]+);?$", 1), F.lit("")),
        F.nullif(F.regexp_extract(t, "^use ([A-Za-z0-9_:]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(t, "^using ([A-Za-z0-9_.]+);", 1), F.lit("")),
    )
    return rows.select("file_id", "line", module.alias("module")).where(F.col("module").isNotNull())


def definitions(files: DataFrame) -> DataFrame:
    """``file_id, line, name, params``: functions by their heading."""
    rows = lines(files)
    name = F.regexp_extract("text", "(?:^|[ \t])(?:def|fn|func|function) ([A-Za-z_][A-Za-z0-9_]*)", 1)
    params = F.regexp_extract("text", "(?:def|fn|func|function) [A-Za-z_][A-Za-z0-9_]*(?:<[^>]*>)?\\(([^)]*)\\)", 1)
    return rows.select("file_id", "line", name.alias("name"), params.alias("params")).where("name <> ''")


def parameter_names(params) -> object:
    """Names of a heading's parameter list; receivers are dropped."""
    parts = F.transform(F.split(params, ","), lambda p: F.regexp_extract(F.trim(p), "^([A-Za-z_][A-Za-z0-9_]*)", 1))
    return F.filter(parts, lambda p: (p != "") & ~p.isin("self", "cls", "this", "mut"))


def data_clumps(functions: DataFrame, least: int, names_least: int = 3) -> DataFrame:
    """``clump, functions, files``: equal sets of ``names_least`` parameter names or more."""
    names = F.array_sort(F.array_distinct(F.filter(parameter_names(F.col("params")), lambda p: F.length(p) > 1)))
    keyed = functions.select("file_id", names.alias("names")).where(F.size("names") >= names_least)
    return (
        keyed.groupBy(F.array_join("names", ", ").alias("clump"))
        .agg(F.count("*").alias("functions"), F.countDistinct("file_id").alias("files"))
        .where(F.col("functions") >= least)
    )


def identifiers(files: DataFrame) -> DataFrame:
    """``name, uses``: identifiers of all files, counted in one map-side aggregation."""
    return files.select(F.explode(F.regexp_extract_all("source", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1)).alias("name")).groupBy("name").agg(F.count("*").alias("uses"))


def unused_functions(files: DataFrame) -> DataFrame:
    """Functions whose name is used nowhere but in their own heading.

    Entry points, tests and dunder names don't count as unused.
    """
    defs = definitions(files).where(~F.col("name").isin("main", "init", "setup", "teardown") & ~F.col("name").rlike("^(test_|Test|__)"))
    heads = defs.groupBy("name").agg(F.count("*").alias("heads"))
    spare = heads.join(identifiers(files), "name").where("uses <= heads").select("name")
    return defs.join(spare, "name").select("file_id", "line", "name")


def error_patterns(files: DataFrame) -> DataFrame:
    """``file_id, line, pattern``: normalised error-handling lines."""
    rows = lines(files)
    hit = F.ltrim("text").rlike("^(except\\b|\\} *catch\\b|catch\\b|if err != nil)|Err\\([a-z_]*\\) *=>")
    return rows.where(hit).select("file_id", "line", T.normal_line(F.col("text")).alias("pattern"))


def test_cases(files: DataFrame) -> DataFrame:
    """Line prefixes that open a test case, in test files."""
    rows = lines(files.where("is_test"))
    return rows.where(F.ltrim("text").rlike("^(def test_|func Test|it\\(|test\\(|#\\[test\\]|@Test|\\[Test\\]|\\[Fact\\])"))


def type_fields(files: DataFrame) -> DataFrame:
    """``file_id, type_name, fields`` of types with at least three fields.

    Braced bodies whose fields are one to a line, and Python class annotations.
    """
    head = "(?:struct|interface|type|class) ([A-Za-z_][A-Za-z0-9_]*)(?: struct)? \\{\\r?\\n([^{}]*)\\}"
    bodies = F.arrays_zip(
        F.regexp_extract_all("source", F.lit(head), 1).alias("name"), F.regexp_extract_all("source", F.lit(head), 2).alias("body")
    )
    rows = files.select("file_id", F.explode(bodies).alias("b")).select("file_id", F.col("b.name").alias("type_name"), F.col("b.body").alias("body"))
    field = "(?m)^[ \\t]*(?:pub |private |public |readonly )*([A-Za-z_][A-Za-z0-9_]*)[?]?[: ]"
    fields = F.array_sort(F.array_distinct(F.regexp_extract_all("body", F.lit(field), 1)))
    return rows.select("file_id", "type_name", fields.alias("fields")).where(F.size("fields") >= 3)


def shape_overlaps(shapes: DataFrame, share: float = 0.75) -> DataFrame:
    """Pairs of different shapes that share three or more fields and ``share``
    of the longer list. One row per distinct field list, not per type.

    Candidates meet on a field in a prefix of the list ordered by rarity: with
    ``p = n - ceil(share * n) + 1`` fields no qualifying pair is missed, and
    frequent fields hardly ever are among them.
    """
    kinds = shapes.groupBy("fields").agg(F.count("*").alias("types"), F.countDistinct("file_id").alias("files"))
    kinds = kinds.select(F.xxhash64("fields").alias("shape"), "fields", "types", "files")
    rarity = kinds.select(F.explode("fields").alias("field")).groupBy("field").agg(F.count("*").alias("df"))
    ranked = (
        kinds.select("shape", F.size("fields").alias("n"), F.explode("fields").alias("field"))
        .join(rarity, "field")
        .groupBy("shape", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "field"))).alias("r"))
    )
    prefix = ranked.select("shape", F.explode(F.slice("r", F.lit(1), (F.col("n") - F.ceil(F.lit(share) * F.col("n")) + 1).cast("int"))).alias("p")).select("shape", "p.field")
    other = prefix.withColumnRenamed("shape", "other")
    met = prefix.join(other, "field").where("shape < other").select("shape", "other").distinct()
    a, b = kinds.alias("a"), kinds.alias("b")
    pairs = met.join(a, met["shape"] == F.col("a.shape")).join(b, met["other"] == F.col("b.shape"))
    common = F.size(F.array_intersect("a.fields", "b.fields"))
    longer = F.greatest(F.size("a.fields"), F.size("b.fields"))
    return pairs.select(
        F.array_join("a.fields", ",").alias("x"), F.array_join("b.fields", ",").alias("y"), common.cast("bigint").alias("common"), longer.cast("bigint").alias("longer")
    ).where((F.col("common") >= 3) & (F.col("common") >= F.col("longer") * share)).select(
        F.least("x", "y").alias("shape_a"), F.greatest("x", "y").alias("shape_b"), "common", "longer"
    )
