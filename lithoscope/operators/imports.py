"""Imports of files and the dependency graph between files.

Specifiers are read from lines, resolved against the files of a repository and
give edges ``src -> dst`` by path; what is local and names no file is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Endings of each family of languages, in the order they are tried.
ENDINGS = {
    "rust": ["rs"], "javascript": ["ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "vue"], "python": ["py"], "ruby": ["rb"],
    "c": ["c", "h", "cc", "cpp", "cxx", "hh", "hpp", "hxx"],
}
# Stems of files that stand for their folder.
ROOT_STEMS = ["main", "lib", "mod"]


def family(path: Column) -> Column:
    """Family of the path's ending, null where imports are not followed."""
    pairs = F.create_map(*[F.lit(x) for name, ends in ENDINGS.items() for e in ends for x in (e, name)])
    return F.try_element_at(pairs, F.regexp_extract(path, "\\.([^./]+)$", 1))


def script_blocks(source: Column) -> Column:
    """A component file with everything outside its script elements blanked, lines kept."""
    parts = F.split(F.regexp_replace(source, "(?is)(<script\\b[^>]*>)(.*?)(</script>)", "$1\u0001$2\u0002$3"), "\u0001", -1)
    blank = lambda s: F.regexp_replace(s, "[^\\n]", " ")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(
        F.split(p, "\u0002", -1)[0], blank(F.array_join(F.slice(F.split(p, "\u0002", -1), 2, F.size(F.split(p, "\u0002", -1))), " "))))
    return F.concat(blank(parts[0]), F.array_join(rest, " "))


def specifiers(files: DataFrame, by: list[str]) -> DataFrame:
    """``by, src, family, line, kind, specifier`` of import lines.

    ``files``: by, path, source. ``kind`` is ``module`` (a Rust module), ``path``
    (a module whose path is given on the line before, attributes between) or
    ``import``. Comment lines import nothing.
    """
    f = family(F.col("path"))
    text = F.when(F.col("path").endswith(".vue"), script_blocks(F.col("source"))).otherwise(F.col("source"))
    rows = files.where(F.col("path").isNotNull() & F.col("source").isNotNull() & f.isNotNull())
    lines = rows.select(*by, F.col("path").alias("src"), f.alias("family"), F.posexplode(X.source_lines(text)).alias("line", "raw"))
    t = F.regexp_replace("raw", "^\\s+|\\s+$", "")
    quoted = lambda c: F.regexp_extract(c, "[\"']([^\"']*)[\"']", 1)
    plain = ~t.rlike("^(//|#|/\\*|\\*)") & (t != "")
    js = F.when(
        t.rlike("^(import|export) |require\\(|import\\("),
        F.when(t.contains(" from "), quoted(F.regexp_extract(t, " from (.*)$", 1)))
        .when(t.rlike("^(import|export) "), quoted(t)).otherwise(quoted(F.regexp_extract(t, "((?:require|import)\\(.*)$", 1))),
    )
    dots, name = F.regexp_extract(t, "^from (\\.[\\w.]*) import ", 1), F.regexp_extract(t, "^from \\.+ import ([A-Za-z0-9_]+)", 1)
    python = F.when(dots.rlike("^\\.+$") & (name != ""), F.concat(dots, name)).otherwise(dots)
    module = F.regexp_extract(F.regexp_replace(t, "//.*$", ""), "^(?:pub(?:\\([^)]*\\))? +)?mod +([A-Za-z0-9_]+) *; *$", 1)
    found = (
        F.when((F.col("family") == "javascript") & plain, js).when((F.col("family") == "python") & plain, python)
        .when((F.col("family") == "ruby") & plain, quoted(F.regexp_extract(t, "^require_relative (.*)$", 1)))
        .when(F.col("family") == "c", F.regexp_extract(t, "^#include \"([^\"]*)\"", 1)).when((F.col("family") == "rust") & plain, module)
    )
    given = F.when((F.col("family") == "rust") & t.rlike("^#\\[path"), quoted(t))
    # lines that neither end nor hold a given path: attributes, blank ones, comments
    passes = (F.col("family") == "rust") & ((t == "") | t.rlike("^(#\\[|//)")) & given.isNull()
    w = Window.partitionBy(*by, "src").orderBy("line")
    # within one file; only files that give paths need the window's sort to matter
    seen = lines.select(*by, "src", "family", "line", found.alias("found"), given.alias("given"), passes.alias("passes"))
    seen = seen.where(~F.col("passes") & ((F.col("family") == "rust") | (F.col("found") != "")))
    before = seen.withColumn("before", F.when(F.col("family") == "rust", F.lag("given").over(w)))
    kind = F.when(F.col("before").isNotNull(), "path").when(F.col("family") == "rust", "module").otherwise("import")
    return before.where("found <> ''").select(*by, "src", "family", (F.col("line") + 1).cast("bigint").alias("line"), kind.alias("kind"), F.coalesce("before", "found").alias("specifier"))


def resolved(found: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """``found`` with ``dst``: the first existing candidate, null without one.

    Candidates are the path itself, then with each ending of the family, then
    the folder's index file (``mod.rs`` for Rust). Dotted Python names lose
    their last words until one is found. Folded at any depth.
    """
    rows = found.distinct()
    folder = F.regexp_replace(F.col("src"), "/?[^/]*$", "")
    stem = X.stem(F.col("src"))
    home = F.when(stem.isin(ROOT_STEMS), folder).otherwise(F.concat_ws("/", F.nullif(folder, F.lit("")), stem))
    # each dot after the first goes up one folder
    dots = F.length(F.regexp_extract("specifier", "^(\\.*)", 1))
    names = F.filter(F.split(F.regexp_replace("specifier", "^\\.+", ""), "\\."), lambda x: x.rlike("^[A-Za-z0-9_]+$"))
    up = F.array_repeat(F.lit(".."), F.greatest(dots - 1, F.lit(0)))
    tails = F.transform(F.sequence(F.size(names), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.concat(F.array(folder), up, F.slice(names, F.lit(1), n)), "/"))
    base = (
        F.when(F.col("kind") == "module", F.array(F.concat_ws("/", F.nullif(home, F.lit("")), F.col("specifier"))))
        .when((F.col("family") == "python") & (F.size(names) > 0), tails)
        .when((F.col("family") == "javascript") & ~F.col("specifier").startswith("."), F.array().cast("array<string>"))
        .when(F.col("family") != "python", F.array(F.concat_ws("/", F.nullif(folder, F.lit("")), F.col("specifier"))))
        .otherwise(F.array().cast("array<string>"))
    )
    tries = rows.withColumn("bases", base).select(*found.columns, F.posexplode("bases").alias("step", "base"))
    tries = tries.withColumn("base", F.regexp_replace(X.folded_path(F.regexp_replace("base", "^/", "")), "^(\\.\\./)+", ""))
    ends = F.create_map(*[
        x for name, es in ENDINGS.items()
        for x in (F.lit(name), F.array(*[F.lit(f".{e}") for e in es], *([F.lit("/mod.rs")] if name == "rust" else [F.lit(f"/index.{e}") for e in es])))
    ])
    bare = ~X.file_name(F.col("base")).contains(".")
    some = F.when(bare, F.concat(F.array(F.lit("")), F.element_at(ends, F.col("family")))).otherwise(F.array(F.lit("")))
    tries = tries.select(*found.columns, "step", "base", F.posexplode(some).alias("rank", "ending")).withColumn("dst", F.concat("base", "ending"))
    known = files.where("path IS NOT NULL").select(*by, F.col("path").alias("dst")).distinct()
    kind = "struct<step: int, rank: int, dst: string>"
    hit = tries.join(known, [*by, "dst"]).select(*found.columns, F.struct("step", "rank", "dst").cast(kind).alias("hit"))
    every = rows.select(*found.columns, F.lit(None).cast(kind).alias("hit")).unionByName(hit)
    return every.groupBy(*found.columns).agg(F.min("hit")["dst"].alias("dst"))


def unresolved(edges: DataFrame) -> Column:
    """Local specifiers of a source ending or none that name no file."""
    local = (F.col("family") != "javascript") | F.col("specifier").startswith(".")
    ending = F.regexp_extract(F.col("specifier"), "\\.([A-Za-z0-9_]+)$", 1)
    known = F.create_map(*[x for name, es in ENDINGS.items() for x in (F.lit(name), F.array(*map(F.lit, es)))])
    named = (F.col("family") == "python") | (ending == "") | F.array_contains(F.element_at(known, F.col("family")), ending)
    return F.col("dst").isNull() & local & named


def simple_cycles(edges: DataFrame) -> DataFrame:
    """``members``: sorted node sets of simple cycles of two nodes or more.

    For small graphs (assemblies of a project): all simple paths are followed,
    each from its smallest node, so a cycle is found once for each direction.
    """
    from ..session import written

    e = written(edges.where("src <> dst").select("src", "dst").distinct(), "cycle-edges")
    front = e.where("src < dst").select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    found = None
    while True:
        front = written(front, "cycle-paths")
        if front.isEmpty():
            break
        step = front.join(e, front["at"] == e["src"])
        closed = step.where(F.col("dst") == F.get("path", F.lit(0))).select(F.array_sort("path").alias("members"))
        found = closed if found is None else found.union(closed)
        front = step.where((F.col("dst") > F.get("path", F.lit(0))) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
    if found is None:
        return e.select(F.array("src").alias("members")).limit(0)
    return found.distinct()
