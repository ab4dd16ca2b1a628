"""Drift of concepts: names, keys and folders that grow apart or together.

All rules read lines of source text and words of names and paths, group by a
key and count; everything stays in built-in expressions. ``files`` has
``display_path``, ``source`` and ``is_test``; further columns named in ``by``
(a repository, say) keep groups apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Words of the rules.
STOP_WORDS = "api app cmd for from get has impl index main mod new old src test tests the this type use with".split()
CAPABILITY_WORDS = "adapt adapter build cache client config load logger map normalize parse retry validate".split()
CAPABILITY_STOP = "a and do for from get has is make new of set the to with".split()
HELPER_WORDS = "common helper helpers shared util utils adapter normalizer validator mapper factory".split()
HELPER_STOP = "common helper helpers shared util utils factory make create build get set".split()
FIXTURE_WORDS = "builder dummy factory fake fixture mock sample setup test".split()
BUCKET_WORDS = "common helper helpers lib misc shared util utils".split()
KEY_WORDS = "api auth base client code config database db endpoint env error host key path port route secret service token url".split()
ENTRY_WORDS = "bin cli cmd command commands script scripts tool tools bench benches benchmark benchmarks differential oracle".split()
BOUNDARY_WORDS = {
    "HTTP": "adapter adapters api client clients gateway http request transport".split(),
    "config": "config configuration env setting settings".split(),
    "filesystem": "dao file filesystem persistence repository storage store".split(),
    "logging": "log logger logging telemetry trace tracing".split(),
}
DIRECT_CALLS = {
    "HTTP": ["fetch(", "axios.", "axios(", "requests.get(", "requests.post(", "reqwest::", "hyper::", "http.client"],
    "config": ["process.env", "std::env::var", "env::var(", "os.environ", "os.getenv(", "getenv("],
    "filesystem": ["fs.readfile", "fs.writfile", "fs.writefile", "std::fs::read", "std::fs::write", "file::open", "read_to_string"],
    "logging": ["console.log(", "println!(", "dbg!(", "print(", "log.printf(", "log.println("],
}


#: a quoted text; possessive, so that long ones need no stack
QUOTED = "|".join(q + "[^Q\\\\]*+(?:\\\\.[^Q\\\\]*+)*+".replace("Q", q) + q for q in "\"'`")


def _singular(word: Column) -> Column:
    return (
        F.when((F.length(word) > 4) & word.endswith("ies"), F.concat(F.substring(word, 1, F.length(word) - 3), F.lit("y")))
        .when((F.length(word) > 4) & word.endswith("s"), F.substring(word, 1, F.length(word) - 1))
        .otherwise(word)
    )


def identifier_words(name: Column) -> Column:
    """Words of a name, broken at signs and before a capital after a small letter or digit; naive singular."""
    spaced = F.regexp_replace(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+", " ")
    return F.transform(F.filter(F.split(spaced, " "), lambda w: w != ""), _singular)


def path_words(path: Column) -> Column:
    """Words of all parts of a path, the ending of each part cut off."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.flatten(F.transform(parts, lambda p: identifier_words(F.regexp_replace(p, "\\.[^.]*$", ""))))


def useful(word: Column) -> Column:
    return (F.length(word) > 2) & ~word.isin(STOP_WORDS) & ~word.rlike("^[0-9]+$")


def concept_key(words: Column, stop: list[str], most: int) -> Column:
    """The first ``most`` different useful words, joined by blanks."""
    kept = F.filter(F.transform(words, _singular), lambda w: useful(w) & ~w.isin(stop))
    return F.array_join(F.slice(F.array_distinct(kept), 1, most), " ")


def has_any(words: Column, wanted: list[str]) -> Column:
    return F.exists(words, lambda w: w.isin(wanted))


def code_part(line: Column) -> Column:
    """A line up to its first ``//`` or ``#``."""
    return F.regexp_extract(line, "^(.*?)(?:$|//|#)", 1)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def callable_name(line: Column) -> Column:
    """The function, class or callable binding a line begins to define; null without one."""
    t = F.regexp_replace(F.regexp_replace(_trimmed(code_part(line)), "^(export )+", ""), "^(pub )*(async )*", "")
    name = "[A-Za-z_][A-Za-z0-9_-]*"
    found = [
        F.regexp_extract(t, f"^func (?:\\s*\\([^)]*\\))?\\s*({name})\\s*(?:\\(|$)", 1),
        F.regexp_extract(t, f"^(?:def|fn|function) \\s*({name})\\s*(?:\\(|$)", 1),
        F.regexp_extract(t, f"^class \\s*({name})\\s*(?:[(:{{]|$)", 1),
        F.when(t.contains("=>") | t.contains("function"), F.regexp_extract(t, f"^(?:const|let|var) \\s*({name})\\s*(?:[=:]|$)", 1)),
    ]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])


def _rows(files: DataFrame, by: list[str], keep: list[Column] | None = None) -> DataFrame:
    path = X.normal_path(F.col("display_path"))
    base = files.where(F.col("display_path").isNotNull() & F.col("source").isNotNull())
    return base.select(*by, path.alias("path"), F.coalesce("is_test", F.lit(False)).alias("is_test"), "source", *(keep or []))


def callables(files: DataFrame, by: list[str]) -> DataFrame:
    """``by, path, is_test, line, name`` of named definitions."""
    lines = _rows(files, by).select(*by, "path", "is_test", F.posexplode(X.source_lines(F.col("source"))).alias("at", "text"))
    named = lines.select(*by, "path", "is_test", (F.col("at") + 1).cast("bigint").alias("line"), callable_name(F.col("text")).alias("name"))
    return named.where(F.col("name").isNotNull())


def grouped(keyed: DataFrame, by: list[str], least: int, cross_file: bool = True) -> DataFrame:
    """``by, key, occurrences, files``: distinct (path, line, name) of a key, counted in two aggregations."""
    once = keyed.where(F.col("key") != "").groupBy(*by, "key", "path").agg(F.countDistinct("line", "name").alias("n"))
    whole = once.groupBy(*by, "key").agg(F.sum("n").alias("occurrences"), F.count("*").alias("files"))
    return whole.where((F.col("occurrences") >= least) & (F.col("files") >= (2 if cross_file else 1)))


def parallel_implementations(named: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Capabilities (two to four words, one of them a capability) defined in several files.

    ``named``: by, path, line, name, is_test, as of :func:`callables`.
    """
    words = identifier_words(F.col("name"))
    rows = named.where("NOT coalesce(is_test, false) AND name IS NOT NULL AND path IS NOT NULL").where(has_any(words, CAPABILITY_WORDS)).withColumn("key", concept_key(words, CAPABILITY_STOP, 4))
    return grouped(rows.where(F.col("key").contains(" ")), by, least)


def shadowed_abstractions(files: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Concepts defined in several files whose paths speak of helpers."""
    rows = callables(files, by).where("NOT is_test").where(has_any(path_words(F.col("path")), HELPER_WORDS))
    return grouped(rows.withColumn("key", concept_key(identifier_words(F.col("name")), HELPER_STOP, 3)), by, least)


def fixture_factories(files: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Concepts of factories of test data, from names and paths of test files."""
    words = identifier_words(F.col("name"))
    place = F.filter(path_words(F.col("path")), lambda w: ~w.isin(BUCKET_WORDS))
    rows = callables(files, by).where("is_test").where(has_any(words, FIXTURE_WORDS))
    return grouped(rows.withColumn("key", concept_key(F.concat(words, place), FIXTURE_WORDS, 3)), by, least)


def is_config_key(value: Column) -> Column:
    """Routes of two or more slashes, or UPPER_SNAKE names with a word of configuration."""
    route = value.startswith("/") & (F.length(value) - F.length(F.replace(value, F.lit("/"), F.lit(""))) >= 2) & ~value.contains(" ")
    upper = ~value.startswith("/") & value.rlike("^[A-Z0-9_]+$") & value.contains("_") & has_any(F.split(F.lower(value), "_"), KEY_WORDS)
    return (F.length(value) >= 4) & (route | upper)


def config_keys(files: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Keys of configuration and routes that several files spell out."""
    lines = _rows(files, by).where("NOT is_test").select(*by, "path", F.posexplode(X.source_lines(F.col("source"))).alias("line", "text"))
    code = code_part(F.col("text"))
    quoted = F.flatten(F.transform(
        F.regexp_extract_all(code, F.lit(f"({QUOTED})"), 1),
        lambda q: F.array(F.substring(q, 2, F.length(q) - 2)),
    ))
    constant = F.when(F.lower(code).rlike("const |static |const_|public const"), F.split(_trimmed(code), "[^A-Za-z0-9_]")).otherwise(F.array().cast("array<string>"))
    rows = lines.select(*by, "path", "line", F.explode(F.filter(F.concat(quoted, constant), is_config_key)).alias("key"))
    return grouped(rows.withColumn("name", F.col("key")), by, least)


def generic_buckets(files: DataFrame, by: list[str], max_dir_files: int = 40) -> DataFrame:
    """``by, path, kind, concepts, files``: generic folders and files that mix concepts.

    A folder counts by its own name, with four files and a quarter of the folder
    limit of concepts (4 to 12); a file by its stem, with 18 or more.
    """
    least = min(max(max_dir_files // 4, 4), 12)
    rows = _rows(files, by).where("NOT is_test")
    folder = X.parent(F.col("path"))
    own = identifier_words(F.regexp_replace(X.file_name(folder), "\\.[^.]*$", ""))
    generic = F.get(F.filter(own, lambda w: w.isin(BUCKET_WORDS)), F.lit(0))
    words = F.filter(path_words(F.col("path")), useful)
    placed = rows.select(*by, "path", folder.alias("folder"), generic.alias("generic"), words.alias("words")).where(F.col("generic").isNotNull())
    counts = placed.groupBy(*by, "folder").agg(F.countDistinct("path").alias("files"))
    concepts = placed.select(*by, "folder", "generic", F.explode("words").alias("word")).where("word <> generic").groupBy(*by, "folder").agg(F.countDistinct("word").alias("concepts"))
    folders = counts.join(concepts, [*by, "folder"]).where((F.col("files") >= 4) & (F.col("concepts") >= least))
    stems = callables(files, by).where("NOT is_test").where(has_any(identifier_words(X.stem(F.col("path"))), BUCKET_WORDS))
    inside = stems.select(*by, "path", F.explode(F.filter(identifier_words(F.col("name")), useful)).alias("word")).groupBy(*by, "path").agg(F.countDistinct("word").alias("concepts"))
    return folders.select(*by, F.col("folder").alias("path"), F.lit("folder").alias("kind"), "concepts", "files").unionByName(
        inside.where(F.col("concepts") >= max(least, 18)).select(*by, "path", F.lit("file").alias("kind"), "concepts", F.lit(1).cast("bigint").alias("files"))
    )


def package(path: Column) -> Column:
    """``crates/x`` or ``tools/x`` of a path, one shared package for all others."""
    return F.regexp_extract(path, "(?:^|/)((?:crates|tools)/[^/]+)(?=/|$)", 1)


def boundary_bypasses(files: DataFrame, by: list[str], least: int = 4, least_files: int = 3) -> DataFrame:
    """``by, kind, calls, files``: direct calls of a kind where its package has a boundary for it.

    Boundary files are told by words of their paths; they, tests, and entry
    points (commands, scripts, benchmarks) may call directly. Strings and
    comments don't count.
    """
    rows = _rows(files, by).where("NOT is_test").withColumn("package", package(F.col("path"))).withColumn("words", path_words(F.col("path")))
    kinds = F.array_compact(F.array(*[F.when(has_any(F.col("words"), w), F.lit(k)) for k, w in BOUNDARY_WORDS.items()]))
    own = rows.withColumn("kinds", kinds)
    held = own.select(*by, "package", F.explode("kinds").alias("kind")).distinct()
    lines = own.where(~has_any(F.col("words"), ENTRY_WORDS)).select(*by, "package", "path", "kinds", F.posexplode(X.source_lines(F.col("source"))).alias("line", "text"))
    bare = F.lower(F.regexp_replace(code_part(F.col("text")), QUOTED, ""))
    direct = F.array_compact(F.array(*[
        F.when(F.exists(F.array(*map(F.lit, calls)), lambda c: F.col("bare").contains(c)), F.lit(k)) for k, calls in DIRECT_CALLS.items()
    ]))
    calls = lines.withColumn("bare", bare).select(*by, "package", "path", "line", F.explode(F.array_except(direct, "kinds")).alias("kind"))
    met = calls.join(held, [*by, "package", "kind"], "left_semi")
    once = met.groupBy(*by, "kind", "path").agg(F.countDistinct("line").alias("n"))
    whole = once.groupBy(*by, "kind").agg(F.sum("n").alias("calls"), F.count("*").alias("files"))
    return whole.where((F.col("calls") >= least) & (F.col("files") >= least_files))
