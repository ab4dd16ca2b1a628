"""Project-level joins: imports to files, assets to their side files, folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Endings tried in order when an import names no extension.
ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".vue", "/index.ts", "/index.tsx", "/index.js", ".py", "/__init__.py", ".rs", "/mod.rs"]


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``src, module, dst``: the first existing candidate of relative imports.

    ``imports``: src (path), module; ``files``: path. Candidates are exact, then
    each ending in order. Local modules that name no file have a null dst.
    """
    local = imports.where(F.col("module").rlike("^[.]")).distinct()
    joined = F.concat_ws("/", X.parent(F.col("src")), F.col("module"))
    folded = X.folded_path(X.normal_path(joined))
    tries = local.withColumn("base", folded).select("src", "module", "base", F.posexplode(F.array(*map(F.lit, ENDINGS))).alias("rank", "ending"))
    known = files.select(F.col("path").alias("dst")).distinct()
    hit = tries.withColumn("dst", F.concat("base", "ending")).join(known, "dst").groupBy("src", "module").agg(F.min(F.struct("rank", "dst"))["dst"].alias("dst"))
    return local.join(hit, ["src", "module"], "left").select("src", "module", "dst")


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression; without wildcards it holds its subtree, too."""
    plain = pattern.replace("\\", "/").strip("/")
    out, i = "", 0
    while i < len(plain):
        if plain.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif plain.startswith("**", i):
            out, i = out + ".*", i + 2
        elif plain[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif plain[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            c = plain[i]
            out, i = out + (c if c.isalnum() or c in "/_-" else "\\" + c), i + 1
    return f"^{out}(?:/.*)?$" if not any(c in pattern for c in "*?") else f"^{out}$"


def folder_concepts(files: DataFrame, most: int = 40, keep: list[str] | None = None) -> DataFrame:
    """Folders whose file stems hold more distinct words than allowed."""
    keep = [*(keep or []), "folder"]
    rows = files.withColumn("folder", X.parent(F.col("path"))).select(*keep, X.folder_words(X.stem(F.col("path"))).alias("words"))
    words = rows.select(*keep, F.explode("words").alias("word"))
    stats = words.groupBy(*keep).agg(F.countDistinct("word").alias("concepts"))
    return stats.where(F.col("concepts") > max(most, 4))


def happy_path_only(cases: DataFrame, files: DataFrame, least: int = 3) -> DataFrame:
    """Test files with enough cases and assertions and no word for failure."""
    # Words of assertions and of failing paths.
    asserts = ["expect(", "assert", "should", "t.error", "t.fatal", "require.", "pytest."]
    negative = [
        "tothrow", "to_throw", ".rejects", "raises(", "pytest.raises", "should_panic", "is_err", "unwrap_err", "expect_err", " err == nil", "err == nil", " err != nil", "err != nil",
        "invalid", "missing", "empty", "none", "null", "nil", "zero", "negative", "unauthorized", "forbidden", "not found", "not_found", "error", "failure", "panic", "duplicate",
        "overflow", "underflow", "timeout", "denied", "boundary", "edge", "does not", "doesn't", "without", "ignore", "ignores", "ignored", "skip", "skips", "skipped", "caps", "prevents",
    ]
    text = F.lower("source")
    holds = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))
    rows = files.select("file_id", holds(asserts).alias("a"), holds(negative).alias("n"))
    counted = cases.groupBy("file_id").agg(F.count("*").alias("cases")).where(F.col("cases") >= least)
    return counted.join(rows.where("a AND NOT n").select("file_id"), "file_id")


def side_files(assets: DataFrame, ending: str = ".meta") -> DataFrame:
    """``path, problem``: assets without side file and side files without asset."""
    side = assets.where(F.col("path").endswith(ending)).select(F.expr(f"substring(path, 1, length(path) - {len(ending)})").alias("path"), F.lit(True).alias("side"))
    main = assets.where(~F.col("path").endswith(ending)).select("path", F.lit(True).alias("main"))
    both = main.join(side, "path", "full_outer")
    return both.where("side IS NULL OR main IS NULL").select("path", F.when(F.col("side").isNull(), "missing_meta").otherwise("orphan_meta").alias("problem"))


def guids(metas: DataFrame) -> DataFrame:
    """``path, guid`` of side files with a 32-digit id line."""
    return metas.select("path", F.regexp_extract("source", "(?m)^guid: ([0-9a-f]{32})", 1).alias("guid")).where("guid <> ''")


def duplicate_guids(ids: DataFrame) -> DataFrame:
    return ids.groupBy("guid").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n > 1")


def broken_references(files: DataFrame, ids: DataFrame) -> DataFrame:
    """``path, guid, rule``: references to ids that no side file has."""
    line = F.explode(X.source_lines(F.col("source"))).alias("line")
    used = files.select("path", line).select("path", F.regexp_extract("line", "guid: ([0-9a-f]{32})", 1).alias("guid"), F.col("line").contains("m_Script").alias("script")).where("guid <> ''")
    return used.join(ids.select("guid").distinct(), "guid", "left_anti").select("path", "guid", F.when(F.col("script"), "missing_script").otherwise("broken_asset_reference").alias("rule")).distinct()


def assembly_references(assemblies: DataFrame) -> DataFrame:
    """``name, reference, resolved, crosses``: references by name.

    ``assemblies``: name, references array, editor boolean. ``crosses`` marks a
    runtime assembly that uses an editor one.
    """
    used = assemblies.select("name", "editor", F.explode("references").alias("reference"))
    known = assemblies.select(F.col("name").alias("reference"), F.col("editor").alias("target_editor"))
    return used.join(known, "reference", "left").select(
        "name", "reference", F.col("target_editor").isNotNull().alias("resolved"), (~F.col("editor") & F.coalesce("target_editor", F.lit(False))).alias("crosses")
    )


# Engine callbacks and look-ups that are slow in a frame.
LIFECYCLE = ["Awake", "OnEnable", "Start", "FixedUpdate", "Update", "LateUpdate", "OnDisable", "OnDestroy", "OnApplicationPause", "OnApplicationQuit", "OnValidate", "Reset"]
SLOW_CALLS = ["GameObject.Find", "FindObjectOfType", "FindFirstObjectByType", "Resources.Load", "GetComponent"]
FRAME_METHODS = ["Update(", "FixedUpdate(", "LateUpdate("]


def behaviour_findings(files: DataFrame, most_methods: int = 8, most_fields: int = 20) -> DataFrame:
    """``path, rule, value`` over C# behaviour sources.

    Too many callbacks or serialised fields, subscriptions without their
    removal, editor APIs outside Editor folders, lines with slow calls at or
    after the first frame method (``value`` is the line; one row for each).
    """
    text = F.col("source")
    methods = sum((text.rlike(f"void {m}\\(").cast("int") for m in LIFECYCLE), F.lit(0))
    fields = F.size(F.regexp_extract_all(text, F.lit("(\\[SerializeField\\])"), 1))
    added, removed = F.size(F.split(text, "\\+=", -1)) - 1, F.size(F.split(text, "-=", -1)) - 1
    found = {
        "lifecycle_overload": (methods, methods > most_methods),
        "serialized_field_bloat": (fields, fields > most_fields),
        "unbalanced_event_subscription": (added, added > removed),
        "editor_api_in_runtime": (F.lit(1), text.contains("UnityEditor") & ~F.col("path").rlike("(^|/)Editor/")),
    }
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), v.cast("bigint").alias("value"), h.alias("hit")) for k, (v, h) in found.items()])
    whole = files.where(text.isNotNull()).select("path", F.explode(F.filter(rules, lambda r: r["hit"])).alias("r")).select("path", "r.rule", "r.value")
    rows = files.where(text.isNotNull()).select("path", X.source_lines(text).alias("ls"))
    holds = lambda line, words: F.exists(F.array(*map(F.lit, words)), lambda w: line.contains(w))
    first = F.array_position(F.transform("ls", lambda x: holds(x, FRAME_METHODS)), True)
    lines = rows.where(first > 0).select("path", first.alias("first"), F.posexplode("ls").alias("at", "line"))
    slow = lines.where((F.col("at") + 1 >= F.col("first")) & holds(F.col("line"), SLOW_CALLS))
    return whole.unionByName(slow.select("path", F.lit("expensive_frame_call").alias("rule"), (F.col("at") + 1).cast("bigint").alias("value")))


def missing_terms(docs: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """``role, term``: required terms that the document of a role doesn't hold.

    ``docs``: role, source (the first existing name of the role). A missing
    document misses all of its terms.
    """
    spark = docs.sparkSession
    wanted = spark.createDataFrame(terms, "role string, term string")
    held = docs.select("role", F.lower("source").alias("body"))
    met = wanted.join(held, "role").where(F.col("body").contains(F.lower("term"))).select("role", "term").distinct()
    return wanted.join(met, ["role", "term"], "left_anti")
