"""Scalar column functions over paths, lines and names.

All are built-in expressions: they stay in whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source extensions and the language of each.
LANGUAGE_OF = {
    "c": "c", "cc": "cpp", "cpp": "cpp", "cs": "csharp", "csx": "csharp", "go": "go", "java": "java", "js": "javascript", "jsx": "javascript",
    "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "kt": "kotlin",
    "php": "php", "py": "python", "rb": "ruby", "rs": "rust", "vue": "vue", "sh": "bash", "bash": "bash", "ps1": "powershell", "psm1": "powershell",
}
# Folders that hold generated or fetched files.
GENERATED_FOLDERS = ["target", "node_modules", "dist", "build", "out", "vendor", "generated", "__generated__", "coverage", "obj", "bin"]
# Folders and file names of tests. Folders are compared in lower case, names as they are.
TEST_FOLDERS = ["test", "tests", "__tests__", "spec", "specs", "editmode", "playmode"]
TEST_FOLDER_ENDS = ["_tests", "-tests"]
TEST_NAMES = "^tests[.]rs$|^test_|[.]test[.]|[.]spec[.]|_test[.](go|py|rs)$|_tests[.]rs$"
# Words that name no concept of a folder.
NO_CONCEPT = ["mod", "lib", "main", "test"]


def normal_path(path: Column) -> Column:
    """Slashes forward, doubled ones and ``./`` parts folded."""
    p = F.regexp_replace(path, r"\\", "/")
    p = F.regexp_replace(p, "^(//[?]/)", "")
    p = F.regexp_replace(p, "/+", "/")
    p = F.regexp_replace(p, "(^|/)(\\./)+", "$1")
    return p


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def parent(path: Column) -> Column:
    """Folder of a normal path, ``.`` for none."""
    cut = F.regexp_replace(path, "/?[^/]*$", "")
    return F.when(cut == "", F.lit(".")).otherwise(cut)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), "\\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))


def language(path: Column) -> Column:
    """Language of the extension, null where it is no source extension."""
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])
    return F.try_element_at(pairs, extension(path))


def is_test(path: Column) -> Column:
    """By the file's name or by any part of the path. A null path is null."""
    parts = F.split(F.lower(path), "/")
    named = F.exists(parts, lambda p: p.isin(TEST_FOLDERS) | p.endswith(TEST_FOLDER_ENDS[0]) | p.endswith(TEST_FOLDER_ENDS[1]))
    return file_name(path).rlike(TEST_NAMES) | named


def folded_path(path: Column) -> Column:
    """``a/../`` and ``./`` parts folded, at any depth; leading ``..`` stay."""
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        F.split(path, "/"), none,
        lambda got, p: F.when((p == ".") | ((p == "") & (F.size(got) > 0)), got)
        .when((p == "..") & (F.size(got) > 0) & ~F.coalesce(F.try_element_at(got, F.lit(-1)), F.lit("")).isin("..", ""), F.slice(got, 1, F.size(got) - 1))
        .otherwise(F.concat(got, F.array(p))),
    )
    return F.array_join(kept, "/")


def folder_words(stem_: Column) -> Column:
    """Words of a file stem for the concepts of its folder.

    Broken at ``_``, ``-``, ``.`` and before every capital, lower case; words of
    up to two letters and those of no concept are left out.
    """
    spaced = F.regexp_replace(F.regexp_replace(stem_, "[_.-]", " "), "(?<=[^ ])(\\p{Lu})", " $1")
    words = F.split(F.lower(F.regexp_replace(spaced, "[^\\p{L}\\p{N} ]", "")), " ")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(NO_CONCEPT))


def is_generated_folder(path: Column) -> Column:
    return F.arrays_overlap(F.split(parent(path), "/"), F.array(*map(F.lit, GENERATED_FOLDERS)))


def is_hidden(path: Column) -> Column:
    return path.rlike("(^|/)\\.[^./]")


def under(path: Column, ignored: Column) -> Column:
    """Whether a path is one of ``ignored`` or lies below one; never a glob."""
    return F.exists(ignored, lambda i: (path == i) | path.startswith(F.concat(F.rtrim(i, F.lit("/")), F.lit("/"))))


def loc(text: Column) -> Column:
    """Number of lines; a line feed at the end adds none. Null text has 0."""
    n = F.size(F.split(text, "\n", -1)) - F.when((text == "") | text.endswith("\n"), 1).otherwise(0)
    return F.coalesce(n, F.lit(0)).cast("bigint")


def source_lines(text: Column) -> Column:
    """Array of the lines of a text, without line ends."""
    parts = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1)
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(
        F.when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    )


def normal_line(line: Column) -> Column:
    """Digits to ``#``, any quote to ``"``, lower case, white space runs to one blank."""
    out = F.regexp_replace(F.lower(line), "[0-9]", "#")
    out = F.regexp_replace(out, "['\"`]", '"')
    return F.trim(F.regexp_replace(out, "[ \t]+", " "))


def name_words(name: Column) -> Column:
    """Words of a camel, snake or kebab name, lower case, naive singular."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.filter(F.split(F.lower(F.regexp_replace(spaced, "[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")
    return F.transform(
        words,
        lambda w: F.when((F.length(w) > 4) & w.endswith("ies"), F.concat(F.substring(w, 1, F.length(w) - 3), F.lit("y")))
        .when((F.length(w) > 4) & w.endswith("s"), F.substring(w, 1, F.length(w) - 1))
        .otherwise(w),
    )


def naming_style(name: Column) -> Column:
    """Style of a file stem after test suffixes are stripped."""
    s = F.regexp_replace(name, "([._-](test|tests|spec))$", "")
    return (
        F.when(s.rlike("^[a-z0-9]+$"), "lowercase")
        .when(s.rlike("^[a-z0-9]+(_[a-z0-9]+)+$"), "snake_case")
        .when(s.rlike("^[a-z0-9]+(-[a-z0-9]+)+$"), "kebab-case")
        .when(s.rlike("^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$"), "camelCase")
        .when(s.rlike("^([A-Z][a-z0-9]*)+$"), "PascalCase")
        .when(s.rlike("^[A-Z0-9]+(_[A-Z0-9]+)*$"), "UPPER_CASE")
        .otherwise("mixed")
    )


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and 20 hex digits of sha256 over the parts, each ended by NUL."""
    body = F.concat(*[x for p in parts for x in (F.coalesce(p, F.lit("")), F.lit("\0"))])
    return F.concat(F.lit(prefix), F.substring(F.sha2(body, 256), 1, 20))


def nearest_rank(values: Column, share: float) -> Column:
    """Element at ``ceil((n - 1) * share)`` of the sorted values, 0 for none."""
    ordered = F.array_sort(values)
    at = F.ceil((F.size(values) - 1) * F.lit(share)).cast("int")
    return F.coalesce(F.when(F.size(values) > 0, F.get(ordered, at)), F.lit(0))


def rounded_percent(part: Column, whole: Column) -> Column:
    """Integer percentage, half up, 0 for an empty whole."""
    return F.when(whole > 0, F.floor((part * 200 + whole) / (whole * 2))).otherwise(0).cast("bigint")
