"""Readers: source trees, git logs, reports and configuration."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.metrics import PRESETS
from ..operators.projects import glob_regex

SCHEMA_VERSION = 26


def decoded(content: Column) -> tuple[Column, Column]:
    """(text, failure) of raw bytes: UTF-8 with or without mark, UTF-16 with one.

    Failures are values (``unsupported_encoding``, ``invalid_encoding``), never
    exceptions.
    """
    head = F.hex(F.substring(content, 1, 4))
    wide = head.startswith("FFFE") | head.startswith("FEFF")
    odd = F.octet_length(content) % 2 == 1
    utf8 = F.when(head.startswith("EFBBBF"), F.substring(content, 4, 1 << 30)).otherwise(content)
    low = F.try_validate_utf8(utf8)
    big, little = F.decode(F.substring(content, 3, 1 << 30), "UTF-16BE"), F.decode(F.substring(content, 3, 1 << 30), "UTF-16LE")
    text = F.when(wide & ~odd, F.when(head.startswith("FEFF"), big).otherwise(little)).when(~wide, low)
    failure = F.when(content.isNull(), "io_error").when(head.startswith("0000FEFF") | head.startswith("FFFE0000"), "unsupported_encoding").when(
        (wide & odd) | (~wide & low.isNull() & content.isNotNull()), "invalid_encoding"
    )
    return F.when(failure.isNull(), text), failure


def ignore_rules(text: str, folder: str = "") -> list[tuple[re.Pattern, bool]]:
    """(pattern, keeps) of an ignore file in ``folder``, in order."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keeps = line.startswith("!")
        line = line.lstrip("!")
        anchored = "/" in line.rstrip("/")
        body = glob_regex(line.strip("/") if anchored else f"**/{line.strip('/')}")[1:-1].removesuffix("(?:/.*)?")
        # a pattern that ends in a slash names folders only
        tail = "/.*" if line.endswith("/") else "(?:/.*)?"
        out.append((re.compile(re.escape(f"{folder}/" if folder else "") + body + tail + r"\Z"), keeps))
    return out


def ignored(path: str, rules: list[tuple[re.Pattern, bool]]) -> bool:
    """The last rule that matches decides."""
    found = False
    for pattern, keeps in rules:
        if pattern.match(path):
            found = not keeps
    return found


def _reader(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    data = (Path(base) / name).read_bytes()
                except OSError:
                    data = None
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], names=["path", "content"])

    return run


def read_tree(spark: SparkSession, root: str, include_hidden: bool = False, include_generated: bool = False, exclude_tests: bool = False, ignore: list[str] | None = None, gitignore: bool = True) -> DataFrame:
    """Source files below ``root``: path, source, failure, language, is_test.

    ``root`` is a URL, or a folder or file that all executors mount; ignore
    files are obeyed in the latter case. Filters run on paths; contents are read
    only of files that stay.
    """
    if "://" in root:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        rows = raw.withColumn("path", F.regexp_replace(F.substring("path", len(root.rstrip("/")) + 2, 1 << 20), "^/+", ""))
    else:
        # Spark's own listing leaves out names that start with a dot or an
        # underscore, such as __init__.py
        base = Path(root).resolve()
        names = [p.relative_to(base).as_posix() for p in sorted(base.rglob("*")) if p.is_file()] if base.is_dir() else [base.name]
        base = base if base.is_dir() else base.parent
        if gitignore:
            rules = []
            for n in sorted((n for n in names if n.split("/")[-1] == ".gitignore"), key=lambda n: n.count("/")):
                rules += ignore_rules((base / n).read_text(errors="replace"), n.rpartition("/")[0])
            names = [n for n in names if not ignored(n, rules)]
        listed = spark.createDataFrame([(n,) for n in names], "path string").withColumn("path", X.normal_path(F.col("path")))
        rows = listed
    rows = rows.where(X.language(F.col("path")).isNotNull())
    if not include_hidden:
        rows = rows.where(~X.is_hidden(F.col("path")))
    if not include_generated:
        rows = rows.where(~X.is_generated_folder(F.col("path")))
    if exclude_tests:
        rows = rows.where(~X.is_test(F.col("path")))
    if ignore:
        rows = rows.where(~X.under(F.col("path"), F.array(*map(F.lit, ignore))))
    if "://" not in root:
        rows = rows.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(_reader(str(base)), "path string, content binary")
    text, failure = decoded(F.col("content"))
    return rows.select("path", text.alias("source"), failure.alias("failure"), X.language(F.col("path")).alias("language"), X.is_test(F.col("path")).alias("is_test"))


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """commit, author, path, added, deleted from ``log --numstat`` text.

    Records open with ``commit:<hash>\\t<author>``; ``-`` marks binary files; of
    a rename the new name counts.
    """
    records = spark.read.option("lineSep", "\ncommit:").text(path).withColumn("value", F.regexp_replace("value", "^commit:", ""))
    parts = records.select(F.split("value", "\n").alias("l")).select(
        F.split(F.get("l", F.lit(0)), "\t").alias("head"), F.explode(F.slice("l", 2, 1 << 20)).alias("line")
    )
    f = F.split("line", "\t")
    name = F.regexp_replace(F.regexp_replace(F.get(f, F.lit(2)), "^.* => ", ""), "[{}]", "")
    return parts.where(F.size(f) == 3).select(
        F.get("head", F.lit(0)).alias("commit"), F.get("head", F.lit(1)).alias("author"), X.normal_path(name).alias("path"),
        F.get(f, F.lit(0)).try_cast("bigint").alias("added"), F.get(f, F.lit(1)).try_cast("bigint").alias("deleted"),
    )


REPORT = (
    "schema_version int, issues array<struct<id: string, analysis: string, family: string, title: string, subject: struct<kind: string, path: string, symbol: string>, "
    "evidence: array<struct<id: string, rule: string, message: string, measurements: array<struct<name: string, value: double, threshold: double, unit: string>>, "
    "locations: array<struct<path: string, line: bigint, symbol: string>>>>>>"
)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports as rows; an unknown field or another version is an error."""
    raw = spark.read.text(path, wholetext=True)
    doc = raw.select(F.from_json("value", REPORT, {"mode": "FAILFAST"}).alias("r"), F.json_object_keys("value").alias("keys")).select("r.*", "keys")
    known = F.array(F.lit("schema_version"), F.lit("issues"))
    checked = F.when(F.size(F.array_except("keys", known)) > 0, F.raise_error(F.lit("unknown field in report"))).when(
        F.col("schema_version") != SCHEMA_VERSION, F.raise_error(F.lit("unsupported report version"))
    ).otherwise(F.col("schema_version"))
    return doc.select(checked.alias("schema_version"), "issues")


def load_config(text: str, overrides: list[str] | None = None) -> dict:
    """TOML over the balanced preset, then ``key=value`` overrides.

    Unknown keys, presets and limits that are no positive integers are errors.
    """
    data = tomllib.loads(text)
    preset = data.pop("preset", "balanced")
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}")
    out = dict(PRESETS[preset])
    given = dict(data.pop("thresholds", {}))
    if data:
        raise ValueError(f"unknown keys: {sorted(data)}")
    for item in overrides or []:
        key, _, value = item.partition("=")
        try:
            given[key] = json.loads(value)
        except ValueError:
            given[key] = value
    for key, value in given.items():
        if key not in out:
            raise ValueError(f"unknown threshold {key!r}")
        if not isinstance(value, int) or isinstance(value, bool) or value < 1:
            raise ValueError(f"{key} must be a positive integer")
        out[key] = value
    return out
