"""Function facts by a lexical scanner: spans, complexity, nesting, clones.

Brace languages are read by brace depth over masked text, Python by indent,
shell functions by braces with nesting by their block words.
Coverage of a lexical scan is partial by nature and is reported as such.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import ship_package, spread

_MASK = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
_MASK_PY = re.compile(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\#[^\n]*")
_HEAD = re.compile(r"(?:\b(?:fn|func|function)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)|^[ \t]+(?:(?:public|private|protected|static|final|async|override|internal|virtual)\s+)+[\w<>\[\], ]+?\s([A-Za-z_]\w*))[^;{}=]*\{", re.M)
_HEAD_PY = re.compile(r"^([ \t]*)(?:async[ \t]+)?def[ \t]+([A-Za-z_]\w*)", re.M)
_MASK_SH = re.compile(r"(?<![\w$\"'}])\#[^\n]*|\"(?:[^\"\\]|\\[\s\S])*\"|'[^']*'")
_HEAD_SH = re.compile(r"^[ \t]*(?:function[ \t]+([A-Za-z_][\w:.-]*)[ \t]*(?:\([ \t]*\))?|([A-Za-z_][\w:.-]*)[ \t]*\([ \t]*\))\s*\{", re.M)
_BLOCKS_SH = re.compile(r"(?:^|(?<=[\s;&|(!]))(if|for|while|until|case|select|fi|done|esac)(?=[\s;&|)]|$)", re.M)
_COMMAND_SH = re.compile(r"(?:^|[;&|({`!]|\b(?:then|do|else|elif|if|while|until)\b)[ \t]*([A-Za-z_][\w-]*)", re.M)
_DECISIONS = re.compile(r"\b(?:if|elif|for|foreach|while|until|case|catch|except|when)\b|&&|\|\||\band\b|\bor\b|\?(?![.?:\[])")
_NESTS = re.compile(r"\b(?:if|elif|else|for|foreach|while|switch|match|try|case)\b")
_TOKEN = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|\"|[^\s\w]")
# Words that keep their spelling in a normalised stream.
_KEPT = set("if else elif for while return break continue switch case match try catch except finally throw raise in of not and or is None null true false new await async".split())


def _blank(m: re.Match) -> str:
    text = m.group()
    mark = '"' if text[0] in "\"'`" else " "
    return mark + "\n" * text.count("\n")


_EDGES_PY = re.compile(r"[(\[{]|[)\]}]|\n([ \t]*)(?=[^\s])")
_BRACES = re.compile(r"[{}]")


def _masked(source: str, language: str) -> str:
    """The text with comments and strings blanked, line ends kept."""
    mask = _MASK_PY if language == "python" else _MASK_SH if language == "bash" else _MASK
    return mask.sub(_blank, source.replace("\r\n", "\n"))


def scan(source: str, language: str) -> list[tuple]:
    """(name, line, loc, complexity, nesting, parameters, tokens) of each function."""
    python, shell = language == "python", language == "bash"
    masked = _masked(source, language)
    out = []
    counted, lines = 0, 0  # line ends up to a place
    for m in (_HEAD_PY if python else _HEAD_SH if shell else _HEAD).finditer(masked):
        name = m.group(2) if python else m.group(1) or m.group(2)
        start = m.start()
        if python:
            indent = len(m.group(1).expandtabs())
            end = len(masked)
            depth = 0
            for n in _EDGES_PY.finditer(masked, m.end()):
                if n.group()[0] != "\n":
                    depth += 1 if n.group() in "([{" else -1
                elif depth <= 0 and len(n.group(1).expandtabs()) <= indent:
                    end = n.start()
                    break
        else:
            depth, end = 1, len(masked)
            for b in _BRACES.finditer(masked, m.end()):
                depth += 1 if b.group() == "{" else -1
                if not depth:
                    end = b.end()
                    break
        body = masked[start:end].rstrip()
        at = start + len(m.group()) - len(m.group().lstrip())
        lines += masked.count("\n", counted, at)
        counted, line = at, lines + 1
        inside = body[body.find(":") + 1 :] if python else body[body.find("{") + 1 :]
        deepest = 0
        if python:
            levels: list[int] = []
            for row in inside.split("\n"):
                if row.strip():
                    at = len(row) - len(row.lstrip())
                    while levels and levels[-1] >= at:
                        levels.pop()
                    if _NESTS.match(row.strip()):
                        levels.append(at)
                        deepest = max(deepest, len(levels))
        elif shell:
            depth = 0
            for b in _BLOCKS_SH.finditer(inside):
                depth = max(0, depth - 1) if b.group(1) in ("fi", "done", "esac") else depth + 1
                deepest = max(deepest, depth)
        else:
            stack: list[bool] = []
            last = 0
            for b in re.finditer(r"[{}]", inside):
                if b.group() == "{":
                    stack.append(bool(_NESTS.search(inside[last : b.start()].rsplit(";", 1)[-1])))
                    deepest = max(deepest, sum(stack))
                elif stack:
                    stack.pop()
                last = b.end()
        heading = re.search(re.escape(name) + r"(?:<[^>]*>)?\s*\(([^)]*)\)", body)
        names = [p.strip() for p in heading.group(1).split(",")] if heading and not shell else []
        params = sum(bool(p) and not re.match(r"(?:&?\s*(?:mut\s+)?self|cls|this)\b", p) for p in names)
        tokens = ["STR" if t == '"' else "NUM" if t[0].isdigit() else t if not (t[0].isalpha() or t[0] == "_") or t in _KEPT else "ID" for t in _TOKEN.findall(inside)]
        out.append((name, line, body.count("\n") + 1, 1 + len(_DECISIONS.findall(inside)), deepest, params, tokens))
    return out


def function_facts(files: DataFrame, streams: bool = False) -> DataFrame:
    """``file_id, name, line, loc, complexity, nesting_depth, parameter_count, tokens, digest``.

    Needs file_id, path, source. ``digest`` names the normalised token stream;
    with ``streams`` the columns ``language`` and ``stream`` hold it.
    Null and empty sources and unknown extensions have no functions.
    """
    ship_package(files.sparkSession)
    names = ["file_id", "name", "line", "loc", "complexity", "nesting_depth", "parameter_count", "tokens", "digest"]
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6, pa.int64()]
    if streams:
        names, kinds = [*names, "language", "stream"], [*kinds, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, lang, source in zip(*(c.to_pylist() for c in batch.columns)):
                for *facts, tokens in scan(source, lang):
                    whole = " ".join(tokens)
                    rows.append((i, *facts, len(tokens), xxhash.xxh64_intdigest(whole) - (1 << 63), *([lang, whole] if streams else [])))
            cols = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    rows = files.select(F.col("file_id").cast("bigint").alias("file_id"), X.language(F.col("path")).alias("l"), F.col("source").alias("s")).where("l IS NOT NULL AND s IS NOT NULL")
    return spread(rows).mapInArrow(run, "file_id bigint, name string, line bigint, loc bigint, complexity bigint, nesting_depth bigint, parameter_count bigint, tokens bigint, digest bigint" + ", language string, stream string" * streams)


def call_names(files: DataFrame) -> DataFrame:
    """``file_id, name, line, callee``: names a function calls, once each."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, lang, source in zip(*(c.to_pylist() for c in batch.columns)):
                for name, line, called in scan_calls(source, lang):
                    rows += [(i, lang, name, line, c) for c in called]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            cols = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file_id", "language", "name", "line", "callee"])

    rows = files.select(F.col("file_id").cast("bigint").alias("file_id"), X.language(F.col("path")).alias("l"), F.col("source").alias("s")).where("l IS NOT NULL AND s IS NOT NULL")
    return spread(rows).mapInArrow(run, "file_id bigint, language string, name string, line bigint, callee string")


# Shell words that name no command of their own.
_WORDS_SH = set("if then else elif fi for while until do done case esac select in function return local export readonly declare set unset shift exit true false".split())
_CALL = re.compile(r"(?<![\w])([A-Za-z_]\w*)\s*\(")


def scan_calls(source: str, language: str) -> list[tuple[str, int, list[str]]]:
    """(name, line, called names) of each function; keywords call nothing."""
    rows = []
    masked = _masked(source, language).split("\n")
    for name, line, loc, *_ in scan(source, language):
        body = "\n".join(masked[line - 1 : line - 1 + loc])
        if language == "bash":
            heading = _HEAD_SH.match(body)
            rows.append((name, line, sorted(set(_COMMAND_SH.findall(body[heading.end() :] if heading else body)) - _WORDS_SH)))
            continue
        called = {c for c in _CALL.findall(body) if c not in _KEPT}
        if len(re.findall(rf"\b{re.escape(name)}\s*\(", body)) <= 1:
            called.discard(name)  # its own heading is no call
        rows.append((name, line, sorted(called)))
    return rows


def call_edges(calls: DataFrame, functions: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved): calls bound to the only function of that name.

    ``files``: file_id, repo_id. A name is resolved within its repository and
    language if exactly one function bears it. Edges: ``src, dst`` as
    ``file_id:name``; unresolved: ``reason`` (none, ambiguous) and ``n``.
    """
    owner = files.select("file_id", F.coalesce("repo_id", F.lit(-1)).alias("repo_id"))
    defs = functions.select("file_id", "name", "language").distinct().join(owner, "file_id")
    known = defs.groupBy("repo_id", "language", "name").agg(F.count("*").alias("n"), F.min("file_id").alias("target"))
    used = calls.select("file_id", "language", "name", "callee").distinct().join(owner, "file_id")
    met = used.join(known.select("repo_id", "language", F.col("name").alias("callee"), "n", "target"), ["repo_id", "language", "callee"], "left")
    edges = met.where("n = 1").select(F.concat_ws(":", "file_id", "name").alias("src"), F.concat_ws(":", "target", "callee").alias("dst")).distinct()
    open_ = met.where("n IS NULL OR n > 1").groupBy(F.when(F.col("n").isNull(), "none").otherwise("ambiguous").alias("reason")).agg(F.count("*").alias("n"))
    return edges, open_


def clone_groups(functions: DataFrame, least_tokens: int, least: int = 2) -> DataFrame:
    """Functions with equal normalised streams: ``digest, functions, files, tokens``."""
    kept = functions.where(F.col("tokens") >= least_tokens)
    return kept.groupBy("digest").agg(F.count("*").alias("functions"), F.countDistinct("file_id").alias("files"), F.max("tokens").alias("tokens")).where(F.col("functions") >= least)


def lcs_similar(a: list, b: list, share: float) -> bool:
    """Whether the longest common subsequence reaches ``ceil(share * (m + n) / 2)``.

    Bit-parallel: one big-integer step for each token of ``b``.
    """
    m, n = len(a), len(b)
    need = -(-int(round(share * 1000)) * (m + n) // 2000)
    if min(m, n) < need:
        return False
    masks: dict = {}
    for i, t in enumerate(a):
        masks[t] = masks.get(t, 0) | 1 << i
    row, full = (1 << m) - 1, (1 << m) - 1
    for t in b:
        hit = row & masks.get(t, 0)
        row = ((row + hit) | (row - hit)) & full
    return m - row.bit_count() >= need


def leaders(items: list[tuple], share: float, least: int) -> list[list[int]]:
    """Greedy leader clusters in order: a member is compared with its leader only.

    ``items``: (position, tokens). Groups below ``least`` release their members.
    """
    left, out = list(items), []
    while left:
        head, *rest = left
        group = [head] + [x for x in rest if x[1] == head[1] or lcs_similar(head[1], x[1], share)]
        taken = {x[0] for x in group}
        if len(group) >= least:
            out.append([x[0] for x in group])
            left = [x for x in rest if x[0] not in taken]
        else:
            left = rest
    return out
