"""Writers of issue tables: JSON lines, SARIF, HTML and plain text.

Large results stay distributed (:func:`write_issues`); the single-document
forms are for gated, human-sized reports and stream rows to the driver.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_issues(report: DataFrame, path: str) -> None:
    """JSON lines, one issue each, written by the executors."""
    report.select(F.to_json(F.struct(*report.columns)).alias("value")).write.mode("overwrite").text(path)


def _rows(report: DataFrame) -> Iterator[dict]:
    for r in report.orderBy("issue_id").toLocalIterator():
        yield r.asDict(recursive=True)


def _atomic(path: str, chunks: Iterator[str]) -> None:
    """Written beside the target, synced and renamed."""
    temporary = Path(f"{path}.part")
    with temporary.open("w", encoding="utf-8") as f:
        for c in chunks:
            f.write(c)
        f.flush()
        os.fsync(f.fileno())
    temporary.replace(path)


def write_sarif(report: DataFrame, path: str, tool: str = "lithoscope") -> None:
    """SARIF 2.1.0: a result for each issue, first location only, no level."""

    def chunks() -> Iterator[str]:
        yield json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json"})[:-1] + ', "runs": [{"tool": {"driver": {"name": %s}}, "results": [' % json.dumps(tool)
        for i, r in enumerate(_rows(report)):
            where = {"artifactLocation": {"uri": r["path"]}}
            line = r["evidence"][0]["line"] if r["evidence"] else None
            if line:
                where["region"] = {"startLine": line}
            yield ("," if i else "") + json.dumps(
                {"ruleId": r["family"], "message": {"text": r["family"]}, "locations": [{"physicalLocation": where}], "partialFingerprints": {"issueId": r["issue_id"]}}
            )
        yield "]}]}"

    _atomic(path, chunks())


def write_html(report: DataFrame, path: str) -> None:
    """A self-contained page with the issues embedded as JSON."""

    def chunks() -> Iterator[str]:
        yield "<!DOCTYPE html><meta charset=utf-8><title>Report</title><table id=t></table><script type='application/json' id=d>["
        for i, r in enumerate(_rows(report)):
            yield ("," if i else "") + json.dumps(r).replace("<", "\\u003c")
        yield "]</script><script>for(const r of JSON.parse(d.textContent)){const e=t.insertRow();for(const k of ['issue_id','family','path'])e.insertCell().textContent=r[k]}</script>"

    _atomic(path, chunks())


def write_text(report: DataFrame, path: str) -> None:
    """Counts and one line for each issue."""

    def chunks() -> Iterator[str]:
        n = 0
        for r in _rows(report):
            n += 1
            yield f"{r['issue_id']} {r['family']} {r['path'] or ''} ({len(r['evidence'])})\n"
        yield f"{n} issues\n"

    _atomic(path, chunks())


FORMATS = {".json": write_issues, ".jsonl": write_issues, ".sarif": write_sarif, ".html": write_html, ".txt": write_text}


def write_report(report: DataFrame, path: str) -> None:
    """The format follows the extension; plain text without one."""
    FORMATS.get(Path(path).suffix.lower(), write_text)(report, path)
