import json

import pytest
from pyspark.sql import functions as F

from lithoscope.operators import issues
from lithoscope.sources import corpus, sinks


def test_read_tree(spark, tmp_path):
    for name, data in {
        "src/a.py": b"x = 1\n", "src/b.js": b"\xef\xbb\xbflet a;", "src/w.cs": b"\xff\xfea\0b\0", "src/bad.go": b"\x80", "src/odd.rs": b"\xff\xfea", "node_modules/c.js": b"1", ".hid/d.py": b"1",
        "tests/t.py": b"1", "notes.txt": b"no", "lib/skip/e.py": b"1",
    }.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    rows = {r.path: r for r in corpus.read_tree(spark, str(tmp_path), ignore=["lib/skip"]).collect()}
    assert set(rows) == {"src/a.py", "src/b.js", "src/w.cs", "src/bad.go", "src/odd.rs", "tests/t.py"}
    assert rows["src/b.js"].source == "let a;" and rows["src/w.cs"].source == "ab"
    assert rows["src/bad.go"].failure == "invalid_encoding" and rows["src/odd.rs"].failure == "invalid_encoding"
    assert rows["tests/t.py"].is_test
    assert corpus.read_tree(spark, str(tmp_path), include_hidden=True, include_generated=True, exclude_tests=True).count() == 8


def test_ignore_files(spark, tmp_path):
    for name, data in {".gitignore": "*.gen.py\n/out/\n!keep.gen.py\n", "a.gen.py": "1", "x/keep.gen.py": "1", "out/b.py": "1", "x/out/c.py": "1", "x/.gitignore": "d.py\n", "x/d.py": "1", "d.py": "1"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(data)
    got = {r.path for r in corpus.read_tree(spark, str(tmp_path), include_generated=True).collect()}
    assert got == {"x/keep.gen.py", "x/out/c.py", "d.py"}
    assert corpus.read_tree(spark, str(tmp_path), include_generated=True, gitignore=False).count() == 6
    assert [r.path for r in corpus.read_tree(spark, str(tmp_path / "d.py")).collect()] == ["d.py"]


def test_git_log(spark, tmp_path):
    p = tmp_path / "log"
    p.write_text("commit:a1\tann\n3\t1\tsrc/x.py\n-\t-\timg.png\n\ncommit:b2\tbob\n2\t0\told.py => new.py\n")
    got = sorted((r.commit, r.path, r.added) for r in corpus.read_git_log(spark, str(p)).collect())
    assert got == [("a1", "img.png", None), ("a1", "src/x.py", 3), ("b2", "new.py", 2)]


def test_config():
    assert corpus.load_config('preset = "strict"\n[thresholds]\nloc = 7', ["complexity=9"]) | {} == corpus.PRESETS["strict"] | {"loc": 7, "complexity": 9}
    for bad in ('preset = "odd"', "[other]\nx = 1", "[thresholds]\nloc = 0", "[thresholds]\nnope = 3"):
        with pytest.raises(ValueError):
            corpus.load_config(bad)


def test_reports(spark, tmp_path):
    good = {"schema_version": 26, "issues": [{"id": "i", "family": "f", "evidence": []}]}
    (tmp_path / "good.json").write_text(json.dumps(good, indent=1))
    assert corpus.read_reports(spark, str(tmp_path / "good.json")).first().issues[0].id == "i"
    for n, change in enumerate(({"schema_version": 25}, {"extra": 1})):
        (tmp_path / f"bad{n}.json").write_text(json.dumps(good | change))
        with pytest.raises(Exception):
            corpus.read_reports(spark, str(tmp_path / f"bad{n}.json")).collect()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("long", "size", "a<b.py", "f", 3, 90.0, 80.0, "k1")], "rule string, family string, path string, symbol string, line int, value double, threshold double, anchor string")
    report = issues.issues(issues.evidence(rows))
    for ext in ("sarif", "html", "txt", "jsonl"):
        sinks.write_report(report, str(tmp_path / f"r.{ext}"))
    sarif = json.loads((tmp_path / "r.sarif").read_text())
    assert sarif["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 3
    assert "a\\u003cb.py" in (tmp_path / "r.html").read_text()
    assert (tmp_path / "r.txt").read_text().endswith("1 issues\n")
    assert spark.read.json(str(tmp_path / "r.jsonl")).count() == 1
    assert report.select(F.size("evidence")).first()[0] == 1
