import numpy as np
import pandas as pd
import pytest

from lithoscope.llm import handwritten as H
from lithoscope.llm import mixing
from lithoscope.llm import toxicity as X


def hand(i, rng):
    return "".join(f"def f{i}_{k}(a, b):\n    total = helper_{rng.integers(99)}(a, {k})\n    if total > b:\n        return total\n    return b\n\n" for k in range(8))


def test_classifiers_and_operator(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        rows.append((i, i % 9, f"src/mod{i % 5}/f{i}.py", hand(i, rng)))
    for i in range(200, 240):
        table = "T = [\n" + "".join("    " + ", ".join(f"0x{rng.integers(2**32):08x}" for _ in range(8)) + ",\n" for _ in range(20)) + "]\n"
        rows.append((i, i % 9, f"src/mod{i % 5}/t{i}.py", table))
    for i in range(300, 330):
        body = "# Code generated by gen 1. DO NOT EDIT.\n" * (i % 2) + "".join(f"_FIELD_{rng.integers(10**6)}_NUMBER = {k}\n_D{k} = _pool.field({k}, 'x')\n" for k in range(30))
        rows.append((i, i % 9, f"src/mod{i % 5}/m{i}_pb2.py" if i % 3 else f"src/mod{i % 5}/m{i}.py", body))
    rows += [(400, 1, "third_party/lib/a.py", hand(1, rng)), (401, 1, "src\\vendors\\a.py", hand(2, rng)), (402, None, None, None), (403, None, None, "  "), (404, None, None, hand(3, rng))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "file_id bigint, repo_id bigint, display_path string, source string, body string")
    models, figures = H.train(df)
    assert figures["made_recall"] > 0.9 and figures["made_precision"] > 0.9
    got = {r.file_id: r.reason for r in H.classify(df, models).collect()}
    assert all(got[i] is None for i in range(120)) and all(got[i] for i in range(200, 240)) and sum(got[i] is not None for i in range(300, 330)) >= 28
    assert got[400] == "copied" and [got[i] for i in (401, 402, 403, 404)] == [None] * 4
    H.save(spark, models, str(tmp_path / "models"))
    assert {r.file_id: r.reason for r in H.classify(df, H.load(spark, str(tmp_path / "models"))).collect()} == got
    empty = df.limit(0)
    assert H.classify(empty, H.train(empty)[0]).count() == 0


def test_notices_are_learnt_from_folders():
    """What files in folders for copies say tells copies elsewhere; one line that
    speaks of generators or owners condemns no file."""
    rng = np.random.default_rng(4)
    rows, says = [], ["Parse the header", "Return the sum of both", "TODO: drop this branch", "The cache is shared"]
    for i in range(400):
        rows.append((i % 11, f"src/mod{i % 7}/f{i}.py", f"# {says[i % 4]} of step {i}\n" + hand(i, rng)))
    for i in range(60):
        notice = f"# Taken over from lib{i % 5} release {i}.{i % 3}; ask its maintainers first\n" if i % 2 else ""
        rows.append((i % 11, f"third_party/lib{i % 5}/f{i}.py", notice + f"# {says[i // 2 % 4]} of step {i}\n" + hand(i, rng)))
    models, figures = H.fit(pd.DataFrame(rows, columns=["repo_id", "path", "source"]).sample(frac=1, random_state=1).reset_index(drop=True))
    assert figures["copied_recall"] == 1.0
    body = hand(7, rng)
    assert models.score_copied("# Taken over from libnew release 7.1; ask its maintainers first\n" + body, "src/mod1/x.py") > 0
    for line in ("Generated tokens are cached per user", "This module is generated lazily", "part of the public API; do not edit without review", "Parse the header of step 9"):
        text = f"# {line}\n" + body
        assert max(models.score_copied(text, "src/mod1/x.py"), models.score_made(text, "src/mod1/x.py")) <= 0, line


def test_giveaways_are_masked():
    text = "# Code generated by zap. DO NOT EDIT.\nx = 1\n# plain words\n"
    assert H.comment_lines(text) == ["plain words"] and H.weak_label(text, "a.py") == 1
    for line in ("@generated by zap", "<auto-generated />", "This file was automatically generated by zap", "GENERATED CODE - DO NOT MODIFY BY HAND"):
        assert H.GIVEAWAY.search(line), line
    assert not H.GIVEAWAY.search("Not generated: edit freely")
    assert [x for x, _ in H.body_hashes(text, "a.py")] == [0, H.DIM, 2 * H.DIM]
    assert all((a[1] == b[1]).all() for a, b in zip(H.body_hashes(text, "a.py"), H.body_hashes("x = 1\n", "b.py")))


def test_svm_separates():
    rows = [H.Vector([(0, np.array([i % 7, 20 + i % 3]))]) for i in range(60)]
    y = np.array([1.0 if i % 7 < 3 else -1.0 for i in range(60)])
    w = H.train_svm(rows, y, H.DIM, cost=10)
    assert all((w[r.at] @ r.x + w[-1] > 0) == (v > 0) for r, v in zip(rows, y))


def test_crf_marginals_against_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    crf = X.CRF(trans=rng.normal(size=(2, 2)), start=rng.normal(size=2))
    b = X.Batch([[0] * 4, [0], [0] * 3], np.zeros(1, np.int64))
    e = rng.normal(size=b.n)
    p, flow = crf.marginals(b, e, np.ones(b.n))
    want, moved = [], np.zeros((2, 2))
    for s, n in zip(b.starts, b.lengths):
        weight = {}
        for path in itertools.product((0, 1), repeat=int(n)):
            v = crf.start[path[0]] + sum(e[s + t] for t in range(n) if path[t]) + sum(crf.trans[a, c] for a, c in zip(path, path[1:]))
            weight[path] = np.exp(v)
        z = sum(weight.values())
        want += [sum(w for q, w in weight.items() if q[t]) / z for t in range(n)]
        for q, w in weight.items():
            for a, c in zip(q, q[1:]):
                moved[a, c] += w / z
    assert np.allclose(p, want) and np.allclose(flow, moved)


def test_spellings():
    known = X.Spellings(["idiot", "parasite"])
    for s in ("idiot", "IDIOT", "idiooooot", "i-d-i-o-t", "id1ot", "i***t", "іdіоt", "id#ot", "i d i o t"):
        assert X._TOKEN.findall(s) == [s] and known.read(s, X.normal_form(s)) == "idiot", s
    assert known.read("parsite", "parsite") == "parasite" and known.read("paarsite", X.normal_form("paarsite")) == "parasite"
    for s in ("assembly", "src/a/b.py", "idle_token", "class", "editor"):
        assert known.read(s, X.normal_form(s)) not in known.known, s


def _labelled(n):
    frames = ["Please rebase, `{}` conflicts with the change.", "The number of rows went from {} to 9.", "Thanks, that explains why {} fails.", "Kill the child process {} first.", "This {} is garbage, I was an idiot to write it."]
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(n):
        t = " ".join(frames[int(rng.integers(5))].format(f"x{rng.integers(50)}") for _ in range(3))
        if i % 8 == 0:
            t += [" Shut up, you worthless idiot.", " You are a worthless moron and everybody knows it.", " Nobody wants you here, you pathetic moron!"][i // 8 % 3]
        docs.append((i, t, "s", 0.5))
        labels.append((i, 1 if i % 8 == 0 else 0, "insult" if i % 8 == 0 else None))
    return docs, labels


def test_toxicity(spark, tmp_path):
    docs, labels = _labelled(240)
    docs += [(900, None, "s", 0.5), (901, "", None, 0.5), (902, " \n", "s", 0.5), (903, "Nobody wants you here, you pathetic m​oron!", "s", 0.5), (904, "the daemon dies when its parent is killed " * 400, "s", 0.5), (905, "Nobody wants you here, you pathetic m*r*n!", None, 0.5)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, score double")
    l = spark.createDataFrame(labels + [(900, None, None)], "doc_id bigint, abusive int, category string")
    model = X.train(d, l)
    assert "moron" in model[1]
    got = {r.doc_id: r for r in X.score_documents(d, model, ["doc_id", "source"]).collect()}
    assert {i for i, r in got.items() if r.score >= X.THRESHOLD} == set(range(0, 240, 8)) | {903, 905}
    assert [got[i].score for i in (900, 901, 902)] == [0.0] * 3
    X.save(spark, model, str(tmp_path / "model"))
    again = {r.doc_id: r.score for r in X.score_documents(d, X.load(spark, str(tmp_path / "model")), ["doc_id"]).collect()}
    assert again == {i: r.score for i, r in got.items()}
    text = docs[0][1]
    p = got[0].passages[0]
    assert "you worthless idiot" in text[p.begin : p.end] and "rows" not in text[p.begin : p.end]
    assert X.score_documents(d.limit(0), model, ["doc_id"]).count() == 0
    none = X.train(d, l.where("abusive = 0"))
    assert X.score_documents(d, none, ["doc_id"]).where("score >= 0.01").count() == 0
    assert X.score_documents(d, X.train(d.limit(0), l), ["doc_id"]).where("score >= 0.01").count() == 0


def test_validation_holds_documents_out(spark):
    docs, labels = _labelled(400)
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, score double")
    got = {r.label: (r.documents, r.flagged) for r in X.validate(d, spark.createDataFrame(labels, "doc_id bigint, abusive int, category string")).collect()}
    assert 0 < sum(n for n, _ in got.values()) < 150
    assert got[1][0] == got[1][1] and got[0][1] == 0


def test_training_rows_are_drawn_by_hash(spark, monkeypatch):
    """The bounds hold for each kind of document apart, whatever the order of ids."""
    for name, bound in (("POSITIVE_DOCS", 40), ("NEGATIVE_DOCS", 300), ("BACKGROUND_DOCS", 200)):
        monkeypatch.setattr(X, name, bound)
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    known = spark.range(2000).selectExpr("id AS doc_id", "CAST(id % 10 = 0 AS INT) AS label")
    rows = X.training_rows(docs, known).collect()
    for label, want in ((1, 40), (0, 300), (-1, 200 * 4000 / 6000)):
        ids = [r.doc_id for r in rows if r.label == label]
        assert abs(len(ids) - want) < 5 * want**0.5
        assert max(ids) > (1500 if label >= 0 else 5000)


def test_document_labels(spark):
    rows = [(1, 1, "insult"), (1, 0, None), (2, 1, "other"), (3, 1, "hate"), (3, 1, "other"), (4, 0, None), (4, None, None), (5, None, None)]
    got = {r.doc_id: r.label for r in X.document_labels(spark.createDataFrame(rows, "doc_id bigint, abusive int, category string")).collect()}
    assert got == {1: 1, 3: 1, 4: 0}


def test_mixing(spark):
    rng = np.random.default_rng(4)
    docs = []
    for i in range(1500):
        s = ["big", "mid", "small", None, "untargeted"][0 if i < 1000 else 1 if i < 1300 else 2 if i < 1340 else 3 if i < 1350 else 4]
        docs.append((i, " ".join(f"word{rng.integers(1000)}" for _ in range(int(rng.integers(5, 60)))), s, 1))
    docs += [(5000 + k, docs[1300][1], "small", 1) for k in range(3)] + [(6000, docs[0][1], "mid", 1), (6001, None, "big", 1), (6002, "", "big", 1)]
    targets = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 4), ("gone", 0.1, 2)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, tokens int")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(d, t)
    r = {x.source: x for x in report.collect()}
    assert set(r) == {"big", "mid", "small", "gone"} and r["gone"].share_reached == 0
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.1)):
        assert abs(r[s].share_reached - share / 0.9) < 0.01
    caps = {s: c for s, _, c in targets}
    text = {i: x for i, x, *_ in docs}
    uses = {}
    for x in mixed.collect():
        assert 1 <= x.copies <= caps[x.source]
        uses[text[x.doc_id]] = uses.get(text[x.doc_id], 0) + x.copies
    assert max(uses.values()) <= 4 and None not in uses and "" not in uses
    assert len(uses) == mixed.count()
    again = mixing.mix(d.repartition(7), t)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))
    none, empty = mixing.mix(d.limit(0), t)
    assert none.count() == 0 and empty.count() == 4
    over = {x.source: x for x in mixing.mix(d, t, total_tokens=10**9)[1].collect()}
    assert over["small"].copies_most == 4 and over["big"].copies_most == 1
