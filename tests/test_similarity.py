import random

import numpy as np
import pytest

from lithoscope.operators import functions as Fn
from lithoscope.operators import similarity as S


def test_streams_against_all_pairs(spark):
    rng = random.Random(6)
    rows = []
    for i in range(25):
        base = [rng.choice("ID NUM ( ) ; if return = + STR".split()) for _ in range(rng.randrange(20, 60))]
        for _ in range(3):
            c = list(base)
            for _ in range(rng.randrange(8)):
                c[rng.randrange(len(c))] = rng.choice(["ID", "x", "else"])
            rows.append((rng.choice(["go", "rust"]), len(rows), len(c), " ".join(c)))
    got = {(r.a, r.b) for r in S.similar_streams(spark.createDataFrame(rows, "language string, digest bigint, tokens bigint, stream string"), 0.85, 25).collect()}
    kept = [r for r in rows if r[2] >= 25]
    want = {(a[1], b[1]) for a in kept for b in kept if a[1] < b[1] and a[0] == b[0] and Fn.lcs_similar(a[3].split(), b[3].split(), 0.85)}
    assert got == want and len(want) > 5


@pytest.mark.parametrize("least", [2, 3, 4])
def test_leaders_against_sequence(spark, least):
    rng = random.Random(least)
    n = 40
    edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(60)}
    got = {}
    nodes = spark.createDataFrame([(i,) for i in range(n)], "ord bigint")
    for r in S.leader_groups(nodes, spark.createDataFrame(sorted(edges), "a bigint, b bigint"), least).collect():
        got.setdefault(r.leader, set()).add(r.member)
    free, want = list(range(n)), {}
    while free:
        head, *rest = free
        group = {x for x in rest if (head, x) in edges}
        if group and len(group) + 1 >= least:
            want[head] = {head} | group
            free = [x for x in rest if x not in group]
        else:
            free = rest
    assert got == want


def test_nothing_similar(spark):
    nodes = spark.createDataFrame([(1,)], "ord bigint")
    assert S.leader_groups(nodes, spark.createDataFrame([], "a bigint, b bigint"), 2).count() == 0


def test_blocks_against_all_pairs(spark):
    """Candidates aren't written; long streams, several blocks and lost tokens keep every pair."""
    rng, rows = random.Random(1), []
    for _ in range(40):
        base = [rng.choice("ID NUM ( ) ; if return = + STR".split()) for _ in range(rng.randrange(20, 400))]
        for _ in range(4):
            c = list(base)
            for _ in range(rng.randrange(int(len(c) * 0.3))):
                k = rng.randrange(len(c))
                if rng.random() < 0.5:
                    del c[k]
                else:
                    c.insert(k, rng.choice(["ID", "x", "else"]))
            rows.append(("go", rng.getrandbits(60), len(c), " ".join(c)))
    pairs = S.similar_streams(spark.createDataFrame(rows, "language string, digest bigint, tokens bigint, stream string"), 0.85, 20)
    assert "CartesianProduct" in pairs._jdf.queryExecution().toString()
    kept = [r for r in rows if r[2] >= 20]
    want = {(a[1], b[1]) for a in kept for b in kept if a[1] < b[1] and Fn.lcs_similar(a[3].split(), b[3].split(), 0.85)}
    assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) > 50


def _block(streams):
    words = sorted({t for s in streams for t in s})
    order = sorted(range(len(streams)), key=lambda i: (len(streams[i]), i))
    ids = np.array([words.index(t) for i in order for t in streams[i]], dtype=np.int64)
    return S.Block(np.array([len(streams[i]) for i in order]), np.array(order, dtype=np.int64), words, ids)


@pytest.mark.parametrize("share", [0.7, 0.85, 0.95])
def test_rare_words_lose_no_pair(share):
    """Streams of frequent words only, of rare ones only, of one token and of many words."""
    rng, streams = random.Random(4), [["ID"], ["if"], ["ID"] * 150, ["ID", "."] * 80]
    for _ in range(60):
        length = rng.choice([3, 40, 90, 130, 300])
        base = rng.choices("ID . ( ) , if for = [ ] NUM STR return + - { } ;".split(), [30, 12, 10, 10, 8, *[2] * 13], k=length)
        for _ in range(4):
            c = list(base)
            for _ in range(rng.randrange(int(length * 0.25) + 1)):
                k = rng.randrange(len(c))
                c[k : k + rng.randrange(2)] = rng.choice([[], ["ID"], ["while"], ["="]])
                c = c or ["ID"]
            streams.append(c)
    streams = [list(x) for x in dict.fromkeys(map(tuple, streams))]
    got = [(x, y) for f, g in S.met(_block(streams[::2] + streams[1::2]), S.Partners(_block(streams[::2] + streams[1::2])), share) for x, y in zip(f.tolist(), g.tolist())]
    kept = streams[::2] + streams[1::2]
    want = {(i, j) for i in range(len(kept)) for j in range(i) if Fn.lcs_similar(kept[i], kept[j], share)}
    assert {(max(p), min(p)) for p in got} == want and len(got) == len(want) > 10


def test_hopeless_pairs_end_early(monkeypatch):
    """Streams of like length and like tokens in another order take a small part of the steps."""
    rng, steps, step = random.Random(3), [], S._step
    words = "ID . ( ) , if for = [ ] NUM STR return + - { } ;".split()
    tokens = rng.choices(words, [30, 12, 10, 10, 8, *[3] * 13], k=200)
    block = _block([rng.sample(tokens, 200) for _ in range(100)])
    monkeypatch.setattr(S, "_step", lambda row, *rest: steps.append(row.size) or step(row, *rest))
    assert not list(S.met(block, S.Partners(block), 0.85))
    assert sum(steps) < 0.15 * 200 * 4 * 100 * 99 / 2  # 200 tokens, four words of 63 places, all pairs
