import random

from lithoscope.llm import near_duplicates as N
from lithoscope.llm import shared_spans as S

WORDS = [f"w{i}" for i in range(400)]


def corpus(seed, n=60):
    rng = random.Random(seed)
    base = [[rng.choice(WORDS) for _ in range(rng.randrange(60, 400))] for _ in range(n)]
    out = []
    for b in base:
        out.append(" ".join(b))
        for _ in range(rng.randrange(3)):
            c = list(b)
            for _ in range(rng.randrange(0, 12)):
                c[rng.randrange(len(c))] = rng.choice(WORDS)
            out.append(" ".join(c))
    return [(i + 1, t) for i, t in enumerate(out)] + [(900, None), (901, ""), (902, "short text"), (903, out[0]), (904, out[0].replace(" ", "\n"))]


def sets(t):
    w = N._WORDS(t or "")
    return len(w), {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_duplicates_against_brute_force(spark):
    rows = corpus(1)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "file_id bigint, source string, rep string, cls string")
    members, links = N.similar_classes(df, 0.6, 50)
    got = {(r.file_a, r.file_b) for r in N.pairs_of_records(members, links).collect()}
    data = [(i, *sets(t)) for i, t in rows]
    data = [(i, s) for i, n, s in data if n >= 50]
    want = {(a, b) for a, x in data for b, y in data if a < b and len(x & y) >= 0.6 * len(x | y)}
    assert got == want and len(want) > 20
    parent = {i: i for i, _ in data}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in want:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = {r.file_id: r.group_id for r in N.groups(members, links).collect()}
    assert found == {i: root(i) for i, _ in data}


def test_hot_block(spark):
    """More records in a bucket than a block holds: no pair is lost."""
    rng = random.Random(3)
    base = [rng.choice(WORDS) for _ in range(300)]
    rows = []
    for i in range(N.BLOCK + 60):
        c = list(base)
        c[i % 300] = f"u{i}"
        rows.append((i, " ".join(c)))
    members, links = N.similar_classes(spark.createDataFrame(rows, "file_id bigint, source string"), 0.6, 50)
    n = len(rows)
    assert links.count() == n * (n - 1) // 2 and members.count() == n


def test_empty_and_depth(spark):
    e = spark.createDataFrame([], "file_id bigint, source string")
    members, links = N.similar_classes(e, 0.6, 50)
    assert members.count() == 0 and links.count() == 0 and N.groups(members, links).count() == 0
    assert S.shared_spans(e).count() == 0
    floors = [N.floor_depth(t) for t in (0.1, 0.4, 0.6, 0.85, 0.95)]
    assert floors == sorted(floors) and floors[0] == 1 and floors[2] < floors[3]
    assert all(N.met(t, f) >= N.FLOOR_RECALL for t, f in zip((0.4, 0.6, 0.85), floors[1:]))


def test_forest_at_all_presets(spark):
    rows = corpus(5, 80)
    df = spark.createDataFrame(rows, "file_id bigint, source string")
    data = [(i, s) for i, n, s in ((i, *sets(t)) for i, t in rows) if n >= 30]
    for threshold in (0.4, 0.6, 0.85):
        got = {(r.file_a, r.file_b) for r in N.pairs_of_records(*N.similar_classes(df, threshold, 30)).collect()}
        want = {(a, b) for a, x in data for b, y in data if a < b and len(x & y) >= threshold * len(x | y)}
        assert got == want and want, threshold


def test_descent(spark):
    """Each level holds the pairs whose longest shared prefix ends there, whatever the chunks."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    base = rng.integers(-2**31, 2**31, N.HASHES)
    sigs = []
    for i in range(40):
        s = base.copy()
        change = rng.random(N.HASHES) < rng.choice([0.05, 0.3, 0.6])
        s[change] = rng.integers(-2**31, 2**31, int(change.sum()))
        sigs.append((i, [int(x) for x in s]))
    reps = spark.createDataFrame(sigs, "rep bigint, sig array<int>")
    floor = 3
    prefixes = N.labels(floor + N.STEPS)
    want = {d: set() for d in range(floor, floor + N.STEPS + 1)}
    for a, x in sigs:
        for b, y in sigs:
            if a < b:
                for f in prefixes:
                    n = next((k for k, i in enumerate(f) if x[i] != y[i]), len(f))
                    if n >= floor:
                        want[n].add((a, b))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        chunks = N.forest(reps, floor)
        for d, pairs in want.items():
            assert {(r.a, r.b) for r in N.matched(chunks, floor, d).collect()} == pairs and pairs
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    links = spark.range(1000).select(F.lit(0.9).alias("similarity"))
    assert N.estimated_recall(links, 0.6, 4) > 0.999 > N.estimated_recall(links.select(F.lit(0.6).alias("similarity")), 0.6, 6)
    assert N.estimated_recall(links.limit(0), 0.6, 4) == 0.0


def test_large_classes_are_joined_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    rows = corpus(1, 10)
    rows += [(2000 + i, rows[0][1]) for i in range(45)] + [(3000 + i, rows[1][1]) for i in range(20)]
    members, links = N.similar_classes(spark.createDataFrame(rows, "file_id bigint, source string"), 0.6, 50)
    got = [(r.file_a, r.file_b) for r in N.pairs_of_records(members, links).collect()]
    data = [(i, s) for i, n, s in ((i, *sets(t)) for i, t in rows) if n >= 50]
    want = {(a, b) for a, x in data for b, y in data if a < b and len(x & y) >= 0.6 * len(x | y)}
    assert len(got) == len(set(got)) and set(got) == want


def shared(rows):
    where = {}
    for i, t in rows:
        for k in range(len(t or "") - S.LEAST + 1):
            where.setdefault(t[k : k + S.LEAST], set()).add(i)
    out = {}
    for i, t in rows:
        cover = set()
        for k in range(len(t or "") - S.LEAST + 1):
            if len(where[t[k : k + S.LEAST]]) > 1:
                cover.update(range(k, k + S.LEAST))
        if cover:
            out[i] = len(cover)
    return out


def test_shared_spans_against_brute_force(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdé🙂 \n") for _ in range(n))
    pool = [text(rng.randrange(280, 700)) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(0, 500))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(pool)
            a = rng.randrange(0, len(p) - 250)
            parts += [p[a : a + rng.choice([299, 300, 301, 350, 700])], text(rng.randrange(0, 200))]
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "x" * 299), (103, "y" * 5000), (104, "y" * 299), (105, pool[0] * 2), (106, "z" * 400), (106, "z" * 400)]
    # one passage that many records hold, each in other surroundings
    rows += [(200 + k, text(200) + pool[1][:305] + text(200)) for k in range(2 * S.GROUP)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "file_id bigint, source string, gram string")
    got = {r.file_id: r.shared_chars for r in S.shared_spans(df).collect()}
    assert got == shared(rows)


def _brute_shared(rows):
    """Code points in spans of LEAST that another record holds, by comparing all of them."""
    grams = {i: [t[k : k + S.LEAST] for k in range(len(t) - S.LEAST + 1)] for i, t in rows}
    holders = {}
    for i, spans in grams.items():
        for x in set(spans):
            holders.setdefault(x, set()).add(i)
    out = {}
    for i, spans in grams.items():
        mark = bytearray(len(dict(rows)[i]))
        for k, x in enumerate(spans):
            if len(holders[x]) > 1:
                mark[k : k + S.LEAST] = b"\1" * S.LEAST
        if any(mark):
            out[i] = sum(mark)
    return out


def test_repeated_blocks(spark):
    """A record that repeats a block many times beside others that hold pieces of it."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh {}()\n") for _ in range(n))
    block, other = text(310), text(400)
    rows = [(1, block * 40 + text(50)), (2, text(200) + block[5:] + block[:120] + text(100)), (3, text(80) + (block * 2)[100:420] + text(90)), (4, text(900)), (5, other + text(70)), (6, text(33) + other), (7, "é" * 900), (8, "é" * 500 + text(100))]
    got = {r.file_id: r.shared_chars for r in S.shared_spans(spark.createDataFrame(rows, "file_id bigint, source string")).collect()}
    assert got == _brute_shared(rows)
    # the same at a size where comparing all places would take hours
    big = [(1, block * 20_000), (2, text(200) + block[5:] + block[:120] + text(100)), (3, text(80) + (block * 2)[100:420] + text(90))]
    got = {r.file_id: r.shared_chars for r in S.shared_spans(spark.createDataFrame(big, "file_id bigint, source string")).collect()}
    want = _brute_shared([(1, block * 6), *big[1:]])
    assert {k: got[k] for k in (2, 3)} == {k: want[k] for k in (2, 3)} and got[1] > 0.9 * len(big[0][1])


def test_pieces(monkeypatch):
    import numpy as np

    rng = random.Random(9)
    t = "".join(rng.choice("abc") for _ in range(5000)) + "z" * 1200 + "".join(rng.choice("abc") for _ in range(900))
    whole = [np.concatenate(x) for x in zip(*S.kept_contexts(t))]
    assert (whole[0] == S.kept_windows(S.Text(t))[0]).all()
    for size in (700, 1000, 3333, 7100):
        monkeypatch.setattr(S, "PIECE", size)
        cut = [np.concatenate(x) for x in zip(*S.kept_contexts(t))]
        assert all((a == b).all() for a, b in zip(whole, cut)), size
    assert S._length(np.array([5, 0, 3]), np.array([9, 4, 6])) == 9 and S._length(np.array([0, 10]), np.array([3, 12])) == 5


def test_hot_keys_are_split(spark, monkeypatch):
    from lithoscope.llm import skew

    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "id AS v")
    keyed = rows.groupBy("k").count()
    want = sorted(map(tuple, rows.join(keyed, ["k"]).collect()))
    for most in (skew.BROADCAST_ROWS, 0):
        monkeypatch.setattr(skew, "BROADCAST_ROWS", most)
        assert sorted(map(tuple, skew.hot_join(rows, keyed, ["k"], "v", "count", 100).collect())) == want
