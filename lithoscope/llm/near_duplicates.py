"""Near-duplicate records by a MinHash LSH forest with exact verification.

Words are runs of ASCII letters, digits and underscores; a record is the set of
its runs of five words. Records with the same set are one class, and only
class representatives are compared. Each of ``TREES`` trees labels a
representative with a string of MinHash values; the sorted labels are the tree's
prefix trie, in which records that agree on a prefix are neighbours.

The tries are built once, from the shortest prefix that may be needed (at which
the modelled recall of a pair exactly at the threshold is ``FLOOR_RECALL``) to
``STEPS`` values more, and written: runs of records with that prefix, sorted by
label, records that are alone left out. The join descends them: it starts with
the longest prefixes, verifies what they match, and estimates from the
similarities of the verified pairs how many pairs these prefixes miss (a pair of
similarity s is met with probability ``1 - (1 - s**depth)**TREES``, so it stands
for one over that many; one pair at the threshold is always thought missed).
While the estimated recall is below ``RECALL`` the prefixes are shortened by a
value; pairs verified before aren't verified again. Candidates whose full
signatures differ by more than six standard errors are dropped, the rest is
verified on the texts, so precision is exact.

Hot prefixes: counts per prefix are aggregated on the map side; records of a
prefix with more than ``BLOCK`` are cut into blocks before they are brought
together, and block is compared with block in separate tasks. No pair is lost,
and no task sees more than two blocks of a prefix at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, spread, written
from .skew import SALTS, hot_rows

TREES, STEPS, HASHES = 64, 2, 128
RECALL, FLOOR_RECALL = 0.9999, 0.999
BLOCK = 256
SHINGLE = 5
_WORDS = re.compile(r"[A-Za-z0-9_]+", re.ASCII).findall
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240501)
_MUL = (_RNG.integers(1, 2**63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)


class _WordHashes(dict):
    """Word -> 64-bit hash; starts anew beyond a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()


def shingles(text: str) -> tuple[int, np.ndarray]:
    """Number of words and the sorted distinct hashes of five-word runs."""
    words = _WORDS(text)
    n = len(words) - SHINGLE + 1
    if n < 1:
        return len(words), np.zeros(0, np.uint64)
    a = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    h = a[:n].copy()
    for i in range(1, SHINGLE):
        h *= _MIX
        h ^= h >> np.uint64(29)
        h += a[i : i + n]
    return len(words), np.unique(h)


def signature(sets: np.ndarray) -> np.ndarray:
    """MinHash values, their upper 32 bits."""
    out = np.empty(HASHES, np.uint64)
    folded = sets ^ (sets >> np.uint64(31))
    for i in range(0, HASHES, 16):
        out[i : i + 16] = (folded[None, :] * _MUL[i : i + 16, None] + _ADD[i : i + 16, None]).min(axis=1)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def met(similarity: float, depth: int) -> float:
    """Modelled probability that a pair shares a prefix of ``depth`` in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def floor_depth(threshold: float, recall: float = FLOOR_RECALL) -> int:
    """The longest prefix that meets the recall for pairs at the threshold, at least 1."""
    return max([d for d in range(1, HASHES // 4) if met(threshold, d) >= recall], default=1)


def labels(depth: int) -> list[list[int]]:
    """The hash functions of each tree's prefix.

    Trees reuse the pool of hash functions under different strides, so no two
    trees share more than one of them at a given place.
    """
    out = []
    for t in range(TREES):
        stride = 1 if t < TREES // 2 else 2 * (t - TREES // 2) + 5
        start = t * 4 if t < TREES // 2 else t * 7
        out.append([(start + stride * i) % HASHES for i in range(depth)])
    return out


def record_sets(files: DataFrame, min_tokens: int, id_col: str = "file_id", text: str = "source") -> DataFrame:
    """file_id, cls (digest of the set), sig; only records of enough words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cls, sigs = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, s = shingles(t)
                if n < min_tokens or not len(s):
                    continue
                ids.append(i)
                cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                sigs.append(signature(s))
            if ids:
                flat = pa.array(np.concatenate(sigs), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, HASHES), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cls, pa.binary()), lists], names=["file_id", "cls", "sig"])

    rows = files.select(F.col(id_col).alias("file_id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & F.col("file_id").isNotNull())
    return spread(rows).mapInArrow(run, "file_id bigint, cls binary, sig array<int>")


_CHUNK = "runs binary, tails binary, sides binary, ids binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (node, i, j, tail, side, id) to chunks of whole runs with more than one record.

    A chunk is a row of packed columns, so it stays whole wherever a file is split.
    """
    held: list[np.ndarray] = []

    def chunk(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        key = np.stack(cols[:3])
        new = np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)] if key.shape[1] else np.zeros(0, bool)
        run = np.cumsum(new)
        many = np.bincount(run, minlength=1)[run] > 1
        if not many.any():
            return None
        packed = [run[many].astype(np.int32), cols[3][many], cols[4][many].astype(np.int8), cols[5][many]]
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in packed], names=["runs", "tails", "sides", "ids"])

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        if not len(cols[0]):
            continue
        # the last run may go on in the next batch; a run has at most two blocks
        last = np.ones(len(cols[0]), bool)
        for c in cols[:3]:
            last &= c == c[-1]
        held = [c[last] for c in cols]
        out = chunk([c[~last] for c in cols])
        if out is not None:
            yield out
    if held:
        out = chunk(held)
        if out is not None:
            yield out


def forest(reps: DataFrame, floor: int) -> DataFrame:
    """The written tries of (rep, sig): chunks of runs that share ``floor`` values.

    ``tails`` hold the next STEPS values of the label, so runs are sorted by label.
    """
    bits = 64 // STEPS
    kinds = []
    for t, f in enumerate(labels(floor + STEPS)):
        node = F.xxhash64(F.lit(t), *[F.get("sig", F.lit(i)) for i in f[:floor]])
        tail = F.lit(0).cast("bigint")
        for i in f[floor:]:
            tail = F.shiftleft(tail, bits).bitwiseOR(F.get("sig", F.lit(i)).cast("bigint").bitwiseAND(F.lit((1 << bits) - 1)))
        kinds.append(F.struct(node.alias("node"), tail.alias("tail")))
    rows = reps.select(F.col("rep").alias("id"), F.explode(F.array(*kinds)).alias("x")).select("x.node", "x.tail", "id")
    none = F.lit(0)
    hot = written(rows.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "hot-prefixes")
    cold, split = hot_rows(rows, hot, ["node"], "id")
    placed = cold.select("node", none.alias("i"), none.alias("j"), "tail", none.alias("side"), "id")
    if split is not None:
        nb = F.ceil(F.col("n") / (BLOCK // 2)).cast("int")
        blocks = (
            split.withColumn("at", F.pmod(F.xxhash64("id", F.lit(7)), nb).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), nb - 1)))
            # within a block all pairs, between two only those across
            .select("node", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "tail",
                    F.when(F.col("at") == F.col("other"), 0).when(F.col("at") < F.col("other"), 1).otherwise(2).alias("side"), "id")
        )
        placed = placed.unionByName(blocks)
    runs = placed.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "tail", "id").select("node", "i", "j", "tail", "side", "id")
    return written(runs.mapInArrow(_pack, _CHUNK), "forest")


def matched(chunks: DataFrame, floor: int, depth: int) -> DataFrame:
    """Pairs (a < b) whose longest shared prefix in some tree has ``depth`` values.

    At ``floor + STEPS`` also longer ones, as labels end there.
    """
    bits = 64 // STEPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for runs, tails, sides, ids in zip(*(c.to_pylist() for c in batch.columns)):
                runs, tails, sides, ids = np.frombuffer(runs, np.int32), np.frombuffer(tails, np.uint64), np.frombuffer(sides, np.int8), np.frombuffer(ids, np.int64)
                # prefixes of this depth are finer runs of the same order
                cut = np.uint64(bits * (floor + STEPS - depth))
                fine = tails >> cut if int(cut) < 64 else np.zeros(len(tails), np.uint64)
                first = np.flatnonzero(np.r_[True, (runs[1:] != runs[:-1]) | (fine[1:] != fine[:-1])])
                size = np.diff(np.r_[first, len(runs)])
                out = []
                for n in np.unique(size[size > 1]):
                    at = first[size == n]
                    x, y = np.triu_indices(int(n), 1)
                    for some in np.array_split(at, max(1, len(at) * len(x) // 500_000)):
                        a, b = (some[:, None] + x).ravel(), (some[:, None] + y).ravel()
                        use = (sides[a] == 0) | (sides[a] != sides[b])
                        if depth < floor + STEPS:  # deeper ones were met before
                            finer = np.uint64(bits * (floor + STEPS - depth - 1))
                            use &= (tails[a] >> finer) != (tails[b] >> finer)
                        use &= ids[a] != ids[b]
                        a, b = ids[a[use]], ids[b[use]]
                        out.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
                if out:
                    both = np.unique(np.concatenate(out, axis=1), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    return chunks.mapInArrow(run, "a bigint, b bigint").distinct()


def similar_classes(files: DataFrame, threshold: float, min_tokens: int, id_col: str = "file_id", text: str = "source") -> tuple[DataFrame, DataFrame]:
    """(members, links): ``file_id, rep`` and verified ``a, b, similarity``.

    ``rep`` is the smallest id among the records with the same set; ``a < b``
    are representatives whose exact Jaccard similarity reaches ``threshold``.
    Null and short texts are in neither; a repeated id counts once; extra
    columns are not read.
    """
    ship_package(files.sparkSession)
    sets = written(record_sets(files, min_tokens, id_col, text), "record-sets")
    reps = sets.groupBy("cls").agg(F.min(F.struct("file_id", "sig")).alias("r")).select("cls", F.col("r.file_id").alias("rep"), F.col("r.sig").alias("sig"))
    members = sets.select("file_id", "cls").distinct().join(reps.select("cls", "rep"), "cls").select("file_id", "rep")
    floor = floor_depth(threshold)
    chunks = forest(reps, floor)
    sig = reps.select("rep", "sig")
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    least = threshold - 6 * (threshold * (1 - threshold) / HASHES) ** 0.5
    texts = files.select(F.col(id_col).alias("id"), F.col(text).alias("t")).where(F.col("t").isNotNull())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, np.ndarray] = {}

        def sets_of(i: int, t: str) -> np.ndarray:
            if i not in memo:
                if len(memo) > 2000:
                    memo.clear()
                memo[i] = shingles(t)[1]
            return memo[i]

        for batch in batches:
            rows = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = sets_of(a, ta), sets_of(b, tb)
                common = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - common
                if common >= threshold * union - 1e-9:
                    rows.append((a, b, common / union))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["a", "b", "similarity"])

    seen: DataFrame | None = None
    links: DataFrame | None = None
    for depth in range(floor + STEPS, floor - 1, -1):
        near = matched(chunks, floor, depth)
        if seen is not None:
            near = near.join(seen, ["a", "b"], "left_anti")
        near = written(
            near.join(sig.withColumnsRenamed({"rep": "a", "sig": "sa"}), "a")
            .join(sig.withColumnsRenamed({"rep": "b", "sig": "sb"}), "b")
            .where(agree >= F.lit(int(least * HASHES)))
            .select("a", "b"),
            "near-pairs",
        )
        ends = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        known = written(texts.join(ends, "id", "left_semi").groupBy("id").agg(F.min("t").alias("t")), "near-texts")
        both = near.join(known.withColumnsRenamed({"id": "a", "t": "ta"}), "a").join(known.withColumnsRenamed({"id": "b", "t": "tb"}), "b")
        found = written(both.select("a", "b", "ta", "tb").mapInArrow(verify, "a bigint, b bigint, similarity double"), "near-links")
        seen = near if seen is None else seen.unionByName(near)
        links = found if links is None else links.unionByName(found)
        if depth > floor and estimated_recall(links, threshold, depth) >= RECALL:
            break
    return members, links


def estimated_recall(links: DataFrame, threshold: float, depth: int) -> float:
    """Share of all pairs that ``links``, met with prefixes of ``depth``, seem to be."""
    chance = 1 - F.pow(1 - F.pow(F.col("similarity"), F.lit(depth)), F.lit(TREES))
    n, total = links.agg(F.count("*"), F.coalesce(F.sum(1 / chance), F.lit(0.0))).first()  # a single row
    return n / (total + 1 - met(threshold, depth)) if n else 0.0


def _blocked(members: DataFrame) -> DataFrame:
    """``file_id, rep, nb, block``: members of a class cut into blocks of about BLOCK."""
    sizes = members.groupBy("rep").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    big = written(sizes.where("nb > 1"), "large-classes")
    # classes of more than BLOCK copies, at most one for each BLOCK records; their rows are salted
    wide = big.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("file_id"), F.lit(SALTS))).join(wide, ["rep", "salt"], "left")
    return salted.select("file_id", "rep", F.coalesce("nb", F.lit(1)).alias("nb")).withColumn("block", F.pmod(F.xxhash64("file_id", F.lit(7)), F.col("nb")).cast("int"))


def pairs_of_records(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of records, copies expanded: ``file_a < file_b``.

    The expansion is an equi-join on the class, for results that ask for it;
    (members, links) holds the same information without it. Classes of many
    copies are cut into blocks, and block is joined with block.
    """
    m = written(_blocked(members), "members")
    every = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    left = m.select(F.col("file_id").alias("file_a"), "rep", F.col("block").alias("i"), every.alias("j"))
    right = m.select(F.col("file_id").alias("file_b"), "rep", F.col("block").alias("j"), every.alias("i"))
    same = left.join(right, ["rep", "i", "j"]).where("file_a < file_b")
    places = m.select("rep", "block").distinct()
    ends = links.select("a", "b").join(places.withColumnsRenamed({"rep": "a", "block": "i"}), "a").join(places.withColumnsRenamed({"rep": "b", "block": "j"}), "b")
    cross = (
        ends.join(m.select(F.col("file_id").alias("x"), F.col("rep").alias("a"), F.col("block").alias("i")), ["a", "i"])
        .join(m.select(F.col("file_id").alias("y"), F.col("rep").alias("b"), F.col("block").alias("j")), ["b", "j"])
        .select(F.least("x", "y").alias("file_a"), F.greatest("x", "y").alias("file_b"))
    )
    return same.select("file_a", "file_b").unionByName(cross)


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each record: ``file_id, class_id, links, group_id``.

    ``links`` counts linked classes; ``group_id`` is the smallest class in the
    connected component. Components come from rounds of min-label exchange
    with pointer jumping, each round written to the shared folder; only the
    flag whether labels still change comes to the driver.
    """
    edges = written(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select(F.col("b"), F.col("a"))), "edges")
    degree = edges.groupBy("x").agg(F.count("*").alias("links"))
    label = written(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")), "labels")
    while True:
        seen = edges.join(label.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
        step = label.join(seen, "x").select("x", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = step.select(F.col("x").alias("j"), F.col("label").alias("far"))
        nxt = step.join(jump, step["label"] == jump["j"], "left").select(
            "x", F.least("label", F.coalesce("far", "label")).alias("label"), "was"
        )
        nxt = written(nxt, "labels")
        label = nxt.select("x", "label")
        if nxt.where("label <> was").limit(1).count() == 0:
            break
    return (
        members.join(degree.withColumnRenamed("x", "rep"), "rep", "left")
        .join(label.withColumnRenamed("x", "rep"), "rep", "left")
        .select("file_id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "rep").alias("group_id"))
    )
