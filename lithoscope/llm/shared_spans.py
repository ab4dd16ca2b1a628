"""Exact spans of at least ``LEAST`` code points shared between records.

Every window of ``GRAM`` code points has a rolling hash; winnowing keeps, of
every ``LEAST - GRAM + 1`` consecutive windows, the one with the smallest hash.
The choice depends on the text alone, so two records that share a span of
``LEAST`` keep a common window inside it: none is lost.

1. Each partition fills a count-min sketch with the kept windows, once for a
   record; merged, the sketches overestimate in how many records a window
   occurs. Counters saturate at two, which is all the prefilter asks.
2. A second pass over the texts exactly groups only windows estimated repeated.
   A repeated window is extended to both sides by ``LEAST - GRAM``: where the
   whole context also occurs in another record, all spans of ``LEAST`` around it
   are shared.
3. What is left lies at the ends of shared passages. Where a window has at most
   ``GROUP`` differing contexts, these are compared letter by letter, a context
   that one record holds in many places once; where it has more, every span of
   ``LEAST`` that contains it is hashed and grouped exactly.

Spans are told apart by 128 bits over their whole text; grouping aggregates
(smallest and largest record) on the map side, so a passage that a third of all
records hold is a single row per task, and contexts of more than ``HOT`` windows
are joined without bringing their windows together. The sketch has two to four
counters for each window the size of the input lets expect, between
``2**LEAST_BITS`` and ``2**MOST_BITS`` of them in each of ``ROWS`` hash rows;
past its capacity it passes more windows on, which costs time and loses none.
Very long texts are hashed in overlapping pieces of ``PIECE`` code points.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, spread, written
from .skew import hot_join

LEAST = 300
GRAM = 150
SIDE = LEAST - GRAM
#: groups of at most this many differing contexts are compared in memory
GROUP = 32
ROWS, LEAST_BITS, MOST_BITS = 2, 20, 27
#: windows of one context that may meet in a task
HOT = 100_000
#: code points of a text that are hashed at once
PIECE = 1 << 20
_U = np.uint64
_FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, b, b**2, ... modulo 2**64, by doubling; kept for the worker."""
    got = _POWERS.get(base)
    if got is None:
        got = np.array([1], _U)
    while len(got) < n:
        got = np.concatenate([got, got * (got[-1:] * np.array([base], _U))])
    _POWERS[base] = got
    return got[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


class Text:
    """Prefix hashes of a text; hashes of any window in constant time."""

    def __init__(self, text: str, base: int = _FIRST) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
        codes += _U(0x51ED27)
        self.n = n = len(codes)
        codes *= _powers(base, n)
        self.prefix = np.zeros(n + 1, _U)
        np.cumsum(codes, out=self.prefix[1:])
        self.inverse = _powers(pow(base, -1, 2**64), n + 1)

    def windows(self, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """Hashes of the windows of ``length`` at ``starts``."""
        return _mixed((self.prefix[starts + length] - self.prefix[starts]) * self.inverse[starts])

    def all_windows(self, length: int) -> np.ndarray:
        k = self.n - length + 1
        return _mixed((self.prefix[length:] - self.prefix[:k]) * self.inverse[:k])


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, by block-wise running minima."""
    n = len(h)
    pad = -n % w
    top = np.full(n + pad, np.iinfo(np.uint64).max, _U)
    top[:n] = h
    blocks = top.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    k = n - w + 1
    return np.minimum(back[:k], ahead[w - 1 : w - 1 + k])


def kept_windows(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the winnowed windows of GRAM."""
    if text.n < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    h = text.all_windows(GRAM)
    low = _sliding_min(h, SIDE + 1)
    # a window is kept where its hash is the minimum of some run it lies in:
    # where it equals the largest minimum of those runs; ties are all kept
    k = len(low)
    pad = np.zeros(k + 2 * SIDE, _U)
    pad[SIDE : SIDE + k] = low
    starts = np.flatnonzero(h == ~_sliding_min(~pad, SIDE + 1))
    return starts, h[starts]


def pieces(t: str) -> Iterator[tuple[int, int, int]]:
    """(begin, first, last): pieces of a text and the windows each answers for.

    A window is kept by what lies within LEAST of it, and its context reaches
    SIDE; both lie inside the piece that answers for it.
    """
    n, margin = len(t), 2 * LEAST
    for first in range(0, max(n, 1), PIECE):
        yield max(first - margin, 0), first, min(first + PIECE, n)


def kept_contexts(t: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each piece the kept windows: starts, hashes, hashes of contexts, their reach to both sides."""
    for begin, first, last in pieces(t):
        x = Text(t[begin : last + 2 * LEAST])
        starts, h = kept_windows(x)
        mine = (starts + begin >= first) & (starts + begin < last)
        starts, h = starts[mine], h[mine]
        left, right = np.maximum(starts - SIDE, 0), np.minimum(starts + GRAM + SIDE, x.n)
        wide = x.windows(left, right - left) + (right - left).astype(_U)
        yield starts + begin, h, wide, starts - left, right - starts


def _cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Counter of each hash in each row of the sketch."""
    mask = _U((1 << bits) - 1)
    return [((h >> _U(32 * r)) & mask).astype(np.int64) for r in range(ROWS)]


def sketch_bits(files: DataFrame) -> int:
    """Bits for two to four counters a window, from the size of the input's files.

    Text takes about a quarter of its length there, and one in 75 windows is
    kept. Without a known size, as for rows made in memory, 22.
    """
    leaves = files._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= 1 << 60:
        return 22
    return min(max((size * 4 // 75).bit_length(), LEAST_BITS), MOST_BITS)


def sketch(files: DataFrame, bits: int) -> bytes:
    """Saturating counters of all partitions, merged, as packed bits.

    A partition sends two bitmaps for each row (met once, met twice), which
    tree-merge: twice = twice | twice | (once & once). They are sent compressed,
    in a size that follows the windows met and not the sketch.
    """
    size = 1 << bits

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros((ROWS, size >> 3), np.uint8), np.zeros((ROWS, size >> 3), np.uint8)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t is None or len(t) < LEAST:
                    continue
                h = np.unique(np.concatenate([k[1] for k in kept_contexts(t)]))
                for r, c in enumerate(_cells(h, bits)):
                    c, n = np.unique(c, return_counts=True)
                    _set(twice[r], c[_get(once[r], c) | (n > 1)])
                    _set(once[r], c)
        for r in range(ROWS):
            for part in range(8):
                cut = slice(part * size // 64, (part + 1) * size // 64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r * 8 + part], pa.int32()), pa.array([_packed(once[r, cut])]), pa.array([_packed(twice[r, cut])])],
                    names=["part", "once", "twice"],
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for p, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = np.frombuffer(zlib.decompress(a), np.uint8), np.frombuffer(zlib.decompress(b), np.uint8)
                if p in held:
                    x, y = held[p]
                    held[p] = [x | a, y | b | (x & a)]
                else:
                    held[p] = [a.copy(), b.copy()]
        for p, (a, b) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([_packed(a)]), pa.array([_packed(b)])], names=["part", "once", "twice"])

    kind = "part int, once binary, twice binary"
    rows = spread(files)
    # a salted stage as wide as the root of the number of tasks bounds what one task merges
    width = int(rows._jdf.queryExecution().toRdd().getNumPartitions() ** 0.5) + 1
    parts = rows.mapInArrow(fill, kind).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(width)))
    parts = parts.repartition("part", "salt").select("part", "once", "twice").mapInArrow(merge, kind)
    rows = parts.repartition("part").mapInArrow(merge, kind).select("part", "twice").collect()
    out = bytearray(ROWS * size // 8)
    step = size // 64
    for r in rows:
        out[r["part"] * step : (r["part"] + 1) * step] = zlib.decompress(r["twice"])
    return bytes(out)


def _get(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Which of the cells are set in a bitmap."""
    return (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1


def _set(bits: np.ndarray, cells: np.ndarray) -> None:
    """Set cells, which are sorted and distinct."""
    if len(cells):
        at = cells >> 3
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        bits[at[first]] |= np.bitwise_or.reduceat((128 >> (cells & 7)).astype(np.uint8), first)


def _packed(bits: np.ndarray) -> bytes:
    return zlib.compress(bits.tobytes(), 1)


def _estimated_repeated(packed: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    keep = np.ones(len(h), bool)
    for r, c in enumerate(_cells(h, bits)):
        c += r << bits
        keep &= _get(packed, c)
    return keep


def shared_spans(files: DataFrame, id_col: str = "file_id", text: str = "source") -> DataFrame:
    """``file_id, shared_chars, n_chars``: records with a shared span.

    ``shared_chars`` counts the code points that lie in a span of at least
    ``LEAST`` code points which occurs, character for character, in another
    record. Spans that only repeat within a record don't count. Null texts and
    texts below ``LEAST`` share nothing; a repeated row of one id is one record;
    extra columns are not read.
    """
    spark = files.sparkSession
    ship_package(spark)
    rows = files.select(F.col(id_col).alias("file_id"), F.col(text).alias("t")).where((F.length("t") >= LEAST) & F.col("file_id").isNotNull())
    bits = sketch_bits(files.select(F.col(text)))
    packed = spark.sparkContext.broadcast(sketch(rows.select("t"), bits))  # at most 32 MiB, by MOST_BITS

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met_twice = np.frombuffer(packed.value, np.uint8)
        for batch in batches:
            out = []
            for i, t in zip(*(c.to_pylist() for c in batch.columns)):
                for starts, h, wide, back, ahead in kept_contexts(t):
                    good = _estimated_repeated(met_twice, h, bits)
                    if good.any():
                        out.append((np.full(int(good.sum()), i), starts[good], h[good].view(np.int64), wide[good].view(np.int64), back[good], ahead[good]))
            if out:
                cols = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1].astype(np.int32)), pa.array(cols[2]), pa.array(cols[3]), pa.array(cols[4].astype(np.int16)), pa.array(cols[5].astype(np.int16))],
                    names=["file_id", "at", "gram", "wide", "back", "ahead"],
                )

    found = written(spread(rows).mapInArrow(second, "file_id bigint, at int, gram bigint, wide bigint, back smallint, ahead smallint"), "windows")
    several = F.min("file_id") != F.max("file_id")
    place = F.struct("file_id", "at")
    classes = found.groupBy("gram", "wide").agg(several.alias("sure"), F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("windows"))
    status = (
        classes.groupBy("gram")
        .agg(
            (F.min("lo.file_id") != F.max("hi.file_id")).alias("s"),
            F.bool_or(~F.col("sure")).alias("some_open"),
            F.sum(F.when(F.col("sure"), 2).otherwise(1)).alias("size"),
        )
        .where("s")
        .select("gram", "some_open", (F.col("size") <= GROUP).alias("few"))
    )
    # an open window may also lie inside a context that step 2 settled for
    # others; two records of that context stand for all of them
    stands = (place == F.col("lo")) | (place == F.col("hi"))
    marked = hot_join(found, classes.join(status, "gram"), ["gram", "wide"], "file_id", "windows", HOT).select(
        "file_id", "at", "gram", "back", "ahead", "sure", stands.alias("stands"), "few",
        (~F.col("sure") | (stands & F.col("some_open"))).alias("emit"),
    )
    # lists are bounded by the record's length
    per_file = written(
        marked.groupBy("file_id").agg(
            F.collect_list(F.when(F.col("sure"), F.struct("at", "back", "ahead", "stands"))).alias("sure"),
            F.collect_list(F.when(F.col("emit") & F.col("few"), F.struct("at", "gram", "sure"))).alias("few"),
            F.collect_list(F.when(F.col("emit") & ~F.col("few"), F.col("at"))).alias("many"),
        ),
        "marked",
    )

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts of windows in small groups, spans around those in large ones."""
        for batch in batches:
            contexts, spans = [], []
            for i, t, sure, few, many in zip(*(batch.column(c).to_pylist() for c in ("file_id", "t", "sure", "few", "many"))):
                # one row for a context, wherever the record repeats it
                places: dict[tuple, list[int]] = {}
                for x in few:
                    left = max(x["at"] - SIDE, 0)
                    places.setdefault((x["gram"], x["sure"], x["at"] - left, t[left : x["at"] + GRAM + SIDE]), []).append(x["at"])
                contexts += [(i, 0, gram, sure, back, c, ats) for (gram, sure, back, c), ats in places.items()]
                if many:
                    n = len(t) - LEAST + 1
                    at = np.array(many)
                    # spans settled by a context for which others stand
                    rest = [x for x in sure if not x["stands"]]
                    begin = np.array([x["at"] - x["back"] for x in rest], np.int64)
                    end = np.maximum(begin, np.array([x["at"] + x["ahead"] for x in rest], np.int64) - LEAST + 1)
                    for first in range(0, n, PIECE):
                        size = min(PIECE, n - first)
                        starts = np.flatnonzero(_covered(at - SIDE - first, at + 1 - first, size) & ~_covered(begin - first, end - first, size))
                        if len(starts):
                            piece = t[first : first + size + LEAST]
                            one, two = Text(piece).windows(starts, LEAST), Text(piece, _SECOND).windows(starts, LEAST)
                            spans.append((np.full(len(starts), i), starts + first, one.view(np.int64), two.view(np.int64)))
            names = ["file_id", "at", "gram", "sure", "back", "context", "ats", "one", "two"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.int64(), pa.int64()]
            if contexts:
                cols = [*zip(*contexts), [None] * len(contexts), [None] * len(contexts)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
            if spans:
                i, at, one, two = (np.concatenate(x) for x in zip(*spans))
                cols = [i, at, *[None] * 5, one, two]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(i), k) if c is None else pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    ends = written(
        rows.join(per_file.where((F.size("few") > 0) | (F.size("many") > 0)), "file_id")
        .select("file_id", "t", "sure", "few", "many")
        .mapInArrow(third, "file_id bigint, at int, gram bigint, sure boolean, back int, context string, ats array<int>, one bigint, two bigint"),
        "ends",
    )
    compared = (
        ends.where("context IS NOT NULL").select("gram", "file_id", "ats", "sure", "back", "context")
        .repartition("gram").sortWithinPartitions("gram", "file_id")
        .mapInArrow(_compare_contexts, "file_id bigint, begin int, end int")
    )
    windows = ends.where("one IS NOT NULL").select("file_id", "at", "one", "two")
    repeated = windows.groupBy("one", "two").agg(several.alias("s")).where("s").select("one", "two")
    met = windows.join(repeated, ["one", "two"]).select("file_id", F.col("at").alias("begin"), (F.col("at") + LEAST).alias("end"))
    extra = compared.unionByName(met).groupBy("file_id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    every = per_file.select("file_id", "sure").join(extra, "file_id", "left").where((F.size("sure") > 0) | F.col("spans").isNotNull())
    lengths = rows.groupBy("file_id").agg(F.max(F.length("t")).cast("int").alias("n"))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, sure, spans, n in zip(*(batch.column(c).to_pylist() for c in ("file_id", "sure", "spans", "n"))):
                begin = [x["at"] - x["back"] for x in sure] + [x["begin"] for x in spans or []]
                end = [x["at"] + x["ahead"] for x in sure] + [x["end"] for x in spans or []]
                begin, end = np.array(begin, np.int64), np.array(end, np.int64)
                wide = end - begin >= LEAST
                out.append((i, _length(begin[wide], np.minimum(end[wide], n)), n))
            if out:
                a, b, c = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["file_id", "shared_chars", "n_chars"])

    return every.join(lengths, "file_id").select("file_id", "sure", "spans", "n").mapInArrow(cover, "file_id bigint, shared_chars bigint, n_chars bigint").where("shared_chars > 0")


def _compare_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that an open window shares with a record of its group.

    Groups (runs of equal gram) have at most about GROUP rows, one for each
    context of a record with all its places.
    """

    def spans(group: list[tuple]) -> list[tuple[int, int, int]]:
        out = []
        halves = [(c[:b][::-1], c[b + GRAM :]) for *_, b, c in group]
        for x, (_, file, ats, sure, _, _) in enumerate(group):
            if sure:
                continue
            reach = set()
            for y, other in enumerate(group):
                if other[1] != file:
                    left = len(commonprefix((halves[x][0], halves[y][0])))
                    right = len(commonprefix((halves[x][1], halves[y][1])))
                    if left + GRAM + right >= LEAST:
                        reach.add((left, right))
            largest = [a for a in reach if not any(b != a and b[0] >= a[0] and b[1] >= a[1] for b in reach)]
            out += [(file, at - left, at + GRAM + right) for left, right in largest for at in ats]
        return out

    held: list[tuple] = []
    for batch in batches:
        found = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != row[0]:
                found += spans(held)
                held = []
            held.append(row)
        if found:
            a, b, c = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int32())], names=["file_id", "begin", "end"])
    found = spans(held)
    if found:
        a, b, c = zip(*found)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int32())], names=["file_id", "begin", "end"])


def _length(begin: np.ndarray, end: np.ndarray) -> int:
    """Size of the union of the intervals [begin, end)."""
    if not len(begin):
        return 0
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    before = np.r_[begin[0], end[:-1]]
    return int(np.maximum(end - np.maximum(begin, before), 0).sum())


def _covered(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of 0..n-1 lie in one of the intervals [begin, end)."""
    begin, end = np.clip(begin, 0, n), np.clip(end, 0, n)
    edge = np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0
