"""Percentiles with bounded rank error from mergeable summaries.

Deterministic buffer collapsing: values are cut into sorted buffers of ``K``
elements at level 0 (weight 1). ``FAN`` buffers of one level collapse into one
buffer of the next: their merged order is read at ``K`` evenly spaced
positions, and every kept element stands for ``FAN`` elements of the level
below. A collapse to weight ``W`` moves the rank of a value by at most ``W/2``,
so a summary carries its own bound, the sum over its collapses. With the tree
schedule each level adds at most ``n / (2K)``: the relative error is at most
``ceil(log_FAN(n / K)) / (2K)``, which is 0.2 % for 10**9 values and 0.25 % for
10**12 with the defaults. Fewer than ``K * FAN`` values stay exact.

A summary is a set of rows ``(key..., level, n, err, buffer)``; combining two
summaries is the union of their rows followed by the same collapse rule, so
days, runs and partitions combine into the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

K = 2048
FAN = 8
#: rows of one key in one partition after the map-side stage are at most this
#: many buffers for each level, so a salted stage bounds what one task merges
SALTS = 16
#: map tasks whose buffers of one key a single task may merge; beyond it a salted
#: stage, as wide as the root of their number, comes before the last one
UNSALTED_TASKS = 64
#: values of a map task that are held at once; beyond it their summaries are emitted
FLUSH_VALUES = 1_500_000
#: values and rows of summaries that a merge holds at once
HELD_VALUES, HELD_ROWS = 2_000_000, 200_000
#: values and rows of a batch that goes back to the JVM
SENT_VALUES, SENT_ROWS = 250_000, 10_000


class Summary:
    """Buffers by level, at most FAN - 1 full ones each, and a rank error."""

    __slots__ = ("levels", "loose", "n", "err")

    def __init__(self) -> None:
        self.levels: dict[int, list[np.ndarray]] = {}
        self.loose: list[np.ndarray] = []
        self.n = 0
        self.err = 0.0

    def add(self, values: np.ndarray) -> None:
        """Add raw values of any number."""
        self.n += len(values)
        self._take(0, values)

    def combine(self, level: int, n: int, err: float, values: np.ndarray) -> None:
        """Add one row of another summary."""
        self.n += n
        self.err += err
        self._take(level, values)

    def _take(self, level: int, values: np.ndarray) -> None:
        if level == 0:
            self.loose.append(values)
            if sum(map(len, self.loose)) >= K * FAN:
                every = np.concatenate(self.loose)
                whole = len(every) // (K * FAN) * (K * FAN)
                self.loose = [every[whole:]]
                for part in every[:whole].reshape(-1, K * FAN):
                    self.err += FAN / 2
                    self._take(1, np.sort(part)[FAN // 2 :: FAN])
            return
        held = self.levels.setdefault(level, [])
        held.append(values)
        if len(held) == FAN:
            weight = float(FAN) ** (level + 1)
            merged = np.sort(np.concatenate(held))
            self.levels[level] = []
            self.err += weight / 2
            self._take(level + 1, merged[FAN // 2 :: FAN])

    def rows(self) -> list[tuple[int, int, float, np.ndarray]]:
        """(level, n, err, values); n and err are carried by the first row."""
        out = [(0, np.sort(np.concatenate(self.loose)))] if self.loose and sum(map(len, self.loose)) else []
        out += [(k, b) for k in sorted(self.levels) for b in self.levels[k]]
        return [(k, self.n if not i else 0, self.err if not i else 0.0, b) for i, (k, b) in enumerate(out)]

    def at(self, shares: list[float]) -> list[float]:
        """Values at nearest ranks ``max(1, ceil(share * n))``."""
        parts = self.rows()
        values = np.concatenate([b for *_, b in parts])
        weights = np.concatenate([np.full(len(b), FAN**k, dtype=np.int64) for k, *_, b in parts])
        order = np.argsort(values, kind="stable")
        ends = np.cumsum(weights[order])
        ranks = [max(1, int(np.ceil(s * self.n - 1e-9))) for s in shares]
        return [float(values[order[min(np.searchsorted(ends, r), len(ends) - 1)]]) for r in ranks]


def _schema(df: DataFrame, keys: list[str], tail: str) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + tail


SUMMARY = "level int, n bigint, err double, buffer array<double>"
_TAIL = [("level", pa.int32()), ("n", pa.int64()), ("err", pa.float64()), ("buffer", pa.list_(pa.float64()))]


def _coded(batch: pa.RecordBatch, keys: list[str]) -> pa.Table:
    """The keys of a batch as dictionaries, the other columns as they are."""
    cols = [c.dictionary_encode() if k in keys else c for k, c in zip(batch.schema.names, batch.columns)]
    return pa.table(cols, names=batch.schema.names)


def _joined(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).unify_dictionaries().combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    chunks = table[name].chunks
    return chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks)


def _codes(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Group code of each row and the first row of each code; nulls are a key."""
    codes, most = np.zeros(len(table), dtype=np.int64), 1
    for k in keys:
        col = _column(table, k)
        width = len(col.dictionary) + 1
        if most * width >= 1 << 62:
            found, codes = np.unique(codes, return_inverse=True)
            most = len(found)
        codes = codes * width + col.indices.fill_null(width - 1).to_numpy(zero_copy_only=False)
        most *= width
    _, first, inverse = np.unique(codes, return_index=True, return_inverse=True)
    return inverse.astype(np.int32), first


class Groups:
    """The groups of a table of summaries: keys, level, n, err, buffer.

    Groups of few values, all of level 0 and exact, are sorted together without
    an object for each (``ids``, ``ends``, ``values``); ``large`` has the others.
    """

    def __init__(self, table: pa.Table, keys: list[str]) -> None:
        codes, self.first = _codes(table, keys)
        self.keys = [_column(table, k) for k in keys]
        if raw := "__v" in table.column_names:  # values instead of summaries
            values = _column(table, "__v").to_numpy(zero_copy_only=False)
            total = self.n = np.bincount(codes, minlength=len(self.first))
            small, each = total < K * FAN, codes
        else:
            buffers = _column(table, "buffer")
            values = buffers.flatten().to_numpy(zero_copy_only=False)
            lengths = buffers.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            level, n, err = (_column(table, k).to_numpy(zero_copy_only=False) for k in ("level", "n", "err"))
            total, self.n = (np.zeros(len(self.first), dtype=np.int64) for _ in range(2))
            high, slack = np.zeros(len(self.first), dtype=np.int64), np.zeros(len(self.first))
            np.add.at(total, codes, lengths)
            np.add.at(self.n, codes, n)
            np.add.at(slack, codes, err)
            np.maximum.at(high, codes, level)
            small, each = (high == 0) & (total < K * FAN) & (total == self.n) & (slack == 0), np.repeat(codes, lengths)
        kept = small[each]
        part, of = values[kept], each[kept]
        self.values = part[np.lexsort((part, of))]
        self.ids = np.nonzero(small & (total > 0))[0]
        self.ends = np.concatenate([[0], np.cumsum(total[self.ids])])
        self.large: list[tuple[int, Summary]] = []
        if small.all():
            return
        rest = np.nonzero(~small[codes])[0]
        rest = rest[np.argsort(codes[rest], kind="stable")]
        at = np.arange(len(codes) + 1) if raw else np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        for rows in np.split(rest, np.nonzero(np.diff(codes[rest]))[0] + 1):
            s = Summary()
            if raw:
                s.add(values[rows])
            else:
                loose = rows[level[rows] == 0]
                if len(loose):
                    s.combine(0, int(n[loose].sum()), float(err[loose].sum()), np.concatenate([values[at[i] : at[i + 1]] for i in loose]))
                for i in rows[level[rows] > 0]:
                    s.combine(int(level[i]), int(n[i]), float(err[i]), values[at[i] : at[i + 1]])
            self.large.append((int(codes[rows[0]]), s))

    def named(self, ids: np.ndarray) -> list[pa.Array]:
        """The keys of groups."""
        at = pa.array(self.first[ids])
        return [c.take(at).dictionary_decode() for c in self.keys]

    def summaries(self, keys: list[str]) -> Iterator[pa.RecordBatch]:
        """Batches of bounded size with the summary of each group."""

        def batch(ids, level, n, err, ends, values) -> pa.RecordBatch:
            tail = [pa.array(x, t) for x, (_, t) in zip((level, n, err), _TAIL)]
            tail.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.float64())))
            return pa.RecordBatch.from_arrays([*self.named(np.asarray(ids, dtype=np.int64)), *tail], names=[*keys, *(k for k, _ in _TAIL)])

        i = 0
        while i < len(self.ids):
            j = min(i + SENT_ROWS, max(i + 1, int(np.searchsorted(self.ends, self.ends[i] + SENT_VALUES, "right")) - 1))
            ids = self.ids[i:j]
            yield batch(ids, np.zeros(j - i), self.n[ids], np.zeros(j - i), self.ends[i : j + 1] - self.ends[i], self.values[self.ends[i] : self.ends[j]])
            i = j
        held, count = [], 0
        for k, (g, s) in enumerate(self.large):
            held += [(g, *row) for row in s.rows()]
            count = sum(len(row[-1]) for row in held)
            if held and (count >= SENT_VALUES or k == len(self.large) - 1):
                ids, level, n, err, buffers = zip(*held)
                yield batch(ids, level, n, err, np.concatenate([[0], np.cumsum([len(b) for b in buffers])]), np.concatenate(buffers))
                held = []

    def percentiles(self, keys: list[str], shares: dict[str, float]) -> pa.RecordBatch:
        """``n``, the values at ``shares`` and ``rank_error`` of each group."""
        large = [(g, s) for g, s in self.large if s.n]
        n = self.n[self.ids]
        at = [np.maximum(1, np.ceil(x * n - 1e-9).astype(np.int64)) for x in shares.values()]
        found = [self.values[self.ends[:-1] + np.minimum(r, n) - 1] for r in at]
        more = [s.at(list(shares.values())) for _, s in large]
        slack = [(s.err + FAN ** max([0, *(k for k, b in s.levels.items() if b)])) / s.n if s.err else 0.0 for _, s in large]
        cols = [np.concatenate([n, np.array([s.n for _, s in large], dtype=np.int64)])]
        cols += [np.concatenate([v, np.array([row[i] for row in more], dtype=float)]) for i, v in enumerate(found)]
        cols.append(np.concatenate([np.zeros(len(n)), np.array(slack, dtype=float)]))
        ids = np.concatenate([self.ids, np.array([g for g, _ in large], dtype=np.int64)])
        return pa.RecordBatch.from_arrays([*self.named(ids), *map(pa.array, cols)], names=[*keys, "n", *shares, "rank_error"])


def _held(parts: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of bounded number and size, as they come."""
    held, rows, values = [], 0, 0
    for batch in parts:
        if not len(batch):
            continue
        held.append(_coded(batch, keys))
        rows += len(batch)
        values += len(batch["buffer"].flatten()) if "buffer" in batch.schema.names else 0
        if rows >= (HELD_ROWS if "buffer" in batch.schema.names else FLUSH_VALUES) or values >= HELD_VALUES:
            yield _joined(held)
            held, rows, values = [], 0, 0
    if held:
        yield _joined(held)


def _whole(parts: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[Groups]:
    """Whole groups of rows that come by key; an open group is held as its summary."""
    last = None
    for table in _held(parts, keys):
        if last is not None:
            table = _joined([last, table])
        codes, _ = _codes(table, keys)
        start = int(np.argmax(codes == codes[-1]))
        if start:
            yield Groups(table.slice(0, start), keys)
        last = _joined([_coded(b, keys) for b in Groups(table.slice(start), keys).summaries(keys)])
    if last is not None:
        yield Groups(last, keys)


def summarise(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mergeable summaries of ``value`` for each combination of ``keys``.

    Null and NaN values are not counted; a group without values has no row.
    Null keys are a group of their own. Repeated rows count as often as they
    come. The map-side stage holds bounded buffers only; those of a hot key are
    spread by salt where many map tasks send some.
    """
    ship_package(df.sparkSession)

    def leaf(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _held(parts, keys):
            yield from Groups(table, keys).summaries(keys)

    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    tasks = rows._jdf.queryExecution().toRdd().getNumPartitions()
    width = max(SALTS, int(tasks**0.5)) if tasks > UNSALTED_TASKS else 0
    return combine(rows.mapInArrow(leaf, _schema(df, keys, SUMMARY)), keys, local=False, salted=width)


def _gathered(summaries: DataFrame, keys: list[str], local: bool, salted: int) -> DataFrame:
    """Summaries of a key side by side, merged before as :func:`combine` says."""
    ship_package(summaries.sparkSession)
    schema = _schema(summaries, keys, SUMMARY)

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _held(parts, keys):
            yield from Groups(table, keys).summaries(keys)

    out = summaries.select(*keys, "level", "n", "err", "buffer")
    if local:
        out = out.mapInArrow(merge, schema)
    if salted:
        out = out.withColumn("__salt", F.pmod(F.xxhash64("buffer"), F.lit(salted))).repartition(*keys, "__salt").drop("__salt")
        out = out.mapInArrow(merge, schema)
    # the content breaks ties, so equal inputs merge in one order
    return out.repartition(*keys).sortWithinPartitions(*keys, "level", F.xxhash64("buffer"))


def combine(summaries: DataFrame, keys: list[str], local: bool = True, salted: int = 0) -> DataFrame:
    """One summary for each combination of ``keys``.

    ``local`` first merges within partitions, so that of one key every
    partition sends a bounded number of buffers; ``salted`` adds a stage that
    spreads hot keys over so many tasks before the last one.
    """

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _whole(parts, keys):
            yield from groups.summaries(keys)

    return _gathered(summaries, keys, local, salted).mapInArrow(merge, _schema(summaries, keys, SUMMARY))


def percentiles(summaries: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """One row for each key: ``n``, the values at ``shares``, ``rank_error``.

    ``rank_error`` is the proven bound, as a share of ``n``, of how far the rank
    of a returned value may lie from the one asked for. Takes the result of
    :func:`summarise` or :func:`combine`, whose rows of a key are adjacent.
    """

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _whole(parts, keys):
            yield groups.percentiles(keys, shares)

    tail = "n bigint, " + ", ".join(f"{x} double" for x in shares) + ", rank_error double"
    return summaries.mapInArrow(read, _schema(summaries, keys, tail))


def combined_percentiles(summaries: DataFrame, keys: list[str], shares: dict[str, float], salted: int = 0) -> DataFrame:
    """:func:`percentiles` of :func:`combine`, with one Python worker less in a task."""
    return percentiles(_gathered(summaries, keys, True, salted), keys, shares)
