"""Byte-level BPE encoding with a hierarchical-bitmap rank queue.

Each pre-token is a doubly linked list of symbols. Every mergeable adjacent
pair is filed in the bucket of its merge rank; a bitmap of non-empty buckets,
64 ranks to a word and 64 words to a word of the level above, gives the lowest
rank by find-first-set on each level. Entries are not removed when a merge
makes them stale: on reading, an entry whose pair no longer has the bucket's
rank is skipped. All pairs of one rank are merged from left to right, which is
the order of the reference algorithm, and each costs O(1) queue work whatever
the pre-token's length.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, spread

TOKENIZER_DIR = "/opt/tokenizers"
#: fixed values: the public pre-tokenization pattern of the byte-level BPE files
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: distinct pre-tokens held by one worker; beyond it the memo starts anew
MEMO = 200_000


class RankQueue:
    """Priority queue over ranks 0..size-1 with positions in buckets."""

    __slots__ = ("levels", "buckets")

    def __init__(self, size: int) -> None:
        self.levels: list[list[int]] = []
        while True:
            size = (size + 63) >> 6
            self.levels.append([0] * size)
            if size == 1:
                break
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        for words in self.levels:
            bit, rank = rank & 63, rank >> 6
            seen = words[rank]
            words[rank] = seen | (1 << bit)
            if seen:
                return

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions, taken out of the queue."""
        if not self.buckets:
            return None
        at = 0
        for words in reversed(self.levels):
            word = words[at]
            at = (at << 6) | ((word & -word).bit_length() - 1)
        rank = at
        for words in self.levels:
            bit, at = at & 63, at >> 6
            words[at] &= ~(1 << bit)
            if words[at]:
                break
        return rank, self.buckets.pop(rank)


class Encoder:
    """Encodes texts with the ranks of a public byte-level BPE vocabulary."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> None:
        ranks: dict[bytes, int] = {}
        for line in (Path(folder) / f"{name}.tiktoken").read_bytes().splitlines():
            if line:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.ranks = ranks
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.token = {i: t for t, i in ranks.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.split = regex.compile(PATTERN).findall
        self.memo: dict[str, list[int]] = {}
        self.queue = RankQueue(max(ranks.values()) + 1)

    def rank(self, a: int, b: int) -> int:
        """Rank of the merge of two symbols, -1 if there is none."""
        key = (a, b)
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > 2 * MEMO:
                self.pairs.clear()
            got = self.pairs[key] = self.ranks.get(self.token[a] + self.token[b], -1)
        return got

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        ids = [self.byte[b] for b in data]
        n = len(ids)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        rank, queue = self.rank, self.queue
        for i in range(n - 1):
            r = rank(ids[i], ids[i + 1])
            if r >= 0:
                queue.push(r, i)
        while (top := queue.pop()) is not None:
            r, positions = top
            positions.sort()
            for i in positions:
                j = after[i]
                # stale: the symbol is gone, is the last one, or changed
                if ids[i] < 0 or j >= n or rank(ids[i], ids[j]) != r:
                    continue
                ids[i], ids[j] = r, -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    s = rank(r, ids[k])
                    if s >= 0:
                        queue.push(s, i)
                h = before[i]
                if h >= 0:
                    s = rank(ids[h], r)
                    if s >= 0:
                        queue.push(s, h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; null and empty texts give an empty list."""
        if not text:
            return []
        out: list[int] = []
        memo = self.memo
        for piece in self.split(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "replace"))
                if len(piece) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(name: str, folder: str) -> Encoder:
    """The worker's encoder for a vocabulary, loaded once."""
    if (name, folder) not in _ENCODERS:
        _ENCODERS[name, folder] = Encoder(name, folder)
    return _ENCODERS[name, folder]


def encode_texts(docs: DataFrame, keep: list[str], text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, lengths_only: bool = False) -> DataFrame:
    """``keep`` columns and ``ids`` (or ``tokens``, their number) of each row.

    Texts that spell special tokens are ordinary text. Null and empty texts give
    an empty array (0 tokens). Repeated rows are encoded each; other columns,
    whatever their names, are not read. The work is per row without a shuffle.
    """
    ship_package(docs.sparkSession)
    target = "tokens" if lengths_only else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name, folder).encode
        for batch in batches:
            got = [encode(t) for t in batch.column(len(keep)).to_pylist()]
            if lengths_only:
                last = pa.array([len(x) for x in got], pa.int64())
            else:
                last = pa.array(got, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], last], names=[*keep, target])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    kind = "bigint" if lengths_only else "array<int>"
    return spread(docs.select(*keep, F.col(text).alias("__text"))).mapInArrow(run, f"{schema}, {target} {kind}")
