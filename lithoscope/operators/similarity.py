"""Similar token streams and leader groups.

Normalised streams have a few dozen distinct tokens, so neither prefixes nor
q-grams tell similar from other pairs: two thirds of all pairs of fitting length
also have tokens enough in common. Streams are therefore packed into blocks by
language and length, and blocks that may hold a similar pair meet in a cartesian
product, which writes no pair. A block is compared with a stream at a time, by
the longest common subsequence of all that fit in length, in bit-parallel steps
over 64-bit words: first of the rarer words alone, to which the frequent words
that both streams have are added in any order. On the way streams are dropped
whose head, compared in order, and tail, compared in any order, fall short
together. What is left is compared with all its words. The result is that of
comparing all pairs; the time still grows with the square of the streams of like
length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, written

#: streams of a block on either side, and most words of its bit masks
NARROW, WIDE, MASK_WORDS = 256, 8192, 4_000_000
#: most partitions of the wide blocks
WIDE_PARTS = 2000
#: bits of a word; the highest one takes the carry
BITS = 63
FULL = np.uint64((1 << BITS) - 1)
#: share of all tokens that the rare words make up, and how many of a stream at least
RARE, FEW = 0.45, 48
#: most places at which a look in place tries the tails
POINTS = 4
#: share of a stream after which hopeless partners are dropped first, and after which again; part of a partner within which its tails start
HEAD, STEP, LOOKED = 0.3, 0.2, 0.6
#: share of partners below which the others are compared with all words, and share of those left below which the dropped ones are left out;
#: words of partners compared together, or lengths so like; pairs held before they are followed, and pairs followed at once
SPARSE, CROWDED, LEAST, LIKE, HELD, GROUP = 0.005, 0.4, 16384, 1.2, 32768, 2048
#: places between the starts of tails, the first with at most so many words of tails
GRIDS, TAIL_WORDS = (7, 9, 21, 63), 4_000_000

BLOCK = "language string, lo int, first bigint, hi int, digests array<bigint>, lengths array<int>, vocabulary array<string>, ids binary"


def _packed(table: pa.Table, most: int) -> Iterator[dict]:
    """Blocks of at most ``most`` rows, halved until their masks are small."""
    lists = pc.split_pattern(table["stream"].combine_chunks(), " ")
    coded = lists.flatten().dictionary_encode()
    n = table["n"].to_numpy()
    if len(table) > most or (len(table) > 1 and len(coded.dictionary) * -(-int(n.max()) // BITS) * len(table) > MASK_WORDS):
        half = min(most, len(table) // 2)
        for part in (table.slice(0, half), table.slice(half)):
            yield from _packed(part, most)
        return
    digests = table["digest"].to_numpy()
    yield {
        "language": table["language"][0].as_py(), "lo": int(n.min()), "first": int(digests[0]), "hi": int(n.max()), "digests": digests, "lengths": n.astype(np.int32),
        "vocabulary": coded.dictionary.to_pylist(), "ids": coded.indices.to_numpy(zero_copy_only=False).astype(np.uint32 if len(coded.dictionary) > 1 << 16 else np.uint16).tobytes(),
    }


def _blocks(kinds: DataFrame, most: int) -> DataFrame:
    """``kinds`` (language, digest, n, stream) packed by language and length."""
    names, types = ["language", "lo", "first", "hi", "digests", "lengths", "vocabulary", "ids"], [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.binary()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _packed(pa.Table.from_batches(held), most):
                yield pa.RecordBatch.from_arrays([pa.array([block[k]], t) for k, t in zip(names, types)], names=names)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            languages = batch["language"].fill_null("").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.nonzero(languages[1:] != languages[:-1])[0] + 1).tolist(), len(batch)]
            for i, j in zip(cuts, cuts[1:]):
                while i < j:
                    if held and (held[0]["language"][0] != batch["language"][i] or sum(map(len, held)) >= most):
                        yield from out(held)
                        held = []
                    k = min(j, i + most - sum(map(len, held)))
                    held.append(batch.slice(i, k - i))
                    i = k
        if held:
            yield from out(held)

    rows = kinds.select("language", "digest", "n", "stream")
    return rows.repartitionByRange("language", "n", "digest").sortWithinPartitions("language", "n", "digest").mapInArrow(pack, BLOCK)


class Block:
    """A block of streams of one language, by length and digest."""

    def __init__(self, lengths: np.ndarray, digests: np.ndarray, vocabulary: list[str], ids: np.ndarray) -> None:
        self.n, self.digests, self.vocabulary, self.ids = lengths.astype(np.int64), digests, vocabulary, ids.astype(np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.n)])
        self.of = np.repeat(np.arange(len(self.n)), self.n)
        # how many equal tokens of its stream a token is the first of
        key = (self.of * len(vocabulary) + self.ids)[::-1]
        order = np.argsort(key, kind="stable")
        at, rank = np.arange(len(key)), np.empty(len(key), dtype=np.int64)
        first = np.zeros(len(key), dtype=np.int64)
        first[1:] = np.where(key[order][1:] != key[order][:-1], at[1:], 0)
        rank[order] = at - np.maximum.accumulate(first) + 1
        self.rank = rank[::-1]

    def only(self, words: np.ndarray) -> Block:
        """The same streams without the tokens that aren't among ``words`` (a flag for each)."""
        kept = words[self.ids]
        return Block(np.bincount(self.of[kept], minlength=len(self.n)), self.digests, self.vocabulary, self.ids[kept])

    def counts(self, word: int) -> np.ndarray:
        return np.bincount(self.of[self.ids == word], minlength=len(self.n))


class Wide(Block):
    """A block with the places of its words and with what its tails hold.

    ``masks``: word of the vocabulary (the last stands for all others), 63 places, stream. ``tails``: for the
    tail of a stream from each ``grid`` places on, one bit for (word, n) if it
    has the word n times, 64 bits, stream; the bits of most streams come first.
    Tails start within the part of a stream that looks come to.
    """

    def __init__(self, block: Block) -> None:
        super().__init__(block.n, block.digests, block.vocabulary, block.ids)
        words, k, most = max(1, -(-int(self.n.max()) // BITS)), len(self.n), len(self.vocabulary)
        place = np.arange(len(self.ids)) - self.ends[self.of]
        masks = np.zeros((most + 1) * words * k, dtype=np.uint64)
        np.bitwise_or.at(masks, (self.ids * words + place // BITS) * k + self.of, np.uint64(1) << (place % BITS).astype(np.uint64))
        self.masks = masks.reshape(most + 1, words, k)
        self.cap = np.zeros(most, dtype=np.int64)
        np.maximum.at(self.cap, self.ids, self.rank)
        self.start = np.concatenate([[0], np.cumsum(self.cap)])
        which = self.start[self.ids] + self.rank - 1
        self.bit = np.empty(self.start[-1], dtype=np.int64)
        self.bit[np.argsort(-np.bincount(which, minlength=len(self.bit)), kind="stable")] = np.arange(len(self.bit))
        self.size = max(1, -(-len(self.bit) // 64))
        for self.grid in GRIDS:
            count = int(self.n.max() * LOOKED) // self.grid + 1
            if count * self.size * k <= TAIL_WORDS:
                break
        tails, bit = np.zeros(count * self.size * k, dtype=np.uint64), self.bit[which]
        np.bitwise_or.at(tails, (np.minimum(place // self.grid, count - 1) * self.size + bit // 64) * k + self.of, np.uint64(1) << (bit % 64).astype(np.uint64))
        self.tails = tails.reshape(count, self.size, k)
        for p in range(count - 2, -1, -1):
            self.tails[p] |= self.tails[p + 1]
        # the same for pairs here and there: stream first
        self.by_stream = [np.ascontiguousarray(x.transpose(2, 0, 1)).reshape(-1) for x in (self.masks, self.tails)]

    def bits(self, tokens: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The bits that the tokens of a stream stand for, -1 where no stream here has them."""
        known = tokens < len(self.vocabulary)
        known[known] = rank[known] <= self.cap[tokens[known]]
        out = np.full(len(tokens), -1, dtype=np.int64)
        out[known] = self.bit[self.start[tokens[known]] + rank[known] - 1]
        return out

    def packed(self, bits: np.ndarray) -> np.ndarray:
        """``bits`` as words."""
        flags = np.zeros(self.size * 64, dtype=np.uint8)
        flags[bits[bits >= 0]] = 1
        return np.packbits(flags, bitorder="little").view(np.uint64)

    def shared(self, p: int, at: slice | np.ndarray, mine: np.ndarray) -> np.ndarray:
        """Tokens that tail ``p`` of the streams ``at`` has in common with ``mine``, in any order."""
        out, both, few, some = np.zeros(at.stop - at.start if isinstance(at, slice) else len(at), dtype=np.int32), None, None, None
        used = np.flatnonzero(mine).tolist()
        for k, w in enumerate(used):
            both = np.bitwise_and(self.tails[p, w, at] if isinstance(at, slice) else np.take(self.tails[p, w], at, mode="clip"), mine[w], out=both)
            few = np.bitwise_count(both, out=few)
            some = few.copy() if k % 3 == 0 else np.add(some, few, out=some)  # 3 * 64 bits fit into a byte
            if k % 3 == 2 or k == len(used) - 1:
                out += some
        return out


def _step(row: np.ndarray, mask: np.ndarray, hit: np.ndarray, total: np.ndarray, carry: np.ndarray) -> None:
    """``row`` of the longest common subsequence after one more token, in place.

    The highest bit of the last word may be wrong afterwards.
    """
    np.bitwise_and(row, mask, out=hit)
    np.add(row, hit, out=total)
    for w in range(1, len(row)):
        np.right_shift(total[w - 1], BITS, out=carry)
        np.add(total[w], carry, out=total[w])
    np.bitwise_xor(row, hit, out=row)
    np.bitwise_or(row, total, out=row)
    if len(row) > 1:
        np.bitwise_and(row[:-1], FULL, out=row[:-1])


class Pairs:
    """Pairs of a stream of ``a`` and one of ``b`` that may be similar."""

    def __init__(self, a: Block, b: Wide) -> None:
        self.a, self.b, self.held, self.count = a, b, [], 0
        place = {t: i for i, t in enumerate(b.vocabulary)}
        self.tokens = np.array([place.get(t, len(b.vocabulary)) for t in a.vocabulary], dtype=np.int64)[a.ids]
        self.bits, self.n = b.bits(self.tokens, a.rank), b.n.astype(np.int32)
        self.space = [np.empty(b.masks[0].size, dtype=np.uint64) for _ in range(3)]

    def head(self, i: int, part: slice, need: np.ndarray) -> None:
        """Compare stream ``i`` with ``part`` of ``b`` where it lies, until few are left; hold what may still be similar."""
        a, b = self.a, self.b
        m, n, first = int(a.n[i]), self.n[part], int(a.ends[i])
        bits = self.bits[first : first + m]
        alive = b.shared(0, part, b.packed(bits)) >= need
        left = np.count_nonzero(alive)
        if not left:
            return
        # places further apart aren't paired by a common subsequence of that length
        ahead, behind = int(np.where(alive, n - need, 0).max()), m - int(np.where(alive, need, m).min())
        at, every = part, len(n)
        row, upto, seen = np.full((max(1, -(-int(n.max()) // BITS)), len(n)), FULL), 0, 0
        hit, total = (x[: row.size].reshape(row.shape) for x in self.space[:2])
        carry = self.space[2][: len(n)]
        while left > SPARSE * every and upto < m - 1:
            before, upto = upto, min(m - 1, upto + max(1, int(m * (STEP if upto else HEAD))))
            for j, t in enumerate(self.tokens[first + before : first + upto].tolist(), before):
                x, y = max(0, j - behind) // BITS, min(len(row), (j + ahead) // BITS + 1)
                if y > seen:
                    row[seen - 1 if seen else 0] &= FULL
                    seen = y
                if t < len(b.vocabulary) and x < y:
                    _step(row[x:y], b.masks[t, x:y, at] if at is part else np.take(b.masks[t, x:y], at, axis=1, mode="clip"), hit[x:y], total[x:y], carry)
            seen = max(1, seen)
            row[seen - 1] &= FULL
            # most that the tails can add, by the place where the other one starts
            mine, best, free = b.packed(bits[upto:]), np.zeros(len(alive), dtype=np.int32), row[:seen] ^ FULL
            whole = [np.bitwise_count(free[0]).astype(np.int32)]
            for x in free[1:]:
                whole.append(whole[-1] + np.bitwise_count(x))
            last = len(b.tails) - 1
            low, high = min(max(0, upto - behind) // b.grid, last), min((upto + ahead) // b.grid, last)
            stride = -(-(high - low + 1) // POINTS)
            for p in range(low, high + 1, stride):
                w, r = divmod((p + stride) * b.grid, BITS)
                got = b.shared(p, at, mine)
                if p + stride > last or w >= len(free):
                    got += whole[-1]
                else:
                    got += np.bitwise_count(free[w] & np.uint64((1 << r) - 1))
                    if w:
                        got += whole[w - 1]
                np.maximum(best, got, out=best)
            alive &= best >= need
            left = np.count_nonzero(alive)
            if left < CROWDED * len(alive):  # the others are left out from now on
                kept = np.flatnonzero(alive)
                at, n, need, row, alive = kept + part.start if at is part else at[kept], n[kept], need[kept], row[:, kept], alive[kept]
                hit, total, carry = (x[:, :left] for x in (hit, total, carry[None]))
                carry = carry[0]
        kept = np.flatnonzero(alive)
        if left:
            self.held.append((np.full(left, i), kept + part.start if at is part else at[kept]))
            self.count += left

    def taken(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs held, which are so no more."""
        held, self.held, self.count = self.held, [], 0
        yield from held

    def hold(self, i: np.ndarray, k: np.ndarray, need: np.ndarray) -> None:
        """Pairs to be compared from their first token on."""
        self.held.append((i, k, np.zeros_like(i), need, np.full((1, len(i)), FULL)))
        self.count += len(i)

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Streams of ``a`` and ``b`` that are similar, among the pairs held."""
        a, b = self.a, self.b
        if not self.held:
            return
        i, k, at, need = (np.concatenate([h[c] for h in self.held]) for c in range(4))
        wide = b.masks.shape[1]
        row = np.full((wide, len(i)), FULL)
        done = 0
        for h in self.held:
            words = min(wide, len(h[4]))
            row[:words, done : done + len(h[0])] = h[4][:words]
            done += len(h[0])
        self.held, self.count = [], 0
        none = a.n[i] == 0
        if (none & (need <= 0)).any():
            yield i[none & (need <= 0)], k[none & (need <= 0)]
        order = np.argsort(k, kind="stable")
        order = order[~none[order]]
        i, k, at, need, row = i[order], k[order], at[order], need[order], row[:, order]
        while len(i):
            left, m = [], a.n[i]
            steps = max(1, min(int(m.min() * STEP), int((m - at).min())))
            # what the tails of the first streams hold then
            _, one, of = np.unique(i * (int(m.max()) + 1) + at, return_index=True, return_inverse=True)
            mine = np.stack([b.packed(self.bits[a.ends[i[x]] + at[x] + steps : a.ends[i[x] + 1]]) for x in one.tolist()], axis=1)
            for x in range(0, len(i), GROUP):
                g = slice(x, x + GROUP)
                found, kept = self._follow(i[g], k[g], at[g], need[g], row[:, g].copy(), steps, mine, of[g])
                left.append(kept)
                if len(found[0]):
                    yield found
            i, k, at, need, row = (np.concatenate([h[c] for h in left], axis=-1) for c in range(5))

    def _follow(self, i: np.ndarray, k: np.ndarray, at: np.ndarray, need: np.ndarray, row: np.ndarray, steps: int, mine: np.ndarray, of: np.ndarray) -> tuple[tuple, tuple]:
        """Pairs that are found similar and those that may still be, some tokens later."""
        a, b = self.a, self.b
        m, first, masks = a.n[i], a.ends[i], b.by_stream[0]
        ahead, behind = b.n[k] - need, m - need
        x, y = max(0, int((at - behind).min())) // BITS, min(len(row), int((at + ahead).max() + steps) // BITS + 1)
        r = row[x:y]
        hit, total, mask, carry = np.empty_like(r), np.empty_like(r), np.empty_like(r), np.empty_like(r[0])
        for j in range(steps):
            spot = (k * len(b.masks) + self.tokens[first + at + j]) * len(row) + x
            for w in range(y - x):
                np.take(masks, spot, out=mask[w], mode="clip")
                spot += 1
            _step(r, mask, hit, total, carry)
        r &= FULL
        at = at + steps
        over = at == m
        upto = np.zeros((len(row) + 1, len(i)), dtype=np.int32)
        np.cumsum(np.bitwise_count(row ^ FULL), axis=0, dtype=np.int32, out=upto[1:])
        found = over & (upto[-1] >= need)
        alive = ~over
        alive[alive] = self._best(k[alive], at[alive], ahead[alive], behind[alive], row[:, alive], upto[:, alive], mine, of[alive]) >= need[alive]
        kept = np.flatnonzero(alive)
        return (i[found], k[found]), (i[kept], k[kept], at[kept], need[kept], row[:, kept])

    def _best(self, k: np.ndarray, at: np.ndarray, ahead: np.ndarray, behind: np.ndarray, row: np.ndarray, upto: np.ndarray, mine: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Most that the common subsequences of pairs can have in the end."""
        b, best = self.b, np.zeros(len(k), dtype=np.int32)
        if not len(k):
            return best
        last, tails = len(b.tails) - 1, b.by_stream[1]
        low, high = np.minimum(np.maximum(at - behind, 0) // b.grid, last), np.minimum((at + ahead) // b.grid, last)
        used = np.flatnonzero(mine.any(axis=1)).tolist()
        bits = [mine[w][of] for w in used]
        s, p = np.arange(len(k)), low
        while len(s):
            spot = (k[s] * len(b.tails) + p) * b.size
            got = np.zeros(len(s), dtype=np.int32)
            for w, own in zip(used, bits):
                got += np.bitwise_count(np.take(tails, spot + w, mode="clip") & own)
            w, r = np.divmod((p + 1) * b.grid, BITS)
            whole = (p == last) | (w >= len(row))
            w[whole] = 0
            part = upto[w, s] + np.bitwise_count((row[w, s] ^ FULL) & ((np.uint64(1) << r.astype(np.uint64)) - np.uint64(1)))
            best[s] = np.maximum(best[s], got + np.where(whole, upto[-1, s], part))
            p = p + 1
            more = p <= high[s]
            if not more.all():
                s, p, bits = s[more], p[more], [x[more] for x in bits]
        return best


class Partners:
    """A wide block: its streams, and what is left of them without the most frequent words.

    Those make up most of a stream and are in any order in all streams, so a pair
    is told apart by what is left: the common subsequence of two streams isn't
    longer than that of their other words and the frequent words both have.
    """

    def __init__(self, block: Block) -> None:
        self.block, self.full = block, None
        often = np.bincount(block.ids, minlength=len(block.vocabulary))
        order = np.argsort(often, kind="stable")
        self.rare = np.zeros(len(often), dtype=bool)
        self.rare[order[np.cumsum(often[order]) <= max(RARE * len(block.ids), FEW * len(block.n))]] = True
        self.thin = Wide(block.only(self.rare))
        self.counts = {block.vocabulary[w]: block.counts(w).astype(np.int32) for w in np.flatnonzero(~self.rare).tolist()}

    def whole(self) -> Wide:
        self.full = self.full or Wide(self.block)
        return self.full


def met(a: Block, partners: Partners, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Digests of similar streams of ``a`` and, later by (length, digest), of the wide block."""
    b, whole = partners.block, int(round(share * 1000))
    rare = {t for t, r in zip(b.vocabulary, partners.rare.tolist()) if r}
    thin, full = Pairs(a.only(np.array([t in rare for t in a.vocabulary])), partners.thin), None
    shared = [(a.counts(w).tolist(), partners.counts[t]) for w, t in enumerate(a.vocabulary) if t in partners.counts]
    for i, m in enumerate(a.n.tolist()):
        low, high = np.searchsorted(b.n, m, "left"), np.searchsorted(b.n, m, "right")
        start = int(low + np.searchsorted(b.digests[low:high], a.digests[i], "right"))
        end = max(start, int(np.searchsorted(b.n, 2000 * m // whole - m, "right")))  # up to where m tokens are enough
        need = ((whole * (m + b.n[start:end]) + 1999) // 2000).astype(np.int32)
        x = start
        while x < end:
            y = min(end, max(x + LEAST // len(partners.thin.masks[0]), int(np.searchsorted(b.n, b.n[x] * LIKE, "right"))))
            left = need[x - start : y - start]
            for mine, theirs in shared:
                if mine[i]:
                    left -= np.minimum(theirs[x:y], mine[i])
            thin.head(i, slice(x, y), left)
            x = y
        if thin.count >= HELD or i == len(a.n) - 1:
            for f, g in thin.taken():
                full = full or Pairs(a, partners.whole())
                full.hold(f, g, -(-whole * (a.n[f] + b.n[g]) // 2000))
        if full and (full.count >= HELD or i == len(a.n) - 1):
            for f, g in full.rest():
                yield a.digests[f], b.digests[g]


def similar_streams(functions: DataFrame, share: float, least_tokens: int) -> DataFrame:
    """``a, b`` (a < b): digests of distinct streams that are similar.

    ``functions``: language, digest, tokens, stream. Equal streams are one
    digest and appear in no pair.
    """
    spark = functions.sparkSession
    ship_package(spark)
    kinds = written(
        functions.where((F.col("tokens") >= least_tokens) & F.col("language").isNotNull()).groupBy("language", "digest").agg(F.max("tokens").cast("int").alias("n"), F.max("stream").alias("stream")),
        "streams",
    )
    narrow, wide = written(_blocks(kinds, NARROW), "narrow"), written(_blocks(kinds, WIDE), "wide")
    parts = max(1, min(WIDE_PARTS, wide.count()))
    few = max(1, -(-16 * spark.sparkContext.defaultParallelism // parts))
    x, y = (df.select(*[F.col(c).alias(f"{k}_{c}") for c in df.columns]) for k, df in (("x", narrow.repartition(few)), ("y", wide.repartition(parts))))
    # a stream's partners are at most so much longer; a little more than exact
    near = (F.col("x_language") == F.col("y_language")) & (F.col("y_hi") >= F.col("x_lo")) & (F.col("y_lo") <= F.col("x_hi") * ((2 - share) / share) + 2)
    both = x.hint("shuffle_replicate_nl").join(y, near)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, Block | Partners] = {}
        for batch in batches:
            for i in range(len(batch)):
                r = batch.slice(i, 1)
                sides = []
                for k in "xy":
                    ids = [r[f"{k}_{c}"][0] for c in ("lengths", "digests", "vocabulary", "ids")]
                    name = (k, r[f"{k}_language"][0].as_py(), r[f"{k}_lo"][0].as_py(), r[f"{k}_first"][0].as_py())
                    if name not in kept:
                        for old in [o for o in kept if o[0] == k]:
                            del kept[old]
                        words = ids[2].as_py()
                        block = Block(ids[0].values.to_numpy(), ids[1].values.to_numpy(), words, np.frombuffer(ids[3].as_py(), np.uint32 if len(words) > 1 << 16 else np.uint16))
                        kept[name] = Partners(block) if k == "y" else block
                    sides.append(kept[name])
                for a, found in met(*sides, share):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, found)), pa.array(np.maximum(a, found))], names=["a", "b"])

    return both.select(*[f"{k}_{c}" for k in "xy" for c in ("language", "lo", "first", "lengths", "digests", "vocabulary", "ids")]).mapInArrow(compare, "a bigint, b bigint").distinct()


def leader_groups(nodes: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """``leader, member``: greedy leader groups in the order of ``ord``.

    ``nodes``: ord (distinct); ``pairs``: a < b over ord. A node joins the first
    free leader it is similar to; groups below ``least`` release their members.
    The sequential result, in parallel rounds: a node that comes first among
    all active ones within two steps decides as it would in sequence.
    """
    edges = written(pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("b", "a")).distinct(), "pairs")
    found = None
    while True:
        if edges.limit(1).count() == 0:
            break
        near = edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        far = edges.join(near.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("m").alias("f"))
        first = far.where("x <= f").select("x")
        groups = written(edges.join(first, "x").select(F.col("x").alias("leader"), F.col("y").alias("member")), "groups")
        large = groups.groupBy("leader").agg(F.count("*").alias("n")).where(F.col("n") + 1 >= least).select("leader")
        kept = groups.join(large, "leader")
        found = kept if found is None else found.union(kept)
        gone = written(groups.select(F.col("leader").alias("x")).union(kept.select("member")).distinct(), "gone")
        edges = written(edges.join(gone, "x", "left_anti").join(gone.withColumnRenamed("x", "y"), "y", "left_anti").select("x", "y"), "pairs")
    if found is None:
        return nodes.select(F.col("ord").alias("leader"), F.col("ord").alias("member")).limit(0)
    every = found.union(found.select("leader", F.col("leader"))).distinct()
    return every
