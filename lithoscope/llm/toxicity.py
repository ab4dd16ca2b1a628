"""Abusive, hateful or sexual passages by a linear-chain CRF.

Texts are cut into sentences and tokens; obfuscated spellings (look-alike
letters, digits for letters, stretched or separated letters) are read through a
normal form, masked letters and slips through the words the training found in
passages. The CRF has two states, outside and inside a passage, with hashed
features of the token and its neighbours, of token pairs and of transitions.
Forward-backward gives each token's marginal; a document's score is its largest
one. In sentences that reach ``THRESHOLD``, runs of tokens at or above ``REACH``
are the offending passages with their offsets.

There are no bundled word lists or sentences: everything comes from the labelled
documents. Raters judge documents, so their tokens are labelled in rounds. First
words and pairs are weighed by how much more often they occur in positive
documents than in all others; the sentence of a positive document that weighs
most is its passage, from its first to its last heavy token. The CRF fitted to
that labels the tokens anew, twice. Sentences of negative documents that the
model takes for passages beyond doubt are raters' slips and left out, positive
documents without such a sentence likewise. Without a positive document nothing
is known to be abusive and every score is 0.

Training, in one task, takes documents drawn by a hash of their id: at most
about ``POSITIVE_DOCS`` and ``NEGATIVE_DOCS`` labelled ones and
``BACKGROUND_DOCS`` without label, whose sentences stand for ordinary text with
a small weight. One copy of each distinct sentence is used; each round takes
``EASY_SENTENCES`` of the ordinary ones, drawn by hash, and all of the others
that could be taken for passages (by their weight, then by the model).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, spread

#: bounds of the training sample
POSITIVE_DOCS, NEGATIVE_DOCS, BACKGROUND_DOCS = 1_500, 6_000, 4_000
#: ordinary sentences of the sample that every round uses; of the others, those that the round before doubts
EASY_SENTENCES = 6_000
BACKGROUND_WEIGHT = 0.5
ROUNDS = (30, 20, 20, 60)
#: weight of ordinary sentences that the round before doubts
HARD_WEIGHT = 4.0
BITS = 17
DIM = 1 << BITS
OFFSETS = (-2, -1, 0, 1, 2)
WIDTH = 8
THRESHOLD = 0.5
#: tokens of a sentence that holds such a marginal belong to its passage from here on
REACH = 0.2
#: most entries in the kept vocabulary of a worker
MEMO = 200_000
#: marginal beyond which a sentence of a negative document is a rater's slip
SLIP = 0.97
#: most words that masked spellings are read as
WORDS = 1_000

# Letters that look like Latin ones, and digits or signs for letters.
LOOKALIKES = str.maketrans("аеорсхуіјѕһкмтвοαερικυν", "aeopcxyijshkmtboaepikuv")
LEET = str.maketrans("013457@$!€", "oieastasie")
INVISIBLE = re.compile("[­​-‏⁠⁦-⁩﻿‪-‮]")


def clean(text: str) -> str:
    """Without invisible characters and with canonical letters, same tokens."""
    return INVISIBLE.sub("", text)


def normal_form(token: str) -> str:
    """The plain spelling a token stands for, as far as rules can tell."""
    t = unicodedata.normalize("NFKC", token).lower().translate(LOOKALIKES)
    if any(c.isalpha() for c in t):
        if re.fullmatch(r"(?:\w[-.*_ ]){2,}\w", t):
            t = re.sub(r"[-.*_ ]", "", t)
        inner = t.strip(".,;:!?\"'")
        if re.search(r"[a-z][013457@$!€]|[013457@$!€][a-z]", inner) and not re.fullmatch(r"[a-z]+\d+|\d+[a-z]{1,2}", inner):
            t = inner.translate(LEET)
    return re.sub(r"(.)\1+", r"\1", t)


class Spellings:
    """Words that masked or misspelt tokens are read as."""

    def __init__(self, words: list[str]) -> None:
        self.words = sorted(set(words))
        self.known = set(self.words)
        self.slips: dict[tuple[str, int], list[str]] = {}
        for w in self.words:
            if len(w) >= 6:
                self.slips.setdefault((w[0], len(w)), []).append(w)

    def read(self, token: str, normal: str) -> str:
        """The word a token stands for, or its normal form."""
        if normal in self.known or not self.words:
            return normal
        low = token.lower()
        if _MASKED.search(low) and low[0].isalpha() and "/" not in low and "_" not in low:
            letters = "".join(re.escape(c) if c not in "*#%$@&-" else "\0" for c in low)
            exact = re.compile(letters.replace("\0", ".") + r"\Z")
            loose = re.compile(re.sub("\0+", lambda m: ".+", letters) + r"\Z")
            for pattern in (exact, loose):
                for w in self.words:
                    if len(w) >= 3 and pattern.match(w):
                        return w
        if len(normal) >= 6:  # one letter left out, doubled, swapped or replaced
            for n in (len(normal) - 1, len(normal), len(normal) + 1):
                for w in self.slips.get((normal[0], n), ()):
                    if _one_slip(w, normal):
                        return w
        return normal


_MASKED = re.compile(r"\w[*#%$@&-]+\w")


def _one_slip(a: str, b: str) -> bool:
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


_TOKEN = re.compile(r"`[^`\n]*`|<\w+>|@\w+|(?:[\w.-]++/)+[\w.-]++|#?\d[\d.,]*+|(?<!\w)(?:[^\W\d_] ){3,}[^\W\d_](?!\w)|[^\W\d_](?:[\w’'*#%@$!.&-]*[\w*])?|[^\s\w]|_+")
# line ends, stops, and a bracket or pictograph before a capital
_BREAK = re.compile(r"\n+|(?<=[.!?])\s+(?=[^\s])|(?<=[)\u2600-\u27bf\U0001f300-\U0001faff])\s+(?=[^\W\d_a-z])")


def token_kind(token: str) -> str:
    """The vocabulary entry of a token: code, paths, names and numbers are one each."""
    c = token[0]
    if c == "`":
        return "CODE"
    if c in "<@" and len(token) > 1:
        return "NAME"
    if c.isdigit() or (c == "#" and len(token) > 1 and token[1].isdigit()):
        return "NUM"
    if "/" in token and len(token) > 1:
        return "PATH"
    if "_" in token and len(token) > 2 and token.replace("_", "").isalnum():
        return "CODE"
    return token


def hashed(s: str) -> int:
    return xxhash.xxh64_intdigest(s) >> (64 - BITS)


def features(token: str, spellings: Spellings) -> tuple[np.ndarray, int, str]:
    """Hashed features of one vocabulary entry (padded with -1), its hash and its word."""
    if token in ("CODE", "NAME", "NUM", "PATH"):
        names, word = [f"k:{token}"], token
    else:
        normal = normal_form(token)
        word = spellings.read(token, normal)
        names = [f"w:{word}", "b"]
        if len(token) > 3 and token.isupper():
            names.append("u")
        if word.isalpha():
            padded = f"^{word}$"
            names += [f"g:{padded[:5]}", f"g:{padded[-5:]}", f"p:{padded[:4]}"]
        if any(c in token for c in "*#%$@") and any(c.isalpha() for c in token):
            names.append("m")
    idx = np.full(WIDTH, -1, np.int64)
    for i, n in enumerate(names[:WIDTH]):
        idx[i] = hashed(n)
    return idx, hashed(f"t:{word}"), word


class _Ids(dict):
    """Token -> entry; a new token is added to its vocabulary."""

    def __init__(self, vocab: Vocabulary) -> None:
        super().__init__({"": 0})
        self.vocab = vocab

    def __missing__(self, token: str) -> int:
        return self.vocab.id(token)


class Vocabulary:
    """Tokens met so far: feature rows, hashes and words."""

    def __init__(self, spellings: Spellings | None = None) -> None:
        self.spellings = spellings or Spellings([])
        self.ids = _Ids(self)
        self.rows: list[np.ndarray] = [np.full(WIDTH, -1, np.int64)]
        self.hashes: list[int] = [hashed("t:")]
        self.words: list[str] = [""]

    def id(self, token: str) -> int:
        got = self.ids.get(token)
        if got is None:
            kind = token_kind(token)
            if kind != token:
                got = self.id(kind)
                if len(token) > 24:  # code and paths rarely come again
                    return got
            else:
                row, h, word = features(token, self.spellings)
                got = len(self.rows)
                self.rows.append(row)
                self.hashes.append(h)
                self.words.append(word)
            self.ids[token] = got
        return got


def sentences(text: str) -> list[tuple[int, str]]:
    """(offset, sentence) of a text; long ones are cut at white space."""
    out, at = [], 0
    for m in [*_BREAK.finditer(text), None]:
        end = m.start() if m else len(text)
        if text[at:end].strip():
            out.append((at, text[at:end]))
        at = m.end() if m else end
    return out


class Batch:
    """Sentences of token ids, padded by two on both sides and laid end to end."""

    def __init__(self, seqs: list[list[int]], hashes: np.ndarray) -> None:
        self.lengths = np.array([len(s) for s in seqs], np.int64)
        self.n = int(self.lengths.sum())
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]) if len(seqs) else np.zeros(0, np.int64)
        gap = self.starts + 2 * np.arange(len(seqs)) + 2
        flat = np.fromiter((i for s in seqs for i in s), np.int64, self.n)
        wide = np.zeros(self.n + 2 * len(seqs) + 4, np.int64)
        self.where = np.repeat(gap - self.starts, self.lengths) + np.arange(self.n)
        wide[self.where] = flat
        self.around = [wide[self.where + o] for o in OFFSETS]
        h = hashes[wide]
        self.pairs = []
        for k, (a, b) in enumerate(((-1, 0), (0, 1), (-2, -1), (1, 2), (-1, 1))):
            key = h[self.where + a] * 0x9E3779B1 + h[self.where + b] * 0x85EBCA77 + k * 0xC2B2AE3D
            self.pairs.append((key ^ (key >> 17)) & (DIM - 1))
        self.order = np.argsort(-self.lengths, kind="stable")


class CRF:
    """Two states, weights of state 1; ``trans[i, j]`` from i to j."""

    def __init__(self, w: np.ndarray | None = None, trans: np.ndarray | None = None, start: np.ndarray | None = None) -> None:
        self.w = np.zeros((len(OFFSETS) + 1, DIM), np.float32) if w is None else w
        self.trans = np.zeros((2, 2)) if trans is None else trans
        self.start = np.array([0.0, -1.0]) if start is None else start

    def token_scores(self, rows: np.ndarray) -> np.ndarray:
        """Score of each vocabulary row at each offset."""
        known = rows >= 0
        return np.stack([(self.w[o][rows] * known).sum(axis=1) for o in range(len(OFFSETS))], axis=1)

    def emissions(self, b: Batch, scores: np.ndarray) -> np.ndarray:
        e = np.zeros(b.n)
        for o, ids in enumerate(b.around):
            e += scores[ids, o]
        for p in b.pairs:
            e += self.w[-1][p]
        return e

    def marginals(self, b: Batch, e: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """P(state 1) of each token, all sentences at once, and with weights of
        the tokens the expected transitions."""
        alpha, beta = np.zeros((b.n, 2)), np.zeros((b.n, 2))
        order, lengths, starts = b.order, b.lengths[b.order], b.starts[b.order]
        if not len(order):
            return np.zeros(0), np.zeros((2, 2))
        most = int(lengths[0])
        live = np.searchsorted(-lengths, -np.arange(1, most + 1), side="right")  # sentences of at least t tokens
        for t in range(most):
            at = starts[: live[t]] + t
            if t == 0:
                alpha[at, 0], alpha[at, 1] = self.start[0], self.start[1] + e[at]
                continue
            prev = alpha[at - 1]
            for j in (0, 1):
                alpha[at, j] = np.logaddexp(prev[:, 0] + self.trans[0, j], prev[:, 1] + self.trans[1, j]) + (e[at] if j else 0)
        for t in range(most - 2, -1, -1):
            at = starts[: live[t + 1]] + t
            nxt, en = beta[at + 1], e[at + 1]
            for i in (0, 1):
                beta[at, i] = np.logaddexp(self.trans[i, 0] + nxt[:, 0], self.trans[i, 1] + nxt[:, 1] + en)
        joint = alpha + beta
        z = np.logaddexp(joint[:, 0], joint[:, 1])
        flow = np.zeros((2, 2))
        if weights is not None:
            inner = np.ones(b.n, bool)
            inner[b.starts[b.lengths > 0]] = False
            at = np.flatnonzero(inner)
            for i in (0, 1):
                for j in (0, 1):
                    share = np.exp(alpha[at - 1, i] + self.trans[i, j] + (e[at] if j else 0) + beta[at, j] - z[at])
                    flow[i, j] = (share * weights[at]).sum()
        return np.exp(joint[:, 1] - z), flow

    def fit(self, seqs: list[list[int]], labels: list[np.ndarray], weights: np.ndarray, vocab: Vocabulary, rounds: int = 120, ridge: float = 0.02) -> None:
        """Penalised likelihood by full-batch Adagrad steps."""
        rows, hashes = np.array(vocab.rows), np.array(vocab.hashes, np.int64)
        b = Batch(seqs, hashes)
        y = np.concatenate(labels).astype(float)
        tw = np.repeat(weights, b.lengths)
        gw, gt, gs = np.full(self.w.shape, 1e-3, np.float32), np.full((2, 2), 1e-3), np.full(2, 1e-3)
        prev = np.arange(b.n) - 1
        inner = np.ones(b.n, bool)
        inner[b.starts] = False
        yi = y.astype(int)
        gold = np.zeros((2, 2))
        np.add.at(gold, (yi[prev[inner]], yi[inner]), tw[inner])
        firsts = np.array([(tw[b.starts] * (1 - y[b.starts])).sum(), (tw[b.starts] * y[b.starts]).sum()])
        known = rows >= 0
        for _ in range(rounds):
            e = self.emissions(b, self.token_scores(rows))
            p, flow = self.marginals(b, e, tw)
            d = (p - y) * tw
            grad = np.zeros_like(self.w)
            for o, ids in enumerate(b.around):
                per = np.bincount(ids, d, minlength=len(rows))
                grad[o] = np.bincount(rows[known], np.repeat(per, known.sum(axis=1)), minlength=DIM)
            for q in b.pairs:
                grad[-1] += np.bincount(q, d, minlength=DIM).astype(np.float32)
            grad += ridge * self.w
            gw += grad * grad
            self.w -= 0.5 * grad / np.sqrt(gw)
            dt = flow - gold + 0.1 * self.trans
            gt += dt * dt
            self.trans -= 0.2 * dt / np.sqrt(gt)
            ps = np.array([(tw[b.starts] * (1 - p[b.starts])).sum(), (tw[b.starts] * p[b.starts]).sum()])
            ds = ps - firsts
            gs += ds * ds
            self.start -= 0.2 * ds / np.sqrt(gs)


def hash_ids(ids: tuple[int, ...]) -> int:
    return xxhash.xxh64_intdigest(np.array(ids, np.int64).tobytes())


def _weights(positive: list[list[list[str]]], others: list[list[list[str]]]) -> dict[object, float]:
    """How much more often words and neighbouring pairs occur in positive documents."""
    def seen(doc: list[list[str]]) -> set:
        return {w for s in doc for w in s} | {p for s in doc for p in zip(s, s[1:])}

    a, b = Counter(), Counter()
    for doc in positive:
        a.update(seen(doc))
    for doc in others:
        b.update(seen(doc))
    base = math.log((len(others) + 1) / (len(positive) + 1))
    # a document is no witness for itself: what one alone holds weighs nothing
    return {f: v for f, n in a.items() if (v := math.log((n - 0.9) / (b[f] + 0.5)) + base) > 0 and n > 1}


def _words_only(sentence: list[str], inside: np.ndarray) -> np.ndarray:
    """Labels from the first to the last inner token that holds a letter: signs around a passage are none of it."""
    lab = np.zeros(len(sentence))
    worded = [i for i in inside if any(c.isalpha() for c in sentence[i])]
    if worded:
        lab[worded[0] : worded[-1] + 1] = 1.0
    return lab


def _first_labels(doc: list[list[str]], weights: dict[object, float]) -> tuple[int, np.ndarray, float]:
    """The heaviest sentence, its labels and its weight: the mean of its four heaviest tokens."""
    best = (0, np.zeros(len(doc[0])), 0.0)
    for k, s in enumerate(doc):
        pairs = [weights.get(p, 0.0) for p in zip(s, s[1:])]
        own = np.array([weights.get(w, 0.0) for w in s])
        both = np.maximum(own, np.maximum([0.0, *pairs], [*pairs, 0.0]))
        value = float(np.sort(both)[-4:].sum() / 4)
        if value > best[2]:
            heavy = np.flatnonzero(both >= 0.5 * both.max())
            best = (k, _words_only(s, heavy), value)
    return best


def train_model(docs: list[tuple[str, int]]) -> tuple[CRF, list[str]]:
    """A CRF and the words of passages from (text, label) documents; label -1
    marks documents without one."""
    cut = [([_TOKEN.findall(s) for _, s in sentences(clean(t))], y) for t, y in docs if t]
    cut = [([s for s in ss if s], y) for ss, y in cut]
    cut = [(ss, y) for ss, y in cut if ss]
    plain = Vocabulary()
    as_words = lambda ss: [[plain.words[plain.id(w)] for w in s] for s in ss]
    first = [as_words(ss) for ss, y in cut if y == 1]
    if not first:
        crf = CRF()
        crf.start = np.array([0.0, -50.0])
        crf.trans = np.array([[0.0, -50.0], [0.0, 0.0]])
        return crf, []
    weights = _weights(first, [as_words(ss) for ss, y in cut if y != 1])
    chosen = [_first_labels(ss, weights) for ss in first]
    middle = float(np.median([v for *_, v in chosen]))
    # words of passages, for masked spellings
    words = Counter(w for ss, (k, lab, v) in zip(first, chosen) if v >= 0.5 * middle for w in {w for w, y in zip(ss[k], lab) if y and w.isalpha() and len(w) >= 3 and weights.get(w, 0.0) > 1.5})
    spell = [w for w, n in words.most_common(WORDS) if n >= 2]
    vocab = Vocabulary(Spellings(spell))
    ids = lambda ss: [[vocab.id(w) for w in s] for s in ss]
    positive = [ids(ss) for ss, y in cut if y == 1]
    mass: dict[tuple, float] = {}
    heavy: dict[tuple, float] = {}
    for ss, y in cut:  # one copy of each ordinary sentence
        if y != 1:
            for s, ws in zip(ids(ss), as_words(ss)):
                key = tuple(s)
                mass[key] = max(mass.get(key, 0.0), 1.0 if y == 0 else BACKGROUND_WEIGHT)
                heavy[key] = _first_labels([ws], weights)[2]
    ordinary = [list(k) for k in mass]
    weight = list(mass.values())
    rank = np.argsort([hash_ids(k) for k in mass], kind="stable")
    easy = np.zeros(len(ordinary), bool)
    easy[rank[:EASY_SENTENCES]] = True
    doubtful = np.array(list(heavy.values())) >= 0.3 * middle
    crf = CRF()
    for step, rounds in enumerate(ROUNDS):
        seqs, labels, wt = [], [], []
        if step == 0:
            for ss, (k, lab, value) in zip(positive, chosen):
                if value >= 0.5 * middle:
                    seqs.append(ss[k])
                    labels.append(lab)
                    wt.append(1.0)
            for k in np.flatnonzero(easy | doubtful):
                seqs.append(ordinary[k])
                labels.append(np.zeros(len(ordinary[k])))
                wt.append(weight[k])
        else:
            flat = [s for ss in positive for s in ss] + ordinary
            b = Batch(flat, np.array(vocab.hashes, np.int64))
            p, _ = crf.marginals(b, crf.emissions(b, crf.token_scores(np.array(vocab.rows))))
            top = np.maximum.reduceat(p, b.starts)
            at = 0
            for ss in positive:
                own = top[at : at + len(ss)]
                best = int(own.argmax())
                if own[best] >= (0.15, 0.3, 0.5)[step - 1]:
                    for k, s in enumerate(ss):
                        m = p[b.starts[at + k] : b.starts[at + k] + len(s)]
                        if k == best or own[k] >= 0.9:
                            seqs.append(s)
                            labels.append(_words_only([vocab.words[i] for i in s], np.flatnonzero(m >= 0.5 * m.max())))
                            wt.append(1.5)
                        elif own[k] < 0.15:
                            seqs.append(s)
                            labels.append(np.zeros(len(s)))
                            wt.append(0.5)
                at += len(ss)
            for k, s in enumerate(ordinary):
                if (easy[k] or top[at + k] > 0.01) and top[at + k] < (SLIP if weight[k] == 1.0 else 0.9):
                    seqs.append(s)
                    labels.append(np.zeros(len(s)))
                    wt.append(weight[k] * (HARD_WEIGHT if top[at + k] > 0.05 else 1.0))
        crf = CRF()
        crf.fit(seqs, labels, np.array(wt), vocab, rounds=rounds)
    return crf, spell


class Scorer:
    """Scores texts with a trained model; token scores are remembered."""

    def __init__(self, crf: CRF, words: list[str]) -> None:
        self.crf, self.spellings = crf, Spellings(words)
        self.reset()

    def reset(self) -> None:
        self.vocab = Vocabulary(self.spellings)
        self.scores = self.crf.token_scores(np.array(self.vocab.rows))
        self.hashes = np.array(self.vocab.hashes, np.int64)

    def marginals(self, seqs: list[list[int]]) -> tuple[np.ndarray, Batch]:
        fresh = len(self.vocab.rows) - len(self.scores)
        if fresh:
            self.scores = np.concatenate([self.scores, self.crf.token_scores(np.array(self.vocab.rows[-fresh:]))])
            self.hashes = np.array(self.vocab.hashes, np.int64)
        b = Batch(seqs, self.hashes)
        return self.crf.marginals(b, self.crf.emissions(b, self.scores))[0], b

    def score(self, texts: list[str | None]) -> list[tuple[float, list[dict]]]:
        """(score, passages) of each text; null and blank ones have score 0.

        Sentences with the same vocabulary entries are scored once a batch, and
        offsets are looked up in flagged texts alone.
        """
        if len(self.vocab.ids) > MEMO:
            self.reset()
        entry = self.vocab.ids.__getitem__
        place: dict[tuple, int] = {}
        owner: list[list[int]] = []
        for t in texts:
            mine = []
            if t:
                body = clean(t)
                at = 0
                for m in [*_BREAK.finditer(body), None]:
                    found = _TOKEN.findall(body, at, m.start() if m else len(body))
                    at = m.end() if m else at
                    if found:
                        key = tuple(map(entry, found))
                        mine.append(place.setdefault(key, len(place)))
            owner.append(mine)
        if not place:
            return [(0.0, []) for _ in texts]
        p, b = self.marginals([list(k) for k in place])
        top = np.maximum.reduceat(p, b.starts)
        out = []
        for t, mine in zip(texts, owner):
            value = float(top[mine].max()) if mine else 0.0
            out.append((value, self.passages(t, mine, top, p, b) if value >= THRESHOLD else []))
        return out

    def passages(self, text: str, mine: list[int], top: np.ndarray, p: np.ndarray, b: Batch) -> list[dict]:
        """Offsets in the text as given."""
        keep = [i for i, c in enumerate(text) if not INVISIBLE.match(c)] if INVISIBLE.search(text) else None
        found, k = [], 0
        for at, s in sentences(clean(text)):
            spans = [(m.start() + at, m.end() + at) for m in _TOKEN.finditer(s)]
            if not spans:
                continue
            n = mine[k]
            k += 1
            if top[n] < THRESHOLD:
                continue
            inside = p[b.starts[n] : b.starts[n] + b.lengths[n]] >= REACH
            places = np.flatnonzero(inside)
            for x, y in zip(places[:-1], places[1:]):
                if y - x <= 3:  # one passage across a gap of two tokens
                    inside[x:y] = True
            edges = np.flatnonzero(np.diff(np.r_[0, inside.astype(int), 0]))
            for first, last in zip(edges[::2], edges[1::2]):
                begin, end = spans[first][0], spans[last - 1][1]
                found.append({"begin": keep[begin] if keep else begin, "end": keep[end - 1] + 1 if keep else end})
        return found


def document_labels(labels: DataFrame) -> DataFrame:
    """doc_id and label (1, 0) of documents whose raters are clear enough.

    Positive: at least half say so, and one names a kind of abuse (a category
    other than 'other'). Negative: nobody says so. Null votes don't count.
    """
    votes = labels.where(F.col("abusive").isNotNull()).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum("abusive").alias("a"),
        F.max(((F.col("abusive") == 1) & F.col("category").isNotNull() & (F.col("category") != "other")).cast("int")).alias("named"),
    )
    label = F.when((F.col("a") * 2 >= F.col("n")) & (F.col("named") == 1), 1).when(F.col("a") == 0, 0)
    return votes.select("doc_id", label.alias("label")).where("label IS NOT NULL")


def _share(bound: int, n: int) -> int:
    return int(min(1.0, bound / max(n, 1)) * (1 << 20))


def training_rows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, text, label`` of the drawn documents; -1 for no label."""
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    drawn = known.where(draw < F.when(F.col("label") == 1, _share(POSITIVE_DOCS, sizes.get(1, 0))).otherwise(_share(NEGATIVE_DOCS, sizes.get(0, 0))))
    texts = docs.select("doc_id", "text")
    rest = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < _share(BACKGROUND_DOCS, docs.count()))  # counted from file footers
    rows = texts.join(drawn, "doc_id").unionByName(rest.join(known.select("doc_id"), "doc_id", "left_anti").withColumn("label", F.lit(-1)))
    return rows.where(F.col("text").isNotNull())


def fit(rows: DataFrame) -> tuple[CRF, list[str]]:
    """The model of training rows, fitted in one task."""
    ship_package(rows.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [p for p in parts if len(p)]
        if held:
            data = pd.concat(held).sort_values(["doc_id", "text"], kind="stable")
            yield pd.DataFrame([_row(train_model(list(zip(data["text"].tolist(), data["label"].astype(int).tolist()))))])

    got = rows.repartition(1).mapInPandas(run, _MODEL).collect()  # 3 MB, fixed
    return _model(got[0]) if got else train_model([])


_MODEL = "w binary, trans array<double>, start array<double>, words array<string>"


def _row(model: tuple[CRF, list[str]]) -> dict:
    crf, words = model
    return {"w": crf.w.astype(np.float32).tobytes(), "trans": crf.trans.ravel().tolist(), "start": crf.start.tolist(), "words": words}


def _model(r: dict) -> tuple[CRF, list[str]]:
    return CRF(np.frombuffer(r["w"], np.float32).reshape(len(OFFSETS) + 1, DIM), np.array(r["trans"]).reshape(2, 2), np.array(r["start"])), list(r["words"])


def save(spark: SparkSession, model: tuple[CRF, list[str]], folder: str) -> None:
    """Write a fitted model, to score other documents without training."""
    spark.createDataFrame([_row(model)], _MODEL).write.parquet(folder)


def load(spark: SparkSession, folder: str) -> tuple[CRF, list[str]]:
    return _model(spark.read.parquet(folder).first().asDict())  # 3 MB, fixed


def train(docs: DataFrame, labels: DataFrame) -> tuple[CRF, list[str]]:
    """Fit on the bounded sample of documents."""
    return fit(training_rows(docs, document_labels(labels)))


def validate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Figures of a model that never saw a fifth of the labelled documents, on those.

    ``label, documents, flagged``; the raters' labels are the measure, slips included.
    """
    known = document_labels(labels)
    held = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(5)) == 0
    model = fit(training_rows(docs.join(known.where(held), "doc_id", "left_anti"), known.where(~held)))
    scored = score_documents(docs.join(known.where(held), "doc_id"), model, ["doc_id", "label"])
    return scored.groupBy("label").agg(F.count("*").alias("documents"), F.sum((F.col("score") >= THRESHOLD).cast("bigint")).alias("flagged"))


def score_documents(docs: DataFrame, model: tuple[CRF, list[str]], keep: list[str]) -> DataFrame:
    """``keep`` columns, ``score`` in 0..1 and ``passages`` (begin, end offsets).

    Offsets count code points of the text as given. Null, empty and blank texts
    have score 0. Repeated rows are scored each; extra columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    crf, words = model
    sent = spark.sparkContext.broadcast((crf.w, crf.trans, crf.start, words))  # 3 MB, fixed by BITS and WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *parts, listed = sent.value
        scorer = Scorer(CRF(*parts), listed)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = scorer.score(part.column(len(keep)).to_pylist())
                kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array([s for s, _ in got], pa.float64()), pa.array([x for _, x in got], kind)], names=[*keep, "score", "passages"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return spread(docs.select(*keep, F.col("text").alias("__text"))).mapInArrow(run, f"{schema}, score double, passages array<struct<begin: int, end: int>>")
