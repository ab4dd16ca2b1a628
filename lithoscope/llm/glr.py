"""Generalised table-driven LR recognition with shared stacks.

Tables are LR(0) item sets with FOLLOW-filtered reductions (SLR), built lazily
as states are first reached. Conflicts are not resolved: all stacks live on in
a set. Stacks are hash-consed cells ``(state, cell below)``, so a set of stacks
is a small set of integers that stands for its whole context, and the outcome
of a segment of tokens depends on nothing but that set. Outcomes are memoised by
``(set, segment)``: text with ordinary repetition costs one lookup a segment.
"""

from __future__ import annotations

import re

_META = re.compile(r"'(?:[^']+)'|[A-Za-z_][A-Za-z0-9_]*|[()|?*+~:]|\S")
#: terminals are single characters from here on; 0x4000.. is free for lexers
FIRST_TERMINAL = 0x100
END = "\x00"
NEWLINE = "\n"
#: memoised outcomes and cells of one parser; beyond it both start anew
MEMO = 600_000


class Grammar:
    """Productions, terminals and FOLLOW sets of one grammar text."""

    def __init__(self, text: str) -> None:
        self.terminals: dict[str, str] = {}
        self.rules: dict[str, list[tuple[str, ...]]] = {}
        self._fresh = 0
        self._repeats: dict[tuple[str, str], str] = {}
        self._groups: dict[tuple, str] = {}
        lines: list[str] = []
        for line in text.splitlines():
            line = re.sub(r"(^|\s)#.*$", "", line)
            if not line.strip():
                continue
            if line[0] in " \t":
                lines[-1] += " " + line.strip()
            else:
                lines.append(line)
        self.start = lines[0].split(":")[0].strip()
        self.names = {line.split(":", 1)[0].strip() for line in lines}
        for line in lines:
            name, body = line.split(":", 1)
            tokens = _META.findall(body)
            alternatives, at = self._alternatives(tokens, 0)
            if at != len(tokens):
                raise ValueError(f"rule {name.strip()}: {tokens[at:]}")
            self.rules.setdefault(name.strip(), []).extend(alternatives)
        self.prods: list[tuple[str, tuple[str, ...]]] = [("<start>", (self.start, END))]
        self.by: dict[str, list[int]] = {}
        for name, bodies in self.rules.items():
            for body in dict.fromkeys(bodies):
                self.by.setdefault(name, []).append(len(self.prods))
                self.prods.append((name, body))
        unknown = {s for _, b in self.prods for s in b if len(s) > 1 and s not in self.rules}
        if unknown:
            raise ValueError(f"undefined: {sorted(unknown)}")
        self._follow()

    def terminal(self, word: str) -> str:
        """The character that stands for a terminal."""
        if word not in self.terminals:
            self.terminals[word] = chr(FIRST_TERMINAL + len(self.terminals))
        return self.terminals[word]

    def _name(self) -> str:
        self._fresh += 1
        return f"<{self._fresh}>"

    def _shared(self, inner: list[tuple[str, ...]]) -> str:
        """One symbol for equal groups; shared symbols keep stacks together."""
        key = tuple(inner)
        if key not in self._groups:
            self._groups[key] = self._name()
            self.rules[self._groups[key]] = inner
        return self._groups[key]

    def _alternatives(self, tokens: list[str], at: int) -> tuple[list[tuple[str, ...]], int]:
        out, body = [], []
        while at < len(tokens) and tokens[at] != ")":
            t = tokens[at]
            at += 1
            if t == "|":
                out.append(tuple(body))
                body = []
                continue
            if t == "(":
                inner, at = self._alternatives(tokens, at)
                at += 1
                symbol = self._shared(inner)
            elif t[0] == "'":
                symbol = self.terminal(t[1:-1])
            elif t.isupper() and t not in self.names:
                symbol = NEWLINE if t == "NL" else self.terminal(t)
            else:
                symbol = t if len(t) > 1 else t + " "
            while at < len(tokens) and tokens[at] in "?*+~":
                mark = tokens[at]
                at += 1
                new = self._repeats.get((symbol, mark))
                if new is None:
                    new = self._repeats[symbol, mark] = self._name()
                    self.rules[new] = {
                        "?": [(), (symbol,)],
                        "*": [(), (new, symbol)],
                        "+": [(symbol,), (new, symbol)],
                        "~": [(symbol,), (new, self.terminal(","), symbol)],
                    }[mark]
                symbol = new
            body.append(symbol)
        out.append(tuple(body))
        return out, at

    def _follow(self) -> None:
        nullable: set[str] = set()
        first: dict[str, set[str]] = {n: set() for n in self.rules}
        follow: dict[str, set[str]] = {n: set() for n in self.rules}
        moved = True
        while moved:
            moved = False
            for name, body in self.prods[1:]:
                if name not in nullable and all(s in nullable for s in body):
                    nullable.add(name)
                    moved = True
                for s in body:
                    new = first[s] if s in first else {s}
                    if not new <= first[name]:
                        first[name] |= new
                        moved = True
                    if s not in nullable:
                        break
        follow[self.start].add(END)
        moved = True
        while moved:
            moved = False
            for name, body in self.prods[1:]:
                trailer = follow[name]
                for s in reversed(body):
                    if s in first:
                        if not trailer <= follow[s]:
                            follow[s] |= trailer
                            moved = True
                        trailer = first[s] | (trailer if s in nullable else set())
                    else:
                        trailer = {s}
        self.follow = follow


class Parser:
    """Recognises token strings of one grammar."""

    def __init__(self, grammar: Grammar) -> None:
        self.g = grammar
        self.kernels: dict[frozenset, int] = {}
        self.shifts: list[dict[str, int]] = []
        self.reduces: list[list[tuple[str, int, set]]] = []
        self._state(frozenset([(0, 0)]))
        self._reset()

    def _reset(self) -> None:
        self.cells: dict[tuple[int, int], int] = {(0, -1): 0}
        self.state = [0]
        self.below = [-1]
        self.sets: dict[frozenset, int] = {frozenset([0]): 0}
        self.members: list[frozenset] = [frozenset([0])]
        self.memo: dict[tuple[int, str], int] = {}

    def _state(self, kernel: frozenset) -> int:
        got = self.kernels.get(kernel)
        if got is not None:
            return got
        at = self.kernels[kernel] = len(self.kernels)
        items, work = set(kernel), list(kernel)
        while work:
            p, d = work.pop()
            body = self.g.prods[p][1]
            if d < len(body):
                for q in self.g.by.get(body[d], ()):
                    if (q, 0) not in items:
                        items.add((q, 0))
                        work.append((q, 0))
        after: dict[str, set] = {}
        reduces = []
        for p, d in items:
            name, body = self.g.prods[p]
            if d < len(body):
                after.setdefault(body[d], set()).add((p, d + 1))
            elif p:
                reduces.append((name, len(body), self.g.follow[name]))
        self.shifts.append({s: frozenset(k) for s, k in after.items()})
        self.reduces.append(sorted(reduces, key=lambda r: r[:2]))
        return at

    def _goto(self, state: int, symbol: str) -> int:
        got = self.shifts[state].get(symbol, -1)
        if isinstance(got, frozenset):
            got = self.shifts[state][symbol] = self._state(got)
        return got

    def _cell(self, state: int, below: int) -> int:
        key = (state, below)
        got = self.cells.get(key)
        if got is None:
            got = self.cells[key] = len(self.state)
            self.state.append(state)
            self.below.append(below)
        return got

    def _step(self, cells: frozenset, token: str) -> frozenset:
        out, work, seen = set(), list(cells), set(cells)
        while work:
            c = work.pop()
            s = self.state[c]
            for name, length, follow in self.reduces[s]:
                if token in follow:
                    b = c
                    for _ in range(length):
                        b = self.below[b]
                    t = self._goto(self.state[b], name)
                    if t >= 0:
                        k = self._cell(t, b)
                        if k not in seen:
                            seen.add(k)
                            work.append(k)
            t = self._goto(s, token)
            if t >= 0:
                out.add(self._cell(t, c))
        if token == NEWLINE:  # may end a statement, else it is white space
            out |= cells
        return frozenset(out)

    def _advance(self, at: int, segment: str) -> int:
        cells = self.members[at]
        for token in segment:
            cells = self._step(cells, token)
            if not cells:
                return -1
        got = self.sets.get(cells)
        if got is None:
            got = self.sets[cells] = len(self.members)
            self.members.append(cells)
        return got

    def failed_at(self, segments: list[str]) -> int:
        """Index of the first token that no reading of the text admits; the
        number of tokens where the text ends too early; -1 if it is whole."""
        if len(self.memo) > MEMO or len(self.state) > MEMO:
            self._reset()
        at, memo, done = 0, self.memo, 0
        for segment in segments:
            key = (at, segment)
            to = memo.get(key)
            if to is None:
                to = memo[key] = self._advance(at, segment)
            if to < 0:
                cells = self.members[at]
                for i, token in enumerate(segment):
                    cells = self._step(cells, token)
                    if not cells:
                        return done + i
            at = to
            done += len(segment)
        key = (at, END)
        if key not in memo:
            memo[key] = 0 if self._step(self.members[at], END) else -1
        return -1 if memo[key] == 0 else done
