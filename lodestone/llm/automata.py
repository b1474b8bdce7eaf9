"""Finite automata over bytes: a regex subset to NFA, subset construction, minimisation, transition arrays."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

_parser, _c = re._parser, re._constants
CLASSES = {_c.CATEGORY_DIGIT: "0123456789", _c.CATEGORY_SPACE: " \t\n\r\f\v", _c.CATEGORY_WORD: "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"}


class Nfa:
    """Thompson's construction. A state has moves (byte set, target) and empty moves."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, pattern: str, backwards: bool = False) -> tuple[int, int]:
        """The start and end states of a pattern (or of its reversal)."""
        fold = re.compile(pattern).flags & re.IGNORECASE
        start = self.state()
        return start, self._sequence(list(_parser.parse(pattern)), start, backwards, bool(fold))

    def _sequence(self, items: list, at: int, backwards: bool, fold: bool) -> int:
        for op, arg in reversed(items) if backwards else items:
            at = self._one(op, arg, at, backwards, fold)
        return at

    def _step(self, at: int, symbols: Iterable[int], fold: bool) -> int:
        found = set(symbols)
        if fold:
            found |= {ord(chr(x).swapcase()) for x in found if x < 128}
        to = self.state()
        self.moves[at].append((frozenset(found), to))
        return to

    def _one(self, op, arg, at: int, backwards: bool, fold: bool) -> int:
        if op is _c.LITERAL:
            data = chr(arg).encode()
            for b in reversed(data) if backwards else data:
                at = self._step(at, [b], fold)
            return at
        if op is _c.IN:
            return self._step(at, self._class(arg), fold)
        if op is _c.ANY:
            return self._step(at, set(range(256)) - {10}, False)
        if op is _c.SUBPATTERN:
            return self._sequence(list(arg[3]), at, backwards, fold or bool(arg[1] & re.IGNORECASE))
        if op is _c.BRANCH:
            to = self.state()
            for branch in arg[1]:
                begin = self.state()
                self.empty[at].append(begin)
                self.empty[self._sequence(list(branch), begin, backwards, fold)].append(to)
            return to
        if op is _c.MAX_REPEAT:
            least, most, body = arg
            for _ in range(least):
                at = self._sequence(list(body), at, backwards, fold)
            if most is _c.MAXREPEAT:
                loop = self.state()
                self.empty[at].append(loop)
                self.empty[self._sequence(list(body), loop, backwards, fold)].append(loop)
                return loop
            to = self.state()
            self.empty[at].append(to)
            for _ in range(most - least):
                at = self._sequence(list(body), at, backwards, fold)
                self.empty[at].append(to)
            return to
        raise ValueError(f"the rule language has no {op}")

    @staticmethod
    def _class(items: list) -> set[int]:
        found: set[int] = set()
        for op, arg in items:
            if op is _c.LITERAL:
                found.add(arg)
            elif op is _c.RANGE:
                found |= set(range(arg[0], arg[1] + 1))
            elif op is _c.CATEGORY:
                found |= set(map(ord, CLASSES[arg]))
        return set(range(256)) - found if items[0][0] is _c.NEGATE else found


class Dfa:
    """A minimal deterministic automaton: next[state][byte] and, for each state, a bit set of the rules that it accepts. State 0 is the start."""

    def __init__(self, patterns: list[str], *, anchored: bool, backwards: bool = False):
        nfa = Nfa()
        start, ends = nfa.state(), {}
        for k, pattern in enumerate(patterns):
            begin, end = nfa.add(pattern, backwards)
            nfa.empty[start].append(begin)
            ends[end] = ends.get(end, 0) | 1 << k
        of, shown = self._byte_classes(nfa)
        table, accepts = self._subsets(nfa, start, ends, shown, anchored)
        table, self.accepts = self._minimal(table, accepts)
        self.next = table[:, of].astype(np.int32)
        self.dead = next((s for s in range(len(table)) if not self.accepts[s] and (table[s] == s).all()), None)

    @staticmethod
    def _byte_classes(nfa: Nfa) -> tuple[np.ndarray, list[int]]:
        """The class of each byte, and one byte of each class; bytes of a class are in the same byte sets."""
        sets = list({x for moves in nfa.moves for x, _ in moves})
        kinds: dict[tuple, int] = {}
        of, shown = np.zeros(256, np.int64), []
        for b in range(256):
            key = tuple(b in x for x in sets)
            if key not in kinds:
                kinds[key] = len(kinds)
                shown.append(b)
            of[b] = kinds[key]
        return of, shown

    @staticmethod
    def _subsets(nfa: Nfa, start: int, ends: dict[int, int], shown: list[int], anchored: bool):
        def closed(states: Iterable[int]) -> frozenset:
            found, todo = set(), list(states)
            while todo:
                if (s := todo.pop()) not in found:
                    found.add(s)
                    todo += nfa.empty[s]
            return frozenset(s for s in found if nfa.moves[s] or s in ends)

        # for each state and byte class, the states that are reached, as bits of a number
        reach = [[sum(1 << x for x in closed({t for symbols, t in moves if b in symbols})) for b in shown] for moves in nfa.moves]
        first = sum(1 << x for x in closed([start]))
        again = 0 if anchored else first  # unanchored: a match may begin at any byte
        number, table, todo = {first: 0}, [], [first]
        for here in todo:
            own, bits = [], here
            while bits:
                low = bits & -bits
                own.append(reach[low.bit_length() - 1])
                bits ^= low
            row = []
            for k in range(len(shown)):
                to = again
                for r in own:
                    to |= r[k]
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            table.append(row)
        accepts = [sum(ends[s] for s in ends if states >> s & 1) for states in todo]
        return np.array(table, np.int64), np.array(accepts, np.int64)

    @staticmethod
    def _minimal(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Moore's partition refinement; the start state stays number 0."""
        part = np.unique(accepts, return_inverse=True)[1].ravel()
        while True:
            finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == part.max():
                break
            part = finer
        order = np.concatenate([[part[0]], np.setdiff1d(np.arange(part.max() + 1), part[0])])
        rank = np.argsort(order)
        part = rank[part]
        shown = np.array([np.flatnonzero(part == k)[0] for k in range(part.max() + 1)])
        return part[table[shown]], accepts[shown]

    def linked(self) -> list:
        """Rows that hold the next rows themselves; entry 256 is the state's bit set. One list access moves on."""
        rows: list[list] = [[None] * 257 for _ in self.next]
        for s, row in enumerate(rows):
            row[:256] = [rows[t] for t in self.next[s]]
            row[256] = int(self.accepts[s])
        return rows
