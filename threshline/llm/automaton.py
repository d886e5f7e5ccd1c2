"""Grammars compiled to one deterministic automaton: a table of states by classes of characters.

Every grammar is an entry into the same table; states that several grammars share exist once.  A text is read as codes of
character classes, one byte a code point, and each step is one look into the table, so reading never goes back.
"""

from __future__ import annotations

import numpy as np

#: Code points from here on are one class.
OTHER = 128
_EVERY = frozenset(range(OTHER + 1))
_NAMED = {"s": frozenset(map(ord, " \t\r\n\f\v")), "w": frozenset(c for c in range(OTHER) if chr(c).isalnum() or c == 95), "d": frozenset(range(48, 58)), "t": frozenset([9]), "n": frozenset([10]), "r": frozenset([13])}


class _Parser:
    """Reads a pattern (characters, [classes], (groups|alternatives), ? * + {m} {m,} {m,n}) into a graph with empty steps."""

    def __init__(self, pattern: str, automaton: Automaton):
        self.p, self.at, self.a = pattern, 0, automaton

    def alternatives(self, start: int) -> int:
        end = self.a.node()
        while True:
            self.a.empty[self.sequence(start)].append(end)
            if self.p[self.at : self.at + 1] != "|":
                return end
            self.at += 1

    def sequence(self, start: int) -> int:
        while self.at < len(self.p) and self.p[self.at] not in "|)":
            begin = self.at
            end, low, high = self.atom(start), 1, 1
            mark = self.p[self.at : self.at + 1]
            if mark and mark in "?*+{":
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(mark, (0, 0))
                self.at += 1
                if mark == "{":
                    close = self.p.index("}", self.at)
                    first, comma, last = self.p[self.at : close].partition(",")
                    low, high = int(first), int(last) if last else None if comma else int(first)
                    self.at = close + 1
                after, node = self.at, start
                for n in range(max(low, high or low, 1)):
                    self.at = begin
                    fresh = self.a.node()
                    self.a.empty[node].append(fresh)
                    end = self.atom(fresh)
                    last_start, node = fresh, end
                    if n == 0 and low == 0:
                        skip = [fresh]
                    elif n >= low:
                        skip.append(fresh)
                    else:
                        skip = []
                stop = self.a.node()
                self.a.empty[node].append(stop)
                for s in skip:
                    self.a.empty[s].append(stop)
                if high is None:
                    self.a.empty[node].append(last_start)
                end, self.at = stop, after
            start = end
        return start

    def atom(self, start: int) -> int:
        c = self.p[self.at]
        self.at += 1
        if c == "(":
            end = self.alternatives(start)
            self.at += 1
            return end
        end = self.a.node()
        self.a.step[start].append((self.charset() if c == "[" else self.one(c), end))
        return end

    def one(self, c: str) -> frozenset:
        if c == ".":
            return _EVERY
        if c != "\\":
            return frozenset([ord(c)])
        c = self.p[self.at]
        self.at += 1
        return _NAMED.get(c, frozenset([ord(c)]))

    def charset(self) -> frozenset:
        out: set[int] = set()
        negated = self.p[self.at] == "^"
        self.at += negated
        while self.p[self.at] != "]":
            c = self.p[self.at]
            self.at += 1
            if c != "\\" and self.p[self.at] == "-" and self.p[self.at + 1] != "]":
                out |= set(range(ord(c), ord(self.p[self.at + 1]) + 1))
                self.at += 2
            else:
                out |= self.one(c) if c == "\\" else {ord(c)}
        self.at += 1
        return _EVERY - out if negated else frozenset(out)


class Automaton:
    """``grammars``: name to pattern.  ``lex`` reads one of them from a place."""

    def __init__(self, grammars: dict[str, str]):
        self.step: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []
        begins, ends = {}, set()
        for name, pattern in grammars.items():
            begins[name] = self.node()
            ends.add(_Parser(pattern, self).alternatives(begins[name]))
        charsets = sorted({s for steps in self.step for s, _ in steps}, key=sorted)
        signature = [tuple(c in s for s in charsets) for c in range(OTHER + 1)]
        classes = {x: n for n, x in enumerate(sorted(set(signature)))}
        self.class_of = np.array([classes[x] for x in signature], np.uint8)
        sample = {n: signature.index(x) for x, n in classes.items()}
        self.table: list[list[int]] = []
        self.accepts: list[bool] = []
        known: dict[frozenset, int] = {}
        todo: list[frozenset] = []

        def state(nodes: set[int]) -> int:
            stack, seen = list(nodes), set(nodes)
            while stack:
                for n in self.empty[stack.pop()]:
                    if n not in seen:
                        seen.add(n)
                        stack.append(n)
            key = frozenset(n for n in seen if self.step[n] or n in ends)
            if key not in known:
                known[key] = len(self.table)
                self.table.append([-1] * len(classes))
                self.accepts.append(bool(key & ends))
                todo.append(key)
            return known[key]

        self.entries = {name: state({n}) for name, n in begins.items()}
        while todo:
            key = todo.pop()
            row = self.table[known[key]]
            for c, char in sample.items():
                following = {t for n in key for s, t in self.step[n] if char in s}
                if following:
                    row[c] = state(following)

    def node(self) -> int:
        self.step.append([])
        self.empty.append([])
        return len(self.step) - 1

    def codes(self, text: str) -> bytes:
        """The class of each code point."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.class_of[np.minimum(points, OTHER)].tobytes()

    def lex(self, codes: memoryview, at: int, name: str, shortest: bool = False) -> tuple[int, int]:
        """(end of the longest, or the shortest, word of the grammar from ``at``, else -1; how far was read)."""
        table, accepts, state, end = self.table, self.accepts, self.entries[name], -1
        if accepts[state]:
            end = at
        for c in codes[at:]:
            state = table[state][c]
            if state < 0:
                break
            at += 1
            if accepts[state]:
                end = at
                if shortest:
                    break
        return end, at
