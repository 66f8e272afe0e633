"""Regexes over bytes, compiled to one minimal deterministic automaton.

Supported: literals, classes with ranges and escapes, groups, alternation, ? * + {n} {n,} {n,m}, \\xHH. A rule becomes a
follow-position automaton (Glushkov); subset construction merges all rules; partition refinement minimises the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ALL = (1 << 256) - 1


class Syntax:
    """Recursive descent over a pattern; nodes are ('set', mask), ('cat', [..]), ('alt', [..]), ('rep', node, low, high)."""

    def __init__(self, pattern: str, any_case: bool = False) -> None:
        self.s, self.i, self.any_case = pattern, 0, any_case

    def parse(self):
        node = self.alternation()
        if self.i < len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i} of {self.s!r}")
        return node

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def take(self) -> str:
        if self.i >= len(self.s):
            raise ValueError(f"{self.s!r} ends early")
        self.i += 1
        return self.s[self.i - 1]

    def alternation(self):
        branches = [self.sequence()]
        while self.peek() == "|":
            self.take()
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else ("alt", branches)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, node):
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                a, _, b = self.s[self.i : self.s.index("}", self.i)].partition(",")
                low, high = int(a), (int(b) if b else None) if "," in self.s[self.i : self.s.index("}", self.i)] else int(a)
                self.i = self.s.index("}", self.i) + 1
            node = ("rep", node, low, high)
        return node

    def atom(self):
        c = self.take()
        if c == "(":
            node = self.alternation()
            if self.take() != ")":
                raise ValueError(f"open group in {self.s!r}")
            return node
        if c == "[":
            return ("set", self.char_class())
        if c == ".":
            return ("set", ALL & ~(1 << 10))
        return ("set", self.fold(1 << self.code(c)))

    def code(self, c: str) -> int:
        if c == "\\":
            c = self.take()
            if c == "x":
                return int(self.take() + self.take(), 16)
        if ord(c) > 127:
            raise ValueError("patterns are ASCII")
        return ord(c)

    def char_class(self) -> int:
        inverse, mask = self.peek() == "^", 0
        if inverse:
            self.take()
        while (c := self.take()) != "]":
            low = self.code(c)
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.take()
                high = self.code(self.take())
            else:
                high = low
            mask |= sum(1 << k for k in range(low, high + 1))
        mask = self.fold(mask)
        return ALL & ~mask if inverse else mask

    def fold(self, mask: int) -> int:
        if self.any_case:
            for k in range(65, 91):
                if mask >> k & 1 or mask >> k + 32 & 1:
                    mask |= 1 << k | 1 << k + 32
        return mask


def reverse(node):
    kind = node[0]
    if kind == "set":
        return node
    if kind == "rep":
        return ("rep", reverse(node[1]), node[2], node[3])
    return (kind, [reverse(x) for x in (reversed(node[1]) if kind == "cat" else node[1])])


class Positions:
    """Position sets of one or more rules: the bytes of each, what may follow it, which rule it ends."""

    def __init__(self) -> None:
        self.bytes: list[int] = []
        self.follow: list[set[int]] = []
        self.first: set[int] = set()
        self.ends: dict[int, int] = {}

    def add(self, node, rule: int) -> None:
        empty, first, last = self.walk(node)
        if empty:
            raise ValueError("a rule must not match nothing")
        self.first |= first
        for p in last:
            self.ends[p] = self.ends.get(p, 0) | 1 << rule

    def walk(self, node) -> tuple[bool, set[int], set[int]]:
        kind = node[0]
        if kind == "set":
            self.bytes.append(node[1])
            self.follow.append(set())
            p = {len(self.bytes) - 1}
            return False, p, p
        if kind == "alt":
            parts = [self.walk(x) for x in node[1]]
            return any(p[0] for p in parts), set().union(*(p[1] for p in parts)), set().union(*(p[2] for p in parts))
        if kind == "cat":
            return self.joined([self.walk(x) for x in node[1]])
        _, inner, low, high = node
        copies = [self.walk(inner) for _ in range(max(low, 1) if high is None else high)]
        if high is None:
            for p in copies[-1][2]:
                self.follow[p] |= copies[-1][1]
        return self.joined([(e or k >= low, f, x) for k, (e, f, x) in enumerate(copies)])

    def joined(self, parts) -> tuple[bool, set[int], set[int]]:
        empty, first, last = True, set(), set()
        for e, f, x in parts:
            for p in last:
                self.follow[p] |= f
            if empty:
                first = first | f
            last = (last if e else set()) | x
            empty = empty and e
        return empty, first, last


@dataclass(frozen=True)
class Automaton:
    """next[state * classes + cls[byte]]; accept: a bit for each rule; state 0 is the start. dead: the state that nothing leaves, or -1."""

    cls: np.ndarray
    next: np.ndarray
    accept: np.ndarray
    classes: int
    dead: int


def compile_rules(nodes: list, search: bool) -> Automaton:
    """search: the rules may begin at any byte; else all begin at the first."""
    at = Positions()
    for k, node in enumerate(nodes):
        at.add(node, k)
    kinds: dict[int, int] = {}
    cls = np.zeros(256, np.int64)
    for b in range(256):
        cls[b] = kinds.setdefault(sum(1 << p for p, m in enumerate(at.bytes) if m >> b & 1), len(kinds))
    reads = list(kinds)
    start = frozenset()
    states, rows, todo = {(start, True): 0}, [], [(start, True)]
    for state in todo:
        held, begins = state
        after = set().union(*(at.follow[p] for p in held)) if held else set()
        if begins or search:
            after |= at.first
        row = []
        for mask in reads:
            new = (frozenset(p for p in after if mask >> p & 1), search)
            if search and not new[0]:
                new = (start, True)  # nothing under way: as at the start
            if new not in states:
                states[new] = len(states)
                todo.append(new)
            row.append(states[new])
        rows.append(row)
    table = np.array(rows, np.int64)
    accept = np.array([np.bitwise_or.reduce([at.ends.get(p, 0) for p in s[0]]) if s[0] else 0 for s in states], np.int64)
    return minimised(table, accept, cls, len(reads))


def minimised(table: np.ndarray, accept: np.ndarray, cls: np.ndarray, classes: int) -> Automaton:
    """Partition refinement: states stay together while their blocks' rows agree."""
    _, block = np.unique(accept, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    # the start's block comes first
    order = np.concatenate([[block[0]], np.setdiff1d(np.unique(block), [block[0]])])
    name = np.empty(order.size, np.int64)
    name[order] = np.arange(order.size)
    block = name[block]
    some = np.zeros(order.size, np.int64)
    some[block] = np.arange(block.size)
    small, ends = block[table[some]], accept[some]
    dead = next((s for s in range(order.size) if not ends[s] and (small[s] == s).all()), -1)
    return Automaton(cls, small.reshape(-1), ends, classes, dead if dead else -1)


def lanes(auto: Automaton, data: np.ndarray, width: int = 1 << 15) -> np.ndarray:
    """The accept bits after each byte of data, as one run from the start state would give them.

    The bytes are cut into lanes that advance together, each from the start state. A lane whose left neighbour ended in another
    state is run again from there until it meets its earlier states; a search forgets fast, so few bytes are run twice.
    """
    n = data.size
    if not n:
        return np.zeros(0, np.int64)
    steps = -(-n // max(1, min(width, n // 64 + 1)))
    count = -(-n // steps)
    cells = np.zeros(count * steps, np.uint8)
    cells[:n] = data
    cells = auto.cls.astype(np.uint8)[cells].reshape(count, steps).T.copy()
    jump = (auto.next * auto.classes).astype(np.int32)
    seen, state = np.empty((steps, count), np.int32), np.zeros(count, np.int32)
    for t in range(steps):
        state = jump[state + cells[t]]
        seen[t] = state
    entry = np.concatenate([[0], seen[-1, :-1]])
    redo = np.flatnonzero(entry != 0)
    while redo.size:
        old, live, state = seen[-1, redo].copy(), redo, entry[redo].astype(np.int32)
        for t in range(steps):
            state = jump[state + cells[t, live]]
            apart = state != seen[t, live]
            seen[t, live] = state
            if not apart.all():
                live, state = live[apart], state[apart]
                if not live.size:
                    break
        changed = redo[seen[-1, redo] != old] + 1
        redo = changed[changed < count]
        entry[redo] = seen[-1, redo - 1]
    bits = auto.accept[seen.T.reshape(-1)[:n] // auto.classes]
    return bits


def longest(auto: Automaton, data: bytes, start: int) -> int:
    """The end of the longest match that begins at start; -1 if none."""
    state, end, cls, jump, accept, dead = 0, -1, auto.cls, auto.next, auto.accept, auto.dead
    for i in range(start, len(data)):
        state = jump[state * auto.classes + cls[data[i]]]
        if state == dead:
            break
        if accept[state]:
            end = i + 1
    return end
