"""Deterministic automata from regular expressions over bytes: subset construction, minimisation, transition arrays.

Expressions know literals, ``\\xHH`` and escaped characters, classes with ranges, groups, ``|``, ``?``, ``*``, ``+``,
``{n}`` and ``{n,}``. All rules are searched for at once, from every position of the input.
"""

from __future__ import annotations

import numpy as np


class _Parser:
    """Builds a nondeterministic automaton: for each state its empty moves and its (bytes, target) moves."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def rule(self, expression: str) -> tuple[int, int]:
        self.text, self.at = expression, 0
        found = self.alternatives()
        if self.at != len(expression):
            raise ValueError(f"{expression!r}: unexpected {expression[self.at]!r}")
        return found

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def alternatives(self) -> tuple[int, int]:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        start, end = self.state(), self.state()
        for a, b in parts:
            self.empty[start].append(a)
            self.empty[b].append(end)
        return start, end

    def sequence(self) -> tuple[int, int]:
        start = end = self.state()
        while self.peek() not in ("", "|", ")"):
            a, b = self.repeated()
            self.empty[end].append(a)
            end = b
        return start, end

    def repeated(self) -> tuple[int, int]:
        begin = self.at
        piece = self.atom()
        source = self.text[begin : self.at]
        sign = self.peek()
        if sign == "{":
            close = self.text.index("}", self.at)
            low, comma, _ = self.text[self.at + 1 : close].partition(",")
            self.at = after = close + 1
            # the piece is built anew for each time
            copies = [piece, *(self._again(source) for _ in range(int(low) - 1))]
            for (_, b), (a, _) in zip(copies, copies[1:], strict=False):
                self.empty[b].append(a)
            if comma:
                a, b = copies[-1]
                self.empty[b].append(a)
            self.at = after
            return copies[0][0], copies[-1][1]
        if sign in ("?", "*", "+"):
            self.at += 1
            start, end = self.state(), self.state()
            self.empty[start].append(piece[0])
            self.empty[piece[1]].append(end)
            if sign != "+":
                self.empty[start].append(end)
            if sign != "?":
                self.empty[piece[1]].append(piece[0])
            return start, end
        return piece

    def _again(self, source: str) -> tuple[int, int]:
        text, at = self.text, self.at
        self.text, self.at = source, 0
        found = self.atom()
        self.text, self.at = text, at
        return found

    def atom(self) -> tuple[int, int]:
        c = self.peek()
        if c == "(":
            self.at += 1
            found = self.alternatives()
            if self.peek() != ")":
                raise ValueError(f"{self.text!r}: a group isn't closed")
            self.at += 1
            return found
        members = self.members() if c == "[" else frozenset([self.character()])
        start, end = self.state(), self.state()
        self.moves[start].append((members, end))
        return start, end

    def character(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self.text[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def members(self) -> frozenset[int]:
        self.at += 1
        found: set[int] = set()
        while self.peek() != "]":
            low = high = self.character()
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                high = self.character()
            found |= set(range(low, high + 1))
        self.at += 1
        return frozenset(found)


def _either(numbers) -> int:
    out = 0
    for n in numbers:
        out |= n
    return out


def _members(states: int) -> list[int]:
    out = []
    while states:
        low = states & -states
        out.append(low.bit_length() - 1)
        states ^= low
    return out


class Automaton:
    """next[state, byte class] and, for each state, the rules that end there as bits; state 0 is the start."""

    def __init__(self, expressions: list[str]) -> None:
        parser = _Parser()
        ends = [parser.rule(e) for e in expressions]
        start = parser.state()
        parser.empty[start] += [a for a, _ in ends]
        final = {b: 1 << k for k, (_, b) in enumerate(ends)}

        closed: dict[int, frozenset[int]] = {}

        def closure(state: int) -> frozenset[int]:
            if state not in closed:
                seen, todo = {state}, [state]
                while todo:
                    for s in parser.empty[todo.pop()]:
                        if s not in seen:
                            seen.add(s)
                            todo.append(s)
                closed[state] = frozenset(s for s in seen if parser.moves[s] or s in final)
            return closed[state]

        # bytes that no move tells apart are one class
        signature = [tuple(byte in m for moves in parser.moves for m, _ in moves) for byte in range(256)]
        numbers = {s: k for k, s in enumerate(dict.fromkeys(signature))}
        self.classes = np.array([numbers[s] for s in signature], np.uint8)
        examples = [signature.index(s) for s in numbers]

        # sets of states as bits of a number
        bits = {s: sum(1 << t for t in closure(s)) for s in range(len(parser.moves))}
        step = {s: [_either(bits[t] for m, t in moves if e in m) for e in examples] for s, moves in enumerate(parser.moves) if moves}
        first = bits[start]
        index, rows, todo = {first: 0}, [], [first]
        while todo:
            following = []
            for states in todo:
                own = [step[s] for s in _members(states) if s in step]
                row = []
                for targets in zip(*own, strict=True):
                    target = first
                    for t in targets:
                        target |= t
                    if target not in index:
                        index[target] = len(index)
                        following.append(target)
                    row.append(index[target])
                rows.append(row)
            todo = following
        ended = [_either(b for s, b in final.items() if states >> s & 1) for states in index]
        self._minimise(np.array(rows), np.array(ended))

    def _minimise(self, rows: np.ndarray, ended: np.ndarray) -> None:
        """Merges states that no further input tells apart: refines a partition until it stands."""
        self.subsets = len(rows)
        _, part = np.unique(ended, return_inverse=True)
        while True:
            _, finer = np.unique(np.column_stack([part, part[rows]]), axis=0, return_inverse=True)
            if finer.max() == part.max():
                break
            part = finer.ravel()
        order = np.append(part[0], np.delete(np.arange(part.max() + 1), part[0]))
        rank = np.argsort(order)
        _, example = np.unique(part, return_index=True)
        example = example[order]
        self.next = rank[part[rows[example]]].astype(np.int32)
        self.ended = ended[example].astype(np.uint16)
        #: Bytes that lead to the start from everywhere: no match holds one.
        self.resets = (self.next == 0).all(axis=0)[self.classes]

    def scan_one(self, data: np.ndarray) -> int:
        """Bits of the rules that end anywhere in data, a byte at a time: for long data, which scan would read alone."""
        rows, ended = self.next.tolist(), self.ended.tolist()
        state = found = 0
        for c in self.classes[data].tobytes():
            state = rows[state][c]
            found |= ended[state]
        return found

    def scan(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Bits of the rules that end anywhere in data[start:end], for each of many segments; all are read at once."""
        order = np.argsort(start - end, kind="stable")
        at, left = start[order], (end - start)[order]
        width = self.next.shape[1]
        table, ended = (self.next * width).ravel(), self.ended
        classes = self.classes[data].astype(np.int32)
        state, found = np.zeros(len(at), np.int32), np.zeros(len(at), np.uint16)
        ends_at = np.repeat(ended, width)
        active = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), "left")
        for k, n in enumerate(active.tolist()):
            now = table[state[:n] + classes[at[:n] + k]]
            state[:n] = now
            found[:n] |= ends_at[now]
        out = np.zeros(len(at), np.uint16)
        out[order] = found
        return out
