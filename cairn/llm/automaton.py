"""Regular expressions over bytes to one minimal deterministic automaton.

Rules are parsed, turned into a position automaton, determinised together by subset construction and
minimised by partition refinement. The result is three arrays: the class of each byte, the next state
of each (state, class), and the bits of the rules that a state accepts. One pass over the bytes runs
every rule at once.
"""

from __future__ import annotations

import re._constants as sc
import re._parser as sp
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np

#: The bytes of tokens; TOKEN_SET is the same for regular expressions.
TOKEN_SET = r"0-9A-Za-z_.~+/-"
TOKEN_BYTES = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz.~+/-")
WORD_BYTES = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")
CATEGORIES = {
    sc.CATEGORY_DIGIT: frozenset(b"0123456789"),
    sc.CATEGORY_WORD: WORD_BYTES,
    sc.CATEGORY_SPACE: frozenset(b" \t\n\r\f\v"),
}
CATEGORIES |= {sc.CATEGORY_NOT_DIGIT: frozenset(range(256)) - CATEGORIES[sc.CATEGORY_DIGIT], sc.CATEGORY_NOT_WORD: frozenset(range(256)) - WORD_BYTES, sc.CATEGORY_NOT_SPACE: frozenset(range(256)) - CATEGORIES[sc.CATEGORY_SPACE]}


class Nfa:
    """Thompson construction: byte edges and empty edges."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def new(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def build(self, items: Iterable, start: int, fold: bool) -> int:
        for op, arg in items:
            start = self.one(op, arg, start, fold)
        return start

    def one(self, op, arg, start: int, fold: bool) -> int:
        if op in (sc.LITERAL, sc.NOT_LITERAL, sc.IN, sc.ANY):
            end = self.new()
            self.edges[start].append((byte_set(op, arg, fold), end))
            return end
        if op is sc.SUBPATTERN:
            _, add, drop, inner = arg
            return self.build(inner, start, (fold or bool(add & sc.SRE_FLAG_IGNORECASE)) and not drop & sc.SRE_FLAG_IGNORECASE)
        if op is sc.BRANCH:
            end = self.new()
            for branch in arg[1]:
                begin = self.new()
                self.empty[start].append(begin)
                self.empty[self.build(branch, begin, fold)].append(end)
            return end
        if op in (sc.MAX_REPEAT, sc.MIN_REPEAT):
            least, most, inner = arg
            for _ in range(least):
                start = self.build(inner, start, fold)
            if most is sc.MAXREPEAT:
                loop, end = self.new(), self.new()
                self.empty[start] += [loop, end]
                self.empty[self.build(inner, loop, fold)] += [loop, end]
                return end
            end = self.new()
            self.empty[start].append(end)
            for _ in range(most - least):
                start = self.build(inner, start, fold)
                self.empty[start].append(end)
            return end
        raise ValueError(f"{op} is not supported in a scanned rule")

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def byte_set(op, arg, fold: bool) -> frozenset[int]:
    if op is sc.LITERAL:
        out = {arg}
    elif op is sc.ANY:
        return frozenset(range(256)) - {10}
    elif op is sc.NOT_LITERAL:
        return frozenset(range(256)) - byte_set(sc.LITERAL, arg, fold)
    else:
        out, negate = set(), False
        for kind, x in arg:
            if kind is sc.NEGATE:
                negate = True
            elif kind is sc.LITERAL:
                out.add(x)
            elif kind is sc.RANGE:
                out.update(range(x[0], x[1] + 1))
            else:
                out |= CATEGORIES[x]
        if fold:
            out |= {ord(chr(b).swapcase()) for b in out if b < 128}
        return frozenset(range(256)) - out if negate else frozenset(out)
    return frozenset(out | {ord(chr(b).swapcase()) for b in out if b < 128}) if fold else frozenset(out)


def parsed(pattern: str) -> tuple[list, bool, bool]:
    """(items, fold, word edge after)."""
    tree = sp.parse(pattern.encode())
    items = list(tree)
    after = bool(items) and items[-1] == (sc.AT, sc.AT_BOUNDARY)
    return items[: len(items) - after], bool(tree.state.flags & sc.SRE_FLAG_IGNORECASE), after


def mirrored(items: list) -> list:
    """The items of the reversed language."""
    out = []
    for op, arg in reversed(items):
        if op is sc.SUBPATTERN:
            arg = (*arg[:3], mirrored(list(arg[3])))
        elif op is sc.BRANCH:
            arg = (arg[0], [mirrored(list(b)) for b in arg[1]])
        elif op in (sc.MAX_REPEAT, sc.MIN_REPEAT):
            arg = (arg[0], arg[1], mirrored(list(arg[2])))
        out.append((op, arg))
    return out


def counted(op, arg) -> bool:
    """Whether an item holds a repeat beyond 4, or without bound."""
    if op in (sc.MAX_REPEAT, sc.MIN_REPEAT):
        return arg[1] is sc.MAXREPEAT or arg[1] > 4 or any(counted(*x) for x in arg[2])
    if op is sc.SUBPATTERN:
        return any(counted(*x) for x in arg[3])
    return op is sc.BRANCH and any(counted(*x) for b in arg[1] for x in b)


def head(items: list) -> list:
    """The items before the first long repeat that isn't the first item: what every match begins with.

    Long runs can hold further starts of rules, each with a count of its own, and the subsets of counts would be
    exponentially many. So the scan looks for heads, and the exact rule goes on from the starts of these.
    """
    out = []
    for k, (op, arg) in enumerate(items):
        if k and counted(op, arg):
            break
        out.append((op, arg))
    while out and out[-1][0] in (sc.MAX_REPEAT, sc.MIN_REPEAT) and not out[-1][1][0]:
        out.pop()
    return out


@dataclass
class Dfa:
    classes: np.ndarray  # of each byte, uint8
    table: np.ndarray  # next state of [state, class], int32
    accepts: np.ndarray  # rule bits of each state, int64
    start: int
    dead: int  # a state that is never left and accepts nothing, -1 if there is none
    resets: np.ndarray  # bytes that lead from every state to the start state


def determinise(nfa: Nfa, starts: frozenset[int], accepting: dict[int, int], search: bool) -> Dfa:
    """Subset construction. search: matches may start anywhere."""
    order = list({s for out in nfa.edges for s, _ in out})
    groups: dict[tuple, list[int]] = {}
    for b in range(256):
        groups.setdefault(tuple(b in s for s in order), []).append(b)
    classes = np.zeros(256, dtype=np.uint8)
    members = list(groups.values())
    for k, bytes_ in enumerate(members):
        classes[bytes_] = k
    first = nfa.closure(starts)
    ids, todo, rows = {first: 0}, [first], []
    while todo:
        state = todo.pop(0)
        edges = [e for s in state for e in nfa.edges[s]]
        row = []
        for bytes_ in members:
            b = bytes_[0]
            to = nfa.closure([t for on, t in edges if b in on])
            if search:
                to |= first
            if to not in ids:
                ids[to] = len(ids)
                todo.append(to)
            row.append(ids[to])
        rows.append(row)
    table = np.array(rows, dtype=np.int32)
    accepts = np.array([sum({accepting[s] for s in state if s in accepting}) for state in ids], dtype=np.int64)
    return minimised(classes, table, accepts)


def minimised(classes: np.ndarray, table: np.ndarray, accepts: np.ndarray) -> Dfa:
    """Partition refinement: states stay together while they accept alike and lead to the same parts."""
    _, part = np.unique(accepts, return_inverse=True)
    while True:
        _, now = np.unique(np.concatenate([part[:, None], part[table]], axis=1), axis=0, return_inverse=True)
        if now.max() == part.max():
            break
        part = now
    part = now
    n = int(part.max()) + 1
    leader = np.zeros(n, dtype=np.int64)
    leader[part[::-1]] = np.arange(len(part))[::-1]
    small = part[table[leader]].astype(np.int32)
    start = int(part[0])
    resets = np.array([b for b in range(256) if (small[:, classes[b]] == start).all()], dtype=np.uint8)
    dead = next((s for s in range(n) if (small[s] == s).all() and not accepts[leader[s]]), -1)
    return Dfa(classes, small, accepts[leader], start, dead, resets)


def combined(patterns: list[str]) -> Dfa:
    """The heads of all rules in one automaton that finds their ends, wherever they start; rule i has bit 1 << i."""
    nfa, starts, accepting = Nfa(), set(), {}
    for i, p in enumerate(patterns):
        items, fold, _ = parsed(p)
        items = head(items)
        if items and items[0][0] in (sc.MAX_REPEAT, sc.MIN_REPEAT):
            # As heads start anywhere, the least count has the same ends.
            items[0] = (items[0][0], (items[0][1][0], items[0][1][0], items[0][1][2]))
        start = nfa.new()
        end = nfa.build(items, start, fold)
        if end in nfa.closure([start]):
            raise ValueError(f"{p!r} has a head that matches the empty text")
        starts.add(start)
        accepting[end] = 1 << i
    return determinise(nfa, frozenset(starts), accepting, search=True)


def anchored(items: list, fold: bool) -> Dfa:
    nfa = Nfa()
    start = nfa.new()
    end = nfa.build(items, start, fold)
    return determinise(nfa, frozenset([start]), {end: 1}, search=False)


def forwards(pattern: str) -> Dfa:
    """The automaton of the rule, anchored: run from a match's start, it accepts at every end."""
    items, fold, _ = parsed(pattern)
    return anchored(items, fold)


def backwards(pattern: str) -> Dfa:
    """The automaton of the rule's reversed head, anchored: run from a head's end, it accepts at every start."""
    items, fold, _ = parsed(pattern)
    return anchored(mirrored(head(items)), fold)


def scan(dfa: Dfa, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position after the head, rule bits) for every end of a head within the texts buf[start:end].

    Texts are cut at bytes that reset the automaton, which changes nothing, and all pieces advance one
    byte at a time together; the longest come first, so that those still running are a prefix.
    """
    cls = dfa.classes[buf]
    width = dfa.table.shape[1]
    flat = (dfa.table * width).ravel()
    hot = np.repeat(dfa.accepts != 0, width)
    cut = np.zeros(256, dtype=bool)
    cut[dfa.resets] = True
    stops = np.flatnonzero(cut[buf])
    marks = np.concatenate([starts, ends, stops, stops + 1])
    marks = np.unique(marks)
    lo, hi = marks[:-1], marks[1:]
    # Only pieces inside a text; a reset byte alone is a piece that can't match.
    owner = np.searchsorted(starts, lo, side="right") - 1
    inside = (owner >= 0) & (hi <= ends[np.maximum(owner, 0)])
    inside &= ~((hi - lo == 1) & cut[buf[np.minimum(lo, len(buf) - 1)]])
    lo, size = lo[inside], (hi - lo)[inside]
    order = np.argsort(-size, kind="stable")
    lo, size = lo[order], size[order]
    if not len(lo):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    running = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")
    state = np.full(len(lo), dfa.start * width, dtype=np.int32)
    at: list[np.ndarray] = []
    bits: list[np.ndarray] = []
    for j, n in enumerate(running):
        if n <= FEW_PIECES:  # the rest of some long pieces: byte by byte costs less than array by array
            for k in range(n):
                where, what = _rest(dfa, cls[lo[k] + j : lo[k] + size[k]], int(state[k]) // width)
                at.append(where + lo[k] + j)
                bits.append(what)
            break
        s = flat[state[:n] + cls[lo[:n] + j]]
        state[:n] = s
        hit = hot[s]
        if hit.any():
            k = np.flatnonzero(hit)
            at.append(lo[k] + (j + 1))
            bits.append(dfa.accepts[s[k] // width])
    if not at:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    where, what = np.concatenate(at), np.concatenate(bits)
    order = np.argsort(where, kind="stable")
    return where[order], what[order]


FEW_PIECES = 16


def _rest(dfa: Dfa, classes: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes read, rule bits) at each accepting state of one piece."""
    rows = dfa.table.tolist()
    hot = [bool(x) for x in dfa.accepts]
    row, where, states = rows[state], [], []
    for i, c in enumerate(classes.tobytes(), 1):
        state = row[c]
        row = rows[state]
        if hot[state]:
            where.append(i)
            states.append(state)
    return np.array(where, dtype=np.int64), dfa.accepts[np.array(states, dtype=np.int64)]


def match_starts(dfa: Dfa, text: bytes, end: int) -> list[int]:
    """Starts of what ends at `end`, by a reversed automaton; nearest first."""
    state, out = dfa.start, []
    for i in range(end - 1, -1, -1):
        state = int(dfa.table[state, dfa.classes[text[i]]])
        if state == dfa.dead:
            break
        if dfa.accepts[state]:
            out.append(i)
    return out


def longest_ends(dfa: Dfa, text: bytes, starts: list[int], good: Callable[[int], bool]) -> dict[int, int]:
    """The last good end of the matches from each of the sorted starts that has one.

    One pass: starts whose runs are in the same state have the same future, which is followed once, for the leftmost. So the
    cost is the text's length times the few states that are alive together, however many starts there are.
    """
    classes, rows, accepts, dead = dfa.classes.tolist(), dfa.table.tolist(), dfa.accepts.tolist(), dfa.dead
    ends: dict[int, int] = {}
    joined: list[tuple[int, int, int]] = []  # (start, the one that goes on for it, from where)
    live: dict[int, int] = {}  # state: start
    k, i, n = 0, 0, len(text)
    while k < len(starts) or live:
        if not live:
            i = starts[k]
        while k < len(starts) and starts[k] == i:
            if (other := live.setdefault(dfa.start, i)) != i:
                joined.append((i, other, i))
            k += 1
        if i >= n:
            break
        c = classes[text[i]]
        i += 1
        # In order of their starts, as each new one is later than all.
        after: dict[int, int] = {}
        for state, start in live.items():
            state = rows[state][c]
            if state == dead:
                continue
            if state not in after:
                after[state] = start
                if accepts[state] and good(i):
                    ends[start] = i
            else:
                joined.append((start, after[state], i))
        live = after
    for start, other, at in reversed(joined):
        if ends.get(other, -1) >= at:
            ends[start] = ends[other]
    return ends
