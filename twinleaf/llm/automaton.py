"""Secret scans by one combined deterministic automaton.

Rules are parsed into non-deterministic automata over bytes, joined, made deterministic
by subset construction and minimised by refining classes; transitions are one
flat array. A text's UTF-8 bytes pass once through the array for all rules
together; where a rule's mark lapses, the automaton of the reversed rule walks back
from there to the leftmost start. Matches of one kind don't overlap: a walk
back stops at the end of the match before.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import cache

#: Sets of bytes that rules name.
DIGIT, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = UPPER + LOWER + DIGIT


@dataclass(frozen=True)
class Set:
    """One byte of ``chars``."""

    chars: str


@dataclass(frozen=True)
class Seq:
    parts: tuple


@dataclass(frozen=True)
class Alt:
    parts: tuple


@dataclass(frozen=True)
class Rep:
    """``part`` from ``least`` times to ``most`` times (None: no limit)."""

    part: object
    least: int = 0
    most: int | None = None


def text(word: str, fold: bool = False) -> Seq:
    return Seq(tuple(Set(c.lower() + c.upper() if fold and c.isalpha() else c) for c in word))


def seq(*parts) -> Seq:
    return Seq(parts)


def reverse(node):
    match node:
        case Seq(parts):
            return Seq(tuple(reverse(p) for p in parts[::-1]))
        case Alt(parts):
            return Alt(tuple(reverse(p) for p in parts))
        case Rep(part, least, most):
            return Rep(reverse(part), least, most)
    return node


class _Nfa:
    def __init__(self):
        self.empty, self.on, self.marks = defaultdict(set), defaultdict(list), {}
        self.size = 0

    def state(self) -> int:
        self.size += 1
        return self.size - 1

    def add(self, node, start: int) -> int:
        """Wire ``node`` from ``start``; return where it ends."""
        match node:
            case Set(chars):
                end = self.state()
                self.on[start].append((frozenset(chars.encode("latin-1")), end))
                return end
            case Seq(parts):
                for p in parts:
                    start = self.add(p, start)
                return start
            case Alt(parts):
                ends = [self.add(p, start) for p in parts]
                end = self.state()
                for e in ends:
                    self.empty[e].add(end)
                return end
            case Rep(part, least, most):
                for _ in range(least):
                    start = self.add(part, start)
                if most is None:
                    loop = self.state()
                    self.empty[start].add(loop)
                    self.empty[self.add(part, loop)].add(loop)
                    return loop
                skips = [start]
                for _ in range(most - least):
                    start = self.add(part, start)
                    skips.append(start)
                end = self.state()
                for s in skips:
                    self.empty[s].add(end)
                return end
        raise TypeError(node)

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        return frozenset(seen)


@dataclass(frozen=True)
class Dfa:
    """``table[state << 8 | byte]`` is the next state; ``marks[state]`` the rules that end there, as bits.

    States from ``first_marked`` on have marks; state 0 is the start.
    """

    table: tuple[int, ...]
    marks: tuple[int, ...]
    first_marked: int


def compile_rules(rules: list, anywhere: bool) -> Dfa:
    """Subset construction, then minimisation. ``anywhere``: a match may start at any byte."""
    nfa = _Nfa()
    root = nfa.state()
    for bit, rule in enumerate(rules):
        start = nfa.state()
        nfa.empty[root].add(start)
        nfa.marks[nfa.add(rule, start)] = 1 << bit
    first = nfa.closure([root])
    ids, todo, rows = {first: 0}, [first], []
    for states in todo:
        to = [set(first) if anywhere else set() for _ in range(256)]
        for s in states:
            for chars, end in nfa.on[s]:
                for b in chars:
                    to[b].add(end)
        row, known = [], {}
        for targets in to:
            key = frozenset(targets)
            if key not in known:
                known[key] = nfa.closure(key)
            target = known[key]
            if target not in ids:
                ids[target] = len(ids)
                todo.append(target)
            row.append(ids[target])
        rows.append(row)
    marks = [sum({nfa.marks[s] for s in states if s in nfa.marks}) for states in todo]
    # Minimisation: split classes until all states of a class go to the same classes.
    cls, count = marks, len(set(marks))
    while True:
        seen: dict = {}
        cls = [seen.setdefault((c, tuple(cls[t] for t in row)), len(seen)) for c, row in zip(cls, rows)]
        if len(seen) == count:
            break
        count = len(seen)
    one = {c: i for i, c in reversed(list(enumerate(cls)))}
    order = sorted(one, key=lambda c: (marks[one[c]] > 0, c != cls[0], c))
    if marks[0]:
        raise ValueError("a rule matches the empty text")
    new = {c: i for i, c in enumerate(order)}
    return Dfa(tuple(new[cls[t]] for c in order for t in rows[one[c]]), tuple(marks[one[c]] for c in order), sum(marks[one[c]] == 0 for c in order))


_QUOTE, _SPACES = Rep(Set("\"'"), 0, 1), Rep(Set(" "))
_NAME = Alt((text("password", True), text("passwd", True), text("secret", True), text("token", True), seq(text("api", True), Rep(Set("_"), 0, 1), text("key", True))))
_HEAD = seq(_NAME, _QUOTE, _SPACES, Set(":="), _SPACES, _QUOTE)
_VALUE = WORD + "+/_.=-"

#: The kinds of secrets, their forms and least lengths (of the value alone for assign).
KINDS = ("assign", "access", "hex", "github", "slack", "jwt", "pem")
RULES = {
    "assign": seq(_HEAD, Rep(Set(_VALUE), 1)),
    "access": seq(text("AKIA"), Rep(Set(UPPER + DIGIT), 1)),
    "hex": Rep(Set(DIGIT + "abcdef"), 16),
    "github": seq(text("gh"), Set("pousr"), text("_"), Rep(Set(WORD), 1)),
    "slack": seq(text("xox"), Set("abprs"), text("-"), Rep(Set(WORD + "-"), 1)),
    "jwt": seq(text("eyJ"), Rep(Set(WORD + "_-"), 1), text(".eyJ"), Rep(Set(WORD + "_-"), 1), text("."), Rep(Set(WORD + "_-"), 1)),
    "pem": seq(text("-----BEGIN "), Rep(Set(UPPER + DIGIT + " ")), text("PRIVATE KEY-----")),
}
BASE = KINDS[:3]
LEAST = {"assign": 12, "access": 18, "hex": 16, "github": 40, "slack": 15, "jwt": 40, "pem": 0}


@cache
def automata() -> tuple[Dfa, dict[str, Dfa], Dfa]:
    """All rules forwards, each rule backwards, and assign's value's head forwards."""
    return compile_rules([RULES[k] for k in KINDS], True), {k: compile_rules([reverse(RULES[k])], False) for k in KINDS}, compile_rules([_HEAD], False)


def _back(dfa: Dfa, data: bytes, end: int, bound: int) -> int | None:
    """The leftmost start, not before ``bound``, of a match that ends at ``end``."""
    table, state, found = dfa.table, 0, None
    dead = _dead(dfa)
    for i in range(end - 1, bound - 1, -1):
        state = table[state << 8 | data[i]]
        if state == dead:
            break
        if state >= dfa.first_marked:
            found = i
    return found


@cache
def _dead(dfa: Dfa) -> int:
    n = len(dfa.marks)
    return next((s for s in range(n) if not dfa.marks[s] and all(t == s for t in dfa.table[s << 8:(s + 1) << 8])), -1)


def _head(data: bytes, start: int, end: int) -> int:
    """Where the value of an assign match begins."""
    dfa = automata()[2]
    state, at = 0, start
    for i in range(start, end):
        state = dfa.table[state << 8 | data[i]]
        if state >= dfa.first_marked:
            at = i + 1
        elif state == _dead(dfa):
            break
    return at


def scan_bytes(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, for each kind leftmost and without overlaps; too short ones are dropped."""
    every, backwards, _ = automata()
    table, marks, least = every.table, every.marks, every.first_marked
    state, before, ends = 0, 0, []
    for i, b in enumerate(data):
        state = table[state << 8 | b]
        if state >= least:
            m = marks[state]
            if before & ~m:
                ends.append((i, before & ~m))
            before = m
        elif before:
            ends.append((i, before))
            before = 0
    if before:
        ends.append((len(data), before))
    found, upto = [], dict.fromkeys(KINDS, 0)
    for end, bits in ends:
        for bit, kind in enumerate(KINDS):
            if bits >> bit & 1:
                start = _back(backwards[kind], data, end, upto[kind])
                if start is None:
                    continue
                upto[kind] = end
                if end - (_head(data, start, end) if kind == "assign" else start) < LEAST[kind]:
                    continue
                found.append((kind, start, end))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan_text(value: str | None) -> list[tuple[str, int, int]]:
    """As scan_bytes, in code points."""
    if not value:
        return []
    data = value.encode("utf-8", "surrogatepass")
    found = scan_bytes(data)
    if not found or len(data) == len(value):
        return found
    at = {0: 0}
    last, points = 0, 0
    for pos in sorted({p for _, s, e in found for p in (s, e)}):
        points += sum(b & 0xC0 != 0x80 for b in data[last:pos])
        last, at[pos] = pos, points
    return [(k, at[s], at[e]) for k, s, e in found]
