"""Conditions of choice branches: ORs of ANDs over ``name op value``, simplified without changing their meaning.

A clause holds one constraint per variable: an interval (lo, hi], one value, or values left out. Containment and
union of constraints are closed, so a rule per kind of constraint covers duplicates, absorption, complements,
tighter bounds and adjoining ranges.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

ROUNDS = 64
_LITERAL = re.compile(r"\s*([A-Za-z_]\w*)\s*(<=|>=|==|!=|<|>)\s*([^\s()&|<>=!]+)\s*\Z")


class Unparsed(ValueError):
    """The text is not an OR of ANDs of comparisons."""


@dataclass(frozen=True)
class Range:
    """Numbers above lo, up to hi."""

    lo: float = -math.inf
    hi: float = math.inf

    def meet(self, other):
        if not isinstance(other, Range):
            return None
        return Range(max(self.lo, other.lo), min(self.hi, other.hi))

    def empty(self) -> bool:
        return self.lo >= self.hi

    def within(self, other) -> bool:
        return isinstance(other, Range) and other.lo <= self.lo and self.hi <= other.hi

    def join(self, other):
        if isinstance(other, Range) and max(self.lo, other.lo) <= min(self.hi, other.hi):
            return Range(min(self.lo, other.lo), max(self.hi, other.hi))
        return None

    def free(self) -> bool:
        return self.lo == -math.inf and self.hi == math.inf

    def literals(self, name: str) -> list[str]:
        return [f"{name} > {self.lo:.15g}"] * (self.lo > -math.inf) + [f"{name} <= {self.hi:.15g}"] * (self.hi < math.inf)


@dataclass(frozen=True)
class Values:
    """One value (inside) or every value but some (not inside)."""

    inside: bool
    of: frozenset[str]

    def meet(self, other):
        if not isinstance(other, Values):
            return None
        if self.inside and other.inside:
            return Values(True, self.of & other.of)
        if self.inside or other.inside:
            some, out = (self, other) if self.inside else (other, self)
            return Values(True, some.of - out.of)
        return Values(False, self.of | other.of)

    def empty(self) -> bool:
        return self.inside and not self.of

    def within(self, other) -> bool:
        if not isinstance(other, Values):
            return False
        if self.inside:
            return self.of <= other.of if other.inside else not self.of & other.of
        return not other.inside and other.of <= self.of

    def join(self, other):
        """The union, where one constraint can say it; true and false make up every boolean."""
        if not isinstance(other, Values):
            return None
        if self.inside and other.inside:
            both = self.of | other.of
            return Values(False, frozenset()) if both == {"true", "false"} else Values(True, both) if len(both) == 1 else None
        if self.inside or other.inside:
            some, out = (self, other) if self.inside else (other, self)
            return Values(False, out.of - some.of)
        return Values(False, self.of & other.of)

    def free(self) -> bool:
        return not self.inside and not self.of

    def literals(self, name: str) -> list[str]:
        return [f"{name} {'==' if self.inside else '!='} {v}" for v in sorted(self.of)]


Clause = dict  # variable -> Range | Values


def _constraint(op: str, text: str) -> Range | Values:
    if op in ("==", "!="):
        if text in ("true", "false") and op == "!=":
            return Values(True, frozenset({"false" if text == "true" else "true"}))
        return Values(op == "==", frozenset({text}))
    try:
        x = float(text)
    except ValueError:
        raise Unparsed(text) from None
    if op in ("<", ">="):
        if x != int(x):
            raise Unparsed(text)  # only whole numbers have a next lower one
        x -= 1
    return Range(hi=x) if op in ("<=", "<") else Range(lo=x)


def _split(text: str, by: str) -> list[str]:
    parts, depth, start, i = [], 0, 0, 0
    while i < len(text):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth < 0:
            raise Unparsed(text)
        if not depth and text.startswith(by, i):
            parts.append(text[start:i])
            i = start = i + len(by)
            continue
        i += 1
    if depth:
        raise Unparsed(text)
    return [*parts, text[start:]]


def parse(text: str) -> list[Clause]:
    """The clauses that can hold; [] is false and [{}] true."""
    out = []
    for part in _split(text, "||"):
        part = part.strip()
        while part.startswith("(") and part.endswith(")"):
            part = part[1:-1].strip()
        clause: Clause | None = {}
        for item in _split(part, "&&"):
            item = item.strip()
            if item in ("true", "false"):
                clause = clause if item == "true" else None
            else:
                m = _LITERAL.match(item)
                if not m:
                    raise Unparsed(item)
                clause = None if clause is None else conjoin(clause, m[1], _constraint(m[2], m[3]))
            if clause is None:
                break
        if clause is not None:
            out.append(clause)
    return out


def conjoin(clause: Clause, name: str, c: Range | Values) -> Clause | None:
    """The clause with one more constraint; None if nothing meets it."""
    if name in clause:
        c = clause[name].meet(c)
        if c is None:
            raise Unparsed(f"{name} is compared both as a number and as a value")
    return None if c.empty() else {**clause, name: c}


def _implies(a: Clause, b: Clause) -> bool:
    return all(name in a and a[name].within(c) for name, c in b.items())


def _merged(a: Clause, b: Clause) -> Clause | None:
    """One clause for both if they differ in one variable and its constraints join."""
    differ = [n for n in a if a[n] != b.get(n)]
    if a.keys() != b.keys() or len(differ) != 1:
        return None
    name = differ[0]
    c = a[name].join(b[name])
    if c is None:
        return None
    out = {n: k for n, k in a.items() if n != name}
    return out if c.free() else out | {name: c}


def _key(c: Clause) -> str:
    return text_of([c])


def simplify(clauses: list[Clause]) -> list[Clause]:
    now = clauses
    for _ in range(ROUNDS):
        kept: list[Clause] = []
        for n, c in enumerate(now):
            weaker = (o for m, o in enumerate(now) if m != n and _implies(c, o) and (not _implies(o, c) or m < n))
            if next(weaker, None) is None:
                kept.append(c)
        for i in range(len(kept)):
            pair = next(((j, m) for j in range(i + 1, len(kept)) if (m := _merged(kept[i], kept[j])) is not None), None)
            if pair:
                kept = [c for n, c in enumerate(kept) if n not in (i, pair[0])] + [pair[1]]
                break
        if kept == now:
            break
        now = kept
    return sorted(now, key=_key)


def text_of(clauses: list[Clause]) -> str:
    if not clauses:
        return "false"
    if any(not c for c in clauses):
        return "true"
    parts = [[lit for name in sorted(c) for lit in c[name].literals(name)] for c in clauses]
    return " || ".join(f"({' && '.join(p)})" if len(p) > 1 and len(parts) > 1 else " && ".join(p) for p in parts)


def minimize(text: str) -> str:
    """The shortest form the rules reach; a text that is no such condition comes back as it is."""
    if not text:
        return text
    try:
        return text_of(simplify(parse(text)))
    except Unparsed:
        return text


def holds(text: str, values: dict[str, object]) -> bool:
    """Whether a condition holds; a variable without a value meets nothing, not even !=."""

    def one(name: str, c: Range | Values) -> bool:
        v = values.get(name)
        if v is None:
            return False
        if isinstance(c, Range):
            return c.lo < float(v) <= c.hi
        shown = str(v).lower() if isinstance(v, bool) else str(v)
        return (shown in c.of) == c.inside

    return any(all(one(n, c) for n, c in clause.items()) for clause in parse(text))
