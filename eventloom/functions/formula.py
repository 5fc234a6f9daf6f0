"""The formula language: text to syntax tree to a Spark column over per-case aggregates.

    expr    := or [ 'where' or ]
    or      := and { 'or' and }          and := not { 'and' not }        not := 'not' not | cmp
    cmp     := sum [ ('=='|'!='|'>='|'<='|'>'|'<') sum ]
    sum     := product { ('+'|'-') product }     product := unary { ('*'|'/') unary }
    unary   := '-' unary | number | string | name '(' [ expr { ',' expr } ] ')' | '(' expr ')'

Null spreads through every operator, ``and`` and ``or`` included; a quotient that is not finite is null.
User text never reaches Spark's own parser.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Functions with the number of their string arguments.
FUNCTIONS = {"duration": 0, "contains": 1, "count": 1, "time_between": 2, "timestamp": 1, "attr": 1}
TIME_FUNCTIONS = frozenset(["duration", "time_between", "timestamp"])
_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?|\.\d+)|(\"[^\"]*\"|'[^']*')|([A-Za-z_]\w*)|(==|!=|>=|<=|[-+*/()<>,])|(\S))")


class FormulaError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    kind: str  # num str call neg bin cmp logic not where
    value: object = None
    args: tuple["Node", ...] = ()


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        num, string, name, op, bad = m.groups()
        if bad:
            raise FormulaError("unclosed string" if bad in "\"'" else "use == to compare" if bad == "=" else f"unexpected character {bad!r}")
        if num and m.end() < len(text) and (text[m.end()].isalpha() or text[m.end()] == "."):
            raise FormulaError(f"bad number near {text[m.start(1):m.end() + 1]!r}")
        out.append(("num", num) if num else ("str", string[1:-1]) if string else ("name", name) if name else ("op", op))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise FormulaError(f"expected {value!r}")

    def expr(self) -> Node:
        left = self.chain("or", lambda: self.chain("and", self.negated))
        return Node("where", None, (left, self.chain("or", lambda: self.chain("and", self.negated)))) if self.take("where") else left

    def chain(self, word: str, below) -> Node:
        left = below()
        while self.take(word):
            left = Node("logic", word, (left, below()))
        return left

    def negated(self) -> Node:
        return Node("not", None, (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        left = self.binary(("+", "-"), lambda: self.binary(("*", "/"), self.unary))
        if op := self.take("==", "!=", ">=", "<=", ">", "<"):
            left = Node("cmp", op, (left, self.binary(("+", "-"), lambda: self.binary(("*", "/"), self.unary))))
            if self.peek("==", "!=", ">=", "<=", ">", "<"):
                raise FormulaError("comparisons cannot be chained")
        return left

    def binary(self, ops: tuple[str, str], below) -> Node:
        left = below()
        while op := self.take(*ops):
            left = Node("bin", op, (left, below()))
        return left

    def unary(self) -> Node:
        if self.take("-"):
            return Node("neg", None, (self.unary(),))
        if self.take("("):
            inner = self.expr()
            self.need(")")
            return inner
        if self.at == len(self.tokens):
            raise FormulaError("unexpected end")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return Node("num", float(value))
        if kind == "str":
            return Node("str", value)
        if kind != "name" or value in ("and", "or", "not", "where"):
            raise FormulaError(f"unexpected {value!r}")
        self.need("(")
        args: list[Node] = []
        while not self.take(")"):
            if args:
                self.need(",")
            args.append(self.expr())
        if value not in FUNCTIONS:
            raise FormulaError(f"unknown function {value!r}")
        if len(args) != FUNCTIONS[value]:
            raise FormulaError(f"{value} takes {FUNCTIONS[value]} arguments")
        if any(a.kind != "str" for a in args):
            raise FormulaError(f"{value} takes text in quotes")
        return Node("call", value, tuple(args))


def _check(node: Node, parent: Node | None = None) -> None:
    if node.kind == "str" and not (parent and (parent.kind == "call" or parent.kind == "cmp" and parent.value in ("==", "!=") and any(a.kind == "call" and a.value == "attr" for a in parent.args))):
        raise FormulaError("text stands where a number is needed")
    for a in node.args:
        _check(a, node)


def parse(text: str) -> Node:
    p = _Parser(text)
    if not p.tokens:
        raise FormulaError("empty formula")
    node = p.expr()
    if p.at < len(p.tokens):
        raise FormulaError(f"unexpected {p.tokens[p.at][1]!r}")
    _check(node)
    return node


def calls(node: Node) -> set[tuple]:
    found = {(node.value, *(a.value for a in node.args))} if node.kind == "call" else set()
    return found.union(*(calls(a) for a in node.args)) if node.args else found


def referenced(node: Node) -> tuple[list[str], list[str]]:
    """The activities and the attributes that a formula names, each sorted."""
    found = calls(node)
    acts = {a for name, *args in found if name != "attr" for a in args}
    return sorted(acts), sorted({args[0] for name, *args in found if name == "attr"})


def unknown_names(node: Node, activities, attributes) -> list[str]:
    """What a formula names and a log does not have: a likely slip, not an error, as such a count is 0."""
    acts, attrs = referenced(node)
    return [a for a in acts if a not in set(activities)] + [f"attr:{a}" for a in attrs if a not in set(attributes)]


def result_type(node: Node) -> str:
    """percent, time or count."""
    if node.kind == "where":
        return result_type(node.args[0])
    if node.kind in ("cmp", "logic", "not") or node.kind == "call" and node.value == "contains":
        return "percent"
    return "time" if any(c[0] in TIME_FUNCTIONS for c in calls(node)) else "count"


def compile_node(node: Node, call, numeric: frozenset[str]) -> Column:
    """A double column; call(name, *args) gives the column of a function."""
    go = lambda n: compile_node(n, call, numeric)
    null = F.lit(None).cast("double")
    if node.kind == "num":
        return F.lit(float(node.value))
    if node.kind == "call":
        if node.value == "attr" and node.args[0].value not in numeric:
            return null
        return call(node.value, *(a.value for a in node.args)).cast("double")
    if node.kind == "neg":
        return -go(node.args[0])
    if node.kind == "bin":
        a, b = map(go, node.args)
        return a + b if node.value == "+" else a - b if node.value == "-" else a * b if node.value == "*" else F.try_divide(a, b)
    if node.kind == "cmp":
        text = next((a for a in node.args if a.kind == "str"), None)
        if text is not None:
            other = next(a for a in node.args if a is not text)
            name = other.args[0].value
            value = call("attr", name)
            if name in numeric:
                try:
                    same = value == float(text.value)
                except ValueError:
                    same = F.lit(False)
            else:
                same = value.cast("string") == text.value
            same = F.when(value.isNotNull(), same)
            return (same if node.value == "==" else ~same).cast("double")
        a, b = map(go, node.args)
        op = {"==": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[node.value]
        return op.cast("double")
    if node.kind == "logic":
        a, b = map(go, node.args)
        both = (a != 0) & (b != 0) if node.value == "and" else (a != 0) | (b != 0)
        return F.when(a.isNotNull() & b.isNotNull(), both.cast("double"))
    if node.kind == "not":
        return (go(node.args[0]) == 0).cast("double")
    value, cond = map(go, node.args)
    return F.when(cond.isNotNull() & (cond != 0), value)
