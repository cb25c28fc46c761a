"""SPARQL strings as DataFrame plans over triples (s, p, o).

Covered: PREFIX, SELECT [DISTINCT] with variables, * or (COUNT([DISTINCT] ?x) AS ?n),
ASK, basic graph patterns with ``;``, ``,`` and ``a``, the path ``+``, OPTIONAL,
UNION, FILTER with comparisons, REGEX, CONTAINS, BOUND, ``!``, ``&&``, ``||`` and
[NOT] EXISTS, GROUP BY, ORDER BY and LIMIT. Whatever else raises ``ValueError``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptflow.operators import graph

_TOKEN = re.compile(r"""\s*(?:\#[^\n]*\n\s*)*(<[^<>\s]*>|\?\w+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^\S+)?|'(?:[^'\\]|\\.)*'|[\w-]*:[\w.-]*\w\+?|[\w-]*:|\d+(?:\.\d+)?|&&|\|\||!=|<=|>=|\w+|[{}().;,*=<>!+])""")
_WORDS = {"a": "rdf:type"}


class Parser:
    """One query string."""

    def __init__(self, text: str) -> None:
        self.tokens, at = [], 0
        text = text.strip() + "\n"
        while text[at:].strip():
            found = _TOKEN.match(text, at)
            if not found:
                raise ValueError(f"cannot read {text[at : at + 20]!r}")
            self.tokens.append(found[1])
            at = found.end()
        self.at, self.prefixes = 0, {}

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> str:
        token = self.peek()
        if not token or (wanted and token.upper() != wanted):
            raise ValueError(f"{wanted or 'more'} expected, {token!r} found")
        self.at += 1
        return token

    def is_(self, word: str) -> bool:
        return self.peek().upper() == word

    def maybe(self, word: str) -> bool:
        if self.is_(word):
            self.at += 1
            return True
        return False

    def term(self) -> str:
        token = self.take()
        if token.startswith("?"):
            return token
        if token.startswith("<"):
            return token[1:-1]
        if token[0] in "\"'":
            return re.sub(r"\\(.)", r"\1", re.match(r"""(["'])((?:[^\\]|\\.)*?)\1""", token)[2])
        if ":" in token:
            prefix, name = token.split(":", 1)
            return self.prefixes.get(prefix, f"{prefix}:") + name
        if token in _WORDS or re.fullmatch(r"\d+(?:\.\d+)?", token):
            return _WORDS.get(token, token)
        raise ValueError(f"a term expected, {token!r} found")

    def path(self) -> str:
        found = self.term()
        return found + "+" if self.maybe("+") else found

    def query(self) -> dict:
        while self.maybe("PREFIX"):
            name = self.take()
            self.prefixes[name.rstrip(":")] = self.take()[1:-1]
        out: dict = {"ask": False, "distinct": False, "vars": [], "counts": [], "group": [], "order": [], "limit": None}
        if self.maybe("ASK"):
            out["ask"] = True
        else:
            self.take("SELECT")
            out["distinct"] = self.maybe("DISTINCT")
            while not self.is_("WHERE") and not self.is_("{"):
                if self.maybe("("):
                    self.take("COUNT"), self.take("(")
                    distinct, counted = self.maybe("DISTINCT"), self.take()
                    self.take(")"), self.take("AS")
                    out["counts"].append((counted, distinct, self.take()))
                    self.take(")")
                else:
                    out["vars"].append(self.take())
        self.maybe("WHERE")
        out["where"] = self.group()
        while self.peek():
            if self.maybe("GROUP"):
                self.take("BY")
                while self.peek().startswith("?"):
                    out["group"].append(self.take())
            elif self.maybe("ORDER"):
                self.take("BY")
                while self.peek().startswith("?") or self.is_("DESC") or self.is_("ASC"):
                    down = self.is_("DESC")
                    if wrapped := not self.peek().startswith("?"):
                        self.take(), self.take("(")
                    out["order"].append((self.take(), down))
                    if wrapped:
                        self.take(")")
            elif self.maybe("LIMIT"):
                out["limit"] = int(self.take())
            else:
                raise ValueError(f"{self.peek()!r} is not understood")
        return out

    def group(self) -> list[tuple]:
        self.take("{")
        parts: list[tuple] = []
        while not self.maybe("}"):
            if self.maybe("OPTIONAL"):
                parts.append(("optional", self.group()))
            elif self.maybe("FILTER"):
                if self.is_("NOT") or self.is_("EXISTS"):
                    parts.append(("exists", not self.maybe("NOT"), self.take("EXISTS") and self.group()))
                else:
                    wrapped = self.is_("(")
                    parts.append(("filter", self.primary() if wrapped else self.either()))
            elif self.is_("{"):
                either = [self.group()]
                while self.maybe("UNION"):
                    either.append(self.group())
                parts.append(("union", either))
            elif not self.maybe("."):
                subject = self.term()
                while True:
                    path = self.path()
                    parts.append(("triple", (subject, path, self.term())))
                    while self.maybe(","):
                        parts.append(("triple", (subject, path, self.term())))
                    if not self.maybe(";") or self.is_(".") or self.is_("}"):
                        break
        return parts

    def either(self) -> tuple:
        left = self.both()
        while self.maybe("||"):
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.primary()
        while self.maybe("&&"):
            left = ("and", left, self.primary())
        return left

    def primary(self) -> tuple:
        if self.maybe("!"):
            return ("not", self.primary())
        if self.maybe("("):
            inner = self.either()
            self.take(")")
            return inner
        if self.peek().upper() in ("REGEX", "CONTAINS", "BOUND"):
            name, arguments = self.take().upper(), []
            self.take("(")
            while not self.maybe(")"):
                arguments.append(self.operand())
                self.maybe(",")
            return (name.lower(), *arguments)
        left = self.operand()
        if self.peek() not in ("=", "!=", "<", ">", "<=", ">="):
            raise ValueError(f"a comparison expected, {self.peek()!r} found")
        return (self.take(), left, self.operand())

    def operand(self) -> str | tuple:
        if self.is_("STR"):
            self.take(), self.take("(")
            inner = self.operand()
            self.take(")")
            return inner
        number = bool(re.fullmatch(r"\d+(?:\.\d+)?", self.peek()))
        return ("number", self.take()) if number else self.term()


def _value(x: str | tuple) -> Column:
    return F.lit(float(x[1])) if isinstance(x, tuple) else F.col(x[1:]) if x.startswith("?") else F.lit(x)


def _test(x: tuple) -> Column:
    kind, *rest = x
    if kind in ("or", "and"):
        left, right = map(_test, rest)
        return left | right if kind == "or" else left & right
    if kind == "not":
        return ~_test(rest[0])
    if kind == "bound":
        return _value(rest[0]).isNotNull()
    if kind == "regex":
        pattern = ("(?i)" if len(rest) > 2 and "i" in rest[2] else "") + rest[1]
        return _value(rest[0]).rlike(pattern)
    if kind == "contains":
        return F.contains(_value(rest[0]), _value(rest[1]))
    left, right = map(_value, rest)
    if any(isinstance(r, tuple) for r in rest) or kind in ("<", ">", "<=", ">="):
        left, right = (c.try_cast("double") for c in (left, right))
    return {"=": left == right, "!=": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[kind]


def _join(left: DataFrame | None, right: DataFrame, how: str = "inner") -> DataFrame:
    if left is None:
        return right
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        if how != "inner":
            raise ValueError("a group shares no variable with what stands before it")
        raise ValueError("patterns without a shared variable would be a cross product")
    return left.join(right, shared, how)


def _rows(triples: DataFrame, parts: list[tuple], outer: DataFrame | None = None) -> DataFrame:
    """Solutions of a group: patterns in the order in which they share variables, then unions, optionals, exclusions and filters."""
    found, left = outer, [p[1] for p in parts if p[0] == "triple"]
    names = lambda pattern: {t[1:] for t in (pattern[0], pattern[1].rstrip("+"), pattern[2]) if t.startswith("?")}
    while left:
        known = set(found.columns) if found is not None else set()
        pattern = next((p for p in left if names(p) & known), left[0])
        left.remove(pattern)
        found = _join(found, graph.match(triples, [pattern]))
    for kind, *rest in parts:
        if kind == "union":
            sides = [_rows(triples, side) for side in rest[0]]
            found = _join(found, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides))
    for kind, *rest in parts:
        if kind == "optional":
            found = _join(found, _rows(triples, rest[0]), "left")
        elif kind == "exists":
            found = _join(found, _rows(triples, rest[1]), "left_semi" if rest[0] else "left_anti")
    for kind, *rest in parts:
        if kind == "filter":
            found = found.where(_test(rest[0]))
    if found is None:
        raise ValueError("an empty group")
    return found


def select(triples: DataFrame, text: str) -> DataFrame:
    """The solutions of a query, a column for each variable; ASK: one row (``answer``)."""
    q = Parser(text).query()
    found = _rows(triples, q["where"])
    if q["ask"]:
        return found.limit(1).agg((F.count("*") > 0).alias("answer"))
    names = [v[1:] for v in q["vars"] if v != "*"]
    if q["counts"]:
        one = lambda x, distinct: F.countDistinct(x[1:]) if distinct else F.count("*" if x == "*" else x[1:])
        found = found.groupBy(*[v[1:] for v in q["group"]]).agg(*[one(x, d).alias(name[1:]) for x, d, name in q["counts"]])
        found = found.select(*names, *[name[1:] for _, _, name in q["counts"]])
    elif names:
        found = found.select(*names)
    if q["distinct"]:
        found = found.distinct()
    if q["order"]:
        found = found.orderBy(*[F.desc(v[1:]) if down else F.asc(v[1:]) for v, down in q["order"]])
    return found if q["limit"] is None else found.limit(q["limit"])


def evaluate(triples: DataFrame, questions: list[tuple[str, str]]) -> list[tuple[str, bool, str | None]]:
    """(id, passes, error) of competency questions (id, query): one passes with a row or more; an error is recorded, not raised."""
    out = []
    for name, text in questions:
        try:
            found = select(triples, text)
            out.append((name, bool(found.first()["answer"]) if found.columns == ["answer"] else not found.isEmpty(), None))
        except ValueError as error:
            out.append((name, False, str(error)))
    return out
