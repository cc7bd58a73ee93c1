"""Parsing of JSON Datalog, with every check that needs no data."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from annalist.errors import QueryError

ORDERED = ("<", "<=", ">", ">=")
PREDICATES = ("=", "!=", *ORDERED, "contains", "starts-with")
AGGREGATES = ("count", "count-distinct", "sum", "avg", "min", "max")


def is_variable(x: Any) -> bool:
    return isinstance(x, str) and len(x) > 1 and x[0] == "?"


@dataclass(frozen=True)
class Pattern:
    terms: tuple[Any, ...]

    def variables(self) -> list[str]:
        return list(dict.fromkeys(t for t in self.terms if is_variable(t)))


@dataclass(frozen=True)
class Predicate:
    op: str
    left: Any
    right: Any

    def variables(self) -> list[str]:
        return [t for t in (self.left, self.right) if is_variable(t)]


@dataclass(frozen=True)
class Not:
    body: tuple[Any, ...]

    def variables(self) -> list[str]:
        return list(dict.fromkeys(v for c in self.body for v in c.variables()))


@dataclass(frozen=True)
class Or:
    branches: tuple[tuple[Any, ...], ...]

    def variables(self) -> list[str]:
        """Variables that the branches bind; those of an inner negation stay inside."""
        return list(dict.fromkeys(v for b in self.branches for c in b if not isinstance(c, Not) for v in c.variables()))


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Any, ...]

    def variables(self) -> list[str]:
        return list(dict.fromkeys(t for t in self.args if is_variable(t)))


@dataclass(frozen=True)
class Rule:
    name: str
    args: tuple[str, ...]
    body: tuple[Any, ...]


@dataclass(frozen=True)
class Find:
    kind: str  # var, pull or an aggregate
    variable: str
    pattern: Any = None

    @property
    def label(self) -> str:
        return self.variable if self.kind == "var" else f"{self.kind}({self.variable})"

    @property
    def column(self) -> str:
        """The label as a column name: ?x is x, count(?x) is count_x."""
        name = self.variable[1:].replace("-", "_")
        return name if self.kind == "var" else f"{self.kind.replace('-', '_')}_{name}"


@dataclass(frozen=True)
class Query:
    find: tuple[Find, ...]
    where: tuple[Any, ...]
    inputs: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()
    history: bool = False
    order: tuple[tuple[str, bool], ...] = ()
    limit: int | None = None
    offset: int = 0
    dependencies: dict[str, set[str]] = field(default_factory=dict, hash=False, compare=False)


def clause(x: Any) -> Any:
    if isinstance(x, list):
        if x and isinstance(x[0], str) and x[0] in PREDICATES:
            if len(x) != 3:
                raise QueryError(f"a predicate has two operands: {x}")
            if any(t == "_" for t in x[1:]):
                raise QueryError("a predicate has no wildcard")
            return Predicate(*x)
        if not 3 <= len(x) <= 5:
            raise QueryError(f"a pattern has three to five terms: {x}")
        if len(x) == 5 and not (is_variable(x[4]) or x[4] == "_" or isinstance(x[4], bool)):
            raise QueryError("the fifth term is a variable, _ or a boolean")
        return Pattern(tuple(json.dumps(t) if isinstance(t, float) and t != t else t for t in map(_frozen, x)))
    if isinstance(x, dict) and len(x) == 1:
        ((key, body),) = x.items()
        if key == "not" and isinstance(body, list) and body:
            return Not(tuple(map(clause, body)))
        if key == "or" and isinstance(body, list) and body and all(isinstance(b, list) and b for b in body):
            return Or(tuple(tuple(map(clause, b)) for b in body))
        if key == "rule" and isinstance(body, list) and body and isinstance(body[0], str):
            if any(t == "_" for t in body[1:]):
                raise QueryError("a rule call has no wildcard")
            return Call(body[0], tuple(map(_frozen, body[1:])))
    raise QueryError(f"not a clause: {x!r}")


@dataclass(frozen=True)
class Constant:
    """A constant term that is not a plain scalar, kept as its JSON text."""

    text: str

    @property
    def wire(self) -> Any:
        return json.loads(self.text)


def _frozen(x: Any) -> Any:
    if x is None:
        raise QueryError("null is not a term")
    return Constant(json.dumps(x)) if isinstance(x, (list, dict)) else x


def wire_of(term: Any) -> Any:
    return term.wire if isinstance(term, Constant) else term


def _find(x: Any) -> Find:
    if is_variable(x):
        return Find("var", x)
    if isinstance(x, list) and len(x) == 2 and x[0] in AGGREGATES and is_variable(x[1]):
        return Find(x[0], x[1])
    if isinstance(x, list) and len(x) == 3 and x[0] == "pull" and is_variable(x[1]):
        check_pull(x[2])
        return Find("pull", x[1], x[2])
    raise QueryError(f"not a find item: {x!r}")


def check_pull(pattern: Any, depth: int = 0) -> None:
    if not isinstance(pattern, list) or not pattern or depth > 16:
        raise QueryError(f"not a pull pattern: {pattern!r}")
    for item in pattern:
        if isinstance(item, dict) and item:
            for key, sub in item.items():
                if key == "*" or "/" not in key:
                    raise QueryError(f"not an attribute: {key!r}")
                check_pull(sub, depth + 1)
        elif not isinstance(item, str) or (item != "*" and "/" not in item):
            raise QueryError(f"not a pull item: {item!r}")


def parse(query: Any) -> Query:
    """A checked query; raises QueryError for anything that no data could make right."""
    if not isinstance(query, dict):
        raise QueryError("a query is an object")
    if extra := set(query) - {"find", "where", "in", "rules", "source", "order", "limit", "offset"}:
        raise QueryError(f"unknown keys: {sorted(extra)}")
    for key in ("find", "where"):
        if not isinstance(query.get(key), list) or not query[key]:
            raise QueryError(f"{key} is a list that is not empty")
    if query.get("source", "current") not in ("current", "history"):
        raise QueryError("source is current or history")
    find = tuple(map(_find, query["find"]))
    if any(f.kind == "pull" for f in find) and any(f.kind in AGGREGATES for f in find):
        raise QueryError("pull cannot be mixed with aggregates")
    inputs = query.get("in", [])
    if not isinstance(inputs, list) or not all(map(is_variable, inputs)) or len(set(inputs)) < len(inputs):
        raise QueryError("in lists distinct variables")
    where = tuple(map(clause, query["where"]))
    rules = tuple(map(_rule, query.get("rules", [])))
    arity: dict[str, int] = {}
    for r in rules:
        if arity.setdefault(r.name, len(r.args)) != len(r.args):
            raise QueryError(f"rule {r.name} has heads of several lengths")
    for body in (where, *(r.body for r in rules)):
        _check_calls(body, arity)
    dependencies = {name: set() for name in arity}
    for r in rules:
        dependencies[r.name] |= set(_calls(r.body))
    rule_order(dependencies)
    for r in rules:
        bound = check_bindings(r.body, set())
        if missing := set(r.args) - bound:
            raise QueryError(f"rule {r.name} does not bind {sorted(missing)}")
    bound = check_bindings(where, set(inputs))
    for f in find:
        if f.variable not in bound:
            raise QueryError(f"{f.variable} is not bound")
    order = []
    labels, grouped = {f.label for f in find}, any(f.kind in AGGREGATES for f in find)
    for item in query.get("order", []):
        if not isinstance(item, list) or len(item) != 2 or item[1] not in ("asc", "desc") or not isinstance(item[0], str):
            raise QueryError(f"not an order item: {item!r}")
        if item[0] not in labels and (grouped or item[0] not in bound):
            raise QueryError(f"cannot order by {item[0]}")
        order.append((item[0], item[1] == "asc"))
    for key in ("limit", "offset"):
        n = query.get(key, 0)
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise QueryError(f"{key} is a whole number")
    return Query(find, where, tuple(inputs), rules, query.get("source") == "history", tuple(order), query.get("limit"), query.get("offset", 0), dependencies)


def _rule(x: Any) -> Rule:
    if not isinstance(x, dict) or set(x) != {"head", "body"} or not isinstance(x["head"], list) or len(x["head"]) < 2 or not isinstance(x["body"], list) or not x["body"]:
        raise QueryError(f"not a rule: {x!r}")
    name, *args = x["head"]
    if not isinstance(name, str) or is_variable(name) or not all(map(is_variable, args)) or len(set(args)) < len(args):
        raise QueryError(f"not a rule head: {x['head']!r}")
    return Rule(name, tuple(args), tuple(map(clause, x["body"])))


def _calls(body: tuple[Any, ...]) -> list[str]:
    out = []
    for c in body:
        if isinstance(c, Call):
            out.append(c.name)
        elif isinstance(c, Not):
            out += _calls(c.body)
        elif isinstance(c, Or):
            out += [n for b in c.branches for n in _calls(b)]
    return out


def calls_of(body: tuple[Any, ...]) -> list[Call]:
    """All calls in a body, at any depth."""
    out = []
    for c in body:
        if isinstance(c, Call):
            out.append(c)
        elif isinstance(c, Not):
            out += calls_of(c.body)
        elif isinstance(c, Or):
            out += [x for b in c.branches for x in calls_of(b)]
    return out


def _check_calls(body: tuple[Any, ...], arity: dict[str, int]) -> None:
    for c in body:
        if isinstance(c, Call) and arity.get(c.name) != len(c.args):
            raise QueryError(f"no rule {c.name} of {len(c.args)} arguments")
        for inner in (c.body,) if isinstance(c, Not) else c.branches if isinstance(c, Or) else ():
            _check_calls(inner, arity)


def rule_order(dependencies: dict[str, set[str]]) -> list[str]:
    """Rules after those that they call; a rule may call itself, but no cycle may be longer."""
    done: list[str] = []
    open_: set[str] = set()

    def visit(name: str) -> None:
        if name in done:
            return
        if name in open_:
            raise QueryError(f"rule {name} is part of a mutual recursion")
        open_.add(name)
        for other in sorted(dependencies[name] - {name}):
            visit(other)
        open_.discard(name)
        done.append(name)

    for name in sorted(dependencies):
        visit(name)
    return done


def check_bindings(body: tuple[Any, ...], bound: set[str]) -> set[str]:
    """Variables bound after the clauses, which must be safe in their order whatever the data."""
    bound = set(bound)
    for c in body:
        if isinstance(c, (Pattern, Call)):
            bound |= set(c.variables())
        elif isinstance(c, Predicate):
            if missing := set(c.variables()) - bound:
                raise QueryError(f"{sorted(missing)} must be bound before {c.op}")
        elif isinstance(c, Not):
            if not set(c.variables()) & bound:
                raise QueryError("a negation shares a variable with what stands before it")
            check_bindings(c.body, bound)
        else:
            found = [check_bindings(b, bound) - bound for b in c.branches]
            if any(f != found[0] for f in found):
                raise QueryError("the branches of or bind different variables")
            bound |= found[0]
    return bound
