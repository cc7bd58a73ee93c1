"""Datalog to one DataFrame.

Patterns that read several attributes of one entity from one table become one
scan, not a join of scans.

Every variable is a column of its own, plain where its kind is known from the
attribute (the usual case), so patterns become equi-joins that Catalyst orders
and picks strategies for.  Duplicates are dropped once, at the end of a body, and
only where some step can make them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.errors import EngineError, QueryError
from annalist.functions import values as V
from annalist.model import Source
from annalist.plans import ast
from annalist.storage import stored


@dataclass(frozen=True)
class Bindings:
    """Rows of variables: ``kinds`` by variable; the column of ?x is ``v_x``; ``distinct``: no two rows are alike."""

    df: DataFrame
    kinds: dict[str, str]
    distinct: bool = True

    def col(self, variable: str) -> Column:
        return F.col(name(variable))


@dataclass(frozen=True)
class Relation:
    df: DataFrame  # columns a0, a1, ...
    kinds: tuple[str, ...]


def name(variable: str) -> str:
    return "v_" + variable[1:]


def once(b: Bindings) -> Bindings:
    """Without duplicate rows."""
    return b if b.distinct else replace(b, df=_distinct(b.df), distinct=True)


def _distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


class Compiler:
    def __init__(self, source: Source, query: ast.Query) -> None:
        self.source, self.query = source, query
        self.spark = source.spark
        self.relations: dict[str, Relation] = {}

    # ------------------------------------------------------------ joins

    def join(self, left: Bindings | None, right: Bindings) -> Bindings:
        if left is None:
            return right
        shared = [v for v in right.kinds if v in left.kinds]
        ldf, rdf, kinds = left.df, right.df, left.kinds | {v: k for v, k in right.kinds.items() if v not in left.kinds}
        for v in shared:
            a, b = left.kinds[v], right.kinds[v]
            if a != b:
                if "any" not in (a, b):
                    rdf = rdf.where(F.lit(False))  # unlike tags never unify
                    rdf = rdf.withColumn(name(v), F.lit(None).cast(V.SPARK_TYPE[a]))
                elif a == "any":
                    rdf = rdf.withColumn(name(v), V.to_struct(b, F.col(name(v))))
                else:
                    ldf = ldf.withColumn(name(v), V.to_struct(a, F.col(name(v))))
                    kinds[v] = "any"
        df = ldf.join(rdf, [name(v) for v in shared], "inner") if shared else ldf.crossJoin(rdf)
        return Bindings(df.select(*(name(v) for v in kinds)), kinds, left.distinct and right.distinct)

    # ------------------------------------------------------------ patterns

    def pattern(self, p: ast.Pattern, bound: Bindings | None) -> Bindings:
        e, a, v, *rest = p.terms
        tx, added = (*rest, "_", "_")[:2]
        fixed = a != "_" and not ast.is_variable(a)
        if fixed and not isinstance(ast.wire_of(a), (str, int)):
            raise QueryError(f"not an attribute: {a!r}")
        if fixed:
            owner = self.entity(e) if e != "_" and not ast.is_variable(e) else None
            wire = ast.wire_of(v)
            target = self.entity(v) if isinstance(wire, dict) and set(wire) == {"ref"} else None
            scan = self.source.scan(a, self.query.history, owner, target)
        else:
            scan = self.source.scan_all(self.query.history)
        if scan is None:
            kinds = {x: "ref" for x in p.variables()}
            return Bindings(self.spark.createDataFrame([], ", ".join(f"`{name(x)}` bigint" for x in kinds) or "none int"), kinds)
        df, kinds = scan.df, {}
        columns: list[tuple[Any, str, str]] = [(e, "e", "ref"), (v, "v", scan.kind), (tx, "tx", "ref"), (added, "added", "bool")]
        if not fixed:
            columns.append((a, "a", "ref"))
        first: dict[str, str] = {}
        for term, column, kind in columns:
            if term == "_":
                continue
            if ast.is_variable(term):
                if term in first:
                    other = next(k for t, c, k in columns if t == term and c == first[term])
                    df = df.where(V.equal(other, F.col(first[term]), kind, F.col(column)) if "any" in (kind, other) and kind != other else (F.col(first[term]) == F.col(column) if kind == other else F.lit(False)))
                else:
                    first[term] = column
                    kinds[term] = kind
            elif column == "v":
                df = df.where(self.constant_value(term, kind, F.col("v")))
            elif column == "added":
                df = df.where(F.col("added") == term)
            else:
                df = df.where(F.col(column) == self.entity(term)) if self.entity(term) is not None else df.where(F.lit(False))
        df = df.select(*(F.col(c).alias(name(t)) for t, c in first.items()))
        # A row stays the only one of its kind while e and v (and a) are all kept or fixed.
        keys = [e, v] if fixed else [e, v, a]
        distinct = scan.distinct and all(k != "_" for k in keys) or (self.query.history and tx != "_" and added != "_" and all(k != "_" for k in keys))
        return Bindings(df, kinds, bool(distinct))

    def entity(self, term: Any) -> int | None:
        wire = ast.wire_of(term)
        if isinstance(wire, dict) and set(wire) == {"ref"}:
            wire = wire["ref"]
        if isinstance(wire, (bool, float)) or (isinstance(wire, dict) and set(wire) != {"eid"}):
            raise QueryError(f"not an entity: {wire!r}")
        try:
            return self.source.entity(wire)
        except EngineError as x:
            raise QueryError(str(x)) from x

    def constant(self, term: Any) -> tuple[str, Any]:
        """(kind, value) of a constant in value position."""
        wire = ast.wire_of(term)
        if isinstance(wire, dict) and set(wire) == {"ref"}:
            return "ref", self.entity(term)
        try:
            return V.encode(wire)
        except EngineError as x:
            raise QueryError(str(x)) from x

    def constant_value(self, term: Any, kind: str, column: Column) -> Column:
        own, x = self.constant(term)
        if x is None or kind not in (own, "any"):
            return F.lit(False)
        if kind == "any":
            return column == V.to_struct(own, V.literal(own, x))
        return column == V.literal(own, x)

    # ------------------------------------------------------------ predicates

    def operand(self, term: Any, b: Bindings) -> tuple[str, Column]:
        if ast.is_variable(term):
            return b.kinds[term], b.col(term)
        kind, x = self.constant(term)
        if x is None:
            raise QueryError(f"nothing is named {term!r}")
        return kind, V.literal(kind, x)

    def predicate(self, p: ast.Predicate, b: Bindings) -> Bindings:
        (ka, x), (kb, y) = self.operand(p.left, b), self.operand(p.right, b)
        return replace(b, df=b.df.where(self.condition(p.op, ka, x, kb, y, b)))

    def condition(self, op: str, ka: str, x: Column, kb: str, y: Column, b: Bindings) -> Column:
        if op in ("=", "!="):
            same = V.equal(ka, x, kb, y)
            return same if op == "=" else ~same
        if op in ("contains", "starts-with"):
            if not {ka, kb} <= {"text", "any"}:
                self.reject(b, f"{op} compares text")
            sides = []
            for k, c in ((ka, x), (kb, y)):
                text = F.when(c["t"].isin(V.TEXT, V.TEXT_REF), c["s"]).otherwise(F.raise_error(F.lit(f"QueryError: {op} compares text")).cast("string")) if k == "any" else c
                sides.append(text)
            return sides[0].contains(sides[1]) if op == "contains" else sides[0].startswith(sides[1])
        if "any" in (ka, kb):
            order = V.order_of_any(V.to_struct(ka, x), V.to_struct(kb, y))
        elif (ka == kb and ka in ("int", "float", "text", "bool", "ref", "instant")) or {ka, kb} == V.NUMERIC:
            if ka == kb:
                return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
            order = V.numeric_order(ka, x, kb, y)
        else:
            self.reject(b, f"{ka} and {kb} have no order")
            return F.lit(False)
        return {"<": order < 0, "<=": order <= 0, ">": order > 0, ">=": order >= 0}[op]

    @staticmethod
    def reject(b: Bindings, why: str) -> None:
        """An operand mismatch is an error only if a row gets as far as to be compared."""
        if not b.df.isEmpty():
            raise QueryError(why)

    # ------------------------------------------------------------ bodies

    def body(self, clauses: tuple[Any, ...], seed: Bindings | None) -> Bindings:
        b = seed
        todo = list(clauses)
        while todo:
            # Within a run of patterns, those that share a variable come first: no product that is not asked for.
            at = 0
            if b is not None and isinstance(todo[0], ast.Pattern):
                run = next((i for i, c in enumerate(todo) if not isinstance(c, ast.Pattern)), len(todo))
                at = next((i for i in range(run) if set(todo[i].variables()) & set(b.kinds)), 0)
            elif b is None and isinstance(todo[0], ast.Pattern):
                run = next((i for i, c in enumerate(todo) if not isinstance(c, ast.Pattern)), len(todo))
                at = max(range(run), key=lambda i: (sum(not ast.is_variable(t) and t != "_" for t in todo[i].terms), -i))
            b = self.step(todo.pop(at), b)
        assert b is not None
        return b

    def step(self, c: Any, b: Bindings | None) -> Bindings:
        if isinstance(c, ast.Pattern):
            return self.join(b, self.pattern(c, b))
        if isinstance(c, ast.Call):
            return self.join(b, self.call(c))
        if isinstance(c, ast.Predicate):
            assert b is not None or not c.variables()
            return self.predicate(c, b if b is not None else self.unit())
        if isinstance(c, ast.Not):
            assert b is not None
            return self.negation(c, b)
        return self.disjunction(c, b)

    def unit(self) -> Bindings:
        return Bindings(self.spark.range(1).select(), {})

    def negation(self, c: ast.Not, b: Bindings) -> Bindings:
        shared = [v for v in c.variables() if v in b.kinds]
        columns = [name(v) for v in shared]
        seed = Bindings(b.df.select(*columns).distinct(), {v: b.kinds[v] for v in shared})
        # Patterns need no seed; predicates and inner negations may use variables from outside.
        plain = all(isinstance(x, ast.Pattern) for x in c.body)
        found = self.body(c.body, None if plain else seed)
        left, right, on = b.df, found.df, []
        for v in shared:
            if v not in found.kinds:
                continue
            x, y = F.col(f"l.{name(v)}"), F.col(f"r.{name(v)}")
            ka, kb = b.kinds[v], found.kinds[v]
            if ka == kb:
                on.append(x == y)
            elif "any" in (ka, kb):
                on.append(V.to_struct(ka, x) == V.to_struct(kb, y))
            else:
                on.append(F.lit(False))
        condition = on[0]
        for more in on[1:]:
            condition = condition & more
        return replace(b, df=left.alias("l").join(right.alias("r"), condition, "left_anti"))

    def disjunction(self, c: ast.Or, b: Bindings | None) -> Bindings:
        parts = [self.body(branch, b) for branch in c.branches]
        keep = list(b.kinds) if b is not None else []
        keep += [v for v in c.variables() if v not in keep]
        keep = [v for v in keep if all(v in p.kinds for p in parts)]
        out, kinds = aligned([replace(p, df=p.df.select(*(name(v) for v in keep)), kinds={v: p.kinds[v] for v in keep}) for p in parts])
        return Bindings(out.distinct(), kinds)

    # ------------------------------------------------------------ rules

    def call(self, c: ast.Call) -> Bindings:
        r = self.relations[c.name]
        df, first = r.df, {}
        for i, (term, kind) in enumerate(zip(c.args, r.kinds, strict=True)):
            column = F.col(f"a{i}")
            if ast.is_variable(term):
                if term in first:
                    j = first[term]
                    df = df.where(V.equal(r.kinds[j], F.col(f"a{j}"), kind, column) if kind == r.kinds[j] or "any" in (kind, r.kinds[j]) else F.lit(False))
                else:
                    first[term] = i
            elif kind == "ref":
                e = self.entity(term)
                df = df.where(column == e) if e is not None else df.where(F.lit(False))
            else:
                df = df.where(self.constant_value(term, kind, column))
        kinds = {v: r.kinds[i] for v, i in first.items()}
        return Bindings(df.select(*(F.col(f"a{i}").alias(name(v)) for v, i in first.items())), kinds, len(first) == len(c.args) or all(not ast.is_variable(t) for t in c.args if t not in first))

    def relation(self, rule: ast.Rule) -> Bindings:
        b = self.body(rule.body, None)
        return Bindings(b.df.select(*(name(v) for v in rule.args)).distinct(), {v: b.kinds[v] for v in rule.args})

    def union(self, rules: list[ast.Rule]) -> Relation:
        parts = []
        for r in rules:
            b = self.relation(r)
            parts.append(Bindings(b.df.select(*(F.col(name(v)).alias(f"v_a{i}") for i, v in enumerate(r.args))), {f"?a{i}": b.kinds[v] for i, v in enumerate(r.args)}))
        df, kinds = aligned(parts)
        return Relation(df.select(*(F.col(f"v_a{i}").alias(f"a{i}") for i in range(len(kinds)))).distinct(), tuple(kinds.values()))

    # ------------------------------------------------------------ what a recursive rule is asked for

    def wanted(self, rule: str, own: list[ast.Rule], again: list[ast.Rule], kinds: tuple[str, ...]) -> tuple[int, DataFrame | Column] | None:
        """(argument, its values) that calls of a recursive rule can need, where all of them give that argument the same constant.

        An argument that recursion hands on unchanged keeps the constant.  Else
        the values are followed through the bodies, from the constant on, until
        no new ones come; only rows with one of them are ever derived.
        """
        calls = [c for body in (self.query.where, *(r.body for r in self.query.rules if r.name != rule)) for c in ast.calls_of(body) if c.name == rule]
        inner = [(r, [c for c in r.body if isinstance(c, ast.Call) and c.name == rule]) for r in again]
        if not calls or any(len(found) != ast._calls(r.body).count(rule) for r, found in inner):
            return None  # it calls itself below a negation or an alternative
        for i, kind in enumerate(kinds):
            terms = {repr(c.args[i]) for c in calls}
            term = calls[0].args[i]
            if len(terms) != 1 or ast.is_variable(term) or term == "_" or kind == "any":
                continue
            value = self.entity(term) if kind == "ref" else self.constant(term)[1]
            if value is None or (kind != "ref" and self.constant(term)[0] != kind):
                continue
            if all(c.args[i] == r.args[i] for r, found in inner for c in found):
                return i, F.col(f"a{i}") == V.literal(kind, value)
            if followed := self.followed(rule, i, kind, value, inner):
                return i, followed
        return None

    def followed(self, rule: str, i: int, kind: str, value: Any, inner: list[tuple[ast.Rule, list[ast.Call]]]) -> DataFrame | None:
        steps = []
        for r, found in inner:
            rest = tuple(c for c in r.body if c not in found)
            if len(found) != 1 or ast._calls(rest) or not ast.is_variable(found[0].args[i]) or found[0].args[i] not in {v for c in rest if isinstance(c, ast.Pattern) for v in c.variables()}:
                return None
            steps.append((rest, r.args[i], found[0].args[i]))
        new = self.spark.range(1).select(V.literal(kind, value).alias("w"))
        parts = [new]
        while True:
            found = None
            for rest, head, called in steps:
                b = self.body(rest, Bindings(new.select(F.col("w").alias(name(head))), {head: kind}))
                if b.kinds[called] != kind:
                    return None
                rows = b.df.select(b.col(called).alias("w"))
                found = rows if found is None else found.unionByName(rows)
            known = parts[0]
            for more in parts[1:]:
                known = known.unionByName(more)
            new = stored(found.distinct().join(known, "w", "left_anti"), "wanted")
            if new.isEmpty():
                return known
            parts.append(new)
            if len(parts) > 8:
                parts = [stored(known.unionByName(new), "wanted")]

    @staticmethod
    def only(r: Relation, wanted: tuple[int, DataFrame | Column] | None) -> Relation:
        if wanted is None:
            return r
        i, values = wanted
        return replace(r, df=r.df.where(values) if isinstance(values, Column) else r.df.join(values, r.df[f"a{i}"] == values["w"], "left_semi"))

    def build_rules(self) -> None:
        """All rules, callees first; a rule that calls itself is iterated to its fixpoint, new rows only.

        Every round joins the last round's new rows, drops those known, and writes
        the rest to the shared folder; it ends when a round finds none.
        """
        for rule in ast.rule_order(self.query.dependencies):
            own = [r for r in self.query.rules if r.name == rule]
            plain = [r for r in own if rule not in ast._calls(r.body)]
            again = [r for r in own if r not in plain]
            if not plain:
                raise QueryError(f"rule {rule} has no ground to start from")
            total = self.union(plain)
            if not again:
                self.relations[rule] = total
                continue
            wanted = self.wanted(rule, own, again, total.kinds)
            delta = Relation(stored(self.only(total, wanted).df, "rule"), total.kinds)
            parts = [delta.df]
            linear = all(ast._calls(r.body).count(rule) == 1 for r in again)
            while not delta.df.isEmpty():
                known = parts[0]
                for more in parts[1:]:
                    known = known.unionByName(more)
                # A body that calls itself once needs only the new rows; more calls need all of them.
                self.relations[rule] = delta if linear else Relation(known, total.kinds)
                found = self.union(again)
                if found.kinds != total.kinds:
                    raise QueryError(f"the bodies of rule {rule} bind values of different kinds")
                columns = [f"a{i}" for i in range(len(total.kinds))]
                delta = Relation(stored(self.only(found, wanted).df.join(known, columns, "left_anti"), "rule"), total.kinds)
                parts.append(delta.df)
                if len(parts) > 8:
                    parts = [stored(known.unionByName(delta.df), "rule")]
            out = parts[0]
            for more in parts[1:]:
                out = out.unionByName(more)
            self.relations[rule] = Relation(out, total.kinds)


def aligned(parts: list[Bindings]) -> tuple[DataFrame, dict[str, str]]:
    """The rows of all parts, with a common kind for each variable."""
    kinds = {v: k if all(p.kinds[v] == k for p in parts) else "any" for v, k in parts[0].kinds.items()}
    out = None
    for p in parts:
        df = p.df.select(*((V.to_struct(p.kinds[v], F.col(name(v))) if k == "any" else F.col(name(v))).alias(name(v)) for v, k in kinds.items()))
        out = df if out is None else out.unionByName(df)
    return out, kinds
