"""The rule language's operators as a typed builder: a rule is checked before any table is read, then compiled to columns.

A scalar has a kind (bool, number, string) and a number its dimension (unit, measurement). A collection is an array column
of records or scalars. And and Or keep all their arguments, so that a gap is never hidden behind a decided one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


class RuleTypeError(TypeError):
    pass


@dataclass(frozen=True)
class Kind:
    """EXP-21. bool, number or string; `many` for collections; record fields by name; dimension of numbers."""

    name: str
    many: bool = False
    dimension: tuple[str, str] | None = None
    fields: tuple[tuple[str, Kind], ...] = field(default=())


BOOL, NUMBER, STRING = Kind("bool"), Kind("number"), Kind("string")


_SEEN = "array<struct<path: string, bindings: map<string, string>>>"


@dataclass(frozen=True)
class Expr:
    """`why` tells, where a boolean is false, which parts of it are: an array of (path, bindings), from what is bound and the
    expression's path. Without it the expression is a part that is not looked into."""

    kind: Kind
    build: Callable[[dict[str, Column]], Column]
    why: Callable[[dict[str, Column], str], Column] | None = None

    def column(self, bound: dict[str, Column] | None = None) -> Column:
        return self.build(bound or {})

    def seen(self, bound: dict[str, Column], path: str) -> Column:
        if self.why:
            return self.why(bound, path)
        held = F.create_map(*[c for name, x in bound.items() for c in (F.lit(name), F.to_json(F.struct(x.alias("value"))))]) if bound else F.create_map()
        one = F.array(F.struct(F.lit(path).alias("path"), held.cast("map<string, string>").alias("bindings")))
        return F.when(~F.coalesce(self.build(bound), F.lit(False)), one.cast(_SEEN)).otherwise(F.array().cast(_SEEN))


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise RuleTypeError(what)


def literal(value: bool | int | str | Decimal, dimension: tuple[str, str] | None = None) -> Expr:
    """EXP-1. Numbers are exact decimals."""
    if isinstance(value, bool):
        return Expr(BOOL, lambda _: F.lit(value))
    if isinstance(value, str):
        return Expr(STRING, lambda _: F.lit(value))
    d = Decimal(value)
    _need(-d.as_tuple().exponent <= 18 and len(d.as_tuple().digits) <= 38, "a decimal beyond 38 digits or 18 places")
    return Expr(Kind("number", dimension=dimension), lambda _: F.lit(str(d)).cast("decimal(38,18)"))


def source(name: str, fields: dict[str, Kind]) -> Expr:
    """EXP-3. A collection of records held in an array column."""
    return Expr(Kind("record", many=True, fields=tuple(fields.items())), lambda _: F.col(name))


def scalars(name: str, kind: Kind) -> Expr:
    return Expr(Kind(kind.name, many=True, dimension=kind.dimension), lambda _: F.col(name))


def column(name: str, kind: Kind) -> Expr:
    return Expr(kind, lambda _: F.col(name))


def var(name: str, kind: Kind) -> Expr:
    """EXP-4. What a surrounding All, Any, Filter or Map bound."""
    return Expr(kind, lambda bound: bound[name])


def get(name: str, of: Expr) -> Expr:
    """EXP-2."""
    kinds = dict(of.kind.fields)
    _need(of.kind.name == "record" and not of.kind.many and name in kinds, f"no field {name}")
    return Expr(kinds[name], lambda b: of.build(b)[name])


def _bools(args: tuple[Expr, ...], join, every: bool) -> Expr:
    _need(1 <= len(args) <= 64 and all(a.kind == BOOL for a in args), "1 to 64 booleans")
    build = lambda b: reduce(join, [a.build(b) for a in args])
    parts = lambda b, path: F.concat(*[a.seen(b, f"{path}/{i}") for i, a in enumerate(args)])
    why = parts if every else lambda b, path: F.when(~F.coalesce(build(b), F.lit(False)), parts(b, path)).otherwise(F.array().cast(_SEEN))
    return Expr(BOOL, build, why)


def all_of(*args: Expr) -> Expr:
    """EXP-5."""
    return _bools(args, lambda x, y: x & y, True)


def any_of(*args: Expr) -> Expr:
    return _bools(args, lambda x, y: x | y, False)


def negate(arg: Expr) -> Expr:
    """EXP-6."""
    _need(arg.kind == BOOL, "a boolean")
    return Expr(BOOL, lambda b: ~arg.build(b))


def _element(many: Expr) -> Kind:
    _need(many.kind.many, "a collection")
    return Kind(many.kind.name, dimension=many.kind.dimension, fields=many.kind.fields)


def _bind(many: Expr, name: str, body: Callable[[Expr], Expr], bound: set[str] | None = None) -> tuple[Expr, Callable]:
    inner = body(var(name, _element(many)))

    def lambda_in(b: dict[str, Column]) -> Callable[[Column], Column]:
        _need(name not in b, f"{name} is bound twice")
        return lambda x: inner.build({**b, name: x})

    return inner, lambda_in


def _quantified(many: Expr, name: str, body: Callable[[Expr], Expr], f, kind: Kind) -> Expr:
    inner, lam = _bind(many, name, body)
    _need(inner.kind == BOOL, "a boolean body")
    return Expr(kind, lambda b: f(many.build(b), lam(b)))


def for_all(many: Expr, name: str, body: Callable[[Expr], Expr]) -> Expr:
    """EXP-7. True of an empty collection."""
    made = _quantified(many, name, body, F.forall, BOOL)
    inner = body(var(name, _element(many)))
    return Expr(BOOL, made.build, lambda b, path: F.flatten(F.transform(many.build(b), lambda x: inner.seen({**b, name: x}, f"{path}/each"))))


def for_any(many: Expr, name: str, body: Callable[[Expr], Expr]) -> Expr:
    """EXP-8. False of an empty collection."""
    return _quantified(many, name, body, F.exists, BOOL)


def keep(many: Expr, name: str, body: Callable[[Expr], Expr]) -> Expr:
    """EXP-9."""
    return _quantified(many, name, body, F.filter, many.kind)


def each(many: Expr, name: str, body: Callable[[Expr], Expr]) -> Expr:
    """EXP-10."""
    inner, lam = _bind(many, name, body)
    _need(not inner.kind.many, "a scalar or record body")
    return Expr(Kind(inner.kind.name, many=True, dimension=inner.kind.dimension, fields=inner.kind.fields), lambda b: F.transform(many.build(b), lam(b)))


def count(many: Expr) -> Expr:
    """EXP-11."""
    _element(many)
    return Expr(NUMBER, lambda b: F.size(many.build(b)).cast("decimal(38,18)"))


def distinct(many: Expr) -> Expr:
    """EXP-12."""
    _need(_element(many).name != "record", "a collection of scalars")
    return Expr(many.kind, lambda b: F.array_distinct(many.build(b)))


def contains(many: Expr, value: Expr) -> Expr:
    """EXP-13."""
    _need(_element(many) == value.kind, "a value of the collection's kind")
    return Expr(BOOL, lambda b: F.array_contains(many.build(b), value.build(b)))


def subset(left: Expr, right: Expr) -> Expr:
    """EXP-14."""
    _need(left.kind.many and left.kind == right.kind, "two collections of one kind")
    return Expr(BOOL, lambda b: F.size(F.array_except(left.build(b), right.build(b))) == 0)


def compare(op: str, left: Expr, right: Expr) -> Expr:
    """EXP-15. eq and ne on scalars of one kind; lt, le, gt, ge on numbers of one dimension."""
    _need(left.kind == right.kind and not left.kind.many and left.kind.name != "record", "two scalars of one kind and dimension")
    _need(op in ("eq", "ne") or left.kind.name == "number", "order is for numbers")
    f = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b}[op]
    return Expr(BOOL, lambda b: f(left.build(b), right.build(b)))


def one_of(value: Expr, *options: Expr) -> Expr:
    """EXP-16."""
    _need(1 <= len(options) <= 64 and all(o.kind == value.kind for o in options), "1 to 64 scalars of one kind")
    return Expr(BOOL, lambda b: value.build(b).isin([o.build(b) for o in options]))


def matches(value: Expr, pattern: str) -> Expr:
    """EXP-17."""
    _need(value.kind == STRING and len(pattern.encode()) <= 1024, "a string, and a pattern of at most 1,024 bytes")
    _need(not re.search(r"\(\?[=!<][=!]?", pattern), "no look-around")
    return Expr(BOOL, lambda b: value.build(b).rlike(pattern))


def concat(*parts: Expr) -> Expr:
    """EXP-18."""
    _need(all(p.kind == STRING for p in parts), "strings")
    return Expr(STRING, lambda b: F.concat(*[p.build(b) for p in parts]))


def replace(value: Expr, old: Expr, new: Expr) -> Expr:
    """EXP-19."""
    _need(value.kind == old.kind == new.kind == STRING, "strings")
    return Expr(STRING, lambda b: F.replace(value.build(b), old.build(b), new.build(b)))


def evaluate(df: DataFrame, rule: Expr, out: str = "holds") -> DataFrame:
    """EXP-20. The rows with the rule's value; rows that fail it are its observations (see windows.first_observations)."""
    _need(rule.kind == BOOL, "a rule is a boolean")
    return df.withColumn(out, rule.column())


def observations(df: DataFrame, rule: Expr, most: int = 64) -> DataFrame:
    """EXP-20. The rows that fail the rule, with `observed`: its first `most` false parts, as (path of the part in the rule, what
    All had bound there, as JSON), and `omitted`, the number of others. A path names arguments by number and the body of an
    All as `each`."""
    _need(rule.kind == BOOL, "a rule is a boolean")
    rows = df.withColumn("_seen", rule.seen({}, "")).where(F.size("_seen") > 0)
    return rows.withColumn("observed", F.slice("_seen", 1, most)).withColumn("omitted", F.greatest(F.size("_seen") - most, F.lit(0))).drop("_seen")
