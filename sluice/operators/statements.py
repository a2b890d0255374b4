"""EXP-21. Rule statements as data: JSON syntax trees in a table, checked for types and dimensions before any fact is read.

A statement is an object {"op": ..} whose parts are statements again. Checking is done where the statements are, a row at a
time; a statement that cannot be a rule is a gap with a reason and the place of its fault. Good statements are compiled to
columns, so the facts are read once for as many rules as fit a plan.

Numbers carry a dimension: that of a field (unit, measurement), that of counts, or none for literals, which fit any.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from decimal import Decimal, InvalidOperation
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluice.operators import expressions as X
from sluice.operators.expressions import BOOL, STRING, Expr, Kind, RuleTypeError
from sluice.tables import partitions

# fixed values: limits of the rule language
DEEPEST, MOST_NODES, MOST_PARTS, LONGEST_TEXT, LONGEST_PATTERN, MOST_SOURCES = 16, 256, 64, 4096, 1024, 16
RULES_A_PLAN = 64  #: rules that one reading of the facts evaluates
REMEMBERED = 4096  #: statements whose judgment a task remembers

COUNTS = Kind("number", dimension=("count", "count"))
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_]{0,63}\Z")
_RELATIONS = ("eq", "ne", "lt", "le", "gt", "ge")
#: Keys of each op besides "op"; those after / may be left out.
_KEYS = {
    "bool": "value", "number": "value", "string": "value", "decimal": "value", "field": "name/of", "entities": "", "source": "name", "var": "name", "and": "args", "or": "args", "not": "arg",
    "all": "input predicate/as", "any": "input predicate/as", "filter": "input predicate/as", "map": "input as body", "count": "input", "distinct": "input", "contains": "input value", "subset": "left right",
    "compare": "left relation right", "in": "value set", "matches": "value pattern", "concat": "args", "replace": "value from to",
}


class Fault(Exception):
    def __init__(self, path: str, what: str):
        super().__init__(what)
        self.path, self.what = path, what


def _unique(pairs: list[tuple]) -> dict:
    if len(dict(pairs)) < len(pairs):
        raise ValueError("a key is given twice")
    return dict(pairs)


def _no_constant(text: str):
    raise ValueError(text)


def fits(kind: Kind, want: Kind) -> bool:
    """Literals, which have no dimension, fit any number, and numbers fit literals."""
    if kind.name == want.name == "number" and kind.many == want.many:
        return kind.dimension == want.dimension or None in (kind.dimension, want.dimension)
    return kind == want


@dataclass
class _Reader:
    """Reads one statement. `bound` holds the names that surrounding quantifiers bound; the innermost element is under ''."""

    sources: Mapping[str, Mapping[str, Kind]]
    nodes: int = 0
    used: dict[str, set[str]] = field(default_factory=dict)

    def read(self, tree, path: str, depth: int, bound: dict[str, Kind]) -> Expr:
        self.nodes += 1
        if depth > DEEPEST or self.nodes > MOST_NODES:
            raise Fault(path, "too deep" if depth > DEEPEST else "too many nodes")
        op = tree.get("op") if isinstance(tree, dict) else None
        if not isinstance(op, str) or op not in _KEYS:
            raise Fault(path, "unknown op")
        must, _, may = _KEYS[op].partition("/")
        if not set(must.split()) <= tree.keys() - {"op"} <= {*must.split(), *may.split()}:
            raise Fault(path, "keys")
        try:
            return getattr(self, f"_{op}")(tree, path, depth + 1, bound)
        except RuleTypeError as e:
            raise Fault(path, str(e)) from e

    def _part(self, tree: dict, key: str, path: str, *rest, want: Kind | None = None) -> Expr:
        e = self.read(tree[key], f"{path}/{key}", *rest)
        return self._as(e, want, f"{path}/{key}") if want else e

    def _as(self, e: Expr, want: Kind, path: str) -> Expr:
        if not fits(e.kind, want):
            raise Fault(path, "type")
        return replace(e, kind=want)

    def _list(self, tree: dict, key: str, path: str) -> list:
        if not isinstance(tree[key], list) or not 1 <= len(tree[key]) <= MOST_PARTS:
            raise Fault(path, "list")
        return tree[key]

    def _parts(self, tree: dict, path: str, want: Kind, *rest) -> list[Expr]:
        return [self._as(self.read(t, f"{path}/args/{i}", *rest), want, f"{path}/args/{i}") for i, t in enumerate(self._list(tree, "args", path))]

    @staticmethod
    def _scalar(kind: Kind, path: str) -> None:
        if kind.many or kind.name == "record":
            raise Fault(path, "scalar")

    @staticmethod
    def _text(value, path: str, longest: int = LONGEST_TEXT) -> str:
        if not isinstance(value, str) or len(value.encode("utf-8", "replace")) > longest:
            raise Fault(path, "text")
        return value

    @staticmethod
    def _name(value, path: str) -> str:
        if not isinstance(value, str) or not _NAME.match(value):
            raise Fault(path, "name")
        return value

    def _constant(self, kind: str, value, path: str) -> Expr:
        if kind == "bool" and isinstance(value, bool):
            return X.literal(value)
        if kind == "string":
            return X.literal(self._text(value, path))
        if kind == "number" and isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63:
            return X.literal(value)
        if kind == "decimal" and isinstance(value, str) and re.fullmatch(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?", value) and len(value) <= 128:
            try:
                d = Decimal(value)
            except InvalidOperation as e:
                raise Fault(path, "value") from e
            if not (value.startswith("-") and not d):
                return X.literal(d)
        raise Fault(path, "value")

    def _bool(self, tree, path, *_):
        return self._constant(tree["op"], tree["value"], path)

    _number = _string = _decimal = _bool

    def _entities(self, tree, path, *_):
        return self._source({"name": "entities"}, path)

    def _source(self, tree, path, *_):
        name = tree["name"]
        if not isinstance(name, str) or name not in self.sources:
            raise Fault(path, "undeclared source")
        return X.source(name, {**self.sources[name], f"@{name}": Kind("source")})  # no name that a statement can ask for

    def _var(self, tree, path, depth, bound):
        name = tree["name"]
        if not isinstance(name, str) or name not in bound or not name:
            raise Fault(path, "unbound variable")
        return X.var(name, bound[name])

    def _field(self, tree, path, depth, bound):
        if "of" in tree:
            of = self._part(tree, "of", path, depth, bound)
        elif "" in bound:
            of = X.var("", bound[""])
        else:
            raise Fault(path, "field without element")
        out = X.get(self._name(tree["name"], path), of)
        self.used.setdefault(of.kind.fields[-1][0][1:], set()).add(tree["name"])
        return out

    def _and(self, tree, path, *rest):
        return X.all_of(*self._parts(tree, path, BOOL, *rest))

    def _or(self, tree, path, *rest):
        return X.any_of(*self._parts(tree, path, BOOL, *rest))

    def _concat(self, tree, path, *rest):
        return X.concat(*self._parts(tree, path, STRING, *rest))

    def _not(self, tree, path, *rest):
        return X.negate(self._part(tree, "arg", path, *rest, want=BOOL))

    def _quantified(self, tree, path, depth, bound, f: Callable, key: str, want: Kind | None):
        many = self._part(tree, "input", path, depth, bound)
        if not many.kind.many:
            raise Fault(f"{path}/input", "collection")
        name = self._name(tree["as"], path) if "as" in tree else ""
        if name and name in bound:
            raise Fault(path, "variable bound twice")
        element = replace(many.kind, many=False)
        inner = self._part(tree, key, path, depth, {**bound, "": element, **({name: element} if name else {})}, want=want)
        # the builder binds under a name of this depth; both names of the element stand for it
        own = f"_{depth}"

        def body(x: Expr) -> Expr:
            both = lambda b: {**b, "": b[own], **({name: b[own]} if name else {})}
            why = None if inner.why is None else lambda b, p: inner.why(both(b), p)
            return Expr(inner.kind, lambda b: inner.build(both(b)), why)

        return f(many, own, body)

    def _all(self, tree, path, *rest):
        return self._quantified(tree, path, *rest, X.for_all, "predicate", BOOL)

    def _any(self, tree, path, *rest):
        return self._quantified(tree, path, *rest, X.for_any, "predicate", BOOL)

    def _filter(self, tree, path, *rest):
        return self._quantified(tree, path, *rest, X.keep, "predicate", BOOL)

    def _map(self, tree, path, *rest):
        out = self._quantified(tree, path, *rest, X.each, "body", None)
        self._scalar(replace(out.kind, many=False), f"{path}/body")
        return out

    def _count(self, tree, path, *rest):
        return replace(X.count(self._part(tree, "input", path, *rest)), kind=COUNTS)

    def _distinct(self, tree, path, *rest):
        return X.distinct(self._part(tree, "input", path, *rest))

    def _contains(self, tree, path, *rest):
        many = self._part(tree, "input", path, *rest)
        if not many.kind.many:
            raise Fault(f"{path}/input", "collection")
        element = replace(many.kind, many=False)
        self._scalar(element, path)
        return X.contains(many, self._part(tree, "value", path, *rest, want=element))

    def _subset(self, tree, path, *rest):
        left = self._part(tree, "left", path, *rest)
        if not left.kind.many:
            raise Fault(f"{path}/left", "collection")
        self._scalar(replace(left.kind, many=False), f"{path}/left")
        return X.subset(left, self._part(tree, "right", path, *rest, want=left.kind))

    def _compare(self, tree, path, *rest):
        left = self._part(tree, "left", path, *rest)
        self._scalar(left.kind, f"{path}/left")
        if tree["relation"] not in _RELATIONS:
            raise Fault(path, "relation")
        return X.compare(tree["relation"], left, self._part(tree, "right", path, *rest, want=left.kind))

    def _in(self, tree, path, *rest):
        value = self._part(tree, "value", path, *rest)
        self._scalar(value.kind, f"{path}/value")
        options = []
        for i, s in enumerate(self._list(tree, "set", path)):
            if not isinstance(s, dict) or s.keys() != {"type", "value"} or not isinstance(s["type"], str):
                raise Fault(f"{path}/set/{i}", "keys")
            options.append(self._as(self._constant(s["type"], s["value"], f"{path}/set/{i}"), value.kind, f"{path}/set/{i}"))
        return X.one_of(value, *options)

    def _matches(self, tree, path, *rest):
        value = self._part(tree, "value", path, *rest, want=STRING)
        pattern = self._text(tree["pattern"], path, LONGEST_PATTERN)
        try:
            re.compile(pattern)
        except re.error as e:
            raise Fault(path, "pattern") from e
        if re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
            raise Fault(path, "pattern")
        return X.matches(value, pattern)

    def _replace(self, tree, path, *rest):
        value = self._part(tree, "value", path, *rest, want=STRING)
        old, new = (self._text(tree[k], path) for k in ("from", "to"))
        if not old:
            raise Fault(path, "empty text to replace")
        return X.replace(value, X.literal(old), X.literal(new))


def decode(statement: str, sources: Mapping[str, Mapping[str, Kind]]) -> tuple[Expr, dict[str, set[str]], int]:
    """The rule that a statement is, the fields of each source that it needs, and how many nodes it has. Raises Fault."""
    if len(sources) > MOST_SOURCES:
        raise Fault("", "too many sources")
    try:
        tree = json.loads(statement, object_pairs_hook=_unique, parse_constant=_no_constant)
    except (ValueError, RecursionError) as e:
        raise Fault("", "malformed") from e
    reader = _Reader(sources)
    rule = reader.read(tree, "", 0, {})
    if rule.kind != BOOL:
        raise Fault("", "not a boolean")
    return rule, reader.used, reader.nodes


_CHECKED = "rule_id string, statement string, nodes int, fields map<string, array<string>>, path string, reason string"


def check(rules: DataFrame, sources: Mapping[str, Mapping[str, Kind]], id_col: str = "rule_id", statement_col: str = "statement") -> tuple[DataFrame, DataFrame]:
    """EXP-21. Statements in, (good ones, gaps) out: rule_id, statement, its nodes and the fields it needs by source; and
    rule_id, path and reason. A null statement is malformed; an id that is given twice is a gap for all its rows; rows without
    an id are gaps too."""
    declared = {name: dict(fields) for name, fields in sources.items()}

    def judged(statement: str) -> tuple:
        try:
            _, used, nodes = decode(statement, declared)
        except Fault as e:
            return None, None, e.path, e.what
        return nodes, [(name, sorted(fields)) for name, fields in sorted(used.items())], None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(REMEMBERED)(judged)  # rules of a catalogue often repeat a statement
        for b in batches:
            out = [known(s) if len(s) <= LONGEST_TEXT else judged(s) for s in (s or "" for s in b.column("statement").to_pylist())]
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int32(), pa.map_(pa.string(), pa.list_(pa.string())), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [*b.schema.names, "nodes", "fields", "path", "reason"])

    given = rules.select(F.col(id_col).cast("string").alias("rule_id"), F.col(statement_col).cast("string").alias("statement"))
    # few bytes and much work: not as few tasks as the table has parts
    read = given.repartition(partitions(rules.sparkSession)).mapInArrow(run, _CHECKED)
    twice = given.groupBy("rule_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 and rule_id is not null").select("rule_id", F.lit(True).alias("_twice"))
    read = read.join(twice, "rule_id", "left")
    why = F.when(F.col("rule_id").isNull(), "no id").when(F.col("_twice"), "id given twice").otherwise(F.col("reason"))
    read = read.withColumn("reason", why)
    return read.where("reason is null").select("rule_id", "statement", "nodes", "fields"), read.where("reason is not null").select("rule_id", F.coalesce("path", F.lit("")).alias("path"), "reason")


def hold(facts: DataFrame, good: DataFrame, sources: Mapping[str, Mapping[str, Kind]], keys: list[str], a_plan: int = RULES_A_PLAN) -> DataFrame:
    """keys, rule_id, holds: every good rule on every row of facts, whose array columns are the sources. holds is null where a
    part that decides is unknown.

    Equal statements are evaluated once and joined to their rules by number. Distinct statements become columns, `a_plan` of
    them in a reading of the facts, so the driver sees the distinct statements of a rule catalogue (256 nodes each at most) in
    slices."""
    spark = facts.sparkSession
    good = good.select("rule_id", "statement")
    statements = good.select("statement").distinct().orderBy("statement")
    parts, numbers, slice_ = [], [], []

    def evaluated(some: list[str]) -> None:
        first = sum(map(len, numbers))
        found = F.array(*[F.struct(F.lit(first + i).alias("n"), decode(s, sources)[0].column().alias("holds")) for i, s in enumerate(some)])
        parts.append(facts.select(*keys, F.explode(found).alias("_r")).select(*keys, "_r.n", "_r.holds"))
        numbers.append([(first + i, s) for i, s in enumerate(some)])

    for row in statements.toLocalIterator():
        slice_.append(row["statement"])
        if len(slice_) == a_plan:
            evaluated(slice_)
            slice_ = []
    if slice_:
        evaluated(slice_)
    if not parts:
        parts.append(facts.select(*keys, F.lit(0).alias("n"), F.lit(None).cast("boolean").alias("holds")).limit(0))
    results = reduce(DataFrame.unionByName, parts)
    numbered = good.join(spark.createDataFrame([x for some in numbers for x in some], "n int, statement string"), "statement").select("rule_id", "n")
    return numbered.join(results, "n").select(*keys, "rule_id", "holds")
