"""Rule statements as data: what is a gap, and what good ones say."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sluice.operators import expressions as X, statements

MS = X.Kind("number", dimension=("ms", "wall"))
SOURCES = {"runs": {"name": X.STRING, "time": MS, "cpu": X.Kind("number", dimension=("ms", "cpu")), "ok": X.BOOL}, "hosts": {"name": X.STRING}}


def _op(op, **parts):
    return {"op": op} | {k.rstrip("_"): v for k, v in parts.items()}


RUNS, HOSTS = _op("source", name="runs"), _op("source", name="hosts")
NAME, TIME = _op("field", name="name"), _op("field", name="time")
TRUE, ONE = _op("bool", value=True), _op("number", value=1)


def _every(predicate, **more):
    return _op("all", input=RUNS, predicate=predicate, **more)


def _less(left, right):
    return _op("compare", left=left, relation="lt", right=right)


DEEP = TRUE
for _ in range(17):
    DEEP = _op("not", arg=DEEP)
BAD = [
    (ONE, "", "not a boolean"), (RUNS, "", "not a boolean"), (_op("nothing"), "", "unknown op"), ([], "", "unknown op"), (_op("not"), "", "keys"), (_op("not", arg=TRUE, more=1), "", "keys"), (_op("not", arg=ONE), "/arg", "type"),
    (_op("and", args=[]), "", "list"), (_op("and", args=[TRUE] * 65), "", "list"), (_op("or", args=[TRUE, ONE]), "/args/1", "type"), (DEEP, "/arg" * 17, "too deep"), (_op("and", args=[_op("and", args=[TRUE] * 63)] * 5), None, "too many nodes"),
    (_every(_less(TIME, _op("field", name="cpu"))), "/predicate/right", "type"), (_every(_less(TIME, _op("count", input=RUNS))), "/predicate/right", "type"), (_every(_less(NAME, NAME)), "/predicate", "order is for numbers"), (_less(TIME, ONE), "/left", "field without element"),
    (_every(_op("field", name="age")), "/predicate", "no field age"), (_every(_op("field", name="@runs")), "/predicate", "name"), (_every(TRUE, as_="1x"), "", "name"), (_every(_every(TRUE, as_="r"), as_="r"), "/predicate", "variable bound twice"), (_op("var", name="r"), "", "unbound variable"),
    (_op("any", input=_op("source", name="others"), predicate=TRUE), "/input", "undeclared source"), (_op("any", input=ONE, predicate=TRUE), "/input", "collection"), (_op("any", input=_op("entities"), predicate=TRUE), "/input", "undeclared source"),
    (_op("contains", input=RUNS, value=ONE), "", "scalar"), (_op("subset", left=_op("map", input=RUNS, as_="r", body=NAME), right=_op("map", input=RUNS, as_="r", body=TIME)), "/right", "type"), (_op("any", input=_op("map", input=RUNS, as_="r", body=_op("var", name="r")), predicate=TRUE), "/input/body", "scalar"),
    (_op("compare", left=ONE, relation="like", right=ONE), "", "relation"), (_op("in", value=ONE, set=[{"type": "number", "value": "1"}]), "/set/0", "value"), (_op("in", value=ONE, set=[{"type": "string", "value": "1"}]), "/set/0", "type"), (_op("in", value=ONE, set=[{"value": 1}]), "/set/0", "keys"),
    (_op("matches", value=_op("string", value="a"), pattern="("), "", "pattern"), (_op("matches", value=_op("string", value="a"), pattern=r"(a)\1"), "", "pattern"), (_op("matches", value=_op("string", value="a"), pattern="(?=a)"), "", "no look-around"), (_op("matches", value=_op("string", value="a"), pattern="a" * 1025), "", "text"),
    (_op("compare", left=_op("replace", value=_op("string", value="a"), from_="", to="b"), relation="eq", right=_op("string", value="a")), "/left", "empty text to replace"), (_less(_op("number", value=True), ONE), "/left", "value"), (_less(_op("decimal", value="01"), ONE), "/left", "value"), (_less(_op("decimal", value="-0.0"), ONE), "/left", "value"),
]


def test_faults_are_gaps_with_their_place(spark):
    given = [(str(i), json.dumps(s)) for i, (s, _, _) in enumerate(BAD)]
    given += [("m0", None), ("m1", "{"), ("m2", '{"op":"bool","value":true} x'), ("m3", '{"op":"bool","value":true,"value":true}'), ("m4", '{"op":"number","value":NaN}'), ("m5", "[" * 100_000), (None, json.dumps(TRUE)), ("d", json.dumps(TRUE)), ("d", json.dumps(TRUE)), ("good", json.dumps(TRUE))]
    good, gaps = statements.check(spark.createDataFrame(given, "rule_id string, statement string"), SOURCES)
    assert [r.rule_id for r in good.collect()] == ["good"]
    got = {r.rule_id: (r.path, r.reason) for r in gaps.collect()}
    for i, (_, path, reason) in enumerate(BAD):
        assert got[str(i)][1] == reason and path in (None, got[str(i)][0]), (i, got[str(i)])
    assert {k: v[1] for k, v in got.items() if not (k or "").isdigit()} == {**{f"m{i}": "malformed" for i in range(6)}, None: "no id", "d": "id given twice"}


def test_good_statements_say_what_they_say(spark):
    some = [{"name": "a", "time": Decimal(5), "cpu": Decimal(1), "ok": True}, {"name": "b", "time": Decimal(20), "cpu": Decimal(2), "ok": True}]
    facts = spark.createDataFrame([(1, some, [{"name": "a"}]), (2, [], []), (3, some[:1], [{"name": "a"}, {"name": "c"}])], "id int, runs array<struct<name: string, time: decimal(38,18), cpu: decimal(38,18), ok: boolean>>, hosts array<struct<name: string>>")
    names = lambda s: _op("map", input=s, as_="r", body=_op("field", name="name", of=_op("var", name="r")))
    on_host = _op("any", input=HOSTS, as_="h", predicate=_op("compare", relation="eq", left=_op("field", name="name", of=_op("var", name="h")), right=_op("field", name="name", of=_op("var", name="r"))))
    rules = {
        "fast": (_every(_less(TIME, _op("decimal", value="10.5"))), [2, 3]), "ok": (_every(_op("field", name="ok")), [1, 2, 3]), "few": (_less(_op("count", input=RUNS), _op("number", value=2)), [2, 3]),
        "hosted": (_every(on_host, as_="r"), [2, 3]), "names": (_op("subset", left=names(RUNS), right=names(HOSTS)), [2, 3]), "has b": (_op("contains", input=_op("distinct", input=names(RUNS)), value=_op("string", value="b")), [1]),
        "both": (_op("and", args=[_op("not", arg=_op("matches", value=_op("concat", args=[_op("string", value="x"), _op("replace", value=_op("string", value="aa"), from_="a", to="b")]), pattern="^xa")), _op("in", value=_op("count", input=_op("filter", input=RUNS, predicate=_less(ONE, TIME))), set=[{"type": "number", "value": 2}, {"type": "decimal", "value": "0"}])]), [1, 2]),
        "same as ok": (_every(_op("field", name="ok")), [1, 2, 3]),
    }
    table = spark.createDataFrame([(k, json.dumps(s)) for k, (s, _) in rules.items()], "rule_id string, statement string")
    good, gaps = statements.check(table, SOURCES)
    assert gaps.count() == 0 and good.where("rule_id = 'hosted'").first()["fields"] == {"runs": ["name"], "hosts": ["name"]}
    for a_plan in (2, 64):
        held = statements.hold(facts, good, SOURCES, ["id"], a_plan).groupBy("rule_id").agg(F.sort_array(F.collect_list(F.when(F.col("holds"), F.col("id")))).alias("ids"))
        assert {r.rule_id: r.ids for r in held.collect()} == {k: ids for k, (_, ids) in rules.items()}
    assert statements.hold(facts, good.limit(0), SOURCES, ["id"]).count() == 0


def test_too_many_sources():
    with pytest.raises(statements.Fault, match="too many sources"):
        statements.decode("{}", {f"s{i}": {} for i in range(17)})


def test_repeated_statements_in_one_partition(spark):
    """2,000 rules of three statements, all in one part of their table, are read in several tasks."""
    rules = spark.range(0, 2000, 1, 1).selectExpr("id AS rule_id", """CASE id % 3 WHEN 0 THEN '{"op":"bool","value":true}' WHEN 1 THEN '{"op":"bool","value":false}' END AS statement""")
    good, gaps = statements.check(rules, {})
    assert good.rdd.getNumPartitions() >= 4
    assert good.groupBy("statement", "nodes").count().count() == 2 and {tuple(r) for r in gaps.groupBy("path", "reason").count().collect()} == {("", "malformed", 666)}
    got = statements.hold(spark.range(3).withColumnRenamed("id", "k"), good, {}, ["k"])
    assert {tuple(r) for r in got.groupBy("k", "holds").count().collect()} == {(k, h, 667) for k in range(3) for h in (True, False)}
