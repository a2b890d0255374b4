"""Registered queries: windows, sorts, sets, rule expressions, functions, graphs and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import text as T
from sluice.operators import diff, expressions as X, graph, rules, sets, statements, stats, windows
from sluice.plans import adapters as A
from sluice.plans.adapters import sql, table
from sluice.plans.queries import query
from sluice.tables import fresh_path, partitions

# --- windows -------------------------------------------------------------------------------------------------------------


def _shell_lines(spark, d):
    """Lineitems as lines of files: some are comments that look like code, some are added."""
    l = table(spark, d, "lineitem")
    n = F.row_number().over(_by_supplier())
    text = F.when(F.col("l_linenumber") % 5 < 4, F.concat(F.lit("# if x"), F.col("l_partkey").cast("string"))).otherwise("echo done")
    return l.select(F.col("l_suppkey").alias("path"), n.alias("line_no"), text.alias("text"), (F.col("l_orderkey") % 3 == 0).alias("added"))


def _by_supplier():
    from pyspark.sql import Window

    return Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query(
    "win1_commented_code",
    "SELECT path, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS n FROM (SELECT *, line_no - row_number() OVER (PARTITION BY path ORDER BY line_no) AS g FROM "
    "(SELECT l_suppkey AS path, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS line_no, l_linenumber % 5 < 4 AS code, l_orderkey % 3 = 0 AS added FROM lineitem) WHERE code) GROUP BY path, g HAVING count(*) >= 3 AND bool_or(added)",
)
def win1(spark, d):
    lines = _shell_lines(spark, d)
    return rules.commented_code(lines.select("path", "line_no", "text"), lines.where("added").select("path", "line_no"))


def _debts(spark, d):
    a = A.attempts(spark, d)
    size = F.pmod(F.col("event_id") * 7, F.lit(5)).cast("int")
    debt = F.when(F.col("event_type") != "view", F.transform(F.sequence(F.lit(0), size), lambda i: F.concat(F.lit("d"), i.cast("string"))))
    return a.select("assignment", "number", "elapsed_ms", debt.alias("debt"))


@query(
    "win2_attempt_audit",
    "SELECT assignment, number, elapsed, progress, streak, stop_after, concat_ws(',', CASE WHEN number > stop_after THEN 'continued_after_no_progress' END, CASE WHEN number > 10 OR elapsed > 3600000 THEN 'attempt_or_time_budget_exceeded' END) AS deviations FROM "
    "(SELECT *, min(CASE WHEN streak >= 3 THEN number END) OVER (PARTITION BY assignment) AS stop_after FROM (SELECT *, number - coalesce(max(CASE WHEN progress THEN number END) OVER (PARTITION BY assignment ORDER BY number), 0) AS streak FROM "
    "(SELECT assignment, number, CAST(sum(elapsed_ms) OVER (PARTITION BY assignment ORDER BY number) AS BIGINT) AS elapsed, coalesce(size < last_value(size IGNORE NULLS) OVER (PARTITION BY assignment ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS progress FROM "
    "(SELECT *, CASE WHEN event_type <> 'view' THEN (event_id * 7) % 5 END AS size FROM attempts))))",
)
def win2(spark, d):
    return windows.attempt_audit(_debts(spark, d))


@query(
    "win3_attempt_results",
    "SELECT assignment, count(*) AS attempts, arg_min_null(a, number) AS first, arg_max_null(a, number) AS last, CASE WHEN bool_or(a) THEN true WHEN count(*) > count(a) THEN NULL ELSE false END AS \"any\" FROM (SELECT assignment, number, CASE WHEN event_type <> 'click' THEN event_type = 'purchase' END AS a FROM attempts) GROUP BY assignment",
)
def win3(spark, d):
    a = A.attempts(spark, d).withColumn("accepted", F.when(F.col("event_type") != "click", F.col("event_type") == "purchase"))
    return windows.attempt_results(a)


@query(
    "win4_schedule",
    "SELECT c_nationkey AS cohort, c_custkey AS assignment, place, CASE WHEN c_custkey % 9 <> 0 THEN place + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END END AS sequence, CASE WHEN c_custkey % 9 = 0 THEN 'missing' WHEN c_custkey % 4 = 0 THEN 'moved' ELSE 'matched' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer)",
)
def win4(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "customer")
    plan = c.groupBy(F.col("c_nationkey").alias("cohort")).agg(F.array_sort(F.collect_list("c_custkey")).alias("run_order"))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    seen = c.select(F.col("c_nationkey").alias("cohort"), F.col("c_custkey").alias("assignment"), place.alias("p")).where("assignment % 9 <> 0")
    return windows.schedule_audit(plan, seen.select("cohort", "assignment", (F.col("p") + F.when(F.col("assignment") % 4 == 0, 1).otherwise(0)).alias("sequence")), ["cohort"])


@query("win5_execution_order", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE o_orderdate <= b")
def win5(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("sequence"), F.col("o_orderdate").alias("started_at"))
    return windows.execution_order(o, ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("win6_output_budget", "SELECT source, doc_id, bool_and(fits) OVER (PARTITION BY source) AS complete FROM (SELECT *, n <= 8 AND used <= 20000 AS fits FROM (SELECT source, doc_id, row_number() OVER w AS n, sum(octet_length(encode(text)) + 1) OVER w AS used FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))) QUALIFY fits")
def win6(spark, d):
    docs = table(spark, d, "documents")
    return windows.output_budget(docs, F.octet_length("text"), ["source"], ["doc_id"], 8, 20_000).select("source", "doc_id", "complete")


@query(
    "win7_greedy_fit",
    "SELECT source, used, kept, places FROM (WITH RECURSIVE r AS (SELECT source, octet_length(encode(text)) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents), "
    "f AS (SELECT source, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS kept, '' AS places FROM (SELECT DISTINCT source FROM r) UNION ALL "
    "SELECT f.source, r.n, f.used + CASE WHEN f.used + r.size <= 10000 THEN r.size ELSE 0 END, f.kept + CASE WHEN f.used + r.size <= 10000 THEN 1 ELSE 0 END, f.places || CASE WHEN f.used + r.size <= 10000 THEN CASE WHEN f.kept > 0 THEN ',' ELSE '' END || r.n ELSE '' END "
    "FROM f JOIN r ON r.source IS NOT DISTINCT FROM f.source AND r.n = f.n + 1) SELECT source, arg_max(used, n) AS used, arg_max(kept, n) AS kept, arg_max(places, n) AS places FROM f GROUP BY source)",
)
def win7(spark, d):
    docs = table(spark, d, "documents").withColumn("bytes", F.octet_length("text"))
    return windows.greedy_fit(docs, "bytes", ["source"], ["doc_id"], 10_000)


@query(
    "win7_shared_fit",
    "WITH RECURSIVE r AS (SELECT source, doc_id % 5 AS section, least(octet_length(encode(text)), 256) AS size, octet_length(encode(text)) > 256 AS cut, row_number() OVER (PARTITION BY source, doc_id % 5 ORDER BY doc_id) AS n FROM documents), "
    "s AS (SELECT source, section, count(*) AS total FROM r GROUP BY ALL), f AS (SELECT source, section, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS kept, false AS cut FROM s UNION ALL "
    "SELECT f.source, f.section, r.n, f.used + CASE WHEN f.used + r.size <= 1024 THEN r.size ELSE 0 END, f.kept + CASE WHEN f.used + r.size <= 1024 THEN 1 ELSE 0 END, f.cut OR r.cut AND f.used + r.size <= 1024 "
    "FROM f JOIN r ON r.source IS NOT DISTINCT FROM f.source AND r.section = f.section AND r.n = f.n + 1), "
    "e AS (SELECT source, section, arg_max(used, n) AS used, arg_max(kept, n) AS kept, bool_or(cut) AS cut FROM f GROUP BY ALL), "
    "g AS (SELECT q.source, q.section, coalesce(total, 0) AS total, coalesce(kept, 0) AS kept, coalesce(used, 0) AS used, coalesce(cut, false) AS cut FROM (SELECT * FROM (SELECT DISTINCT source FROM r), (SELECT unnest(range(0, 5)) AS section)) q LEFT JOIN s ON s.source IS NOT DISTINCT FROM q.source AND s.section = q.section LEFT JOIN e ON e.source IS NOT DISTINCT FROM q.source AND e.section = q.section) "
    "SELECT source, CAST(section AS VARCHAR) AS section, total, kept, total - kept AS omitted, used, bool_or(total > kept OR cut) OVER (PARTITION BY source) AS truncated FROM g",
)
def win7_shares(spark, d):
    """Texts cut to 256 bytes, in five sections that share 5,120 bytes."""
    size = F.octet_length("text")
    docs = table(spark, d, "documents").withColumn("bytes", F.least(size, F.lit(256))).withColumn("cut", size > 256).withColumn("section", (F.col("doc_id") % 5).cast("string"))
    return windows.shared_fit(docs, "bytes", ["source"], "section", ["doc_id"], 5120, list("01234"), "cut")


@query(
    "agg19_distribution_of_values",
    "SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS samples, 0 AS unknown, median(l_extendedprice) AS median, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY ALL",
)
def agg19_values(spark, d):
    return stats.distribution(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])


A.CTE["lines8"] = "SELECT l_suppkey AS path, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS line_no, CASE WHEN l_linenumber = 1 THEN 'code' WHEN l_linenumber = 4 THEN 'blank' ELSE 'comment' END AS kind FROM lineitem"


@query(
    "win8_comment_above",
    "SELECT path, symbol, start_line, min(c_line) AS first_line, max(c_line) AS last_line FROM (SELECT e.path, e.symbol, e.start_line, c.line_no AS c_line FROM (SELECT path, line_no AS start_line, line_no AS symbol FROM lines8 WHERE kind = 'code') e JOIN (SELECT path, line_no FROM lines8 WHERE kind = 'comment') c "
    "ON c.path = e.path AND c.line_no < e.start_line WHERE NOT EXISTS (SELECT 1 FROM lines8 x WHERE x.path = e.path AND x.kind = 'code' AND x.line_no > c.line_no AND x.line_no < e.start_line)) GROUP BY ALL",
)
def win8(spark, d):
    l = _kinds(spark, d)
    code = l.where("kind = 'code'").select("path", F.col("line_no").alias("symbol"), F.col("line_no").alias("start_line"))
    return rules.comment_above(l.where("kind = 'comment'"), code, l.where("kind = 'blank'"))




def _kinds(spark, d):
    l = table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    return l.select(F.col("l_suppkey").alias("path"), F.row_number().over(_by_supplier()).alias("line_no"), F.when(n == 1, "code").when(n == 4, "blank").otherwise("comment").alias("kind"))


@query("win9_first_observations", "SELECT user_id, event_id, observed FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS observed FROM events WHERE event_type = 'error') WHERE n <= 3")
def win9(spark, d):
    return windows.first_observations(table(spark, d, "events").where("event_type = 'error'"), ["user_id"], ["event_id"], 3).select("user_id", "event_id", "observed")


# --- sorts and samples ---------------------------------------------------------------------------------------------------


@query("srt1_canonical_order", "SELECT path FROM head ORDER BY path")
def srt1(spark, d):
    return A.head_files(spark, d).select("path").orderBy("path")


@query("srt2_newest_page", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100")
def srt2(spark, d):
    return windows.newest_page(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], 100, 50).select("o_orderkey")


@query("srt3_audit_sample", "SELECT decision_id FROM (SELECT decision_id, row_number() OVER (ORDER BY sha256('s1:' || decision_id), decision_id) AS n, count(*) OVER () AS c FROM judgments) WHERE n <= greatest(1, ceil(c * 0.1))")
def srt3(spark, d):
    from sluice.operators import stats

    return stats.audit_sample(A.judgments(spark, d), "s1", 0.1).select("decision_id")


@query("srt4_capped_list", "SELECT source, count(*) AS paths, string_agg(CASE WHEN n <= 3 THEN doc_id END, ',' ORDER BY p) AS shown, count(*) > 3 AS truncated FROM (SELECT source, doc_id, CAST(doc_id AS VARCHAR) AS p, row_number() OVER (PARTITION BY source ORDER BY CAST(doc_id AS VARCHAR)) AS n FROM documents) GROUP BY source")
def srt4(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("reason"), F.col("doc_id").cast("string").alias("path"))
    return diff.inventory_by_reason(docs, most=3).select(F.col("reason").alias("source"), "paths", F.array_join("shown", ",").alias("shown"), "truncated")


# --- sets ----------------------------------------------------------------------------------------------------------------


def _ids(spark, d, condition):
    return table(spark, d, "documents").where(condition).select("source", "lang")


@query("set1_chain", "SELECT lang, count(*) AS n FROM (SELECT lang FROM documents WHERE n_chars > 500 UNION ALL SELECT lang FROM documents WHERE n_chars < 900) GROUP BY lang")
def set1(spark, d):
    return sets.chain(_ids(spark, d, "n_chars > 500"), _ids(spark, d, "n_chars < 900")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("set2_difference", "SELECT source, lang FROM documents EXCEPT SELECT source, lang FROM documents WHERE n_chars > 1500")
def set2(spark, d):
    return sets.difference(_ids(spark, d, "true"), _ids(spark, d, "n_chars > 1500"))


@query("set3_subset", "SELECT count(*) AS lacking, count(*) = 0 AS subset FROM (SELECT source, lang FROM documents WHERE n_chars > 300 EXCEPT SELECT source, lang FROM documents WHERE n_chars > 1500)")
def set3(spark, d):
    return sets.subset(_ids(spark, d, "n_chars > 300"), _ids(spark, d, "n_chars > 1500"))


@query("set4_equality", "SELECT left_only, right_only, left_only + right_only = 0 AS equal FROM (SELECT (SELECT count(*) FROM (SELECT source, lang FROM documents WHERE n_chars > 900 EXCEPT SELECT source, lang FROM documents WHERE n_chars < 1500)) AS left_only, (SELECT count(*) FROM (SELECT source, lang FROM documents WHERE n_chars < 1500 EXCEPT SELECT source, lang FROM documents WHERE n_chars > 900)) AS right_only)")
def set4(spark, d):
    return sets.equal(_ids(spark, d, "n_chars > 900"), _ids(spark, d, "n_chars < 1500"))


@query("set5_disjoint", "SELECT doc_id, doc_id % 3 <> 0 AS disjoint FROM documents")
def set5(spark, d):
    a = F.array(F.col("doc_id"), F.col("doc_id") + 1)
    b = F.array(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).otherwise(-F.col("doc_id") - 5))
    return table(spark, d, "documents").select("doc_id", sets.disjoint(a, b).alias("disjoint"))


@query("set6_first_occurrences", "SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) WHERE n = 1")
def set6(spark, d):
    return sets.first_occurrences(table(spark, d, "conversations"), "role", ["turn"], ["conv_id"]).select("conv_id", "turn", "role")


@query("set7_multiset_difference", "SELECT lang, source FROM documents WHERE n_chars > 500 EXCEPT ALL SELECT lang, source FROM documents WHERE n_chars > 900")
def set7(spark, d):
    return _ids(spark, d, "n_chars > 500").exceptAll(_ids(spark, d, "n_chars > 900"))


# --- the rule language ---------------------------------------------------------------------------------------------------

_RECORD = {"type": X.STRING, "amount": X.Kind("number", dimension=("points", "exact")), "day": X.NUMBER}


def _sessions(spark, d):
    record = F.struct(F.col("event_type").alias("type"), F.round(F.col("value"), 2).cast("decimal(38,18)").alias("amount"), (F.col("event_id") % 5).cast("decimal(38,18)").alias("day"))
    e = table(spark, d, "events").repartition(partitions(spark), "user_id")  # few bytes and much work: not fewer tasks
    return e.groupBy("user_id").agg(F.collect_list(record).alias("events"))


def _points(x):
    return X.literal(x, ("points", "exact"))


@query(
    "exp_rules",
    "SELECT user_id, bool_and(round(value, 2) >= 0 AND event_type IN ('view', 'click', 'purchase', 'error', 'signup')) AND NOT bool_or(event_type = 'nothing') AS holds, count(*) FILTER (WHERE round(value, 2) > 50) AS large, "
    "count(DISTINCT event_type) AS types, bool_or(event_type = 'error') AS has_error, count(DISTINCT event_type) FILTER (WHERE NOT regexp_matches(event_type, '^[a-z]+$')) = 0 AS plain, bool_and('t:' || replace(event_type, 'e', 'E') <> 't:viEw') AS renamed FROM events GROUP BY user_id",
)
def exp_rules(spark, d):
    """EXP-1..19 in one statement: each column is a checked rule."""
    e = X.source("events", _RECORD)
    kind = X.get("type", X.var("x", X.Kind("record", fields=tuple(_RECORD.items()))))
    known = [X.literal(t) for t in ("view", "click", "purchase", "error", "signup")]
    holds = X.all_of(
        X.for_all(e, "x", lambda x: X.all_of(X.compare("ge", X.get("amount", x), _points(0)), X.one_of(X.get("type", x), *known))),
        X.negate(X.for_any(e, "x", lambda x: X.compare("eq", X.get("type", x), X.literal("nothing")))),
    )
    types = X.distinct(X.each(e, "x", lambda x: X.get("type", x)))
    large = X.count(X.keep(e, "x", lambda x: X.compare("gt", X.get("amount", x), _points(50))))
    plain = X.subset(types, X.distinct(X.each(X.keep(e, "x", lambda x: X.matches(X.get("type", x), "^[a-z]+$")), "x", lambda x: X.get("type", x))))
    renamed = X.for_all(e, "x", lambda x: X.compare("ne", X.concat(X.literal("t:"), X.replace(X.get("type", x), X.literal("e"), X.literal("E"))), X.literal("t:viEw")))
    assert kind.kind == X.STRING
    rows = X.evaluate(_sessions(spark, d), holds)
    return rows.select(
        "user_id", "holds", large.column().cast("long").alias("large"), X.count(types).column().cast("long").alias("types"), X.contains(types, X.literal("error")).column().alias("has_error"),
        plain.column().alias("plain"), renamed.column().alias("renamed"),
    )


@query("exp20_false_observations", "SELECT user_id, event_id, observed FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS observed FROM events WHERE NOT (round(value, 2) < 90 OR event_type = 'view')) WHERE n <= 64")
def exp20(spark, d):
    e = table(spark, d, "events").withColumn("amount", F.round("value", 2).cast("decimal(38,18)"))
    rule = X.any_of(X.compare("lt", X.column("amount", X.NUMBER), X.literal(90)), X.compare("eq", X.column("event_type", X.STRING), X.literal("view")))
    return windows.first_observations(X.evaluate(e, rule).where("not holds"), ["user_id"], ["event_id"]).select("user_id", "event_id", "observed")


@query(
    "exp20_traces",
    "SELECT user_id, path, type, count(*) AS n FROM (SELECT user_id, event_type AS type, unnest(list_filter([CASE WHEN NOT round(value, 2) < 90 THEN '/0/each/0' END, CASE WHEN event_type IN ('error', 'signup') THEN '/0/each/1/0' END, CASE WHEN event_type IN ('error', 'signup') THEN '/0/each/1/1' END], lambda x: x IS NOT NULL)) AS path FROM events "
    "UNION ALL SELECT user_id, NULL, '/1' FROM events GROUP BY user_id HAVING count(*) >= 40) GROUP BY ALL",
)
def exp20_traces(spark, d):
    """Which parts of a rule are false in each user's events, and of which event."""
    e = X.source("events", _RECORD)
    rule = X.all_of(
        X.for_all(e, "x", lambda x: X.all_of(
            X.compare("lt", X.get("amount", x), _points(90)),
            X.any_of(X.negate(X.one_of(X.get("type", x), X.literal("error"), X.literal("signup"))), X.compare("eq", X.get("type", x), X.literal("nothing"))),
        )),
        X.compare("lt", X.count(e), X.literal(40)),
    )
    rows = X.observations(_sessions(spark, d), rule, most=1 << 30).select("user_id", F.explode("observed").alias("o"))
    return rows.select("user_id", "o.path", F.get_json_object(F.element_at("o.bindings", "x"), "$.value.type").alias("type")).groupBy("user_id", "path", "type").agg(F.count(F.lit(1)).alias("n"))


#: Statements that a part's number chooses; {size} and {price} are the part's. Where there is a reason, it is a gap.
_STATEMENTS = [
    ('{"op":"all","input":{"op":"source","name":"events"},"predicate":{"op":"compare","relation":"le","left":{"op":"field","name":"amount"},"right":{"op":"number","value":{size}}}}', None),
    ('{"op":"compare","relation":"ge","left":{"op":"count","input":{"op":"filter","input":{"op":"source","name":"events"},"as":"x","predicate":{"op":"compare","relation":"gt","left":{"op":"field","name":"amount","of":{"op":"var","name":"x"}},"right":{"op":"decimal","value":"{size}.5"}}}},"right":{"op":"number","value":10}}', None),
    ('{"op":"contains","input":{"op":"distinct","input":{"op":"map","input":{"op":"source","name":"events"},"as":"x","body":{"op":"field","name":"type"}}},"value":{"op":"string","value":"error"}}', None),
    ('{"op":"compare","relation":"le","left":{"op":"count","input":{"op":"source","name":"events"}},"right":{"op":"string","value":"{size}"}}', "type"),
    ('{"op":"any","input":{"op":"source","name":"events"},"as":"x","predicate":{"op":"compare","relation":"eq","left":{"op":"field","name":"amount"},"right":{"op":"count","input":{"op":"source","name":"events"}}}}', "type"),
    ('{"op":"any","input":{"op":"source","name":"orders{size}"},"predicate":{"op":"bool","value":true}}', "undeclared source"),
    ('{"op":"any","input":{"op":"source","name":"events"},"as":"x","predicate":{"op":"all","input":{"op":"source","name":"events"},"as":"x","predicate":{"op":"bool","value":true}}}', "variable bound twice"),
    ('{"op":"count","input":{"op":"source","name":"events"}} {size}', "malformed"),
]
_FAULTY = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{why}'" for i, (_, why) in enumerate(_STATEMENTS) if why) + " END"


def _rules(spark, d):
    """A rule for each part."""
    form = F.element_at(F.array(*[F.lit(s) for s, _ in _STATEMENTS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), F.replace(form, F.lit("{size}"), F.col("p_size").cast("string")).alias("statement"))


@query("exp21_statement_gaps", f"SELECT CAST(p_partkey AS VARCHAR) AS rule_id, {_FAULTY} AS reason FROM part WHERE {_FAULTY} IS NOT NULL")
def exp21_gaps(spark, d):
    return statements.check(_rules(spark, d), {"events": _RECORD})[1].select("rule_id", "reason")


@query("exp21_statement_fields", "SELECT CAST(p_partkey AS VARCHAR) AS rule_id, CASE WHEN p_partkey % 8 = 2 THEN 'type' ELSE 'amount' END AS fields, CASE p_partkey % 8 WHEN 0 THEN 5 WHEN 1 THEN 9 ELSE 6 END AS nodes FROM part WHERE p_partkey % 8 < 3")
def exp21_fields(spark, d):
    good = statements.check(_rules(spark, d), {"events": _RECORD})[0]
    return good.select("rule_id", F.array_join(F.element_at("fields", "events"), ",").alias("fields"), "nodes")


@query(
    "exp21_rules_on_users",
    """WITH u AS (SELECT user_id, list(round(value, 2)) AS v, bool_or(event_type = 'error') AS e FROM events GROUP BY user_id),
    r AS (SELECT DISTINCT p_partkey % 8 AS form, CASE WHEN p_partkey % 8 < 2 THEN p_size END AS size FROM part WHERE p_partkey % 8 < 3),
    h AS (SELECT form, size, count(*) FILTER (WHERE CASE form WHEN 0 THEN len(list_filter(v, lambda x: x > size)) = 0 WHEN 1 THEN len(list_filter(v, lambda x: x > size + 0.5)) >= 10 ELSE e END) AS users FROM u, r GROUP BY ALL)
    SELECT CAST(p_partkey AS VARCHAR) AS rule_id, users FROM part JOIN h ON h.form = p_partkey % 8 AND (h.size = p_size OR h.form = 2)""",
)
def exp21_users(spark, d):
    """For how many users each part's rule holds."""
    good, _ = statements.check(_rules(spark, d), {"events": _RECORD})
    distinct = good.select(F.xxhash64("statement").cast("string").alias("rule_id"), "statement").distinct()
    held = statements.hold(_sessions(spark, d), distinct, {"events": _RECORD}, ["user_id"])
    users = held.groupBy("rule_id").agg(F.count_if("holds").alias("users"))
    return good.withColumn("of", F.xxhash64("statement").cast("string")).join(users.withColumnRenamed("rule_id", "of"), "of").select("rule_id", "users")


# --- functions -----------------------------------------------------------------------------------------------------------


@query("fn1_lines", "SELECT path, len(l) AS n FROM lined")
def fn1(spark, d):
    return A.head_files(spark, d).select("path", F.size(T.lines(F.col("content"))).alias("n"))


@query("fn2_words", r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n FROM documents")
def fn2(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("n"))


@query("fn3_extension", "SELECT page_id, ['.gz', '', '.html', ''][page_id % 4 + 1] AS ext FROM pages")
def fn3(spark, d):
    names = F.array(*[F.lit(x) for x in ("a/b.tar.GZ", "a.b/c", "x.html", "a/.hidden")])
    return table(spark, d, "pages").select("page_id", T.extension(F.element_at(names, (F.col("page_id") % 4 + 1).cast("int"))).alias("ext"))


@query("fn4_digest", "SELECT doc_id, 'sha256:' || sha256(text) AS digest FROM documents")
def fn4(spark, d):
    return table(spark, d, "documents").select("doc_id", T.digest(F.col("text")).alias("digest"))


@query("fn5_glob", "SELECT page_id, regexp_matches(url, '^https?://[^/]*/(?:[^/]+/)*[^/]*1[^/]*$') AS hit FROM pages")
def fn5(spark, d):
    return table(spark, d, "pages").select("page_id", T.any_glob(F.col("url"), ["{http,https}://*/**/*1*"]).alias("hit"))


@query("fn6_fields", "SELECT conv_id, turn, role AS who, CASE WHEN turn % 2 = 0 THEN '' ELSE 'a b' END AS note FROM conversations")
def fn6(spark, d):
    text = F.concat(F.lit("who: "), "role", F.when(F.col("turn") % 2 == 0, "; note=x, note=y").otherwise("; note = 'a b'"))
    m = T.fields(text)
    return table(spark, d, "conversations").select("conv_id", "turn", F.element_at(m, "who").alias("who"), F.element_at(m, "note").alias("note"))


@query("fn7_exact_decimal", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_size + 0.5 END AS value FROM part")
def fn7(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 3 == 0, F.concat(s, F.lit(".5"))).when(k % 3 == 1, F.concat(F.lit("0"), s)).otherwise(F.concat(s, F.lit("e3")))
    return table(spark, d, "part").select(k.alias("id"), T.exact_decimal(text).cast("double").alias("value"))


@query("fn8_cjk", "SELECT doc_id, regexp_matches(text, '[㐀-鿿]') AS cjk, len(regexp_extract_all(text, '[A-Za-z]+')) AS words FROM documents")
def fn8(spark, d):
    return table(spark, d, "documents").select("doc_id", T.has_cjk(F.col("text")).alias("cjk"), T.ascii_words(F.col("text")).alias("words"))


@query(
    "fn9_truncate",
    "SELECT doc_id, n, octet_length(encode(left(text, n))) AS bytes, octet_length(encode(text)) > 256 AS truncated FROM (SELECT doc_id, text, (SELECT max(k) FROM range(0, 257) r(k) WHERE k <= length(text) AND octet_length(encode(left(text, k))) <= 256) AS n FROM documents)",
)
def fn9(spark, d):
    t = T.truncated_utf8(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(t["text"]).alias("n"), F.octet_length(t["text"]).alias("bytes"), t["truncated"].alias("truncated"))


@query("fn10_one_line", r"SELECT doc_id, length(t) AS n, sha256(CASE WHEN length(t) > 512 THEN left(t, 512) || '…' ELSE t END) AS digest FROM (SELECT doc_id, regexp_replace(text, '[\x00-\x1F\x7F-\x{9F}\x{2028}\x{2029}]', ' ', 'g') AS t FROM documents)")
def fn10(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").alias("n"), F.sha2(T.one_line(F.col("text")), 256).alias("digest"))


@query("fn11_branch_counts", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_size % 7 END AS hit, CASE WHEN p_size % 2 = 0 THEN 7 END AS found FROM part")
def fn11(spark, d):
    s = F.col("p_size")
    text = F.when(s % 2 == 0, F.concat(F.lit("50% ("), (s % 7).cast("string"), F.lit("/7)"))).otherwise("50% of (9/7)")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.branch_counts(text).alias("b")).select("id", "b.hit", "b.found")


@query("fn12_interpreter", "SELECT page_id, ['bash', 'sh', 'python3', ''][page_id % 4 + 1] AS program FROM pages")
def fn12(spark, d):
    names = F.array(*[F.lit(x) for x in ("#!/usr/bin/env -S bash -eu", "#! /bin/sh", "#!/usr/bin/env A=1 python3", "echo #!/bin/sh")])
    return table(spark, d, "pages").select("page_id", T.interpreter(F.element_at(names, (F.col("page_id") % 4 + 1).cast("int"))).alias("program"))


@query("fn13_marker_line", "SELECT page_id, page_id % 4 < 2 AS marker FROM pages")
def fn13(spark, d):
    names = F.array(*[F.lit(x) for x in ("/* @ai: yes", "# @ai(me)", "// @air", "x @ai")])
    return table(spark, d, "pages").select("page_id", T.marker_line(F.element_at(names, (F.col("page_id") % 4 + 1).cast("int")), "@ai").alias("marker"))


# The same functions on the words and lines of real texts, where most have another form.

A.CTE["spoken"] = r"SELECT doc_id, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS w FROM documents"
A.CTE["written"] = r"SELECT doc_id, unnest(CASE WHEN text = '' THEN [] ELSE string_split_regex(regexp_replace(text, '\r?\n\z', ''), '\r?\n') END) AS l FROM documents"


def _spoken(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.filter(F.split("text", r"\s+", -1), lambda x: x != "")).alias("w"))


def _written(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(T.lines(F.col("text"))).alias("l"))


@query("fn3_extensions_of_words", r"SELECT lower(regexp_extract(w, '[^/](\.[^./]+)$', 1)) AS ext, count(*) AS n FROM spoken GROUP BY ALL")
def fn3_words(spark, d):
    return _spoken(spark, d).groupBy(T.extension(F.col("w")).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


@query("fn7_decimals_in_texts", r"SELECT doc_id, count(*) AS words, count(v) AS decimals, CAST(max(v) AS DOUBLE) AS largest FROM (SELECT doc_id, CASE WHEN regexp_matches(w, '^-?(?:0|[1-9][0-9]*)(?:\.[0-9]{1,18})?$') THEN try_cast(w AS DECIMAL(38, 18)) END AS v FROM spoken) GROUP BY doc_id")
def fn7_words(spark, d):
    w = _spoken(spark, d).select("doc_id", T.exact_decimal(F.col("w")).alias("v"))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.count("v").alias("decimals"), F.max("v").cast("double").alias("largest"))


@query(
    "fn12_interpreters_of_lines",
    r"SELECT doc_id, program, count(*) AS n FROM (SELECT doc_id, CASE WHEN e <> '' THEN e ELSE regexp_extract(s, '^#!\s*(?:\S*/)?([^\s/]+)', 1) END AS program FROM "
    r"(SELECT *, regexp_extract(s, '^#!\s*\S*/env\s+(?:-S\s+)?(?:\S+=\S*\s+)*([^\s/]+)', 1) AS e FROM (SELECT doc_id, CASE length(l) % 3 WHEN 0 THEN '#!/usr/bin/env ' WHEN 1 THEN '#! /opt/' ELSE '' END || l AS s FROM written))) GROUP BY ALL",
)
def fn12_lines(spark, d):
    n = F.length("l") % 3
    s = F.concat(F.when(n == 0, "#!/usr/bin/env ").when(n == 1, "#! /opt/").otherwise(""), "l")
    return _written(spark, d).select("doc_id", T.interpreter(s).alias("program")).groupBy("doc_id", "program").agg(F.count(F.lit(1)).alias("n"))


@query("fn13_markers_in_texts", r"SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE regexp_matches(l, '^[\s/*#]*De(?:$|[ :(])')) AS markers FROM written GROUP BY doc_id")
def fn13_lines(spark, d):
    return _written(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(T.marker_line(F.col("l"), "De")).alias("markers"))


# --- graphs --------------------------------------------------------------------------------------------------------------


@query("grf1_closure", "SELECT root, id, depth FROM (WITH RECURSIVE w AS (SELECT p_partkey AS root, p_partkey AS id, 0 AS depth FROM part UNION ALL SELECT root, id // 2, depth + 1 FROM w WHERE id > 1) SELECT * FROM w)")
def grf1(spark, d):
    return graph.closure(A.check_edges(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("root")))


@query("grf2_levels", "SELECT p_partkey AS id, length(bin(greatest(p_partkey, 1))) - 1 AS level FROM part")
def grf2(spark, d):
    return graph.levels(table(spark, d, "part").select(F.col("p_partkey").alias("id")), A.check_edges(spark, d))[0]


@query("grf3_blocked", "SELECT DISTINCT id FROM (WITH RECURSIVE w AS (SELECT p_partkey AS id, p_partkey AS up FROM part UNION ALL SELECT id, up // 2 FROM w WHERE up > 1) SELECT w.id FROM w JOIN part p ON p.p_partkey = w.up WHERE w.up <> w.id AND p.p_size = 7)")
def grf3(spark, d):
    return graph.blocked(table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") != 7).alias("passed")), A.check_edges(spark, d))


@query("grf4_prerequisites", "SELECT DISTINCT id FROM (WITH RECURSIVE w AS (SELECT p_partkey AS id FROM part WHERE p_size = 9 UNION ALL SELECT id // 2 FROM w WHERE id > 1) SELECT id FROM w)")
def grf4(spark, d):
    return graph.prerequisites(A.check_edges(spark, d), table(spark, d, "part").where("p_size = 9").select(F.col("p_partkey").alias("id")))


def _history(spark, d):
    """Parts as commits of a tree; each holds two entities, whose bytes change now and then."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    commits = p.select(k.alias("oid"), F.when(k > 1, F.array(F.expr("p_partkey div 2"))).otherwise(F.array().cast("array<bigint>")).alias("parents"))
    e = p.select(k.alias("oid"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("entity"), "p_size")
    return commits, e.select("oid", "entity", F.when(F.col("entity") == "a", F.expr("(length(bin(greatest(oid, 1))) - 1) div 3")).otherwise(F.col("p_size") % 2).cast("long").alias("bytes"))


A.CTE["ent_g"] = "SELECT p_partkey AS oid, e AS entity, CASE WHEN e = 'a' THEN (length(bin(greatest(p_partkey, 1))) - 1) // 3 ELSE p_size % 2 END AS bytes FROM part, (SELECT unnest(['a', 'b']) AS e)"
A.CTE["origins"] = "SELECT oid, entity, bytes, oid AS origin FROM ent_g g WHERE NOT EXISTS (SELECT 1 FROM ent_g x WHERE g.oid > 1 AND x.oid = g.oid // 2 AND x.entity = g.entity AND x.bytes = g.bytes) UNION ALL SELECT g.oid, g.entity, g.bytes, o.origin FROM origins o JOIN ent_g g ON g.oid > 1 AND g.oid // 2 = o.oid AND g.entity = o.entity AND g.bytes = o.bytes"


def _origins(spark, d):
    commits, e = _history(spark, d)
    return graph.origins(commits, e, graph.levels(commits.select(F.col("oid").alias("id")), A.check_edges(spark, d))[0].select(F.col("id").alias("oid"), "level"))


@query("grf5_origins", "SELECT oid, entity, origin FROM origins")
def grf5(spark, d):
    return _origins(spark, d)


@query("grf6_declarations", "SELECT oid, entity, 't' || origin AS value FROM origins WHERE origin % 3 <> 0")
def grf6(spark, d):
    p = table(spark, d, "part")
    trailers = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("oid"), F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("value"))
    twice = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("oid"), F.lit("x").alias("value"))
    return graph.declarations(_origins(spark, d), trailers.unionByName(twice).unionByName(twice))[0]


@query("grf7_contamination", "SELECT id, why FROM (WITH RECURSIVE w AS (SELECT p_partkey AS id, p_partkey AS up FROM part UNION ALL SELECT id, up // 2 FROM w WHERE up > 1) SELECT DISTINCT w.id, 'descends' AS why FROM w JOIN part u ON u.p_partkey = w.up JOIN part s ON s.p_partkey = w.id WHERE u.p_size = 3 AND s.p_size > 10) UNION ALL SELECT p_partkey, 'shares_source' FROM part WHERE p_size > 10 AND p_name IN (SELECT p_name FROM part WHERE p_size = 3)")
def grf7(spark, d):
    s = F.col("p_size")
    cases = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(s == 3, "generated").when(s > 10, "independent").otherwise("other").alias("kind"), F.col("p_name").alias("source"))
    return graph.contaminated(cases, A.check_edges(spark, d))


@query("grf8_participation", "SELECT DISTINCT oid, entity FROM origins WHERE origin % 4 = 1")
def grf8(spark, d):
    actors = table(spark, d, "part").select(F.col("p_partkey").alias("oid"), F.when(F.col("p_partkey") % 4 == 1, "agent").otherwise("human").alias("kind"))
    return graph.participated(_origins(spark, d), actors)


# --- the stream ----------------------------------------------------------------------------------------------------------


@query(
    "st1_attempt_stream",
    "SELECT *, concat_ws(',', CASE WHEN number > stop_after THEN 'continued_after_no_progress' END, CASE WHEN number > 10 OR elapsed > 3600000 THEN 'attempt_or_time_budget_exceeded' END) AS deviations FROM ("
    "SELECT assignment, number, elapsed, progress, streak, min(CASE WHEN streak >= 3 THEN number END) OVER (PARTITION BY assignment ORDER BY number) AS stop_after FROM (SELECT *, number - coalesce(max(CASE WHEN progress THEN number END) OVER (PARTITION BY assignment ORDER BY number), 0) AS streak FROM "
    "(SELECT assignment, number, CAST(sum(elapsed_ms) OVER (PARTITION BY assignment ORDER BY number) AS BIGINT) AS elapsed, coalesce(size < last_value(size IGNORE NULLS) OVER (PARTITION BY assignment ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS progress FROM "
    "(SELECT *, CASE WHEN event_type <> 'view' THEN (event_id * 7) % 5 END AS size FROM attempts))))",
)
def st1(spark, d):
    """The batch audit's rows from a stream over files of attempts in the shared folder."""
    from sluice.streaming.attempts import audit_stream

    at = fresh_path(spark, "stream")
    rows = _debts(spark, d)
    rows.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
    out = audit_stream(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.parquet(f"{at}/out").select("assignment", "number", "elapsed", "progress", "streak", "stop_after", "deviations")
