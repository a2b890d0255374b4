"""Fact tables made from the star-schema tables, in Spark and, as common table expressions, in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.functions import text as T
from sluice.operators import diff, gates
from sluice.tables import keep

Facts = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _path(prefix=None):
    parts = [F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")]
    return F.concat(*([prefix] if prefix is not None else []), *parts)


def base_files(spark, d):
    return table(spark, d, "documents").where("doc_id % 10 <> 0").select(_path().alias("path"), F.col("text").alias("content"))


def head_files(spark, d):
    m = F.col("doc_id") % 10
    text = F.when(m == 2, F.concat("text", F.lit("\nTODO: check"))).otherwise(F.col("text"))
    path = _path(F.when(m == 3, "moved/").otherwise(""))
    return table(spark, d, "documents").where("doc_id % 10 <> 1").select(path.alias("path"), text.alias("content"))


def changes(spark, d):
    return diff.snapshot_diff(base_files(spark, d), head_files(spark, d))


def numbered(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(T.lines(F.col("content"))).alias("n", "text")).select("path", (F.col("n") + 1).alias("line_no"), "text")


def head_lines(spark, d):
    return numbered(head_files(spark, d))


def added_lines(spark, d):
    """All lines of added files, and those of modified ones that the line diff finds."""
    kinds = changes(spark, d).where("kind in ('added', 'modified')").select("path", "kind")
    files = keep(head_files(spark, d).join(kinds, "path"), "changed")
    old = base_files(spark, d).select("path", F.col("content").alias("old"))
    fresh = diff.line_diff(files.where("kind = 'modified'").select("path", F.col("content").alias("new")).join(old, "path")).where("op = 'added'").select("path", "line_no")
    added, edited = (numbered(files.where(F.col("kind") == k)) for k in ("added", "modified"))
    edited = edited.join(fresh, ["path", "line_no"])
    return added.withColumn("kind", F.lit("added")).unionByName(edited.withColumn("kind", F.lit("modified"))).select("path", "kind", "line_no", "text")


def issues(spark, d):
    e = table(spark, d, "events")
    half = F.broadcast(e.agg(F.max("event_id").alias("_last")))  # one row
    return e.crossJoin(half).select(
        F.when(F.col("event_id") * 2 <= F.col("_last"), "base").otherwise("head").alias("side"), "event_id",
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("tool"), F.concat(F.lit("r"), (F.col("user_id") % 7).cast("string")).alias("rule"),
        F.col("user_id").cast("string").alias("file"),
    )


def coverage(spark, d):
    l = table(spark, d, "lineitem")
    found = F.col("l_quantity").cast("int") % 4
    return l.select(
        F.col("l_suppkey").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), (F.col("l_returnflag") == "R").cast("int").cast("long").alias("hits"),
        found.alias("branches_found"), F.least(found, F.col("l_linenumber") % 4).alias("branches_hit"), (F.col("l_linestatus") == "F").alias("excluded"),
    )


def test_cases(spark, d):
    o = table(spark, d, "orders")
    outcome = F.when(F.col("o_orderstatus") == "F", "failure").when(F.col("o_orderstatus") == "P", "passed").otherwise("skipped")
    return o.select((F.col("o_custkey") % 100).alias("file"), F.col("o_orderkey").alias("name"), outcome.alias("outcome"))


def checks(spark, d):
    s = F.col("o_orderstatus")
    verdict = F.when(s == "F", "fail").when(s == "P", "pass")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3 != 0).alias("required"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "error").otherwise("warning").alias("severity"), F.lit("applicable").alias("applicability"),
        F.when(verdict.isNull(), "failed").otherwise("completed").alias("status"), F.lit(None).cast("string").alias("reason"), verdict.alias("verdict"),
        F.when(s == "F", 1).otherwise(0).cast("long").alias("finding_count"),
    )


def attempts(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(
        F.col("user_id").alias("assignment"), n.alias("number"), F.floor(F.col("value") * 100).cast("long").alias("elapsed_ms"), (F.col("event_type") != "error").alias("completed"),
        F.when(F.col("event_type") != "click", F.floor(F.col("value") * 10).cast("long")).alias("check_elapsed_ms"), "event_type", "event_id",
    )


def dependencies(spark, d):
    l, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    n, p = table(spark, d, "nation"), table(spark, d, "part")
    return l.join(s, l.l_suppkey == s.s_suppkey).join(n, n.n_nationkey == s.s_nationkey).join(p, p.p_partkey == l.l_partkey).select(
        F.col("n_name").alias("root"), F.col("p_brand").alias("artifact"), F.col("l_returnflag").alias("scope")
    )


def judgments(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("decision_id"), (((F.col("doc_id") * 37) % 101).cast("double") / 100).alias("probability"), (F.col("quality") == 1).alias("label"),
        F.col("source").alias("rule"), F.col("lang").alias("language"), F.lit(0.5).alias("threshold"),
    )


def eval_cases(spark, d):
    k = F.col("o_orderkey")
    cents = F.floor(F.col("o_totalprice")).cast("long")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("repo"), k.alias("id"), F.element_at(F.array(F.lit("replay"), F.lit("held_out"), F.lit("anchor")), (k % 3 + 1).cast("int")).alias("kind"),
        (F.col("o_orderstatus") != "P").alias("base_complete"), (cents % 10).alias("base_mismatches"), F.lit(True).alias("cand_complete"), (F.expr("floor(o_totalprice / 10)").cast("long") % 10).alias("cand_mismatches"),
    )


def check_edges(spark, d):
    p = table(spark, d, "part")
    return p.where("p_partkey > 1").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 2").alias("depends_on"))


def entities(spark, d, side: str):
    docs = table(spark, d, "documents")
    m = F.col("doc_id") % 10
    docs = docs.where(m != (0 if side == "base" else 1))
    path = F.when((m == 3) & F.lit(side == "head"), F.concat(F.lit("moved/"), "source")).otherwise(F.col("source"))
    text = F.when((m == 2) & F.lit(side == "head"), F.concat("text", F.lit("+"))).otherwise(F.col("text"))
    symbol = F.when((m == 4) & F.lit(side == "head"), -F.col("doc_id")).otherwise(F.col("doc_id")).cast("string")
    return docs.select(
        path.alias("path"), F.col("lang").alias("language"), symbol.alias("symbol"), F.col("doc_id").alias("ord"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"),
        F.sha2(text, 256).alias("body_digest"), F.lit("").alias("annotations"), F.sha2(F.concat("lang", F.expr("cast(n_chars div 100 as string)")), 256).alias("shape_digest"), text.alias("text"),
    )


def ratchet(spark, d):
    rows = issues(spark, d)
    return gates.ratchet(gates.bucket_counts(rows.where("side = 'base'")), gates.bucket_counts(rows.where("side = 'head'")))


_LINES = r"CASE WHEN content = '' THEN [] ELSE string_split_regex(regexp_replace(content, '\r?\n\z', ''), '\r?\n') END"

#: The same tables in SQL; each may use those before it.
CTE: dict[str, str] = {
    "base": "SELECT concat(source, '/', lang, '/', doc_id, '.txt') AS path, text AS content FROM documents WHERE doc_id % 10 <> 0",
    "head": "SELECT concat(CASE WHEN doc_id % 10 = 3 THEN 'moved/' ELSE '' END, source, '/', lang, '/', doc_id, '.txt') AS path, "
    "CASE WHEN doc_id % 10 = 2 THEN text || chr(10) || 'TODO: check' ELSE text END AS content FROM documents WHERE doc_id % 10 <> 1",
    "pair": "SELECT coalesce(b.path, h.path) AS path, b.content AS was, h.content AS now FROM base b FULL JOIN head h ON b.path = h.path",
    "gone": "SELECT path AS old_path, was, row_number() OVER (PARTITION BY was ORDER BY path) AS n FROM pair WHERE now IS NULL",
    "fresh": "SELECT path, now, row_number() OVER (PARTITION BY now ORDER BY path) AS n FROM pair WHERE was IS NULL",
    "changes": "SELECT path, CASE WHEN was = now THEN 'unchanged' ELSE 'modified' END AS kind, path AS old_path FROM pair WHERE was IS NOT NULL AND now IS NOT NULL "
    "UNION ALL SELECT coalesce(f.path, g.old_path), CASE WHEN f.path IS NULL THEN 'deleted' WHEN g.old_path IS NULL THEN 'added' ELSE 'renamed' END, g.old_path "
    "FROM gone g FULL JOIN fresh f ON g.was = f.now AND g.n = f.n",
    "lined": f"SELECT path, {_LINES} AS l FROM head",
    "head_lines": "SELECT path, unnest(l) AS text, generate_subscripts(l, 1) AS line_no, len(l) AS of FROM lined",
    "added_lines": "SELECT h.path, c.kind, h.line_no, h.text FROM head_lines h JOIN changes c ON c.path = h.path WHERE c.kind = 'added' OR c.kind = 'modified' AND h.line_no >= h.of - 1",
    "issues": "SELECT CASE WHEN event_id * 2 <= (SELECT max(event_id) FROM events) THEN 'base' ELSE 'head' END AS side, event_id, "
    "nullif(event_type, 'view') AS tool, 'r' || (user_id % 7) AS rule, CAST(user_id AS VARCHAR) AS file FROM events",
    "counts_b": "SELECT tool, rule, count(*) AS n FROM issues WHERE side = 'base' GROUP BY ALL",
    "counts_h": "SELECT tool, rule, count(*) AS n FROM issues WHERE side = 'head' GROUP BY ALL",
    "ratchet": "SELECT coalesce(b.tool, h.tool) AS tool, coalesce(b.rule, h.rule) AS rule, coalesce(b.n, 0) AS baseline, coalesce(h.n, 0) AS current, "
    "coalesce(h.n, 0) > coalesce(b.n, 0) AS increased FROM counts_b b FULL JOIN counts_h h ON b.tool IS NOT DISTINCT FROM h.tool AND b.rule = h.rule",
    "coverage": "SELECT l_suppkey AS file, l_orderkey * 10 + l_linenumber AS line, CAST(l_returnflag = 'R' AS BIGINT) AS hits, CAST(trunc(l_quantity) AS INT) % 4 AS branches_found, "
    "least(CAST(trunc(l_quantity) AS INT) % 4, l_linenumber % 4) AS branches_hit, l_linestatus = 'F' AS excluded FROM lineitem",
    "cases": "SELECT o_custkey % 100 AS file, o_orderkey AS name, CASE o_orderstatus WHEN 'F' THEN 'failure' WHEN 'P' THEN 'passed' ELSE 'skipped' END AS outcome FROM orders",
    "checks": "SELECT o_custkey AS repo, o_orderkey AS id, o_orderkey % 3 <> 0 AS required, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'error' ELSE 'warning' END AS severity, "
    "CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'P' THEN 'pass' END AS verdict, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS finding_count FROM orders",
    "attempts": "SELECT user_id AS assignment, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number, CAST(floor(value * 100) AS BIGINT) AS elapsed_ms, event_type <> 'error' AS completed, "
    "CASE WHEN event_type <> 'click' THEN CAST(floor(value * 10) AS BIGINT) END AS check_elapsed_ms, event_type, event_id FROM events",
    "deps": "SELECT n_name AS root, p_brand AS artifact, l_returnflag AS scope FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey",
    "judgments": "SELECT doc_id AS decision_id, CAST((doc_id * 37) % 101 AS DOUBLE) / 100 AS probability, quality = 1 AS label, source AS rule, lang AS language, 0.5 AS threshold FROM documents JOIN labels USING (doc_id)",
    "eval_cases": "SELECT o_custkey AS repo, o_orderkey AS id, ['replay', 'held_out', 'anchor'][o_orderkey % 3 + 1] AS kind, o_orderstatus <> 'P' AS base_complete, CAST(floor(o_totalprice) AS BIGINT) % 10 AS base_mismatches, "
    "true AS cand_complete, CAST(floor(o_totalprice / 10) AS BIGINT) % 10 AS cand_mismatches FROM orders",
    "edges": "SELECT p_partkey AS id, p_partkey // 2 AS depends_on FROM part WHERE p_partkey > 1",
    "grams": r"SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM "
    r"(SELECT min(doc_id) AS id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents GROUP BY text)",
    "gram_counts": "SELECT id, count(*) AS n FROM grams GROUP BY id",
    "ent_b": "SELECT source AS path, lang AS language, CAST(doc_id AS VARCHAR) AS symbol, doc_id AS ord, sha256(text) AS body_digest FROM documents WHERE doc_id % 10 <> 0",
    "ent_h": "SELECT CASE WHEN doc_id % 10 = 3 THEN 'moved/' ELSE '' END || source AS path, lang AS language, CAST(CASE WHEN doc_id % 10 = 4 THEN -doc_id ELSE doc_id END AS VARCHAR) AS symbol, doc_id AS ord, "
    "sha256(CASE WHEN doc_id % 10 = 2 THEN text || '+' ELSE text END) AS body_digest, 'doc_' || doc_id AS name, sha256(lang || (n_chars // 100)) AS shape_digest FROM documents WHERE doc_id % 10 <> 1",
}


def sql(final: str) -> str:
    """A statement with the tables it names, and those that they name."""
    import re

    used: set[str] = set()

    def need(text: str) -> None:
        for name in CTE:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                need(CTE[name])

    need(final)
    order = [n for n in CTE if n in used]
    return ("WITH RECURSIVE " + ", ".join(f"{n} AS ({CTE[n]})" for n in order) + " " + final) if order else final
