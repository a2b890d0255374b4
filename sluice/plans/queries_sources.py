"""Registered queries of the report readers: reports are written from the orders of each customer, then read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sluice.plans import adapters as A
from sluice.plans.adapters import table
from sluice.plans.queries import query
from sluice.sources import json_reports, sink, text_reports, xml_reports
from sluice.tables import fresh_path, partitions


def _key() -> Column:
    return F.col("o_orderkey")


def _status() -> Column:
    return F.col("o_orderstatus")


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _reports(spark, d, item: Column, before, after, joint: str = "", sums: dict[str, Column] | None = None, collect=F.collect_list) -> DataFrame:
    """One report per customer; `before` and `after` may use n (orders), failed (orders of status F) and `sums`."""
    o = table(spark, d, "orders").repartition(partitions(spark), "o_custkey")  # reports are few bytes and much work: not fewer tasks
    g = o.groupBy("o_custkey").agg(
        F.array_join(F.transform(F.array_sort(collect(F.struct((_key() if collect is F.collect_list else F.lit(0)).alias("k"), item.alias("x")))), lambda r: r["x"]), joint).alias("items"), F.count(F.lit(1)).alias("n"), F.count_if(_status() == "F").alias("failed"),
        *[F.sum(v).alias(k) for k, v in (sums or {}).items()],
    )
    return g.select(F.col("o_custkey").alias("report_id"), _text(*before, F.col("items"), *after).alias("content"))


def _junit(spark, d):
    body = F.when(_status() == "F", _text('<failure message="', F.col("o_orderpriority"), '" type="T"/>')).when(_status() == "P", "").otherwise("<skipped/>")
    item = _text('<testcase classname="C', _key() % 10, '" name="t', _key(), '" file="f', _key() % 3, '">', body, "</testcase>")
    wrong = F.when(F.col("o_custkey") % 7 == 0, 1).otherwise(0)
    return _reports(spark, d, item, ['<testsuites tests="', F.col("n") + wrong, '"><testsuite name="s" failures="', F.col("failed"), '"><testsuite name="inner">'], ["</testsuite></testsuite></testsuites>"])


@query("src3_junit", "SELECT o_custkey AS report_id, 'f' || (o_orderkey % 3) AS file, o_orderpriority AS message, 'C' || (o_orderkey % 10) || '#t' || o_orderkey AS symbol FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 7 <> 0")
def src3(spark, d):
    return xml_reports.junit(_junit(spark, d))[0].select("report_id", "file", "message", "symbol")


@query("src3_junit_gaps", "SELECT DISTINCT o_custkey AS report_id, 'counters differ' AS reason FROM orders WHERE o_custkey % 7 = 0")
def src3_gaps(spark, d):
    return xml_reports.junit(_junit(spark, d))[1]


@query("src4_junit_cases", "SELECT 'f' || (o_orderkey % 3) AS file, CASE o_orderstatus WHEN 'F' THEN 'failure' WHEN 'P' THEN 'passed' ELSE 'skipped' END AS outcome, count(*) AS n FROM orders WHERE o_custkey % 7 <> 0 GROUP BY ALL")
def src4(spark, d):
    return xml_reports.junit_cases(_junit(spark, d))[0].groupBy("file", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("src5_checkstyle", "SELECT o_custkey AS report_id, 'R.' || o_orderpriority AS rule, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 END AS line, 'm ' || o_orderkey AS message FROM orders")
def src5(spark, d):
    return xml_reports.checkstyle(_checkstyle(spark, d))[0].select("report_id", "rule", "line", "message")


def _checkstyle(spark, d):
    item = _text('<error line="', _key() % 4, '" message="m ', _key(), '" source="R.', F.col("o_orderpriority"), '"/>')
    return _reports(spark, d, item, ['<checkstyle version="1"><file name="a">'], ["</file></checkstyle>"])


@query("src6_src7_pmd", "SELECT o_custkey AS report_id, CASE WHEN o_orderstatus = 'F' THEN 'pmd-suppressed' ELSE o_orderpriority END AS rule, count(*) AS n FROM orders GROUP BY ALL")
def src6(spark, d):
    return xml_reports.pmd(_pmd(spark, d))[0].groupBy("report_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def _pmd(spark, d):
    o = table(spark, d, "orders")
    v = o.where("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.array_join(F.collect_list(_text('<violation beginline="1" rule="', F.col("o_orderpriority"), '"> text</violation>')), "").alias("v"))
    s = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.array_join(F.collect_list(_text('<suppressedviolation filename="x" suppressiontype="a" msg="', _key(), '"/>')), "").alias("s"))
    none = F.lit("")
    return v.join(s, "o_custkey", "full").select(F.col("o_custkey").alias("report_id"), _text('<pmd version="6"><file name="a">', F.coalesce("v", none), "</file>", F.coalesce("s", none), "</pmd>").alias("content"))


@query("src8_spotbugs", "SELECT o_custkey AS report_id, o_orderpriority AS rule, 'b' AS file, o_orderkey % 90 + 1 AS line, CASE WHEN o_orderstatus = 'F' THEN 'long' ELSE 'short' END AS message FROM orders")
def src8(spark, d):
    return xml_reports.spotbugs(_spotbugs(spark, d))[0].select("report_id", "rule", "file", "line", "message")


def _spotbugs(spark, d):
    long = F.when(_status() == "F", "<LongMessage>long</LongMessage>").otherwise("")
    item = _text('<BugInstance type="', F.col("o_orderpriority"), '"><ShortMessage>short</ShortMessage>', long, '<SourceLine sourcepath="a" start="9"/><SourceLine sourcepath="b" start="', _key() % 90 + 1, '" primary="true"/></BugInstance>')
    return _reports(spark, d, item, ['<BugCollection version="4">'], ["</BugCollection>"])


def _sarif(spark, d):
    kind = F.when(_status() == "P", ',"kind":"pass"').otherwise("")
    hushed = F.when(_key() % 9 == 0, ',"suppressions":[{"kind":"inSource"}]').otherwise("")
    item = _text('{"ruleIndex":0,"message":{"id":"d","arguments":["', _key(), '","', F.col("o_orderpriority"), '"]},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"a"},"region":{"startLine":', _key() % 50 + 1, "}}}]", kind, hushed, "}")
    head = '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"T","rules":[{"id":"R","messageStrings":{"d":{"text":"{0} is {1}"}}}]}},"results":['
    return _reports(spark, d, item, [head], ["]}]}"], ",")


@query("src9_src10_src11_sarif", "SELECT o_custkey AS report_id, 'R' AS rule, o_orderkey % 50 + 1 AS line, o_orderkey || ' is ' || o_orderpriority AS message FROM orders WHERE o_orderstatus <> 'P'")
def src9(spark, d):
    return json_reports.sarif(_sarif(spark, d))[0].select("report_id", "rule", "line", "message")


@query("src9_sarif_summary", "SELECT o_custkey AS report_id, count(*) AS results, count(*) FILTER (WHERE o_orderstatus <> 'P') AS violations, count(*) FILTER (WHERE o_orderstatus = 'P') AS non_violations, count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_orderkey % 9 = 0) AS suppressed FROM orders GROUP BY o_custkey")
def src9_summary(spark, d):
    return json_reports.sarif(_sarif(spark, d))[2].drop("run")


@query("src12_lcov", "SELECT o_custkey AS report_id, o_orderkey % 5 + 1 AS line, sum(o_orderkey % 3) AS hits, 2 AS branches_found, max(o_orderkey % 2) AS branches_hit FROM orders GROUP BY ALL")
def src12(spark, d):
    return text_reports.lcov(_lcov(spark, d))[0].select("report_id", "line", "hits", "branches_found", "branches_hit")


def _lcov(spark, d):
    line = _key() % 5 + 1
    item = _text("SF:a.c\nDA:", line, ",", _key() % 3, "\nBRDA:", line, ",0,0,", F.when(_key() % 2 == 1, "1").otherwise("-"), "\nBRDA:", line, ",0,1,-\nLF:1\nLH:", F.when(_key() % 3 > 0, 1).otherwise(0), "\nBRF:2\nBRH:", _key() % 2, "\nend_of_record\n")
    return _reports(spark, d, item, [], [])


@query("src13_cobertura", "SELECT o_custkey AS report_id, o_orderkey + 1 AS line, o_orderkey % 3 AS hits, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END AS branches_found, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS branches_hit FROM orders WHERE o_custkey % 8 <> 0")
def src13(spark, d):
    return xml_reports.cobertura(_cobertura(spark, d))[0].select("report_id", "line", "hits", "branches_found", "branches_hit")


def _cobertura(spark, d):
    item = _text('<line number="', _key() + 1, '" hits="', _key() % 3, '"', F.when(_key() % 2 == 0, ' condition-coverage="50% (1/2)"').otherwise(""), "/>")
    valid = F.col("n") + F.when(F.col("o_custkey") % 8 == 0, 1).otherwise(0)
    return _reports(spark, d, item, ['<coverage lines-valid="', valid, '"><packages><package><classes><class filename="a"><lines>'], ["</lines></class></classes></package></packages></coverage>"])


@query("src14_jacoco", "SELECT o_custkey AS report_id, 'p/A' AS file, o_orderkey + 1 AS line, o_orderkey % 3 AS hits, 4 AS branches_found, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 4 END AS branches_hit FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 97 = 0)")
def src14(spark, d):
    return xml_reports.jacoco(_jacoco(spark, d))[0]


def _jacoco(spark, d):
    """Packages in groups, with the counters of each level; a line without instructions in reports of some orders."""
    covered = F.when(_key() % 97 == 0, 0).otherwise(_key() % 3)
    missed, hit = F.when(_key() % 97 == 0, 0).otherwise(1), F.when(covered == 0, 0).otherwise(_key() % 4)
    item = _text('<line nr="', _key() + 1, '" mi="', missed, '" ci="', covered, '" mb="', 4 - hit, '" cb="', hit, '"/>')
    sums = {"missed": missed, "covered": covered, "dark": (covered == 0).cast("int"), "lit": (covered > 0).cast("int"), "unhit": 4 - hit, "hit": hit}
    totals = [x for kind, m, c in (("INSTRUCTION", "missed", "covered"), ("LINE", "dark", "lit"), ("BRANCH", "unhit", "hit")) for x in (f'<counter type="{kind}" missed="', F.col(m), '" covered="', F.col(c), '"/>')]
    after = [x for end in ("</sourcefile>", "</package>", "</group>", "</group>", "</report>") for x in (*totals, end)]
    return _reports(spark, d, item, ['<report name="r"><group name="g"><group name="h"><package name="p"><sourcefile name="A">'], after, sums=sums)


@query("src15_coverage_py", "SELECT o_custkey AS report_id, 'f' || o_orderkey AS file, l AS line, CASE WHEN l = 1 THEN 1 ELSE 0 END AS hits, CASE WHEN l = 1 THEN 2 ELSE 0 END AS branches_found, CASE WHEN l = 1 THEN 1 ELSE 0 END AS branches_hit, l = 3 AS excluded FROM orders, (SELECT unnest([1, 2, 3]) AS l)")
def src15(spark, d):
    return json_reports.coverage_py(_coverage_py(spark, d))[0]


def _coverage_py(spark, d):
    item = _text('"f', _key(), '":{"executed_lines":[1],"missing_lines":[2],"excluded_lines":[3],"executed_branches":[[1,2]],"missing_branches":[[1,3]]}')
    return _reports(spark, d, item, ['{"meta":{"format":3},"totals":{"covered_lines":', F.col("n"), ',"num_statements":', 2 * F.col("n"), ',"num_branches":', 2 * F.col("n"), '},"files":{'], ["}}"], ",")


@query("src16_clippy", "SELECT o_custkey AS report_id, 'clippy::' || o_orderpriority AS rule, o_orderkey % 70 + 1 AS line FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 83 = 0)")
def src16(spark, d):
    code = F.when(_key() % 83 == 0, "E0001").otherwise(_text("clippy::", F.col("o_orderpriority")))
    level = F.when(_key() % 83 == 0, "error").otherwise("warning")
    item = _text('{"reason":"compiler-message","message":{"message":"m","level":"', level, '","code":{"code":"', code, '"},"spans":[{"file_name":"a","line_start":', _key() % 70 + 1, ',"is_primary":true}]}}\n')
    return json_reports.cargo_clippy(_reports(spark, d, item, [], ['{"reason":"build-finished","success":true}\n']))[0].select("report_id", "rule", "line")


@query("src17_eslint", "SELECT o_custkey AS report_id, 'f' || o_orderkey AS file, o_orderpriority AS rule, 2 AS line FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 89 = 0)")
def src17(spark, d):
    return json_reports.eslint(_eslint(spark, d))[0].select("report_id", "file", "rule", "line")


def _eslint(spark, d):
    item = _text('{"filePath":"f', _key(), '","errorCount":', F.when(_key() % 89 == 0, 3).otherwise(1), ',"warningCount":0,"messages":[{"ruleId":"', F.col("o_orderpriority"), '","severity":2,"message":"m","line":2}]}')
    return _reports(spark, d, item, ["["], ["]"], ",")


@query("src18_golangci", "SELECT o_custkey AS report_id, CASE WHEN o_orderkey % 2 = 0 THEN 'SA' || (o_orderkey % 10) ELSE 'lll' END AS rule, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL")
def src18(spark, d):
    return json_reports.golangci(_golangci(spark, d), ["lll"])[0].groupBy("report_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def _golangci(spark, d):
    text = F.when(_key() % 2 == 0, _text("SA", _key() % 10, ": old")).otherwise("long: line")
    item = _text('{"FromLinter":"', F.when(_key() % 3 == 0, "other").otherwise("lll"), '","Text":"', text, '","Pos":{"Filename":"a","Line":1}}')
    return _reports(spark, d, item, ['{"Report":{},"Issues":['], ["]}"], ",")


@query("src19_ruff", "SELECT o_custkey AS report_id, 'F' || (o_orderkey % 900) AS rule, o_orderkey % 60 + 1 AS line FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 101 = 0)")
def src19(spark, d):
    code = F.when(_key() % 101 == 0, "null").otherwise(_text('"F', _key() % 900, '"'))
    return json_reports.ruff(_ruff(spark, d, code))[0].select("report_id", "rule", "line")


def _ruff(spark, d, code=None):
    code = _text('"F', _key() % 900, '"') if code is None else code
    row = _key() % 60 + 1
    item = _text('{"code":', code, ',"filename":"a","message":"m","location":{"row":', row, ',"column":5},"end_location":{"row":', row, ',"column":9}}')
    return _reports(spark, d, item, ["["], ["]"], ",")


@query("src20_pyright", "SELECT o_custkey AS report_id, o_orderkey % 60 + 1 AS line FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 9 <> 0")
def src20(spark, d):
    return json_reports.pyright(_pyright(spark, d))[0].select("report_id", "line")


def _pyright(spark, d):
    item = _text('{"file":"a","severity":"warning","message":"m","rule":"', F.when(_key() % 2 == 0, "reportDeprecated").otherwise("other"), '","range":{"start":{"line":', _key() % 60, "}}}")
    total = F.col("n") + F.when(F.col("o_custkey") % 9 == 0, 1).otherwise(0)
    return _reports(spark, d, item, ['{"summary":{"errorCount":0,"informationCount":0,"warningCount":', total, '},"generalDiagnostics":['], ["]}"], ",")


@query("src21_javac", "SELECT o_custkey AS report_id, CASE WHEN o_orderkey % 2 = 0 THEN 'removal' ELSE 'deprecation' END AS rule, 'f() ' || o_orderkey AS message FROM orders WHERE o_custkey % 6 <> 0")
def src21(spark, d):
    return text_reports.javac(_javac(spark, d))[0].select("report_id", "rule", "message")


def _javac(spark, d):
    item = _text("A.java:7: warning: [", F.when(_key() % 2 == 0, "removal").otherwise("deprecation"), "] f() ", _key(), "\n  a.f();\n   ^\n")
    note = F.when(F.col("o_custkey") % 6 == 0, "Note: A.java uses deprecated API.\n").otherwise("")
    return _reports(spark, d, item, [], [note, F.col("n"), F.when(F.col("n") == 1, " warning\n").otherwise(" warnings\n")])


@query(
    "src21_javac_gaps",
    """SELECT DISTINCT o_custkey AS report_id, CASE o_custkey % 7 WHEN 0 THEN 'unexpected line' WHEN 1 THEN 'caret' WHEN 2 THEN 'text after the total' WHEN 3 THEN 'cut'
    WHEN 4 THEN 'total differs' WHEN 5 THEN 'place' ELSE 'malformed' END AS reason FROM orders WHERE o_custkey % 6 <> 0""",
)
def src21_gaps(spark, d):
    """Compiler errors, carets that are missing, text after the total, a file that was cut, a wrong total, a line 0, no text."""
    which = F.col("report_id") % 7
    content = (
        F.when(which == 0, F.concat(F.lit("A.java:1: error: cannot find symbol\n  x();\n  ^\n"), "content")).when(which == 1, F.regexp_replace("content", r"\n   \^\n", "\n"))
        .when(which == 2, F.concat("content", F.lit("more\n"))).when(which == 3, F.expr("substring(content, 1, length(content) - 1)"))
        .when(which == 4, F.regexp_replace("content", r"\n(\d+ warnings?\n)$", "\n1$1")).when(which == 5, F.regexp_replace("content", ":7:", ":0:"))
    )
    return text_reports.javac(_javac(spark, d).where("report_id % 6 <> 0").withColumn("content", content))[1]


@query("src22_diagnostics", "SELECT o_custkey AS report_id, 't' AS tool, o_orderpriority AS rule, 'f' || (o_orderkey % 5) AS file FROM orders WHERE o_custkey % 4 <> 0")
def src22(spark, d):
    return json_reports.diagnostics(_diagnostics(spark, d))[0].select("report_id", "tool", "rule", "file")


def _diagnostics(spark, d):
    item = _text('{"rule":"', F.col("o_orderpriority"), '","file":"f', _key() % 5, '","line":1,"message":"m"}')
    return _reports(spark, d, item, ['{"tool":"t","executed":5,"failures":', F.when(F.col("o_custkey") % 4 == 0, 6).otherwise(0), ',"issues":['], ["]}"], ",")


@query("src23_tool_facts", "SELECT o_custkey AS report_id, CAST(o_orderkey AS VARCHAR) AS id, (o_orderkey % 1000) / 8.0 AS value FROM orders WHERE o_custkey % 3 <> 0")
def src23(spark, d):
    return json_reports.tool_facts(_facts(spark, d), "p", "t")[0].select("report_id", "id", F.col("value").cast("double").alias("value"))


@query("src23_clone_pairs", "SELECT o_custkey AS report_id, CAST(o_orderkey AS VARCHAR) AS id, (o_orderkey % 9) / 8.0 AS similarity, 'f' || (o_orderkey % 5) AS left_file, o_orderkey % 40 + 1 AS left_start, o_orderkey % 40 + 10 AS left_end FROM orders WHERE o_custkey % 3 <> 0")
def src23_clones(spark, d):
    return json_reports.tool_clones(_facts(spark, d), "p", "t")[0].select("report_id", "id", F.col("similarity").cast("double").alias("similarity"), "left_file", "left_start", "left_end")


def _facts(spark, d):
    """Each report holds its orders as metrics and as clone pairs."""
    side = ('","left":{"file":"f', _key() % 5, '","start":', _key() % 40 + 1, ',"end":', _key() % 40 + 10, ',"nodes":3},"right":{"file":"b","start":1,"end":2,"nodes":3}}')
    pair = _text('{"id":"', _key(), '","similarity":"', ((_key() % 9).cast("double") / 8).cast("decimal(10,3)"), *side)
    pairs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("report_id")).agg(F.array_join(F.collect_list(pair), ",").alias("pairs"))
    item = _text('{"id":"', _key(), '","file":"a","metric":"m","value":"', ((_key() % 1000).cast("double") / 8).cast("decimal(10,3)"), '","unit":"u","measurement":"e"}')
    raw = _reports(spark, d, item, ['{"project":"p","target":"', F.when(F.col("o_custkey") % 3 == 0, "x").otherwise("t"), '","metrics":['], ["]}"], ",")
    return raw.join(pairs, "report_id").select("report_id", _text(F.regexp_replace("content", r"\}\z", ""), ',"clones":[', F.col("pairs"), "]}").alias("content"))


@query("src24_api_compatibility", "SELECT DISTINCT o_custkey AS report_id, 'c.' || (o_orderkey % 20) AS class, CASE WHEN o_orderkey % 20 % 2 = 0 THEN 'CLASS_INCOMPATIBLE' ELSE 'REMOVED' END AS rule FROM orders WHERE o_orderkey % 20 % 3 <> 0")
def src24(spark, d):
    return xml_reports.api_compatibility(_api(spark, d), "binary", _classes(spark, d))[0].select("report_id", "class", "rule")


def _classes(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("report_id"), _text("c.", _key() % 20).alias("class")).distinct()


def _api(spark, d):
    c = _key() % 20
    state = F.when(c % 3 == 0, "true").otherwise("false")
    member = F.when((c % 2 == 1) & (c % 3 != 0), '<member name="m" binaryCompatible="false" sourceCompatible="true" change="REMOVED"/>').otherwise("")
    item = _text('<class fullyQualifiedName="c.', c, '" binaryCompatible="', state, '" sourceCompatible="true">', member, "</class>")
    return _reports(spark, d, item, ['<japi old="a"><classes>'], ["</classes></japi>"], collect=F.collect_set)


#: Reports without evidence, mixed into good ones: what a fifth of them is replaced with, the gap that it must be, and SQL for
#: the gaps that the good ones' writer makes (its ids, the reason). Two more fifths are cut short or missing.
SPOILED = {
    "src3_junit_mixed_gaps": (_junit, xml_reports.junit, "<html/>", "wrong root", "o_custkey % 7 = 0", "counters differ"),
    "src5_checkstyle_gaps": (_checkstyle, xml_reports.checkstyle, "<html/>", "wrong root", None, None),
    "src6_src7_pmd_gaps": (_pmd, xml_reports.pmd, "<html/>", "wrong root", None, None),
    "src8_spotbugs_gaps": (_spotbugs, xml_reports.spotbugs, "<html/>", "wrong root", None, None),
    "src9_sarif_gaps": (_sarif, json_reports.sarif, '{"version":"2.1.0"}', "no run", None, None),
    "src9_sarif_failed_runs": (_sarif, json_reports.sarif, '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"T"}},"invocations":[{"executionSuccessful":false}],"results":[]}]}', "run failed", None, None),
    "src13_cobertura_gaps": (_cobertura, xml_reports.cobertura, "<html/>", "wrong root", "o_custkey % 8 = 0", "totals differ"),
    "src14_jacoco_gaps": (_jacoco, xml_reports.jacoco, "<report><group/></report>", "no source file", "o_orderkey % 97 = 0", "line without instructions"),
    "src15_coverage_py_gaps": (_coverage_py, json_reports.coverage_py, '{"meta":{"format":3}}', "no file", None, None),
    "src17_eslint_gaps": (_eslint, json_reports.eslint, "[]", "no file", "o_orderkey % 89 = 0", "counts differ"),
    "src18_golangci_gaps": (_golangci, lambda raw: json_reports.golangci(raw, ["lll"]), "{}", "no report", None, None),
    "src20_pyright_gaps": (_pyright, json_reports.pyright, "{}", "no diagnostics", "o_custkey % 9 = 0", "counts differ"),
    "src23_tool_facts_gaps": (_facts, lambda raw: json_reports.tool_facts(raw, "p", "t"), '{"project":"p","target":"t"}', "no facts", "o_custkey % 3 = 0", "envelope"),
    "src24_api_gaps": (_api, xml_reports.api_compatibility, "<japicmp/>", "no class", None, None),
}


def _spoiled(name: str) -> None:
    write, read, bad, reason, also, why = SPOILED[name]
    own = f"SELECT DISTINCT o_custkey AS report_id, CASE o_custkey % 5 WHEN 1 THEN '{reason}' ELSE 'malformed' END AS reason FROM orders WHERE o_custkey % 5 IN (1, 2, 3)"
    more = f" UNION ALL SELECT DISTINCT o_custkey AS report_id, '{why}' AS reason FROM orders WHERE o_custkey % 5 NOT IN (1, 2, 3) AND {also}" if also else ""

    def run(spark, d):
        which = F.col("report_id") % 5
        content = F.when(which == 1, bad).when(which == 2, F.expr("substring(content, 1, length(content) - 3)")).when(which == 3, F.lit(None)).otherwise(F.col("content"))
        raw = write(spark, d).withColumn("content", content)
        return read(raw)[1]

    query(name, own + more)(run)


for _name in SPOILED:
    _spoiled(_name)


#: JSON reports that are more than one whole value: writer, reader, and the reports that the writer itself makes gaps of.
WHOLE = {
    "src9_sarif_whole": (_sarif, json_reports.sarif, None), "src15_coverage_py_whole": (_coverage_py, json_reports.coverage_py, None), "src17_eslint_whole": (_eslint, json_reports.eslint, "o_orderkey % 89 = 0"),
    "src18_golangci_whole": (_golangci, lambda raw: json_reports.golangci(raw, ["lll"]), None), "src19_ruff_whole": (_ruff, json_reports.ruff, None), "src20_pyright_whole": (_pyright, json_reports.pyright, "o_custkey % 9 = 0"),
    "src22_diagnostics_whole": (_diagnostics, json_reports.diagnostics, "o_custkey % 4 = 0"), "src23_tool_facts_whole": (_facts, lambda raw: json_reports.tool_facts(raw, "p", "t"), "o_custkey % 3 = 0"),
}


def _not_whole(name: str) -> None:
    """A fifth each of the reports go on after their value (text; a second value) or have a key twice: all malformed."""
    write, read, other = WHOLE[name]
    bad = f"SELECT DISTINCT o_custkey AS report_id FROM orders WHERE o_custkey % 5 NOT IN (1, 2, 3){f' AND {other}' if other else ''}"

    def run(spark, d):
        which = F.col("report_id") % 5
        twice = F.concat(F.expr("substring_index(content, '{', 1)"), F.lit('{"twice":0,"twice":[1],'), F.expr("substring(content, instr(content, '{') + 1)"))
        content = F.when(which == 1, F.concat("content", F.lit(" boom ]"))).when(which == 2, F.concat("content", "content")).when(which == 3, twice).otherwise(F.col("content"))
        return read(write(spark, d).withColumn("content", content))[1].groupBy("report_id").agg(F.bool_and(F.col("reason") == "malformed").alias("malformed"))

    query(name, f"SELECT DISTINCT o_custkey AS report_id, true AS malformed FROM orders WHERE o_custkey % 5 IN (1, 2, 3) UNION ALL SELECT report_id, false FROM ({bad if other else bad + ' AND false'})")(run)


for _name in WHOLE:
    _not_whole(_name)


@query(
    "src12_branch_coverage",
    "SELECT o_custkey AS report_id, true AS branch_coverage FROM orders GROUP BY o_custkey HAVING o_custkey % 3 = 0 OR bool_and(o_orderkey % 2 = 1) ORDER BY ALL",
)
def src12_branches(spark, d):
    """Branches count as measured only if every section counts them: here two thirds of the reports lose BRF where a branch
    was not taken."""
    content = F.when(F.col("report_id") % 3 > 0, F.regexp_replace("content", r"BRF:2\nBRH:0\n", "")).otherwise(F.col("content"))
    return text_reports.lcov_branch_coverage(_lcov(spark, d).withColumn("content", content)).where("branch_coverage")


@query(
    "src12_lcov_gaps",
    "SELECT DISTINCT o_custkey AS report_id, CASE o_custkey % 5 WHEN 1 THEN 'counters differ' WHEN 2 THEN 'open section' ELSE 'malformed' END AS reason FROM orders WHERE o_custkey % 5 IN (1, 2, 3)",
)
def src12_gaps(spark, d):
    which = F.col("report_id") % 5
    content = F.when(which == 1, F.regexp_replace("content", r"\nLF:1\n", "\nLF:2\n")).when(which == 2, F.concat("content", F.lit("SF:b\nDA:1,1\n"))).when(which == 3, F.lit(None)).otherwise(F.col("content"))
    return text_reports.lcov(_lcov(spark, d).withColumn("content", content))[1]


@query("snk1_report_sink", "SELECT repo, count(*) AS checks, sum(finding_count) AS findings FROM checks GROUP BY repo")
def snk1(spark, d):
    """Writes checks by repository and reads them back."""
    at = fresh_path(spark, "report")
    checks = A.checks(spark, d).withColumn("group", F.col("repo") % 16).repartition("group")
    sink.write_report({"checks": checks}, at, keys=["group"])
    return spark.read.parquet(f"{at}/checks").groupBy("repo").agg(F.count(F.lit(1)).alias("checks"), F.sum("finding_count").alias("findings"))
