"""SARIF, coverage.py, clippy, ESLint, golangci-lint, Ruff, Pyright, generic diagnostics and tool facts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sluice.sources.common import blank, differs, first_fault, line, once, parsed_json, split, whole_json


def _issue(rows: DataFrame, tool: Column, rule: Column, file: Column, at: Column, message: Column) -> DataFrame:
    return rows.select("report_id", tool.alias("tool"), rule.alias("rule"), file.alias("file"), line(at).alias("line"), message.alias("message"), F.lit(None).cast("string").alias("symbol"))


_MESSAGE = "struct<text: string, id: string, arguments: array<string>>"
_PLACE = "struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int, endLine: int>>, logicalLocations: array<struct<fullyQualifiedName: string, name: string>>>"
_RULE = "struct<id: string, messageStrings: map<string, struct<text: string>>>"
_RESULT = f"struct<ruleId: string, ruleIndex: int, rule: struct<id: string, index: int>, kind: string, level: string, baselineState: string, message: {_MESSAGE}, locations: array<{_PLACE}>, suppressions: array<struct<kind: string>>>"
_NOTE = "struct<level: string, exception: string>"
_CALL = f"struct<executionSuccessful: boolean, toolExecutionNotifications: array<{_NOTE}>, toolConfigurationNotifications: array<{_NOTE}>>"
_DRIVER = f"struct<name: string, rules: array<{_RULE}>, globalMessageStrings: map<string, struct<text: string>>>"
_RUN = f"struct<tool: struct<driver: {_DRIVER}>, results: array<{_RESULT}>, invocations: array<{_CALL}>, externalPropertyFileReferences: map<string, string>, baselineGuid: string>"
_FOUND = "array<struct<kind: string, rule: string, message: string, suppressed: boolean, spots: array<struct<file: string, line: int, end_line: int>>>>"


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being computed once however often it is used, which no projection does within a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _filled(template: Column, arguments: Column) -> Column:
    """{0}, {1}.. by the arguments, {{ and }} as braces; null for any other brace or a missing argument."""
    parts = F.regexp_extract_all(template, F.lit(r"\{\{|\}\}|\{\d+\}|[^{}]+|[{}]"), F.lit(0))
    one = lambda p: (
        F.when(p == "{{", "{").when(p == "}}", "}").when(p.isin("{", "}"), F.lit(None))
        .when(p.rlike(r"^\{\d+\}$"), F.get(arguments, F.regexp_extract(p, r"\d+", 0).try_cast("int"))).otherwise(p)
    )
    return _with(F.transform(parts, one), lambda done: F.when(~F.exists(done, lambda p: p.isNull()), F.array_join(done, "")))


def sarif(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC-9..11, AGG-16. (issues with all locations, gaps, run summaries). Results of kind fail (the default) are issues,
    suppressed ones too, which are counted besides; pass, notApplicable and informational are counted only. Messages fill {0},
    {1}.. from arguments, looked up in the rule's or the driver's strings where only an id is given; rules are found by id
    and by index, which must agree.

    Gaps: another version, no run, a run without a tool's name or a list of results, an invocation that did not succeed or
    notified of errors, external properties, results of a baseline, results that are undecided or of an unknown kind, repeated
    rule ids, rules and messages that cannot be resolved, and places without file and name or with impossible lines."""
    rows = parsed_json(raw, f"version string, inlineExternalProperties array<string>, runs array<{_RUN}>")
    runs = F.coalesce("r.runs", _none(_RUN))
    rows = rows.withColumn("runs", runs)
    rules = lambda u: F.coalesce(u["tool"]["driver"]["rules"], _none(_RULE))
    ids = lambda u: F.transform(rules(u), lambda q: q["id"])
    noted = lambda n: F.exists(F.coalesce(n, _none(_NOTE)), lambda x: (F.coalesce(x["level"], F.lit("warning")) == "error") | x["exception"].isNotNull() | ~F.coalesce(x["level"], F.lit("warning")).isin("none", "note", "warning", "error"))
    failed = lambda u: F.exists(F.coalesce(u["invocations"], _none(_CALL)), lambda c: ~F.coalesce(c["executionSuccessful"], F.lit(False)) | noted(c["toolExecutionNotifications"]) | noted(c["toolConfigurationNotifications"]))
    faults = {
        "version": ~F.col("r.version").eqNullSafe(F.lit("2.1.0")),
        "external properties": (F.size(F.coalesce("r.inlineExternalProperties", _none("string"))) > 0) | F.exists("runs", lambda u: F.coalesce(F.size(F.map_keys(u["externalPropertyFileReferences"])) > 0, F.lit(False))),
        "no run": F.size("runs") == 0, "run without tool": F.exists("runs", lambda u: blank(u["tool"]["driver"]["name"])), "run failed": F.exists("runs", failed),
        "run without results": F.exists("runs", lambda u: u["results"].isNull()), "baseline": F.exists("runs", lambda u: u["baselineGuid"].isNotNull() | F.exists(F.coalesce(u["results"], _none(_RESULT)), lambda x: x["baselineState"].isNotNull())),
        "rules": F.exists("runs", lambda u: F.exists(ids(u), blank) | (F.size(F.array_distinct(ids(u))) != F.size(ids(u)))),
    }
    rows = once(rows, "fault", first_fault(rows, faults))

    def result(u: Column, by_id: Column, x: Column) -> Column:
        index = F.coalesce(x["ruleIndex"], x["rule"]["index"])
        at = F.get(rules(u), index)
        name = F.coalesce(x["ruleId"], x["rule"]["id"], at["id"])
        disagree = F.coalesce(x["ruleId"] != x["rule"]["id"], F.lit(False)) | F.coalesce(x["ruleIndex"] != x["rule"]["index"], F.lit(False)) | F.coalesce(at["id"] != name, F.lit(False)) | index.isNotNull() & at.isNull()
        strings = F.coalesce(at["messageStrings"], F.try_element_at(by_id, name))
        known = F.coalesce(F.try_element_at(strings, x["message"]["id"])["text"], F.try_element_at(u["tool"]["driver"]["globalMessageStrings"], x["message"]["id"])["text"])
        text = _filled(F.coalesce(x["message"]["text"], known), F.coalesce(x["message"]["arguments"], _none("string")))
        spots = F.array_distinct(F.transform(F.coalesce(x["locations"], _none(_PLACE)), lambda p: F.struct(
            p["physicalLocation"]["artifactLocation"]["uri"].alias("file"), p["physicalLocation"]["region"]["startLine"].alias("line"), p["physicalLocation"]["region"]["endLine"].alias("end_line"))))
        lost = F.exists(F.coalesce(x["locations"], _none(_PLACE)), lambda p: blank(p["physicalLocation"]["artifactLocation"]["uri"]) & (F.size(F.filter(F.coalesce(p["logicalLocations"], _none("struct<fullyQualifiedName: string, name: string>")), lambda l: ~blank(F.coalesce(l["fullyQualifiedName"], l["name"])))) == 0))
        wrong = lambda s: F.exists(s, lambda p: F.coalesce((p["line"] < 1) | (p["end_line"] < 1), F.lit(False)) | p["end_line"].isNotNull() & F.coalesce(p["end_line"] < p["line"], F.lit(True)))
        kind, level = F.coalesce(x["kind"], F.lit("fail")), x["level"]
        severe = level.isNotNull() & (~level.isin("none", "note", "warning", "error") | (kind != "fail") & (level != "none"))
        hushed = F.coalesce(x["suppressions"], _none("struct<kind: string>"))
        why = lambda v: (
            F.when(kind.isin("open", "review"), "undecided").when(~kind.isin("fail", "pass", "notApplicable", "informational"), "kind").when(severe, "level").when(disagree | blank(name), "rule")
            .when(v["text"].isNull(), "message").when(lost | wrong(v["spots"]), "location").when(F.exists(hushed, lambda h: ~F.coalesce(h["kind"].isin("inSource", "external"), F.lit(False))), "suppression")
        )
        return _with(F.struct(text.alias("text"), spots.alias("spots")), lambda v: F.struct(kind.alias("kind"), name.alias("rule"), v["text"].alias("message"), (F.size(hushed) > 0).alias("suppressed"), v["spots"].alias("spots"), why(v).alias("why")))

    def read(u: Column) -> Column:
        by_id = F.map_from_entries(F.transform(rules(u), lambda q: F.struct(q["id"], q["messageStrings"])))
        return F.struct(u["tool"]["driver"]["name"].alias("name"), F.transform(u["results"], lambda x: result(u, by_id, x)).alias("found"))

    # repeated rule ids are gaps by now: the map of the ids has each key once; good and bad reports part without being read twice
    rows = once(rows.select("report_id", "fault", "runs"), "read", F.when(F.col("fault").isNull(), F.transform("runs", read))).select("report_id", "fault", "read")
    whys = F.flatten(F.transform("read", lambda u: F.transform(u["found"], lambda x: x["why"])))
    rows = rows.withColumn("why", F.coalesce("fault", F.get(F.filter(whys, lambda w: w.isNotNull()), F.lit(0))))
    gaps = rows.where("why is not null").select("report_id", F.col("why").alias("reason"))
    good = rows.where("why is null").select("report_id", F.posexplode("read").alias("run", "u")).select("report_id", "run", "u.name", "u.found")
    x = good.select("report_id", "run", "name", F.explode("found").alias("x"))
    issues = x.where("x.kind = 'fail'").select(
        "report_id", F.col("name").alias("tool"), "x.rule", F.try_element_at("x.spots", F.lit(1))["file"].alias("file"), F.try_element_at("x.spots", F.lit(1))["line"].alias("line"), "x.message", F.col("x.spots").alias("locations")
    )
    number = lambda f: F.size(F.filter("found", f)).cast("long")
    summary = good.select(
        "report_id", "run", F.size("found").cast("long").alias("results"), number(lambda x: x["kind"] == "fail").alias("violations"), number(lambda x: x["kind"] != "fail").alias("non_violations"), number(lambda x: (x["kind"] == "fail") & x["suppressed"]).alias("suppressed")
    )
    return issues, gaps, summary


def coverage_py(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-15, SET-5, AGG-15. Executed lines less excluded ones are hit; branch arcs count at their source line.

    Gaps: another format, no file, lists of lines that are missing, overlap or repeat a line, branches whose line is not
    there or contradicts its state, and totals, of the report or of a file that has a summary, that differ."""
    s = "struct<covered_lines: long, num_statements: long, missing_lines: long, excluded_lines: long, num_branches: long, covered_branches: long, missing_branches: long>"
    f = f"struct<executed_lines: array<int>, missing_lines: array<int>, excluded_lines: array<int>, executed_branches: array<array<int>>, missing_branches: array<array<int>>, summary: {s}>"
    rows = parsed_json(raw, f"meta struct<format: int, branch_coverage: boolean>, files map<string, {f}>, totals {s}")
    none, arcs = _none("int"), _none("array<int>")
    file = lambda e: F.struct(
        e["key"].alias("file"), e["value"]["executed_lines"].alias("executed"), e["value"]["missing_lines"].alias("missing"), F.coalesce(e["value"]["excluded_lines"], none).alias("excluded"),
        F.array_except(e["value"]["executed_lines"], F.coalesce(e["value"]["excluded_lines"], none)).alias("hit"), F.coalesce(e["value"]["executed_branches"], arcs).alias("taken"), F.coalesce(e["value"]["missing_branches"], arcs).alias("untaken"), e["value"]["summary"].alias("summary"),
    )
    rows = once(rows, "files", F.transform(F.map_entries("r.files"), file))
    repeats = lambda a: F.size(F.array_distinct(a)) != F.size(a)
    count = {
        "covered_lines": lambda e: F.size(e["hit"]), "num_statements": lambda e: F.size(e["hit"]) + F.size(e["missing"]), "missing_lines": lambda e: F.size(e["missing"]), "excluded_lines": lambda e: F.size(e["excluded"]),
        "num_branches": lambda e: F.size(e["taken"]) + F.size(e["untaken"]), "covered_branches": lambda e: F.size(e["taken"]), "missing_branches": lambda e: F.size(e["untaken"]),
    }
    total = lambda k: F.aggregate("files", F.lit(0).cast("long"), lambda n, e: n + F.coalesce(count[k](e), F.lit(0)))
    off = lambda k: differs(F.col(f"r.totals.{k}"), total(k)) | F.exists("files", lambda e: differs(e["summary"][k], count[k](e)))
    differ = reduce(lambda a, b: a | b, map(off, count))
    strange = lambda e: F.exists(e["taken"], lambda b: F.coalesce(~F.array_contains(e["hit"], b[0]), F.lit(True))) | F.exists(e["untaken"], lambda b: F.coalesce(~F.array_contains(F.concat(e["hit"], e["missing"]), b[0]), F.lit(True)))
    good, gaps = split(rows, {
        "format": ~F.coalesce(F.col("r.meta.format").isin(2, 3), F.lit(False)), "no file": F.coalesce(F.size("files"), F.lit(0)) == 0,
        "lists missing": F.exists("files", lambda e: e["executed"].isNull() | e["missing"].isNull()),
        "lists overlap": F.exists("files", lambda e: F.arrays_overlap(e["executed"], e["missing"]) | F.arrays_overlap(e["missing"], e["excluded"])),
        "lists repeat": F.exists("files", lambda e: repeats(e["executed"]) | repeats(e["missing"]) | repeats(e["excluded"]) | F.exists(F.concat(e["executed"], e["missing"], e["excluded"]), lambda n: F.coalesce(n < 1, F.lit(True)))),
        "branches": F.exists("files", lambda e: strange(e) | repeats(F.concat(e["taken"], e["untaken"]))), "no totals": F.col("r.totals.covered_lines").isNull() | F.col("r.totals.num_statements").isNull(), "totals differ": differ,
    })
    e = good.select("report_id", F.explode("files").alias("v")).select("report_id", "v.*")
    state = lambda a, h, x: F.transform(a, lambda n: F.struct(n.alias("line"), F.lit(h).cast("long").alias("hits"), F.lit(x).alias("excluded")))
    lines = e.select("report_id", "file", F.explode(F.concat(state(F.col("hit"), 1, False), state(F.col("missing"), 0, False), state(F.col("excluded"), 0, True))).alias("l")).select("report_id", "file", "l.*")
    arc = lambda c, h: F.transform(c, lambda b: F.struct(b[0].alias("line"), F.lit(h).alias("hit")))
    ends = e.select("report_id", "file", F.explode(F.concat(arc(F.col("taken"), 1), arc(F.col("untaken"), 0))).alias("b"))
    ends = ends.groupBy("report_id", "file", "b.line").agg(F.count(F.lit(1)).cast("int").alias("branches_found"), F.sum("b.hit").cast("int").alias("branches_hit"))
    out = lines.join(ends, ["report_id", "file", "line"], "left")
    return out.select("report_id", "file", "line", "hits", F.coalesce("branches_found", F.lit(0)).alias("branches_found"), F.coalesce("branches_hit", F.lit(0)).alias("branches_hit"), "excluded"), gaps


def cargo_clippy(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-16. JSON lines with one build-finished at the end; compiler errors (code E.. or none) are a gap; success must agree
    with whether a lint was denied."""
    m = "struct<reason: string, success: boolean, message: struct<message: string, level: string, code: struct<code: string>, spans: array<struct<file_name: string, line_start: int, is_primary: boolean>>>>"
    texts = F.filter(F.split("content", "\n"), lambda x: F.trim(x) != "")
    read = F.transform(texts, lambda x: F.struct(F.from_json(x, m).alias("x"), whole_json(x).alias("whole")))
    rows = once(raw, "lines", read).withColumn("ok", (F.size("lines") > 0) & F.forall("lines", lambda l: l["whole"] & l["x"]["reason"].isNotNull()))
    rows = rows.withColumn("r", F.transform("lines", lambda l: l["x"]))
    ends = F.size(F.filter("r", lambda x: x["reason"] == "build-finished"))
    last = F.try_element_at("r", F.lit(-1))
    denied = F.exists("r", lambda x: F.coalesce((x["reason"] == "compiler-message") & (x["message"]["level"] == "error"), F.lit(False)))
    broken = F.exists("r", lambda x: F.coalesce((x["reason"] == "compiler-message") & (x["message"]["level"] == "error") & (x["message"]["code"]["code"].isNull() | x["message"]["code"]["code"].rlike("^E[0-9]")), F.lit(False)))
    good, gaps = split(rows, {"no single end": (ends != 1) | (last["reason"] != "build-finished"), "compiler error": broken, "success disagrees": last["success"] == denied})
    x = good.select("report_id", F.explode("r").alias("x")).where("x.reason = 'compiler-message' and x.message.code is not null")
    spot = F.coalesce(F.try_element_at(F.filter("x.message.spans", lambda s: s["is_primary"]), F.lit(1)), F.try_element_at("x.message.spans", F.lit(1)))
    return _issue(x, F.lit("clippy"), F.col("x.message.code.code"), spot["file_name"], spot["line_start"], F.col("x.message.message")), gaps


def eslint(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-17. No file, fatal messages, files without a path or given twice, messages without rule, text or line, severities
    other than 1 and 2, and counts that are missing or differ are gaps."""
    m = "struct<ruleId: string, severity: int, message: string, line: int, fatal: boolean>"
    rows = parsed_json(raw, f"array<struct<filePath: string, errorCount: int, warningCount: int, fatalErrorCount: int, messages: array<{m}>>>")
    n = lambda f, s: F.size(F.filter(f["messages"], lambda m: m["severity"] == s))
    each = lambda f, bad: F.exists(F.coalesce(f["messages"], _none(m)), bad)
    good, gaps = split(rows, {
        "no file": F.size("r") == 0, "file without path": F.exists("r", lambda f: blank(f["filePath"])), "no messages": F.exists("r", lambda f: f["messages"].isNull()),
        "fatal": F.exists("r", lambda f: (F.coalesce(f["fatalErrorCount"], F.lit(0)) != 0) | each(f, lambda m: F.coalesce(m["fatal"], F.lit(False)))),
        "message": F.exists("r", lambda f: each(f, lambda m: blank(m["ruleId"]) | blank(m["message"]) | ~F.coalesce(m["line"] > 0, F.lit(False)) | ~F.coalesce(m["severity"].isin(1, 2), F.lit(False)))),
        "file given twice": F.size(F.array_distinct(F.transform("r", lambda f: f["filePath"]))) != F.size("r"),
        "counts differ": F.exists("r", lambda f: F.coalesce((f["errorCount"] != n(f, 2)) | (f["warningCount"] != n(f, 1)), F.lit(True))),
    })
    m = good.select("report_id", F.explode("r").alias("f")).select("report_id", "f.filePath", F.explode("f.messages").alias("m"))
    return _issue(m, F.lit("eslint"), F.col("m.ruleId"), F.col("filePath"), F.col("m.line"), F.col("m.message")), gaps


def golangci(raw: DataFrame, enabled: list[str]) -> tuple[DataFrame, DataFrame]:
    """SRC-18. Issues of enabled linters: those that the report lists as enabled, else the given ones. Typecheck, an error,
    warnings, a missing report or list of issues, a list of linters with none enabled or one twice, and issues without text,
    file or line are gaps. The rule is a short code before a colon in the text, of a letter and at least a digit, else the
    linter's name."""
    rows = parsed_json(raw, "Issues array<struct<FromLinter: string, Text: string, Pos: struct<Filename: string, Line: int>>>, Report struct<Error: string, Warnings: array<struct<Text: string>>, Linters: array<struct<Name: string, Enabled: boolean>>>")
    names = F.transform("r.Report.Linters", lambda l: l["Name"])
    on = F.coalesce(F.transform(F.filter("r.Report.Linters", lambda l: F.coalesce(l["Enabled"], F.lit(False))), lambda l: l["Name"]), F.array(*[F.lit(x) for x in enabled]))
    rows = rows.withColumn("on", on)
    good, gaps = split(rows, {
        "no report": F.col("r.Report").isNull(), "no issues": F.col("r.Issues").isNull(), "typecheck": F.exists("r.Issues", lambda i: F.coalesce(i["FromLinter"] == "typecheck", F.lit(False))), "error": ~blank(F.col("r.Report.Error")),
        "warnings": F.size(F.coalesce("r.Report.Warnings", _none("struct<Text: string>"))) > 0, "linters": (F.size("on") == 0) | F.coalesce(F.exists(names, blank) | (F.size(F.array_distinct(names)) != F.size(names)), F.lit(False)),
        "issue": F.exists("r.Issues", lambda i: blank(i["FromLinter"]) | blank(i["Text"]) | blank(i["Pos"]["Filename"]) | ~F.coalesce(i["Pos"]["Line"] > 0, F.lit(False))),
    })
    i = good.select("report_id", "on", F.explode("r.Issues").alias("i")).where(F.array_contains("on", F.col("i.FromLinter")))
    code = F.regexp_extract("i.Text", r"^([A-Za-z](?=[A-Za-z0-9]{0,15}:)[A-Za-z]*[0-9][A-Za-z0-9]*):", 1)
    return _issue(i, F.lit("golangci-lint"), F.when(code != "", code).otherwise(F.col("i.FromLinter")), F.col("i.Pos.Filename"), F.col("i.Pos.Line"), F.col("i.Text")), gaps


def ruff(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-19. Entries without a code, a file, a message, a place to begin or a place to end, that end before they begin, and
    syntax or input errors, are gaps."""
    place = "struct<row: long, column: long>"
    rows = parsed_json(raw, f"array<struct<code: string, filename: string, message: string, location: {place}, end_location: {place}>>")

    def range_of(x: Column) -> Column:
        a, z = x["location"], x["end_location"]
        return (a["row"] > 0) & (a["column"] > 0) & (z["column"] > 0) & ((z["row"] > a["row"]) | (z["row"] == a["row"]) & (z["column"] >= a["column"]))

    good, gaps = split(rows, {
        "syntax or io error": F.exists("r", lambda x: blank(x["code"]) | x["code"].isin("E902", "E999", "invalid-syntax", "io-error")),
        "entry": F.exists("r", lambda x: blank(x["filename"]) | blank(x["message"]) | ~F.coalesce(range_of(x), F.lit(False))),
    })
    x = good.select("report_id", F.explode("r").alias("x"))
    return _issue(x, F.lit("ruff"), F.col("x.code"), F.col("x.filename"), F.col("x.location.row"), F.col("x.message")), gaps


def pyright(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-20. Only reportDeprecated is kept; lines count from 0. No list of diagnostics, no summary or one that counts no
    file, counts by severity that differ from it, an error, and diagnostics without text or of an unknown severity, or kept
    ones without file or place, are gaps."""
    d = "struct<file: string, severity: string, message: string, rule: string, range: struct<start: struct<line: int>>>"
    rows = parsed_json(raw, f"generalDiagnostics array<{d}>, summary struct<errorCount: int, warningCount: int, informationCount: int, filesAnalyzed: int>")
    n = lambda s: F.size(F.filter("r.generalDiagnostics", lambda x: x["severity"] == s))
    every = lambda bad: F.exists("r.generalDiagnostics", bad)
    good, gaps = split(rows, {
        "no diagnostics": F.col("r.generalDiagnostics").isNull(), "no summary": F.col("r.summary").isNull(), "no file": F.coalesce(F.col("r.summary.filesAnalyzed") < 1, F.lit(False)), "error": n("error") > 0,
        "counts differ": F.coalesce((n("error") != F.col("r.summary.errorCount")) | (n("warning") != F.col("r.summary.warningCount")) | (n("information") != F.col("r.summary.informationCount")), F.lit(True)),
        "diagnostic": every(lambda x: blank(x["message"]) | ~F.coalesce(x["severity"].isin("error", "warning", "information"), F.lit(False)) | F.coalesce(x["rule"] == "reportDeprecated", F.lit(False)) & (blank(x["file"]) | ~F.coalesce(x["range"]["start"]["line"] >= 0, F.lit(False)))),
    })
    x = good.select("report_id", F.explode("r.generalDiagnostics").alias("x")).where("x.rule = 'reportDeprecated'")
    return _issue(x, F.lit("pyright"), F.col("x.rule"), F.col("x.file"), F.col("x.range.start.line") + 1, F.col("x.message")), gaps


def diagnostics(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-22. The generic form; a line below 1, a first location in another file or more failures than executed is a gap."""
    place = "array<struct<file: string, line: int, end_line: int>>"
    rows = parsed_json(raw, f"tool string, executed long, failures long, issues array<struct<rule: string, file: string, line: int, message: string, symbol: string, locations: {place}>>")
    first = lambda i: F.try_element_at(i["locations"], F.lit(1))
    wrong = F.exists("r.issues", lambda i: blank(i["rule"]) | blank(i["message"]) | F.coalesce(i["line"] < 1, F.lit(False)) | F.coalesce((first(i)["file"] != i["file"]) | (first(i)["line"] != i["line"]), F.lit(False)))
    good, gaps = split(rows, {"no issues": F.col("r.issues").isNull(), "no tool": blank(F.col("r.tool")), "issue": wrong, "failures": F.coalesce(F.col("r.failures") > F.col("r.executed"), F.lit(False))})
    i = good.select("report_id", "r.tool", F.explode("r.issues").alias("i"))
    return i.select("report_id", "tool", "i.rule", "i.file", "i.line", "i.message", "i.symbol"), gaps


def tool_facts(raw: DataFrame, project: str, target: str) -> tuple[DataFrame, DataFrame]:
    """SRC-23. Metric facts whose envelope names the expected project and target; values are exact decimals, kept as text
    until they fit (see functions.text.exact_decimal). Reports that hold neither metrics nor clone pairs are gaps."""
    from sluice.functions.text import exact_decimal

    good, gaps = _envelope(raw, project, target)
    m = good.select("report_id", F.explode("r.metrics").alias("m"))
    return m.select("report_id", "m.id", "m.file", "m.metric", exact_decimal(F.col("m.value")).alias("value"), "m.unit", "m.measurement"), gaps


def tool_clones(raw: DataFrame, project: str, target: str) -> tuple[DataFrame, DataFrame]:
    """SRC-23. Clone pairs of the same reports, in the columns that rules.clone_facts takes; a similarity outside 0 to 1 or a
    range that ends before it starts is a gap."""
    from sluice.functions.text import exact_decimal

    good, gaps = _envelope(raw, project, target)
    c = good.select("report_id", F.explode("r.clones").alias("c"))
    ends = [F.col(f"c.{side}.{x}").alias(f"{side}_{x}") for side in ("left", "right") for x in ("file", "start", "end", "nodes")]
    return c.select("report_id", "c.id", exact_decimal(F.col("c.similarity")).alias("similarity"), *ends), gaps


def _envelope(raw: DataFrame, project: str, target: str) -> tuple[DataFrame, DataFrame]:
    from sluice.functions.text import exact_decimal

    m, side = "struct<id: string, file: string, metric: string, value: string, unit: string, measurement: string>", "struct<file: string, start: int, end: int, nodes: int>"
    c = f"struct<id: string, similarity: string, left: {side}, right: {side}>"
    rows = parsed_json(raw, f"project string, target string, complete boolean, metrics array<{m}>, clones array<{c}>")
    end = lambda s: blank(s["file"]) | ~F.coalesce((s["start"] >= 1) & (s["end"] >= s["start"]) & (s["nodes"] >= 0), F.lit(False))
    return split(rows, {
        "envelope": ~(F.col("r.project").eqNullSafe(F.lit(project)) & F.col("r.target").eqNullSafe(F.lit(target))), "incomplete": ~F.coalesce("r.complete", F.lit(True)), "no facts": F.col("r.metrics").isNull() & F.col("r.clones").isNull(),
        "value": F.exists(F.coalesce("r.metrics", _none(m)), lambda m: exact_decimal(m["value"]).isNull()), "metric": F.exists(F.coalesce("r.metrics", _none(m)), lambda m: blank(m["metric"]) | blank(m["unit"]) | blank(m["measurement"])),
        "clone pair": F.exists(F.coalesce("r.clones", _none(c)), lambda p: ~F.coalesce(exact_decimal(p["similarity"]).between(0, 1), F.lit(False)) | end(p["left"]) | end(p["right"])),
    })
