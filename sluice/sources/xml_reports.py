"""JUnit, Checkstyle, PMD, SpotBugs, Cobertura, JaCoCo and API-compatibility reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sluice.functions.text import branch_counts
from sluice.sources.common import bad_number, blank, differs, elements, flattened, line, parsed_xml, split, tags

_CASE = "struct<name: string, classname: string, file: string, line: string, outcomes: array<string>, types: array<string>, messages: array<string>>"
_COUNTS = "struct<tests: long, failures: long, errors: long, skipped: long>"
_SUITES = f"ok boolean, root boolean, misplaced boolean, suites array<struct<declared: struct<tests: string, failures: string, errors: string, skipped: string>, counted: {_COUNTS}>>, cases array<{_CASE}>"
_COUNTERS = ("tests", "failures", "errors", "skipped")
_OUTCOMES = ("failure", "error", "skipped")
_SUITE_TAGS = ("testsuite", "testsuites")


def _junit_report(content: str | None) -> dict:
    """The suites of a report at any depth, each with the counters it declares and what it and its inner suites hold."""
    found = elements(content)
    if found is None:
        return {"ok": False}
    tag = [e.tag for e, _ in found]
    misplaced, cases, counted = False, [], {i: [0, 0, 0, 0] for i, t in enumerate(tag) if t in _SUITE_TAGS}
    for i, (e, up) in enumerate(found):
        above = tag[up] if up >= 0 else ""
        misplaced |= tag[i] in _OUTCOMES and above != "testcase" or tag[i] == "testcase" and above != "testsuite"
        misplaced |= tag[i] in _SUITE_TAGS and up >= 0 and above not in _SUITE_TAGS
        if tag[i] == "testcase":
            ends = [c for c in e if c.tag.rsplit("}", 1)[-1] in _OUTCOMES]
            names = [c.tag.rsplit("}", 1)[-1] for c in ends]
            text = [c.get("message") if c.get("message") is not None else (c.text or "").strip() or "Test failed" for c in ends]
            cases.append({"outcomes": names, "types": [c.get("type") or "" for c in ends], "messages": text, **{k: e.get(k) for k in ("name", "classname", "file", "line")}})
            if up in counted:
                total = counted[up]
                total[0] += 1
                if names and names[0] in _OUTCOMES:
                    total[1 + _OUTCOMES.index(names[0])] += 1
    for i in reversed(counted):
        if found[i][1] in counted:
            counted[found[i][1]] = [a + b for a, b in zip(counted[found[i][1]], counted[i], strict=True)]
    suites = [{"declared": {k: found[i][0].get(k) for k in _COUNTERS}, "counted": dict(zip(_COUNTERS, n, strict=True))} for i, n in counted.items()]
    return {"ok": True, "root": tag[0] in _SUITE_TAGS, "misplaced": misplaced, "suites": suites, "cases": cases}


def _cases(raw: DataFrame, named: bool) -> tuple[DataFrame, DataFrame]:
    rows = flattened(raw, _SUITES, _junit_report)
    wrong = F.exists("suites", lambda s: differs(s["declared"]["tests"], s["counted"]["tests"]) | differs(s["declared"]["failures"], s["counted"]["failures"]) | differs(s["declared"]["errors"], s["counted"]["errors"]) | differs(s["declared"]["skipped"], s["counted"]["skipped"]))
    mixed = F.exists("cases", lambda c: (F.size(F.array_distinct(c["outcomes"])) > 1) | (F.size(c["outcomes"]) > 1) & (c["outcomes"][0] != "failure"))
    faults = {"out of place": F.col("misplaced"), "contradictory outcomes": mixed, "counters differ": wrong, "line": F.exists("cases", lambda c: bad_number(c["line"]))}
    if named:
        faults["case without file or name"] = F.exists("cases", lambda c: blank(c["file"]) | blank(c["name"]))
    good, gaps = split(rows, faults)
    c = good.select("report_id", F.explode("cases").alias("c"))
    outcome = F.coalesce(F.try_element_at("c.outcomes", F.lit(1)), F.lit("passed"))
    return c.select(
        "report_id", "c.file", "c.classname", "c.name", outcome.alias("outcome"), F.col("c.types").alias("failure_types"),
        F.array_join("c.messages", "; ").alias("message"), line(F.col("c.line")).alias("line"),
    ), gaps


def junit_cases(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-4, AGG-13. Test cases with outcome, failure types and messages. Suites may be nested to any depth; one whose
    counters differ from its cases, a case without file or name, one with several outcomes, and elements out of place are
    gaps."""
    cases, gaps = _cases(raw, True)
    kinds = F.when(F.col("outcome") != "skipped", F.col("failure_types")).otherwise(F.array().cast("array<string>"))
    message = F.when(F.col("outcome") != "skipped", F.col("message")).otherwise("")
    return cases.drop("line").withColumn("failure_types", kinds).withColumn("message", message), gaps


def junit(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-3. One issue per failing case: symbol class#name, messages joined by "; "."""
    cases, gaps = _cases(raw, False)
    bad = cases.where("outcome in ('failure', 'error')")
    name = F.concat_ws("#", F.coalesce("classname", F.lit("")), F.coalesce("name", F.lit("")))
    return bad.select("report_id", F.lit("junit").alias("tool"), F.col("outcome").alias("rule"), "file", "line", "message", name.alias("symbol")), gaps


def _inner(field: str) -> Column:
    """The elements `field` of all files of a report, each with its file's name."""
    return F.flatten(F.transform(F.coalesce("r.file", F.array()), lambda f: F.transform(F.coalesce(f[field], F.array()), lambda e: F.struct(f["_name"].alias("file"), e.alias("e")))))


def _located(rows: DataFrame, tool: str, rule: str, at: str, message: Column) -> DataFrame:
    f = rows.select("report_id", F.explode("found").alias("f"))
    return f.select("report_id", F.lit(tool).alias("tool"), F.col(f"f.e.{rule}").alias("rule"), "f.file", line(F.col(f"f.e.{at}")).alias("line"), F.trim(message).alias("message"), F.lit(None).cast("string").alias("symbol"))


def checkstyle(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-5. The rule is the source; errors outside a named file, without a message or with a bad line, and exceptions of the
    tool are gaps."""
    rows = parsed_xml(raw, "checkstyle", "_version string, file array<struct<_name: string, error: array<struct<_line: string, _severity: string, _message: string, _source: string, _VALUE: string>>>>")
    rows = rows.withColumn("found", _inner("error"))
    message = lambda e: F.coalesce(e["_message"], e["_VALUE"])
    good, gaps = split(rows, {
        "execution error": (tags("exception") > 0) | (tags("configerror") > 0), "out of place": tags("error") != F.size("found"), "file without name": F.exists("found", lambda x: blank(x["file"])),
        "error without source": F.exists("found", lambda x: x["e"]["_source"].isNull()), "message": F.exists("found", lambda x: message(x["e"]).isNull()), "line": F.exists("found", lambda x: bad_number(x["e"]["_line"])),
    })
    return _located(good, "checkstyle", "_source", "_line", message(F.col("f.e"))), gaps


def pmd(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-6, SRC-7. Violations, and suppressed ones under the rule pmd-suppressed; errors of the tool are gaps."""
    rows = parsed_xml(raw, "pmd", "_version string, file array<struct<_name: string, violation: array<struct<_beginline: string, _rule: string, _VALUE: string>>>>, suppressedviolation array<struct<_filename: string, _suppressiontype: string, _msg: string>>")
    rows = rows.withColumn("found", _inner("violation")).withColumn("hushed", F.coalesce("r.suppressedviolation", F.array()))
    good, gaps = split(rows, {
        "execution error": (tags("error") > 0) | (tags("configerror") > 0), "out of place": (tags("violation") != F.size("found")) | (tags("suppressedviolation") != F.size("hushed")),
        "file without name": F.exists("found", lambda x: blank(x["file"])), "rule or message": F.exists("found", lambda x: blank(x["e"]["_rule"]) | x["e"]["_VALUE"].isNull()), "line": F.exists("found", lambda x: bad_number(x["e"]["_beginline"])),
        "suppression without fields": F.exists("hushed", lambda s: blank(s["_filename"]) | blank(s["_suppressiontype"]) | blank(s["_msg"])),
    })
    s = good.select("report_id", F.explode("hushed").alias("s"))
    s = s.select("report_id", F.lit("pmd").alias("tool"), F.lit("pmd-suppressed").alias("rule"), F.col("s._filename").alias("file"), F.lit(None).cast("int").alias("line"), F.col("s._msg").alias("message"), F.lit(None).cast("string").alias("symbol"))
    return _located(good, "pmd", "_rule", "_beginline", F.col("f.e._VALUE")).unionByName(s), gaps


def spotbugs(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-8. The primary source line, else the first; the long message, else the short one; errors of the analysis, bugs out
    of place or without a type are gaps."""
    at = "array<struct<_sourcepath: string, _sourcefile: string, _start: string, _primary: string>>"
    rows = parsed_xml(raw, "BugCollection", f"_version string, BugInstance array<struct<_type: string, ShortMessage: string, LongMessage: string, SourceLine: {at}>>")
    rows = rows.withColumn("found", F.coalesce("r.BugInstance", F.array()))
    good, gaps = split(rows, {
        "execution error": tags("Error") > 0, "out of place": tags("BugInstance") != F.size("found"), "bug without type": F.exists("found", lambda b: blank(b["_type"])),
        "line": F.exists("found", lambda b: F.exists(F.coalesce(b["SourceLine"], F.array().cast(at)), lambda x: bad_number(x["_start"]))),
    })
    b = good.select("report_id", F.explode("found").alias("b")).withColumn("at", F.coalesce(F.try_element_at(F.filter("b.SourceLine", lambda x: x["_primary"] == "true"), F.lit(1)), F.try_element_at("b.SourceLine", F.lit(1))))
    return b.select("report_id", F.lit("spotbugs").alias("tool"), F.col("b._type").alias("rule"), F.coalesce("at._sourcepath", "at._sourcefile").alias("file"), line(F.col("at._start")).alias("line"), F.coalesce("b.LongMessage", "b.ShortMessage", "b._type").alias("message"), F.lit(None).cast("string").alias("symbol")), gaps


def cobertura(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-13, AGG-15, FN-11. Lines of classes with hits and branches. No file at all, a line given twice or out of place,
    branches that contradict each other and totals that differ from the lines are gaps."""
    lines = "struct<line: array<struct<_number: string, _hits: string, _branch: string, `_condition-coverage`: string>>>"
    rows = parsed_xml(
        raw, "coverage", "`_lines-valid` string, `_lines-covered` string, `_branches-valid` string, `_branches-covered` string, packages struct<package: array<struct<classes: struct<class: array<struct<_filename: string, "
        f"methods: struct<method: array<struct<lines: {lines}>>>, lines: {lines}>>>>>>",
    )
    none = F.array().cast(lines.removeprefix("struct<line: ")[:-1])
    classes = F.flatten(F.transform(F.coalesce("r.packages.package", F.array()), lambda p: F.coalesce(p["classes"]["class"], F.array())))
    within = F.aggregate("classes", F.lit(0), lambda n, c: n + F.aggregate(F.coalesce(c["methods"]["method"], F.array()), F.lit(0), lambda m, x: m + F.size(F.coalesce(x["lines"]["line"], none))))
    one = F.flatten(F.transform("classes", lambda c: F.transform(F.coalesce(c["lines"]["line"], none), lambda x: F.struct(
        c["_filename"].alias("file"), x["_number"].try_cast("int").alias("line"), x["_hits"].try_cast("long").alias("hits"), F.coalesce(x["_branch"], F.lit("false")).alias("branch"),
        branch_counts(x["_condition-coverage"]).alias("b"), x["_condition-coverage"].alias("condition"),
    ))))
    rows = rows.withColumn("classes", classes).withColumn("inner", within).withColumn("l", one)
    rate = lambda x: F.regexp_extract(x["condition"], r"^\s*(\d+(?:\.\d+)?)%", 1).try_cast("double")
    # a condition without the branch flag is read; where the flag says false, it contradicts
    branch = lambda x: F.when(x["condition"].isNull(), x["branch"] == "true").otherwise(
        x["b"].isNull() | ~x["branch"].isin("true", "false") | (x["hits"] == 0) & (x["b"]["hit"] > 0) & (x["branch"] == "true") | (F.abs(rate(x) - 100.0 * x["b"]["hit"] / x["b"]["found"]) >= 1)
    )
    sum_of = lambda f: F.aggregate("l", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x["b"][f], F.lit(0)).cast("long"))
    good, gaps = split(rows, {
        "totals differ": differs(F.col("r.`_lines-valid`"), F.size("l")) | differs(F.col("r.`_lines-covered`"), F.size(F.filter("l", lambda x: x["hits"] > 0))),
        "no file": (F.size("classes") == 0) | F.exists("classes", lambda c: blank(c["_filename"])), "out of place": (tags("line") != F.size("l") + F.col("inner")) | (tags("class") != F.size("classes")),
        "line": F.exists("l", lambda x: F.coalesce((x["line"] < 1) | (x["hits"] < 0), F.lit(True))), "line given twice": F.size(F.array_distinct(F.transform("l", lambda x: F.struct(x["file"], x["line"])))) != F.size("l"),
        "branches": F.exists("l", branch), "branch totals differ": differs(F.col("r.`_branches-valid`"), sum_of("found")) | differs(F.col("r.`_branches-covered`"), sum_of("hit")),
    })
    c = good.select("report_id", F.explode("l").alias("l"))
    return c.select("report_id", "l.file", "l.line", "l.hits", F.coalesce("l.b.found", F.lit(0)).alias("branches_found"), F.coalesce("l.b.hit", F.lit(0)).alias("branches_hit")), gaps


_SOURCES = "ok boolean, root boolean, fault string, files array<struct<file: string, line: array<struct<nr: int, mi: int, ci: int, mb: int, cb: int>>>>"
_JACOCO_COUNTERS = ("INSTRUCTION", "LINE", "BRANCH")
_JACOCO_OTHERS = ("COMPLEXITY", "METHOD", "CLASS")


def _jacoco_report(content: str | None) -> dict:
    """The source files of packages in groups of any depth; `fault` is the first contradiction between the lines and the
    counters of a source file, package, group or the report."""
    found = elements(content)
    if found is None:
        return {"ok": False}
    tag, fault, files, totals = [e.tag for e, _ in found], None, [], {}

    def number(e, name: str, default: int | None = 0) -> int:
        value = e.get(name)
        if value is None and default is not None:
            return default
        if not (value or "").isdecimal():
            raise ValueError(f"{name} of {e.tag}")
        return int(value)

    try:
        for i, (e, up) in enumerate(found):
            if tag[i] == "line" and (up < 0 or tag[up] != "sourcefile"):
                raise ValueError("out of place")
            if tag[i] in ("report", "package", "group", "sourcefile"):
                totals[i] = [0] * 6
            if tag[i] != "sourcefile":
                continue
            package = found[up][0].get("name") if up >= 0 and tag[up] == "package" else None
            if package is None or not e.get("name"):
                raise ValueError("source file without package or name")
            lines = [{k: number(x, k, None if k == "nr" else 0) for k in ("nr", "mi", "ci", "mb", "cb")} for x in e if x.tag == "line"]
            if any(x["nr"] == 0 for x in lines) or len({x["nr"] for x in lines}) < len(lines):
                raise ValueError("line given twice")
            if any(x["mi"] + x["ci"] == 0 for x in lines):
                raise ValueError("line without instructions")
            if any(x["ci"] == 0 < x["cb"] for x in lines):
                raise ValueError("branches")
            files.append({"file": f"{package}/{e.get('name')}" if package else e.get("name"), "line": lines})
            own = [f(lines) for f in (
                lambda v: sum(x["mi"] for x in v), lambda v: sum(x["ci"] for x in v), lambda v: sum(x["ci"] == 0 for x in v), lambda v: sum(x["ci"] > 0 for x in v), lambda v: sum(x["mb"] for x in v), lambda v: sum(x["cb"] for x in v),
            )]
            at = i
            while at >= 0:
                if at != i and tag[at] not in ("report", "package", "group"):
                    raise ValueError("out of place")
                totals[at] = [a + b for a, b in zip(totals[at], own, strict=True)]
                at = found[at][1]
        if not files:
            raise ValueError("no source file")
        if len({f["file"] for f in files}) < len(files):
            raise ValueError("file given twice")
        for i, total in totals.items():
            declared = [(c.get("type"), number(c, "missed", None), number(c, "covered", None)) for c in found[i][0] if c.tag == "counter"]
            kinds = [k for k, *_ in declared]
            if len(set(kinds)) < len(kinds) or not set(kinds) <= {*_JACOCO_COUNTERS, *_JACOCO_OTHERS}:
                raise ValueError("counters")
            given = {k: [m, c] for k, m, c in declared}
            if any(given.get(k, [0, 0]) != total[2 * n : 2 * n + 2] for n, k in enumerate(_JACOCO_COUNTERS)):
                raise ValueError("counters differ")
    except ValueError as e:
        fault = str(e)
    return {"ok": True, "root": tag[0] == "report", "fault": fault, "files": files}


def jacoco(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-14, AGG-14. file = package/name, hits = covered instructions, branches = missed + covered. Packages may stand in
    groups of any depth; a line without instructions or given twice, a file given twice, no file at all, and counters of a
    source file, package, group or report that differ from its lines are gaps."""
    rows = flattened(raw, _SOURCES, _jacoco_report)
    why = F.when(~F.col("ok"), "malformed").when(~F.col("root"), "wrong root").otherwise(F.col("fault"))
    rows = rows.withColumn("why", why)
    l = rows.where("why is null").select("report_id", F.explode("files").alias("f")).select("report_id", "f.file", F.explode("f.line").alias("l"))
    out = l.select("report_id", "file", F.col("l.nr").alias("line"), F.col("l.ci").cast("long").alias("hits"), (F.col("l.mb") + F.col("l.cb")).alias("branches_found"), F.col("l.cb").alias("branches_hit"))
    return out, rows.where("why is not null").select("report_id", F.col("why").alias("reason"))


def api_compatibility(raw: DataFrame, level: str = "both", expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC-24. Incompatible classes and members at a level (binary, source, both), sorted and once each; an incompatible class
    without a member's change yields CLASS_INCOMPATIBLE. Gaps: no class, a class without a name or given twice, flags that are
    missing, members worse than their class says, and, with `expected` (report_id, class), another set of classes."""
    member = "array<struct<_name: string, _binaryCompatible: boolean, _sourceCompatible: boolean, _change: string>>"
    rows = parsed_xml(raw, "japicmp japi", f"_old string, classes struct<class: array<struct<_fullyQualifiedName: string, _binaryCompatible: boolean, _sourceCompatible: boolean, member: {member}>>>")
    none = F.array().cast(member)
    rows = rows.withColumn("c", F.coalesce("r.classes.class", F.array()))
    members = lambda c: F.coalesce(c["member"], none)
    worse = lambda c: F.exists(members(c), lambda m: c["_binaryCompatible"] & ~m["_binaryCompatible"] | c["_sourceCompatible"] & ~m["_sourceCompatible"])
    unknown = lambda x: x["_binaryCompatible"].isNull() | x["_sourceCompatible"].isNull()
    names = F.transform("c", lambda c: c["_fullyQualifiedName"])
    faults = {
        "no class": F.size("c") == 0, "out of place": (tags("classes") != 1) | (tags("class") != F.size("c")), "class without name": F.exists("c", lambda c: blank(c["_fullyQualifiedName"])),
        "class given twice": F.size(F.array_distinct(names)) != F.size("c"), "flags": F.exists("c", lambda c: unknown(c) | F.exists(members(c), lambda m: unknown(m) | blank(m["_change"]))), "member contradicts class": F.exists("c", worse),
    }
    if expected is not None:
        want = expected.groupBy("report_id").agg(F.array_sort(F.collect_set("class")).alias("want"))
        rows = rows.join(want, "report_id", "left")
        faults["other classes than expected"] = F.array_sort(names) != F.coalesce("want", F.array().cast("array<string>"))
    good, gaps = split(rows, faults)
    bad = lambda x: {"binary": ~x["_binaryCompatible"], "source": ~x["_sourceCompatible"], "both": ~x["_binaryCompatible"] | ~x["_sourceCompatible"]}[level]
    c = good.select("report_id", F.explode("c").alias("c")).where(bad(F.col("c")) | F.exists(members(F.col("c")), bad))
    changes = F.filter(members(F.col("c")), bad)
    own = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit("CLASS_INCOMPATIBLE").alias("change")))
    found = F.when(F.size(changes) > 0, F.transform(changes, lambda m: F.struct(m["_name"].alias("name"), m["_change"].alias("change")))).otherwise(own)
    out = c.select("report_id", F.col("c._fullyQualifiedName").alias("class"), F.explode(found).alias("m")).select("report_id", "class", F.col("m.name").alias("member"), F.col("m.change").alias("rule"))
    return out.distinct(), gaps
