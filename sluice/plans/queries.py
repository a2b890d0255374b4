"""The registered queries over the star-schema tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.functions import text as T
from sluice.operators import diff, expressions as X, gates, globs, graph, rules, scope, sets, stats, windows
from sluice.plans import adapters as A
from sluice.plans.adapters import sql, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, statement: str | None = None):
    def register(f):
        QUERIES[name] = f
        if statement:
            ORACLE_SQL[name] = sql(statement)
        return f

    return register


@query("flagship_gate")
def flagship_gate(spark: SparkSession, d: str) -> DataFrame:
    """Diff, marker rule on added lines, ratchet of marker counts and gate."""
    marker = [r for r in rules.PATTERN_RULES if r[0] == "todo-marker"]

    def hits(files: DataFrame) -> DataFrame:
        return rules.pattern_findings(A.numbered(files).withColumn("language", F.lit(None).cast("string")), rules=marker)

    count = lambda df: df.groupBy(F.lit(None).cast("string").alias("tool"), "rule").agg(F.count(F.lit(1)).alias("n"))
    held = gates.ratchet(count(hits(A.base_files(spark, d))), count(hits(A.head_files(spark, d))))
    added = rules.pattern_findings(A.added_lines(spark, d).withColumn("language", F.lit(None).cast("string")), rules=marker)
    found = added.groupBy("rule").agg(F.count(F.lit(1)).alias("added_findings"))
    rows = held.join(found, "rule", "left").select("rule", "baseline", "current", "increased", F.coalesce("added_findings", F.lit(0)).alias("added_findings"))
    check = rows.select(
        F.col("rule").alias("id"), F.lit(True).alias("required"), F.lit("error").alias("severity"), F.lit("applicable").alias("applicability"), F.lit("completed").alias("status"),
        F.lit(None).cast("string").alias("reason"), F.when(F.col("increased"), "fail").otherwise("pass").alias("verdict"), F.when(F.col("increased"), F.col("added_findings")).otherwise(0).alias("finding_count"), "baseline", "current", "added_findings",
    )
    return gates.gate(check, keys=["baseline", "current", "added_findings"]).select("decision", "gaps", "failures", "baseline", "current", "added_findings")


MARK = r"regexp_matches(text, '(?i)\b(?:TODO|FIXME|XXX)\b')"
ORACLE_SQL["flagship_gate"] = sql(
    "SELECT CASE WHEN current > baseline THEN 'fail' ELSE 'pass' END AS decision, 0 AS gaps, CASE WHEN current > baseline THEN 1 ELSE 0 END AS failures, baseline, current, added_findings FROM ("
    f"SELECT (SELECT count(*) FROM head_lines WHERE {MARK}) AS current, (SELECT count(*) FROM added_lines WHERE {MARK}) AS added_findings, "
    r"(SELECT count(*) FROM (SELECT unnest(CASE WHEN content = '' THEN [] ELSE string_split_regex(regexp_replace(content, '\r?\n\z', ''), '\r?\n') END) AS text FROM base) "
    f"WHERE {MARK}) AS baseline)"
)


# --- sources and files ---------------------------------------------------------------------------------------------------


@query("src1_file_scan", "SELECT path, octet_length(encode(content)) AS bytes, 'sha256:' || sha256(content) AS digest, octet_length(encode(content)) > 20000 AS over_limit FROM head")
def src1(spark, d):
    c = F.col("content")
    return A.head_files(spark, d).select("path", F.octet_length(c).alias("bytes"), T.digest(c).alias("digest"), (F.octet_length(c) > 20_000).alias("over_limit"))


@query("src2_commit_messages", "SELECT conv_id || ':' || turn AS oid, string_split(text, chr(10))[1] AS subject FROM conversations WHERE NOT regexp_matches(string_split(text, chr(10))[1], '^[A-Z][a-z]+ [a-z]+')")
def src2(spark, d):
    c = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("oid"), F.col("text").alias("message"))
    return rules.commit_subjects(c, r"^[A-Z][a-z]+ [a-z]+")


@query("flt1_include_globs", "SELECT path FROM head WHERE regexp_matches(path, '^src1[^/]*/') OR regexp_matches(path, '^moved/.*/en/[^/]*\\.txt$')")
def flt1(spark, d):
    return rules.include(A.head_files(spark, d), ["src1*/**", "moved/**/en/*.txt"]).select("path")


@query("flt2_exclude_globs", "SELECT path FROM head WHERE NOT regexp_matches(path, '^[^/]*/de/[^/]*5\\.txt$') AND NOT regexp_matches(path, '^moved/')")
def flt2(spark, d):
    return rules.exclude(A.head_files(spark, d), ["*/de/*5.txt", "moved/**"]).select("path")


@query(
    "flt3_exclusion_reason",
    "SELECT path, CASE WHEN regexp_matches(path, '^a/[^/]*7\\.(?:pdf|md)$') THEN 'explicit' WHEN path LIKE '%.pdf' AND NOT regexp_matches(path, '^b/') THEN 'resource' END AS reason "
    "FROM (SELECT concat(['a', 'b', 'c'][page_id % 3 + 1], '/', page_id, CASE WHEN page_id % 2 = 0 THEN '.pdf' ELSE '.md' END) AS path FROM pages)",
)
def flt3(spark, d):
    return _resources(spark, d).select("path", rules.exclusion_reason(F.col("path"), ["a/*7.{pdf,md}"], ["b/**"]).alias("reason"))


def _resources(spark, d):
    p = F.col("page_id")
    name = F.concat(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (p % 3 + 1).cast("int")), F.lit("/"), p.cast("string"), F.when(p % 2 == 0, ".pdf").otherwise(".md"))
    return table(spark, d, "pages").select(name.alias("path"))


@query("flt4_protected_exclusions", "SELECT path FROM (SELECT concat(['a', 'b', 'c'][page_id % 3 + 1], '/', page_id, CASE WHEN page_id % 2 = 0 THEN '.pdf' ELSE '.md' END) AS path FROM pages) WHERE regexp_matches(path, '^a/[^/]*\\.pdf$')")
def flt4(spark, d):
    r = _resources(spark, d)
    return rules.protected_exclusions(r.where(rules.exclusion_reason(F.col("path"), [], []).isNotNull()), ["a/*"])


@query(
    "flt5_language",
    "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'rust' WHEN 3 THEN 'shell' WHEN 4 THEN 'c' END AS language FROM documents",
)
def flt5(spark, d):
    m = (F.col("doc_id") % 6).cast("int")
    name = F.element_at(F.array(*[F.lit(x) for x in ("a.py", "b.tsx", "c.rs", "run", "d.h", "e.txt")]), m + 1)
    content = F.when(m == 3, F.concat(F.lit("#!/usr/bin/env -S bash -e\n"), "text")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", rules.language(name, content, c_family=True).alias("language"))


@query(
    "flt6_eol",
    r"SELECT doc_id, CASE WHEN regexp_matches(c, '\r\n') AND regexp_matches(c, '(?s)(?:^|[^\r])\n') THEN 'mixed' WHEN regexp_matches(c, '\r\n') THEN 'crlf' WHEN regexp_matches(c, '(?s)(?:^|[^\r])\n') THEN 'lf' ELSE 'none' END AS eol "
    r"FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 1 THEN text || chr(13) || chr(10) ELSE text END AS c FROM documents)",
)
def flt6(spark, d):
    return table(spark, d, "documents").select("doc_id", T.eol(_eols()).alias("eol"))


def _eols():
    m = F.col("doc_id") % 3
    return F.when(m == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).when(m == 1, F.concat("text", F.lit("\r\n"))).otherwise(F.col("text"))


@query(
    "flt7_line_endings",
    "SELECT path, actual, CASE WHEN was = 'none' THEN 'lf' ELSE was END AS expected FROM (SELECT CAST(doc_id AS VARCHAR) AS path, "
    r"CASE WHEN regexp_matches(c, '\r\n') AND regexp_matches(c, '(?s)(?:^|[^\r])\n') THEN 'mixed' WHEN regexp_matches(c, '\r\n') THEN 'crlf' WHEN regexp_matches(c, '(?s)(?:^|[^\r])\n') THEN 'lf' ELSE 'none' END AS actual, "
    r"CASE WHEN regexp_matches(text, '\r\n') AND regexp_matches(text, '(?s)(?:^|[^\r])\n') THEN 'mixed' WHEN regexp_matches(text, '\r\n') THEN 'crlf' WHEN regexp_matches(text, '(?s)(?:^|[^\r])\n') THEN 'lf' ELSE 'none' END AS was "
    "FROM (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 1 THEN text || chr(13) || chr(10) ELSE text END AS c FROM documents) WHERE c <> text) WHERE actual <> 'none' AND actual <> expected",
)
def flt7(spark, d):
    docs = table(spark, d, "documents")
    base = docs.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    head = docs.select(F.col("doc_id").cast("string").alias("path"), _eols().alias("content"))
    return rules.line_endings(diff.snapshot_diff(base, head), base, head)


@query("flt8_binary_files", "SELECT path, CASE WHEN path LIKE '%.jar' THEN 'suffix' ELSE 'nul' END AS reason FROM (SELECT concat('x/', doc_id, CASE WHEN doc_id % 7 = 0 THEN '.JAR' ELSE '.txt' END) AS p, lower(concat('x/', doc_id, CASE WHEN doc_id % 7 = 0 THEN '.JAR' ELSE '.txt' END)) AS path, doc_id FROM documents) WHERE doc_id % 7 = 0 OR doc_id % 5 = 0")
def flt8(spark, d):
    m = F.col("doc_id")
    content = F.when(m % 5 == 0, F.concat(F.lit("ab\0"), "text")).otherwise(F.concat(F.lit("x" * 4095 + "é"), "text"))
    files = table(spark, d, "documents").select(F.concat(F.lit("x/"), m.cast("string"), F.when(m % 7 == 0, ".JAR").otherwise(".txt")).alias("path"), content.alias("content"))
    return rules.binary_files(files).select(F.lower("path").alias("path"), "reason")


@query("flt9_oversized_files", "SELECT path, octet_length(encode(content)) AS bytes FROM head JOIN changes USING (path) WHERE kind = 'added' AND octet_length(encode(content)) > 2000")
def flt9(spark, d):
    added = A.head_files(spark, d).join(A.changes(spark, d).where("kind = 'added'").select("path"), "path")
    return rules.oversized_files(added, 2000).select("path", F.octet_length("content").alias("bytes"))


@query(
    "flt10_source_patterns",
    "SELECT path, line_no, 'todo-marker' AS rule, 0 AS pattern FROM added_lines WHERE regexp_matches(text, '(?i)\\b(?:TODO|FIXME|XXX)\\b') "
    "UNION ALL SELECT path, line_no, 'workaround-marker', 0 FROM added_lines WHERE regexp_matches(text, '(?i)\\bworkaround\\b|\\btemporary\\s+fix\\b|暂时规避|临时方案|临时绕过') "
    "UNION ALL SELECT path, line_no, 'py-bare-except', 0 FROM added_lines WHERE regexp_matches(text, '^\\s*except\\s*:') "
    "UNION ALL SELECT path, line_no, 'py-eval-exec', 0 FROM added_lines WHERE regexp_matches(text, '\\b(?:eval|exec)\\s*\\(') "
    "UNION ALL SELECT path, line_no, 'py-assert-in-production', 0 FROM added_lines WHERE regexp_matches(text, '^\\s*assert\\s+')",
)
def flt10(spark, d):
    wanted = {"todo-marker", "workaround-marker", "py-bare-except", "py-eval-exec", "py-assert-in-production"}
    lines = A.added_lines(spark, d).withColumn("language", F.lit("python"))
    return rules.pattern_findings(lines, "source-pattern", [r for r in rules.PATTERN_RULES if r[0] in wanted]).select("path", "line_no", "rule", "pattern")


def _sample(pattern: str) -> str:
    """A text that a pattern matches: first alternatives, fewest repeats. Empty for syntax that Python lacks."""
    from re import _constants as c, _parser, error

    def one(items) -> str:
        out = ""
        for op, arg in items:
            if op is c.LITERAL:
                out += chr(arg)
            elif op in (c.NOT_LITERAL, c.ANY):
                out += "~"
            elif op is c.IN:
                kind, first = arg[0]
                out += {c.LITERAL: lambda x: chr(x), c.RANGE: lambda x: chr(x[0]), c.CATEGORY: lambda x: {c.CATEGORY_SPACE: " ", c.CATEGORY_DIGIT: "7"}.get(x, "w"), c.NEGATE: lambda x: "~"}[kind](first)
            elif op is c.SUBPATTERN:
                out += one(arg[3])
            elif op is c.BRANCH:
                out += one(arg[1][0])
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
                out += one(arg[2]) * max(arg[0], 0)
        return out

    try:
        return one(_parser.parse(pattern))
    except error:
        return ""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: A text for each pattern and a language that it is for, in the order of the rules: added lines are mixed with them, as the
#: tables hold prose. Half of the files stand below tests.
_SAMPLES = [(_sample(p), "python" if lang == "all" else lang) for r in rules.PATTERN_RULES for lang, ps in r[5].items() for p in ps]
_PICK = f"(line_no + length(path) * 7) % {len(_SAMPLES)} + 1"
_CODE = f"""SELECT CASE WHEN length(path) % 2 = 0 THEN 'tests/' || path ELSE path END AS path, kind, line_no, list_extract([{', '.join(_quoted(lang) for _, lang in _SAMPLES)}], {_PICK}) AS language,
CASE WHEN line_no % 3 = 0 THEN text ELSE list_extract([{', '.join(_quoted(x) for x, _ in _SAMPLES)}], {_PICK}) || ' ' || text END AS text FROM added_lines"""


#: The line for DuckDB's regexes, whose word ends are those of ASCII words. The rules' are those of words in any language: no word
#: ends between a letter or digit, with its marks, and the next one. So these are written as 9, which no pattern asks for once 8
#: stands for 9 and the patterns' classes end at 8.
_MARKED = r"""regexp_replace(regexp_replace(replace(text, '9', '8'), '([\p{L}\p{Nd}])\p{Mn}+', '\19', 'g'), '[^\P{L}\x00-\x7F]|[^\P{Nd}\x00-\x7F]', '9', 'g')"""


def _matches(pattern: str) -> str:
    """SQL for whether a rule's pattern matches a line as it does in the rules, on `marked` if it is ASCII."""
    if not pattern.isascii():  # its parts that are not ASCII are plain texts or classes, without word ends
        flags = "(?i)" if pattern.startswith("(?i)") else ""
        parts = pattern.removeprefix("(?i)").split("|")
        wide = "|".join(p for p in parts if not p.isascii())
        rest = "|".join(p for p in parts if p.isascii())
        return f"(regexp_matches(text, {_quoted(wide)}) OR {_matches(flags + rest)})" if rest else f"regexp_matches(text, {_quoted(wide)})"
    if r"\x{" in pattern:
        return f"regexp_matches(text, {_quoted(pattern)})"
    same, out, inside, i = {r"\s": r"[\s\x0B]", r"\S": r"[^\s\x0B]", r"\d": "[0-8]", r"\w": "[A-Za-z0-8_]"}, "", False, 0
    while i < len(pattern):
        c = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        if inside and pattern.startswith("-9", i):
            c, new = "-9", "-8"
        elif c == "[" and not inside:
            inside, new = True, c
        elif c == "]" and inside:
            inside, new = False, c
        elif c in same:
            new = same[c][1:-1] if inside else same[c]
        elif c == "." and not inside:
            new = r"[^\n\r\x{85}\x{2028}\x{2029}]"
        elif c == "$" and not inside:
            new = r"(?:\r\n?|[\n\x{85}\x{2028}\x{2029}])?$"
        else:
            new = c
        out, i = out + new, i + len(c)
    return f"regexp_matches(marked, {_quoted(out)})"


def _all_patterns(kind: str) -> str:
    """path, line_no, rule and severity of every pattern of a kind, each tried on each line."""
    cases = [
        f"CASE WHEN {_matches(p)}{'' if lang == 'all' else f' AND language = {_quoted(lang)}'}{" AND starts_with(path, 'tests/')" if paths else ''} THEN {{'rule': {_quoted(rule)}, 'severity': {_quoted(severity)}}} END"
        for rule, of, severity, _, paths, patterns in rules.PATTERN_RULES if of == kind for lang, several in patterns.items() for p in dict.fromkeys(several)
    ]
    return f"SELECT path, line_no, h.rule, h.severity FROM (SELECT path, line_no, unnest(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)) AS h FROM (SELECT *, {_MARKED} AS marked FROM ({_CODE})) {'' if kind == 'source-pattern' else 'WHERE kind = ' + _quoted('added')})"


def _code_lines(spark, d):
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in _SAMPLES]), ((F.col("line_no") + F.length("path") * 7) % len(_SAMPLES) + 1).cast("int"))
    text = F.when(F.col("line_no") % 3 == 0, F.col("text")).otherwise(F.concat(pick(0), F.lit(" "), "text"))
    path = F.when(F.length("path") % 2 == 0, F.concat(F.lit("tests/"), "path")).otherwise(F.col("path"))
    return A.added_lines(spark, d).select(path.alias("path"), "kind", "line_no", pick(1).alias("language"), text.alias("text"))


@query("flt10_all_rules_one_scan", f"SELECT rule, severity, count(*) AS findings, count(DISTINCT path) AS files FROM ({_all_patterns('source-pattern')}) GROUP BY ALL")
def flt10_all(spark, d):
    return rules.pattern_findings(_code_lines(spark, d), "source-pattern").groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("path").alias("files"))


@query("flt11_file_patterns", f"SELECT path, line_no, rule FROM ({_all_patterns('file-pattern')})")
def flt11(spark, d):
    return rules.pattern_findings(_code_lines(spark, d).where("kind = 'added'"), "file-pattern").select("path", "line_no", "rule")


@query("flt12_shebang", "SELECT path, text FROM head_lines JOIN (SELECT path FROM changes WHERE kind = 'added') USING (path) WHERE line_no = 1 AND NOT starts_with(text, '#!')")
def flt12(spark, d):
    return rules.missing_shebang(A.added_lines(spark, d).where("kind = 'added'")).select("path", "text")


@query("flt13_commit_verdict", "SELECT count(*) AS commits, count(*) FILTER (WHERE NOT regexp_matches(string_split(text, chr(10))[1], '^[A-Z][a-z]+ [a-z]+')) AS bad, CASE WHEN count(*) = 0 THEN 'skipped' WHEN count(*) FILTER (WHERE NOT regexp_matches(string_split(text, chr(10))[1], '^[A-Z][a-z]+ [a-z]+')) > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM conversations")
def flt13(spark, d):
    return rules.commit_verdict(table(spark, d, "conversations").select(F.col("text").alias("message")), r"^[A-Z][a-z]+ [a-z]+")


@query("flt14_entity_names", "SELECT doc_id, name FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'test_' || source ELSE 'Test' || doc_id END AS name, ['python', 'go', 'rust'][doc_id % 3 + 1] AS language FROM documents) "
       "WHERE CASE language WHEN 'python' THEN NOT regexp_matches(name, '^test_[a-z0-9_]+$') WHEN 'go' THEN NOT regexp_matches(name, '^Test[A-Z_][A-Za-z0-9_]*$') ELSE NOT regexp_matches(name, '^[a-z][a-z0-9_]*$') END")
def flt14(spark, d):
    i = F.col("doc_id")
    e = table(spark, d, "documents").select(
        "doc_id", F.when(i % 2 == 0, F.concat(F.lit("test_"), "source")).otherwise(F.concat(F.lit("Test"), i.cast("string"))).alias("name"),
        F.element_at(F.array(F.lit("python"), F.lit("go"), F.lit("rust")), (i % 3 + 1).cast("int")).alias("language"), F.lit("added").alias("kind"),
    )
    return rules.name_findings(e).select("doc_id", "name")


@query("flt15_import_boundary", "SELECT class, count(*) AS n FROM (SELECT CASE WHEN lang NOT IN ('en', 'de') THEN 'gap' WHEN regexp_matches(w, '^[Tt]h') THEN 'forbidden' WHEN regexp_matches(w, '^[A-M]') THEN 'declared' ELSE 'undeclared' END AS class FROM (SELECT lang, string_split(text, ' ')[1] AS w FROM documents)) GROUP BY class")
def flt15(spark, d):
    i = table(spark, d, "documents").select(F.col("lang").alias("language"), F.element_at(F.split("text", " ", -1), 1).alias("text"))
    both = lambda p: {"en": [p], "de": [p]}
    return rules.import_classes(i, both("^[Tt]h"), both("^[A-M]")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("flt16_comment_language", "SELECT lang, count(*) AS n FROM documents WHERE NOT regexp_matches(text, '[㐀-鿿]') AND len(regexp_extract_all(text, '[A-Za-z]+')) >= 3 AND NOT regexp_matches(text, '^Licensed') GROUP BY lang")
def flt16(spark, d):
    return rules.comment_findings(table(spark, d, "documents"), "chinese", exempt="^Licensed").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("flt17_assertions", "SELECT doc_id, 'forbid_pattern' AS assertion FROM documents WHERE regexp_matches(text, 'token\\s*=') UNION ALL SELECT doc_id, 'require_pattern' FROM documents WHERE NOT regexp_matches(text, '[.]')")
def flt17(spark, d):
    e = table(spark, d, "documents").withColumn("name", F.col("source"))
    return rules.name_assertions(e, forbid=r"token\s*=", require=r"[.]").select("doc_id", "assertion")


@query("flt18_marker_fields", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'tool' WHEN doc_id % 3 = 1 THEN 'author' ELSE 'author,tool' END AS missing FROM documents WHERE doc_id % 4 <> 0 OR true")
def flt18(spark, d):
    m = F.col("doc_id") % 3
    text = F.when(m == 0, "@ai(author: me)").when(m == 1, "@ai(author: a, author: b, tool='x y')").otherwise("@ai(note: none)")
    return rules.missing_marker_fields(table(spark, d, "documents").select("doc_id", text.alias("text")), ["author", "tool"]).select("doc_id", "missing")


@query("flt19_select_changes", "SELECT kind, count(*) AS n FROM changes WHERE kind IN ('added', 'modified', 'renamed') GROUP BY kind")
def flt19(spark, d):
    return rules.select_changes(A.changes(spark, d), ["any"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("flt20_project_issues", "SELECT count(*) AS n FROM events WHERE regexp_matches(CAST(user_id AS VARCHAR), '^1')")
def flt20(spark, d):
    i = A.issues(spark, d).withColumn("locations", F.array(F.struct(F.col("file"), F.lit(1).alias("line"))))
    return scope.project_issues(i, "^1").agg(F.count(F.lit(1)).alias("n"))


@query("flt21_changed_line_issues", "SELECT event_id AS id, false AS gap FROM issues WHERE side = 'head' AND event_id % 5 <> 0 AND event_id % 100 BETWEEN 0 AND 100 AND EXISTS (SELECT 1 FROM (SELECT CAST(o_custkey % 150 AS VARCHAR) AS file, o_orderkey % 100 AS line FROM orders) l WHERE l.file = issues.file AND l.line BETWEEN event_id % 100 AND event_id % 100 + 1) UNION ALL SELECT event_id, true FROM issues WHERE side = 'head' AND event_id % 5 = 0")
def flt21(spark, d):
    i = A.issues(spark, d).where("side = 'head'")
    at = (F.col("event_id") % 100).cast("int")
    spot = F.struct(F.col("file"), F.when(F.col("event_id") % 5 != 0, at).alias("line"), (at + 1).alias("end_line"))
    lines = table(spark, d, "orders").select((F.col("o_custkey") % 150).cast("string").alias("path"), (F.col("o_orderkey") % 100).cast("int").alias("line_no"))
    hit, gaps = scope.changed_line_issues(i.select(F.col("event_id").alias("id"), F.array(spot).alias("locations")), lines)
    return hit.select("id", F.lit(False).alias("gap")).unionByName(gaps.select("id", F.lit(True).alias("gap")))


@query("flt22_affected_scope", "SELECT tool, count(*) AS n FROM issues WHERE side = 'head' AND file IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 3 = 0) GROUP BY tool")
def flt22(spark, d):
    affected = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("file"))
    return scope.affected_issues(A.issues(spark, d).where("side = 'head'"), affected).groupBy("tool").agg(F.count(F.lit(1)).alias("n"))


@query("flt23_delivery_scope", "SELECT id FROM (SELECT doc_id AS id, concat(source, '/', lang, '/', doc_id, '.txt') AS file, 1 AS s, 3 AS e FROM documents WHERE doc_id % 10 <> 1) f LEFT JOIN (SELECT old_path, path FROM changes WHERE old_path <> path) a ON a.old_path = f.file WHERE id % 17 = 0 OR EXISTS (SELECT 1 FROM added_lines l WHERE l.path = coalesce(a.path, f.file) AND l.line_no BETWEEN 1 AND 3)")
def flt23(spark, d):
    f = table(spark, d, "documents").where("doc_id % 10 <> 1").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 17 != 0, F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("file"), F.lit(1).alias("start_line"), F.lit(3).alias("end_line")
    )
    lines = A.added_lines(spark, d).select("path", "line_no", F.lit("added").alias("op"))
    return scope.deliver(f, A.changes(spark, d), lines).select("id")


@query("flt24_baseline_delivery", "SELECT old_path AS file FROM changes WHERE kind IN ('deleted', 'renamed') AND old_path IN (SELECT path FROM base WHERE content <> '')")
def flt24(spark, d):
    """Findings on the first line of every base file; the lines of files that left their place count as removed."""
    c = A.changes(spark, d)
    f = A.base_files(spark, d).select(F.col("path").alias("id"), F.col("path").alias("file"), F.lit(1).alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    gone = A.numbered(A.base_files(spark, d)).join(c.where("kind in ('deleted', 'renamed')").select(F.col("old_path").alias("path")), "path", "left_semi")
    return scope.deliver(f, c, gone.select("path", "line_no", F.lit("removed").alias("op")), op="removed").select("file")


@query("flt25_shown_location", "SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'f' || user_id ELSE 'a' END AS file FROM events")
def flt25(spark, d):
    e = table(spark, d, "events")
    spots = F.array(F.struct(F.lit("a").alias("file")), F.struct(F.concat(F.when(F.col("user_id") % 2 == 0, "f").otherwise("g"), F.col("user_id").cast("string")).alias("file")))
    return scope.shown_location(e.select(F.col("event_id").alias("id"), spots.alias("locations")), "^f").select("id", F.col("location.file").alias("file"))


@query("flt26_metric_facts", "SELECT 'fact' AS part, count(*) AS n FROM part WHERE p_brand = 'Brand#1' AND p_partkey % 4 <> 0 UNION ALL SELECT 'gap', count(*) FROM part WHERE p_brand = 'Brand#1' AND p_partkey % 4 = 0")
def flt26(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("metric"), F.when(F.col("p_partkey") % 4 != 0, "lines").alias("unit"), F.lit("exact").alias("measurement"))
    good, bad = rules.metric_facts(p, "Brand#1", "lines", "exact")
    return good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("fact").alias("part"), "n").unionByName(bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit("gap").alias("part"), "n"))


@query("flt27_clone_facts", "SELECT p_partkey AS id FROM part WHERE p_size >= 40 AND p_partkey % 10 >= 4 AND p_partkey % 7 >= 3")
def flt27(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(
        k.alias("id"), (F.col("p_size") / 50).cast("decimal(38,18)").alias("similarity"), F.lit(1).alias("left_start"), (k % 10 + 1).cast("int").alias("left_end"), F.lit(1).alias("right_start"), F.lit(50).alias("right_end"),
        (k % 7).alias("left_nodes"), F.lit(9).alias("right_nodes"),
    )
    return rules.clone_facts(p, "0.8", min_lines=5, min_nodes=3).select("id")


@query("flt28_floor_covers", "SELECT p_partkey AS id, p_size < 25 AS covers FROM part")
def flt28(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), rules.floor_covers((F.col("p_size") / 50).cast("decimal(38,18)"), F.lit("0.5")).alias("covers"))


@query("flt29_rule_query", "SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#2' AND (p_size % 3 = 0 OR p_size % 3 = 1)")
def flt29(spark, d):
    langs = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).when(F.col("p_size") % 3 == 1, F.array(F.lit("go"), F.lit("java"))).otherwise(F.array(F.lit("c")))
    r = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"), langs.alias("languages"))
    return rules.rule_query(r, "Brand#2", "go").select("id")


@query("flt30_triggers", "SELECT id, min(path) AS evidence, count(*) AS changes FROM (SELECT 'docs' AS id, path FROM changes WHERE kind <> 'unchanged' AND regexp_matches(path, '^src1/') UNION ALL SELECT 'moved', path FROM changes WHERE kind <> 'unchanged' AND regexp_matches(path, '^moved/') AND path LIKE '%/en/%') GROUP BY id")
def flt30(spark, d):
    c = A.changes(spark, d).where("kind <> 'unchanged'").withColumn("language", F.when(F.col("path").contains("/en/"), "en"))
    checks = spark.createDataFrame([("docs", [], ["^src1/"], []), ("moved", ["^moved/"], [], ["en"])], "id string, paths array<string>, inputs array<string>, languages array<string>")
    return rules.triggered(checks, c)


@query("flt31_build_inputs", "SELECT page_id AS id, page_id % 5 < 3 AS shared FROM pages")
def flt31(spark, d):
    names = F.array(*[F.lit(x) for x in ("x/pom.xml", "requirements-dev.txt", "a/b/.cargo/config", "src/main.rs", "docs/requirements.md")])
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), rules.shared_build_input(F.element_at(names, (F.col("page_id") % 5 + 1).cast("int"))).alias("shared"))


@query("flt32_scope", "SELECT conv_id, turn, role = 'user' OR turn % 2 = 0 AS applies FROM conversations")
def flt32(spark, d):
    roles = F.when(F.col("turn") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", rules.in_scope(roles, F.array().cast("array<string>"), "user", "any").alias("applies"))


# --- diffs ---------------------------------------------------------------------------------------------------------------


@query("dif1_snapshot_diff", "SELECT path, kind, old_path FROM changes")
def dif1(spark, d):
    return A.changes(spark, d)


# a last line without an end gets one, so it is another line
@query("dif2_line_diff", "SELECT path, 'added' AS op, count(*) AS n FROM added_lines WHERE kind = 'modified' GROUP BY path UNION ALL SELECT path, 'removed' AS op, 1 AS n FROM changes JOIN base USING (path) WHERE kind = 'modified' AND content <> '' AND NOT suffix(content, chr(10))")
def dif2(spark, d):
    pairs = A.changes(spark, d).where("kind = 'modified'").select("path")
    old = A.base_files(spark, d).select("path", F.col("content").alias("old"))
    new = A.head_files(spark, d).select("path", F.col("content").alias("new"))
    return diff.line_diff(pairs.join(old, "path").join(new, "path")).groupBy("path", "op").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dif2_edited_lines",
    r"SELECT path, op, line_no FROM (WITH l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS k, len(a) AS n FROM (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split_regex(regexp_replace(text, '\r?\n\z', ''), '\r?\n') END AS a FROM documents)), "
    "new AS (SELECT doc_id, k, 0 AS sub, k % 11 = 5 AS fresh FROM l WHERE k % 7 <> 3 AND NOT (k = 1 AND n >= 4) UNION ALL SELECT doc_id, k, 1, true FROM l WHERE k % 7 <> 3 AND k % 13 = 4 "
    "UNION ALL SELECT doc_id, n + 1, 0, true FROM l WHERE k = 1 AND n >= 4) "
    "SELECT CAST(doc_id AS VARCHAR) AS path, 'removed' AS op, k AS line_no FROM l WHERE k % 7 = 3 OR k % 11 = 5 OR (k = 1 AND n >= 4) "
    "UNION ALL SELECT CAST(doc_id AS VARCHAR), 'added', line_no FROM (SELECT doc_id, fresh, row_number() OVER (PARTITION BY doc_id ORDER BY k, sub) AS line_no FROM new) WHERE fresh)",
)
def dif2_edits(spark, d):
    """Every document against itself with lines deleted, edited, inserted and the first one moved to the end."""
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), T.lines(F.col("text")).alias("l"))
    old = F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), F.regexp_replace(x, "\r", "")))

    def edited(x, i):
        k, none = i + 1, F.array().cast("array<string>")
        line = F.array(F.when(k % 11 == 5, F.concat(x, F.lit(" edited"))).otherwise(x))
        return F.when(k % 7 == 3, none).otherwise(F.concat(line, F.when(k % 13 == 4, F.array(F.concat(F.lit("new "), k.cast("string")))).otherwise(none)))

    docs = docs.withColumn("old", old).withColumn("new", F.flatten(F.transform("old", edited)))
    moved = F.when(F.size("l") >= 4, F.concat(F.slice("new", 2, F.size("new")), F.slice("new", 1, 1))).otherwise(F.col("new"))
    ended = lambda a: F.array_join(F.transform(a, lambda x: F.concat(x, F.lit("\n"))), "")
    return diff.line_diff(docs.select("path", ended(F.col("old")).alias("old"), ended(moved).alias("new")))


@query(
    "dif3_tree_digest",
    "SELECT sum(n) AS files, 'sha256:' || sha256(string_agg(leaf, ',' ORDER BY part)) AS digest FROM (SELECT substr(sha256(path), 1, 3) AS part, count(*) AS n, sha256(string_agg(leaf, ',' ORDER BY path)) AS leaf FROM "
    "(SELECT path, sha256(concat_ws(chr(10), octet_length(encode(path)), path, 0, octet_length(encode(content)), sha256(content))) AS leaf FROM head) GROUP BY 1)",
)
def dif3(spark, d):
    return diff.tree_digest(A.head_files(spark, d))


_DIF4 = """
, r1 AS (SELECT h.ord, h.path, h.symbol, b.ord AS b_ord, CASE WHEN h.body_digest = b.body_digest THEN 'unchanged' ELSE 'modified' END AS kind
  FROM (SELECT *, row_number() OVER (PARTITION BY path, language, symbol ORDER BY path, ord, symbol) AS n FROM ent_h) h
  JOIN (SELECT *, row_number() OVER (PARTITION BY path, language, symbol ORDER BY path, ord, symbol) AS n FROM ent_b) b
  ON h.path = b.path AND h.language = b.language AND h.symbol = b.symbol AND h.n = b.n),
h2 AS (SELECT * FROM ent_h WHERE ord NOT IN (SELECT ord FROM r1)), b2 AS (SELECT * FROM ent_b WHERE ord NOT IN (SELECT b_ord FROM r1)),
r2 AS (SELECT h.ord, h.path, h.symbol, b.ord AS b_ord, 'renamed' AS kind
  FROM (SELECT *, row_number() OVER (PARTITION BY language, symbol, body_digest ORDER BY path, ord, symbol) AS n FROM h2) h
  JOIN (SELECT *, row_number() OVER (PARTITION BY language, symbol, body_digest ORDER BY path, ord, symbol) AS n FROM b2) b
  ON h.language = b.language AND h.symbol = b.symbol AND h.body_digest = b.body_digest AND h.n = b.n),
h3 AS (SELECT * FROM h2 WHERE ord NOT IN (SELECT ord FROM r2)), b3 AS (SELECT * FROM b2 WHERE ord NOT IN (SELECT b_ord FROM r2)),
r3 AS (SELECT h.ord, h.path, h.symbol, b.ord AS b_ord, 'renamed' AS kind
  FROM (SELECT *, row_number() OVER (PARTITION BY language, body_digest ORDER BY path, ord, symbol) AS n FROM h3) h
  JOIN (SELECT *, row_number() OVER (PARTITION BY language, body_digest ORDER BY path, ord, symbol) AS n FROM b3) b
  ON h.language = b.language AND h.body_digest = b.body_digest AND h.n = b.n),
matched AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT ord, path, symbol, NULL, 'added' FROM h3 WHERE ord NOT IN (SELECT ord FROM r3))
"""


@query("dif4_entity_matching")
def dif4(spark, d):
    m = diff.match_entities(A.entities(spark, d, "base"), A.entities(spark, d, "head"))
    return m.select("path", "symbol", "kind", F.col("base_ord").alias("base_ord"))


ORACLE_SQL["dif4_entity_matching"] = sql("SELECT 1 FROM ent_b, ent_h").replace(" SELECT 1 FROM ent_b, ent_h", _DIF4 + "SELECT path, symbol, kind, b_ord AS base_ord FROM matched")


@query("dif5_text_multiset", "SELECT conv_id, turn, first_word FROM (SELECT conv_id, turn, role, string_split(text, ' ')[1] AS first_word, row_number() OVER (PARTITION BY conv_id, string_split(text, ' ')[1] ORDER BY turn) AS n FROM conversations WHERE turn % 2 = 1) h LEFT JOIN (SELECT conv_id AS c, string_split(text, ' ')[1] AS w, count(*) AS was FROM conversations WHERE turn % 2 = 0 GROUP BY ALL) b ON h.conv_id = b.c AND h.first_word = b.w WHERE n > coalesce(was, 0)")
def dif5(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.element_at(F.split("text", " ", -1), 1).alias("first_word"))
    return diff.new_texts(c.where("turn % 2 = 0"), c.where("turn % 2 = 1"), ["conv_id"], "first_word", ["turn"])


@query("dif6_new_diagnostics", "SELECT event_id FROM (SELECT event_id, fp, row_number() OVER (PARTITION BY fp ORDER BY event_id % 2 = 0 DESC, event_id) AS n FROM (SELECT side, event_id, coalesce(tool, '-') || rule || file AS fp FROM issues) WHERE side = 'head') h LEFT JOIN (SELECT coalesce(tool, '-') || rule || file AS fp, count(*) AS was FROM issues WHERE side = 'base' GROUP BY 1) b USING (fp) WHERE n > coalesce(was, 0)")
def dif6(spark, d):
    i = A.issues(spark, d).withColumn("fingerprint", F.concat(F.coalesce("tool", F.lit("-")), "rule", "file")).withColumn("ord", F.col("event_id")).withColumn("retained", F.col("event_id") % 2 == 0)
    return diff.new_issues(i.where("side = 'base'"), i.where("side = 'head'")).select("event_id")


@query("dif7_inventory_by_reason", "SELECT kind AS reason, count(*) AS paths, string_agg(CASE WHEN n <= 5 THEN path END, ',' ORDER BY path) AS shown, count(*) > 5 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY path) AS n FROM changes) GROUP BY kind")
def dif7(spark, d):
    rows = A.changes(spark, d).select(F.col("kind").alias("reason"), "path")
    return diff.inventory_by_reason(rows, most=5).withColumn("shown", F.array_join("shown", ","))


# --- joins ---------------------------------------------------------------------------------------------------------------


def _issue_counts(spark, d, side):
    return gates.bucket_counts(A.issues(spark, d).where(F.col("side") == side))


@query("join1_ratchet", "SELECT * FROM ratchet")
def join1(spark, d):
    return gates.ratchet(_issue_counts(spark, d, "base"), _issue_counts(spark, d, "head"))


@query("join2_range_overlap", "SELECT DISTINCT o_orderkey AS id FROM orders JOIN (SELECT l_suppkey AS k, l_linenumber * 40 AS line FROM lineitem) l ON l.k = o_custkey % 100 + 1 AND l.line BETWEEN o_orderkey % 200 AND o_orderkey % 200 + 30")
def join2(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100 + 1).alias("path"), (F.col("o_orderkey") % 200).cast("int").alias("start_line"), (F.col("o_orderkey") % 200 + 30).cast("int").alias("end_line"))
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("path"), (F.col("l_linenumber") * 40).alias("line_no"))
    return scope.range_overlap(o, lines, ["path"]).select("id")


@query("join3_missing_inventory", "SELECT s_suppkey AS file FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_suppkey IS NOT NULL)")
def join3(spark, d):
    return scope.missing_inventory(table(spark, d, "supplier").select(F.col("s_suppkey").alias("file")), table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("file")), ["file"])


_TREE = "SELECT p_partkey AS id, concat(['src', 'lib', 'app'][p_partkey % 3 + 1], '/', p_brand, '/', p_partkey % 400, '.c') AS path FROM part"


def _tree(spark, d):
    k = F.col("p_partkey")
    top = F.element_at(F.array(F.lit("src"), F.lit("lib"), F.lit("app")), (k % 3 + 1).cast("int"))
    return table(spark, d, "part").select(k.alias("id"), F.concat_ws("/", top, "p_brand", F.concat((k % 400).cast("string"), F.lit(".c"))).alias("path"))


@query("join4_report_paths", f"SELECT r.file, CASE WHEN count(DISTINCT t.path) FILTER (WHERE t.path = r.file) = 1 THEN r.file WHEN count(DISTINCT t.path) = 1 THEN min(t.path) END AS path, count(DISTINCT t.path) AS candidates "
       "FROM (SELECT DISTINCT concat(p_brand, '/', p_partkey % 500, '.c') AS file FROM part UNION SELECT DISTINCT concat('src/', p_brand, '/', p_partkey % 400, '.c') FROM part) r "
       f"LEFT JOIN ({_TREE}) t ON t.path = r.file OR ends_with(t.path, '/' || r.file) GROUP BY r.file")
def join4(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    a = p.select(F.concat_ws("/", "p_brand", F.concat((k % 500).cast("string"), F.lit(".c"))).alias("file"))
    b = p.select(F.concat_ws("/", F.lit("src"), "p_brand", F.concat((k % 400).cast("string"), F.lit(".c"))).alias("file"))
    return scope.map_report_paths(sets.chain(a, b), _tree(spark, d))


@query("join5_coverage_roots", f"SELECT f.file, CASE WHEN count(DISTINCT t.path) = 1 THEN min(t.path) END AS path, count(DISTINCT t.path) AS candidates FROM (SELECT DISTINCT concat(p_brand, '/', p_partkey % 500, '.c') AS file FROM part) f LEFT JOIN ({_TREE}) t ON t.path = 'src/' || f.file OR t.path = 'app/' || f.file GROUP BY f.file")
def join5(spark, d):
    f = table(spark, d, "part").select(F.concat_ws("/", "p_brand", F.concat((F.col("p_partkey") % 500).cast("string"), F.lit(".c"))).alias("file"))
    return scope.map_with_roots(f, _tree(spark, d), spark.createDataFrame([("src",), ("app",)], "root string"))


@query("join6_baseline_remap", "SELECT coalesce(c.path, b.path) AS file FROM base b LEFT JOIN (SELECT old_path, min(path) AS path FROM changes WHERE kind = 'renamed' GROUP BY old_path) c ON c.old_path = b.path")
def join6(spark, d):
    return scope.remap_baseline(A.base_files(spark, d).select(F.col("path").alias("file")), A.changes(spark, d))


@query("join7_glob_matches", "SELECT path, number FROM (SELECT path, 0 AS number FROM head WHERE regexp_matches(path, '^src1/[^/]*/[^/]*\\.txt$') UNION ALL SELECT path, 1 FROM head WHERE regexp_matches(path, '^moved/.*$') UNION ALL SELECT path, 2 FROM head WHERE regexp_matches(path, '^(?:[^/]+/)*[^/]*7\\.txt$'))")
def join7(spark, d):
    globs = ["src1/*/*.txt", "moved/**", "**/*7.txt"]
    hits = F.array(*[F.when(F.col("path").rlike(T.glob_regex(g)), F.lit(i)) for i, g in enumerate(globs)])
    return A.head_files(spark, d).select("path", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("number"))


_GLOBS = r"""SELECT p_partkey AS number, CASE p_partkey % 6 WHEN 0 THEN 'src' || (p_size % 8) || '/*/' || p_partkey || '.txt' WHEN 1 THEN 'src' || (p_size % 8) || '/en/**' WHEN 2 THEN '**/' || p_partkey || '.txt'
WHEN 3 THEN '**/?' || (p_size % 10) || '*.txt' WHEN 4 THEN 'src' || p_size || '/{en,de}/*' || (p_partkey % 10) || '.txt' ELSE 'moved/**/*[' || (p_size % 5) || '-' || (p_size % 5 + 2) || '].*' END AS "glob",
CASE p_partkey % 6 WHEN 0 THEN '^src' || (p_size % 8) || '/[^/]*/' || p_partkey || '\.txt$' WHEN 1 THEN '^src' || (p_size % 8) || '/en/.*$' WHEN 2 THEN '^([^/]+/)*' || p_partkey || '\.txt$'
WHEN 3 THEN '^([^/]+/)*[^/]' || (p_size % 10) || '[^/]*\.txt$' WHEN 4 THEN '^src' || p_size || '/(en|de)/[^/]*' || (p_partkey % 10) || '\.txt$' ELSE '^moved/([^/]+/)*[^/]*[' || (p_size % 5) || '-' || (p_size % 5 + 2) || ']\.[^/]*$' END AS regex FROM part"""


@query("join7_glob_table", f'SELECT number, "glob", count(*) AS paths FROM head JOIN ({_GLOBS}) g ON regexp_matches(path, regex) GROUP BY ALL')
def join7_table(spark, d):
    """A glob for each part, on all files."""
    k, size = F.col("p_partkey"), F.col("p_size")
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    form = [
        text("src", size % 8, "/*/", k, ".txt"), text("src", size % 8, "/en/**"), text("**/", k, ".txt"), text("**/?", size % 10, "*.txt"), text("src", size, "/{en,de}/*", k % 10, ".txt"),
        text("moved/**/*[", size % 5, "-", size % 5 + 2, "].*"),
    ]
    table_of = table(spark, d, "part").select(k.alias("number"), F.element_at(F.array(*form), (k % 6 + 1).cast("int")).alias("glob"))
    return globs.glob_counts(A.head_files(spark, d).select("path"), table_of).groupBy("number", "glob").agg(F.sum("paths").alias("paths"))


@query("join8_module_owner", f"SELECT path, CASE WHEN count(DISTINCT m.root) = 1 THEN min(m.root) END AS root, count(DISTINCT m.root) AS owners FROM (SELECT DISTINCT path FROM ({_TREE})) t LEFT JOIN (SELECT 'src/' || p_brand AS dir, 'm' || p_brand AS root FROM part UNION SELECT 'src', 'top' UNION SELECT 'lib', 'lib') m ON starts_with(t.path, m.dir || '/') GROUP BY path")
def join8(spark, d):
    m = table(spark, d, "part").select(F.concat(F.lit("src/"), "p_brand").alias("test_source_root"), F.concat(F.lit("m"), "p_brand").alias("root")).distinct()
    return scope.module_owner(_tree(spark, d), m.unionByName(spark.createDataFrame([("src", "top"), ("lib", "lib")], "test_source_root string, root string")))


@query("join9_required_dependency", "SELECT n_name AS root, 'Brand#11' AS artifact FROM nation WHERE n_name NOT IN (SELECT root FROM deps WHERE artifact = 'Brand#11' AND scope IN ('A', 'N') INTERSECT SELECT root FROM deps WHERE artifact = 'Brand#11' AND scope IN ('N', 'R'))")
def join9(spark, d):
    deps = A.dependencies(spark, d)
    both = deps.where("scope in ('A', 'N')").withColumn("kind", F.lit("declared")).unionByName(deps.where("scope in ('N', 'R')").withColumn("kind", F.lit("resolved")))
    return scope.missing_required(table(spark, d, "nation").select(F.col("n_name").alias("root"), F.lit("Brand#11").alias("artifact")), both)


@query("join10_module_boundary", "SELECT DISTINCT root AS \"from\", artifact AS \"to\", scope, concat_ws(',', CASE WHEN regexp_matches(root, '^A') AND regexp_matches(artifact, '^Brand#1') AND scope = 'A' THEN '0' END, CASE WHEN regexp_matches(artifact, '2$') THEN '1' END) AS directions FROM deps WHERE regexp_matches(root, '^A') AND regexp_matches(artifact, '^Brand#1') AND scope = 'A' OR regexp_matches(artifact, '2$')")
def join10(spark, d):
    edges = A.dependencies(spark, d).select(F.col("root").alias("from"), F.col("artifact").alias("to"), "scope")
    return scope.boundary_findings(edges, [("^A", "^Brand#1", ["A"]), (".*", "2$", [])])


@query("join11_used_undeclared", "SELECT DISTINCT root, artifact FROM deps u WHERE scope = 'R' AND NOT EXISTS (SELECT 1 FROM deps x WHERE x.root = u.root AND x.artifact = u.artifact AND x.scope = 'A') AND root IN (SELECT n_name FROM nation WHERE n_nationkey % 3 <> 0)")
def join11(spark, d):
    deps = A.dependencies(spark, d)
    kinds = deps.withColumn("kind", F.when(F.col("scope") == "R", "used").when(F.col("scope") == "A", "declared").otherwise("resolved"))
    producers = table(spark, d, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_name").alias("root"))
    return scope.used_undeclared(kinds, producers)[0]


@query("join12_retained_markers")
def join12(spark, d):
    base, head = A.entities(spark, d, "base"), A.entities(spark, d, "head")
    marked = lambda e, m: e.where(F.col("ord") % m == 0).select("path", "symbol")
    return scope.lost_markers(diff.match_entities(base, head), marked(base, 3), marked(head, 6)).select("path", "symbol")


ORACLE_SQL["join12_retained_markers"] = sql("SELECT 1 FROM ent_b, ent_h").replace(
    " SELECT 1 FROM ent_b, ent_h", _DIF4 + "SELECT m.path, m.symbol FROM matched m WHERE m.kind <> 'added' AND m.b_ord % 3 = 0 AND m.ord % 6 <> 0"
)


@query("join13_unmeasured_functions", "SELECT o_orderkey AS symbol FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = o_custkey % 100 + 1 AND l_linenumber * 40 BETWEEN o_orderkey % 200 AND o_orderkey % 200 + 30)")
def join13(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("symbol"), (F.col("o_custkey") % 100 + 1).alias("path"), (F.col("o_orderkey") % 200).cast("int").alias("start_line"), (F.col("o_orderkey") % 200 + 30).cast("int").alias("end_line"))
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("path"), (F.col("l_linenumber") * 40).alias("line_no"))
    return scope.unmeasured_functions(o, lines).select("symbol")


@query("join14_reviews", "SELECT user_id AS fingerprint, CASE WHEN n = 1 THEN a END AS attribution FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') f LEFT JOIN (SELECT c_custkey % 200 AS u, count(*) AS n, min(c_mktsegment) AS a FROM customer GROUP BY 1) r ON r.u = f.user_id")
def join14(spark, d):
    k = lambda c: [F.lit(1).alias("report_id"), F.lit("c").alias("check_id"), c.alias("fingerprint")]
    f = table(spark, d, "events").where("event_type = 'error'").select(*k(F.col("user_id"))).distinct()
    r = table(spark, d, "customer").select(*k(F.col("c_custkey") % 200), F.col("c_mktsegment").alias("attribution"), F.lit("x").alias("label"))
    return scope.attach_reviews(f, r)[0].select("fingerprint", "attribution")


@query("join16_agg39_counterexamples", "SELECT file, count(*) AS executed, count(*) FILTER (WHERE outcome = 'passed' AND o2 = 'failure') AS counterexamples FROM (SELECT a.file, a.outcome, b.outcome AS o2 FROM cases a JOIN (SELECT file, name - 1 AS name, outcome FROM cases) b ON a.file = b.file AND a.name = b.name) GROUP BY file")
def join16(spark, d):
    c = A.test_cases(spark, d)
    return gates.counterexamples(c, c.withColumn("name", F.col("name") - 1))[0]


@query("join17_clause_status", "SELECT clause, CASE WHEN bool_or(s = 'fail') THEN 'failed' WHEN bool_or(s = 'pending') THEN 'pending' WHEN bool_and(s = 'not_applicable') THEN 'not_applicable' ELSE 'verified' END AS status FROM (SELECT c_custkey AS clause, CASE WHEN coalesce(n, 0) <> 1 THEN 'pending' ELSE st END AS s FROM (SELECT c_custkey, unnest([c_custkey * 3, c_custkey * 3 + 1]) AS c FROM customer) x LEFT JOIN (SELECT o_orderkey % 4001 AS k, count(*) AS n, min(CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'P' THEN 'not_applicable' ELSE 'pass' END) AS st FROM orders GROUP BY 1) r ON r.k = x.c) GROUP BY clause")
def join17(spark, d):
    k = F.col("c_custkey") * 3
    clauses = table(spark, d, "customer").select(F.col("c_custkey").alias("clause"), F.array(k, k + 1).alias("checks"))
    s = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "P", "not_applicable").otherwise("pass")
    return scope.clause_status(clauses, table(spark, d, "orders").select((F.col("o_orderkey") % 4001).alias("check"), s.alias("status")))


@query("join18_obligation_conflicts", "SELECT a.p_partkey AS must, b.p_partkey AS must_not, count(*) OVER () AS conflicts FROM part a JOIN part b ON trim(a.p_name) = trim(b.p_name) WHERE a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1 ORDER BY must, must_not LIMIT 128")
def join18(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "must").otherwise("must_not").alias("modality"), F.concat(F.lit(" "), "p_name").alias("text"))
    return scope.obligation_conflicts(p).select("must", "must_not", "conflicts")


@query("join19_obligation_status", "SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 = 0 THEN 'source_invalid' WHEN o_orderkey % 3 = 0 THEN 'unadopted' WHEN o_orderkey % 7 = 0 THEN 'stale' WHEN o_orderpriority = '5-LOW' THEN 'unavailable' ELSE 'ready' END AS status FROM orders")
def join19(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    obligations = o.select(k.alias("id"), F.col("o_custkey").alias("source"), F.lit("new").alias("digest"), F.col("o_orderpriority").alias("check"))
    sources = o.select(F.col("o_custkey").alias("source"), (F.col("o_custkey") % 5 != 0).alias("valid")).distinct()
    adoptions = o.where(k % 3 != 0).select(k.alias("id"), F.when(k % 7 == 0, "old").otherwise("new").alias("digest"))
    return scope.obligation_status(obligations, sources, adoptions, o.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderpriority").alias("check")).distinct())


@query("join20_verdict_oracle", "SELECT id, verdict AS actual, CASE WHEN id % 5 <> 0 THEN 'pass' END AS expected FROM checks WHERE verdict IS DISTINCT FROM (CASE WHEN id % 5 <> 0 THEN 'pass' END) OR id % 5 = 0")
def join20(spark, d):
    c = A.checks(spark, d)
    return scope.verdict_mismatches(c, c.where("id % 5 <> 0").select("id", F.lit("pass").alias("verdict")))


@query("join21_producers", "SELECT o_custkey % 50 AS repo, count(*) AS shared, bool_and(o_orderpriority IS NOT DISTINCT FROM CASE WHEN o_orderkey % 997 = 0 THEN 'other' ELSE o_orderpriority END) AS matched FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def join21(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("repo"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("environment"))
    other = o.where("id % 2 = 0").withColumn("environment", F.when(F.col("id") % 997 == 0, "other").otherwise(F.col("environment")))
    return scope.producers_match(o, other, ["repo"])


@query("join22_label_join", "SELECT doc_id AS decision_id, quality = 1 AS finding_valid FROM labels JOIN documents USING (doc_id) WHERE n_chars >= doc_id % 1000")
def join22(spark, d):
    j = table(spark, d, "documents").select(F.col("doc_id").alias("decision_id"), (F.col("doc_id") % 1000).alias("started"), "n_chars")
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("doc_id").alias("decision_id"), (F.col("quality") == 1).alias("finding_valid"), F.col("n_chars").alias("reviewed"))
    return scope.label_judgments(j.drop("n_chars"), l)[0].select("decision_id", "finding_valid")


@query(
    "join23_clone_pairs",
    r"SELECT l AS left_id, r AS right_id, round(c / (x.n + y.n - c), 6) AS similarity FROM (SELECT a.id AS l, b.id AS r, count(*) AS c FROM grams a JOIN grams b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2) "
    "JOIN gram_counts x ON x.id = l JOIN gram_counts y ON y.id = r WHERE c / (x.n + y.n - c) >= 0.8",
)
def join23(spark, d):
    return scope.clone_pairs(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).select("left_id", "right_id", F.round("similarity", 6).alias("similarity"))


@query("join24_review_status", "SELECT coalesce(p_partkey, k) AS id, CASE WHEN p_partkey IS NULL THEN 'orphan' WHEN k IS NULL THEN 'missing' WHEN p_name = n THEN 'bound' ELSE 'stale' END AS status FROM part FULL JOIN (SELECT p_partkey + 5 AS k, CASE WHEN p_partkey % 2 = 0 THEN lead_name ELSE 'x' END AS n FROM (SELECT p_partkey, (SELECT p_name FROM part q WHERE q.p_partkey = p.p_partkey + 5) AS lead_name FROM part p) WHERE p_partkey % 3 <> 0) r ON r.k = p_partkey")
def join24(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("digest"))
    ids = p.where("p_partkey % 3 <> 0").select((F.col("p_partkey") + 5).alias("id"), "p_partkey")
    reviews = ids.join(rows, "id", "left").select("id", F.when(F.col("p_partkey") % 2 == 0, F.col("digest")).otherwise("x").alias("digest"))
    return scope.review_status(rows, reviews)


@query("join25_categories", "SELECT p_partkey AS id, coalesce(CASE WHEN p_partkey % 4 = 0 THEN 'own' END, CASE WHEN p_brand <> 'Brand#3' THEN 'of ' || p_brand END) AS category FROM part")
def join25(spark, d):
    p = table(spark, d, "part")
    members = p.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("id"), F.lit("own").alias("category"))
    origins = p.where("p_brand <> 'Brand#3'").select(F.col("p_brand").alias("origin"), F.concat(F.lit("of "), "p_brand").alias("category")).distinct()
    return scope.categories(p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("origin")), members, origins)


# --- aggregations --------------------------------------------------------------------------------------------------------

_GATE = (
    "SELECT repo, CASE WHEN gaps > 0 THEN 'incomplete' WHEN failures > 0 THEN 'fail' ELSE 'pass' END AS decision, gaps, failures, completed FROM (SELECT repo, "
    "count(*) FILTER (WHERE required AND verdict IS NULL) + CASE WHEN count(verdict) = 0 THEN 1 ELSE 0 END AS gaps, count(*) FILTER (WHERE verdict = 'fail' AND severity = 'error') AS failures, count(verdict) AS completed FROM checks GROUP BY repo)"
)


@query("agg1_gate", _GATE)
def agg1(spark, d):
    return gates.gate(A.checks(spark, d), keys=["repo"]).drop("blockers")


@query("agg1_blockers", "SELECT repo, id, CASE WHEN required AND verdict IS NULL THEN 'gap' ELSE 'failure' END AS why FROM checks WHERE required AND verdict IS NULL OR verdict = 'fail' AND severity = 'error'")
def agg1_blockers(spark, d):
    return gates.blockers(A.checks(spark, d), ["repo"])


@query("agg2_summary", "SELECT repo, count(*) FILTER (WHERE verdict = 'pass') AS passed, count(*) FILTER (WHERE verdict = 'fail') AS failed, 0 AS skipped, count(*) FILTER (WHERE verdict IS NULL) AS incomplete, sum(finding_count) AS findings FROM checks GROUP BY repo")
def agg2(spark, d):
    return gates.summary(A.checks(spark, d), ["repo"])


@query("agg3_route", f"SELECT g.repo, CASE decision WHEN 'incomplete' THEN 'inspect_gap' WHEN 'fail' THEN 'block' ELSE CASE WHEN findings > 0 THEN 'review' ELSE 'accept' END END AS route FROM ({_GATE}) g JOIN (SELECT repo, sum(finding_count) AS findings FROM checks GROUP BY repo) s USING (repo)")
def agg3(spark, d):
    c = A.checks(spark, d)
    return gates.route(gates.gate(c, keys=["repo"]).join(gates.summary(c, ["repo"]), "repo")).select("repo", "route")


@query("agg4_bucket_counts", "SELECT tool, rule, n FROM counts_h")
def agg4(spark, d):
    return _issue_counts(spark, d, "head")


_MERGED = "(SELECT file, line, sum(hits) AS hits, max(branches_found) AS branches_found, max(branches_hit) AS branches_hit FROM coverage GROUP BY file, line)"


@query("agg5_coverage_totals", "SELECT file, count(*) FILTER (WHERE NOT excluded) AS lines, count(*) FILTER (WHERE NOT excluded AND hits > 0) AS hit, count(*) FILTER (WHERE excluded) AS excluded, coalesce(sum(branches_found) FILTER (WHERE NOT excluded), 0) AS branches, coalesce(sum(branches_hit) FILTER (WHERE NOT excluded), 0) AS branches_hit, count(*) FILTER (WHERE NOT excluded) > 0 AND count(*) FILTER (WHERE NOT excluded AND hits > 0) * 1000 < count(*) FILTER (WHERE NOT excluded) * 255 AS below FROM coverage GROUP BY file")
def agg5(spark, d):
    return gates.coverage_totals(A.coverage(spark, d), ["file"], 25.5)


@query("agg6_thresholds", f"SELECT threshold, count(*) FILTER (WHERE lines > 0 AND hit * 100 < lines * threshold) AS below FROM (SELECT file, count(*) AS lines, count(*) FILTER (WHERE hits > 0) AS hit FROM {_MERGED} GROUP BY file), (SELECT unnest(range(0, 101, 10)) AS threshold) GROUP BY threshold")
def agg6(spark, d):
    t = gates.coverage_totals(gates.merge_coverage(A.coverage(spark, d)), ["file"]).withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in range(0, 101, 10)])))
    return t.groupBy("threshold").agg(F.count_if(gates.below(F.col("hit"), F.col("lines"), F.col("threshold"))).alias("below"))


@query("agg7_merge_coverage", f"SELECT file, line, hits, branches_found, branches_hit FROM {_MERGED}")
def agg7(spark, d):
    return gates.merge_coverage(A.coverage(spark, d))


@query("agg8_duplicate_lines", "SELECT file, line, count(*) AS reports FROM coverage GROUP BY file, line HAVING count(*) > 1")
def agg8(spark, d):
    return gates.duplicate_lines(A.coverage(spark, d))


@query("agg9_diff_size", "SELECT count(*) AS added, count(*) > 500 AS too_large FROM added_lines")
def agg9(spark, d):
    return gates.diff_size(A.added_lines(spark, d).withColumn("op", F.lit("added")))


@query("agg10_file_inventory", r"SELECT count(*) AS files, sum(len(l)) AS lines, sum(w) AS words, count(*) FILTER (WHERE len(l) > 20) AS long_files, false AS too_few, sum(w) > 100000 AS too_many_words FROM (SELECT l, (SELECT len(list_filter(string_split_regex(content, '\s+'), lambda x: x <> '')) ) AS w FROM lined JOIN head USING (path))")
def agg10(spark, d):
    c = F.col("content")
    files = A.head_files(spark, d).select("path", F.size(T.lines(c)).alias("n_lines"), T.word_count(c).alias("n_words"))
    return gates.file_inventory(files, max_lines=20, max_words=100_000)


@query("agg11_repeated_shapes", "SELECT path AS owner, shape_digest, count(*) AS n, min(symbol) AS first_symbol FROM ent_h GROUP BY ALL HAVING count(*) >= 3")
def agg11(spark, d):
    e = A.entities(spark, d, "head").select(F.col("path").alias("owner"), "shape_digest", "symbol", F.lit("added").alias("kind"), F.lit(False).alias("parameterized"))
    return gates.repeated_shapes(e)


@query("agg12_test_count", "SELECT file, count(*) FILTER (WHERE outcome <> 'skipped') AS executed, count(*) FILTER (WHERE outcome = 'failure') AS failures, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome <> 'skipped') < 50 AS too_few, count(*) FILTER (WHERE outcome = 'failure') > 0 AS failed FROM cases GROUP BY file")
def agg12(spark, d):
    return gates.test_count(A.test_cases(spark, d), ["file"], 50)


@query("agg13_agg14_rollup_mismatches", "SELECT a.g, a.p, a.n AS actual_n, d.n AS declared_n FROM (SELECT l_returnflag AS g, l_linestatus AS p, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)) a JOIN (SELECT l_returnflag AS g, l_linestatus AS p, count(*) FILTER (WHERE l_linenumber < 7) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)) d ON a.g IS NOT DISTINCT FROM d.g AND a.p IS NOT DISTINCT FROM d.p WHERE a.n <> d.n")
def agg13(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_linestatus").alias("p"), F.lit(1).cast("long").alias("n"), "l_linenumber")
    declared = l.rollup("g", "p").agg(F.count_if(F.col("l_linenumber") < 7).alias("n"))
    return gates.rollup_mismatches(l.drop("l_linenumber"), declared, ["g", "p"])


@query("agg15_summary_mismatches", "SELECT file AS report_id FROM coverage GROUP BY file HAVING count(*) FILTER (WHERE hits > 0) % 2 = 1")
def agg15(spark, d):
    c = A.coverage(spark, d).withColumnRenamed("file", "report_id")
    n, hit = F.count(F.lit(1)), F.count_if(F.col("hits") > 0)
    declared = c.groupBy("report_id").agg(n.alias("lines_valid"), (hit - hit % 2).alias("lines_covered"), F.sum("branches_found").alias("branches_valid"), F.lit(None).cast("long").alias("branches_covered"))
    return gates.summary_mismatches(c, declared)


@query("agg16_run_summary", "SELECT user_id AS run, count(*) AS results, count(*) FILTER (WHERE event_type = 'error' AND event_id % 3 <> 0) AS violations, count(*) FILTER (WHERE event_type <> 'error') AS non_violations, count(*) FILTER (WHERE event_type = 'error' AND event_id % 3 = 0) AS suppressed FROM events GROUP BY user_id")
def agg16(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("run"), F.when(F.col("event_type") == "error", "fail").otherwise("pass").alias("kind"), (F.col("event_id") % 3 == 0).alias("suppressed"))
    return gates.run_summary(e)


@query("agg17_missing_metrics", "SELECT p_partkey AS id, m AS metric FROM part, (SELECT unnest(['lines', 'branches']) AS m) WHERE NOT (m = 'lines' AND p_size > 5 OR m = 'branches' AND p_size > 45)")
def agg17(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    facts = p.where("p_size > 5").select("id", F.lit("lines").alias("metric")).unionByName(p.where("p_size > 45").select("id", F.lit("branches").alias("metric")))
    return gates.missing_metrics(p, spark.createDataFrame([("lines",), ("branches",)], "metric string"), facts)


@query("agg17_pair_completeness", "SELECT n_regionkey AS region, count(*) AS n, count(*) * (count(*) - 1) // 2 - CASE WHEN n_regionkey = 1 THEN 1 ELSE 0 END AS pairs, n_regionkey = 1 AS incomplete, false AS repeated FROM nation GROUP BY n_regionkey")
def agg17_pairs(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("id"))
    pairs = n.join(n.select("region", F.col("id").alias("right_id")), "region").where("id < right_id").select("region", F.col("id").alias("left_id"), "right_id")
    lost = n.where("region = 1").groupBy("region").agg(F.min("id").alias("left_id"), F.max("id").alias("right_id"))
    return gates.pair_completeness(n, pairs.join(lost, ["region", "left_id", "right_id"], "left_anti"), ["region"])


@query("agg18_agg20_success_rate", "SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS numerator, count(*) AS denominator, count(*) FILTER (WHERE event_type = 'error') AS unknown, CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN count(*) FILTER (WHERE event_type = 'purchase') / count(*) END AS value FROM events GROUP BY user_id")
def agg18(spark, d):
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("event_type") == "purchase").alias("ok"))
    return stats.success(e, "ok", ["user_id"])


@query("agg19_distribution", "SELECT event_type, count(check_elapsed_ms) AS samples, count(*) - count(check_elapsed_ms) AS unknown, CASE WHEN count(*) = count(check_elapsed_ms) THEN median(check_elapsed_ms) END AS median, CASE WHEN count(*) = count(check_elapsed_ms) THEN quantile_disc(check_elapsed_ms, 0.95) END AS p95 FROM attempts GROUP BY event_type")
def agg19(spark, d):
    return stats.distribution(A.attempts(spark, d), "check_elapsed_ms", ["event_type"])


@query("agg21_usage", "SELECT assignment, coalesce(sum(check_elapsed_ms), 0) AS known, count(*) - count(check_elapsed_ms) AS unknown, CASE WHEN count(*) = count(check_elapsed_ms) THEN coalesce(sum(check_elapsed_ms), 0) END AS total FROM attempts GROUP BY assignment")
def agg21(spark, d):
    return stats.usage(A.attempts(spark, d), "check_elapsed_ms", ["assignment"])


@query("agg22_cost", "SELECT o_custkey AS id, count(DISTINCT cur) AS currencies, count(DISTINCT o_orderdate) AS price_dates, CASE WHEN count(DISTINCT cur) = 1 AND count(DISTINCT o_orderdate) = 1 THEN sum(m) END AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS accepted, CASE WHEN count(DISTINCT cur) = 1 AND count(DISTINCT o_orderdate) = 1 THEN sum(m) / nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) END AS per_accepted FROM (SELECT *, CASE WHEN o_custkey % 2 = 0 THEN 'EUR' ELSE 'USD' END AS cur, CAST(floor(o_totalprice * 10) AS BIGINT) AS m FROM orders) GROUP BY 1")
def agg22(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("id"), F.when(F.col("o_custkey") % 2 == 0, "EUR").otherwise("USD").alias("currency"), F.col("o_orderdate").alias("priced_at"),
        F.floor(F.col("o_totalprice") * 10).cast("long").alias("micros"), (F.col("o_orderstatus") == "F").alias("accepted"),
    )
    return stats.cost(o, ["id"])


_COHORT = "SELECT c_mktsegment AS cohort, c_custkey % 2 AS workflow, c_nationkey AS input, c_custkey AS id, c_custkey % 3 <> 0 AS seeded, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal > 0 END AS detected, c_acctbal > 5000 AS fp, c_custkey % 4 AS findings, least(c_custkey % 4, 2) AS reviewed, c_custkey % 5 = 0 AS eligible, c_acctbal > 1000 AS repaired, c_acctbal > -500 AS completed FROM customer"


def _cohort_rows(spark, d):
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    return table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("cohort"), (k % 2).alias("workflow"), F.col("c_nationkey").alias("input_id"), (k % 3 != 0).alias("seeded"), F.when(k % 7 != 0, b > 0).alias("detected"), (b > 5000).alias("false_positive"),
        (k % 4).alias("findings"), F.least(k % 4, F.lit(2)).alias("reviewed"), (k % 5 == 0).alias("eligible_repair"), (b > 1000).alias("repaired"), (b > -500).alias("completed"), b.alias("elapsed"),
    )


@query("agg23_cohorts", f"SELECT cohort, count(*) AS tasks, CASE WHEN count(*) FILTER (WHERE seeded) > 0 AND count(*) FILTER (WHERE seeded AND detected IS NULL) = 0 THEN count(*) FILTER (WHERE seeded AND detected) / count(*) FILTER (WHERE seeded) END AS detection, count(*) FILTER (WHERE NOT seeded AND fp) / count(*) FILTER (WHERE NOT seeded) AS false_positive, count(*) FILTER (WHERE eligible AND repaired) / count(*) FILTER (WHERE eligible) AS repair, count(*) FILTER (WHERE completed) / count(*) AS completion, sum(reviewed) / sum(findings) AS review FROM ({_COHORT}) GROUP BY cohort")
def agg23(spark, d):
    return stats.cohorts(_cohort_rows(spark, d), ["cohort"])


@query("agg24_distinct_findings", "SELECT c_nationkey AS k, count(DISTINCT c_mktsegment) AS versions FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def agg24(spark, d):
    return stats.distinct_findings(table(spark, d, "customer").withColumnRenamed("c_nationkey", "k"), ["k"], ["c_mktsegment"])[1]


@query("agg25_attributions", "SELECT coalesce(tool, 'unclassified') AS attribution, count(*) AS n FROM issues GROUP BY 1")
def agg25(spark, d):
    return stats.attributions(A.issues(spark, d).withColumnRenamed("tool", "attribution"))


@query("agg26_stability", "SELECT cohort, count(*) FILTER (WHERE a AND u = 0) AS numerator, count(*) AS denominator, count(*) FILTER (WHERE u > 0) AS unknown, CASE WHEN count(*) FILTER (WHERE u > 0) = 0 THEN count(*) FILTER (WHERE a AND u = 0) / count(*) END AS value FROM (SELECT c_mktsegment AS cohort, c_nationkey, count(*) AS n, bool_and(CASE WHEN c_custkey % 101 <> 0 THEN c_acctbal > -900 END) AS a, count(*) FILTER (WHERE c_custkey % 101 = 0) AS u FROM customer GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY cohort")
def agg26(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("cohort"), F.col("c_nationkey").alias("input_id"), F.when(F.col("c_custkey") % 101 != 0, F.col("c_acctbal") > -900).alias("accepted"))
    return stats.stability(c, ["cohort"])


@query(
    "join15_agg27_cohort_comparison",
    "SELECT a.cohort, a.workflow, a.items = b.items AS comparable, CASE WHEN a.items = b.items AND b.median <> 0 THEN round(a.median / b.median, 6) END AS median_ratio, CASE WHEN a.items = b.items AND b.cost <> 0 THEN round(a.cost / b.cost, 6) END AS cost_ratio "
    "FROM (SELECT cohort, workflow, median(elapsed) AS median, sum(findings) AS cost, list_sort(list(input_id)) AS items FROM (SELECT c_mktsegment AS cohort, unnest(CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 2 = 1 THEN [1, 7] ELSE [c_custkey % 2] END) AS workflow, c_acctbal AS elapsed, c_custkey % 4 AS findings, c_nationkey AS input_id FROM customer) GROUP BY ALL) a "
    "JOIN (SELECT c_mktsegment AS cohort, median(c_acctbal) AS median, sum(c_custkey % 4) AS cost, list_sort(list(c_nationkey)) AS items FROM customer WHERE c_custkey % 2 = 1 GROUP BY ALL) b ON a.cohort = b.cohort WHERE a.workflow <> 1",
)
def join15(spark, d):
    rows = _cohort_rows(spark, d)
    rows = rows.unionByName(rows.where("cohort = 'BUILDING' and workflow = 1").withColumn("workflow", F.lit(7).cast("long")))
    m = rows.groupBy("cohort", "workflow").agg(F.median("elapsed").alias("median"), F.expr("percentile_disc(0.95) within group (order by elapsed)").alias("p95"), F.sum("findings").alias("cost"), F.avg("reviewed").alias("review"))
    joined = m.join(stats.inventory(rows, ["cohort", "workflow"]), ["cohort", "workflow"])
    return stats.compare_cohorts(joined, ["cohort"], "workflow", "1").select("cohort", "workflow", "comparable", F.round("median_ratio", 6).alias("median_ratio"), F.round("cost_ratio", 6).alias("cost_ratio"))


@query("agg28_thresholds", "SELECT name, n, d, CASE WHEN u > 0 THEN 'unknown' WHEN name = 'F' AND n / d >= 0.5 OR name = 'P' AND n / d <= 0.4 OR name = 'O' AND n / d >= 0.9 THEN 'met' ELSE 'not_met' END AS state FROM (SELECT o_orderstatus AS name, count(*) FILTER (WHERE o_totalprice > 200000) AS n, count(*) AS d, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderkey % 10 = 0) AS u FROM orders GROUP BY 1)")
def agg28(spark, d):
    o = table(spark, d, "orders").groupBy((F.col("o_custkey") % 9).alias("g"), F.col("o_orderstatus").alias("name")).agg(
        F.count_if(F.col("o_totalprice") > 200_000).alias("numerator"), F.count(F.lit(1)).alias("denominator"), F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 10 == 0)).alias("unknown")
    )
    return stats.assess(o, [("F", ">=", 0.5), ("P", "<=", 0.4), ("O", ">=", 0.9)])


@query("agg29_budget", "SELECT assignment, sum(elapsed_ms) AS machine, CAST(ceil(sum(number) * 90000 / 3600000.0) AS BIGINT) AS human, count(*) - count(check_elapsed_ms) AS unknown, CASE WHEN count(*) = count(check_elapsed_ms) THEN sum(elapsed_ms) + CAST(ceil(sum(number) * 90000 / 3600000.0) AS BIGINT) END AS total, CASE WHEN count(*) <> count(check_elapsed_ms) THEN 'unknown' WHEN sum(elapsed_ms) + CAST(ceil(sum(number) * 90000 / 3600000.0) AS BIGINT) <= 100000 THEN 'met' ELSE 'not_met' END AS state FROM attempts GROUP BY assignment")
def agg29(spark, d):
    a = A.attempts(spark, d).select("assignment", F.col("number").alias("n"), "check_elapsed_ms", "elapsed_ms")
    rows = a.select("assignment", F.col("elapsed_ms").alias("micros"), F.col("n").cast("long").alias("human_ms"), "check_elapsed_ms")
    out = stats.budget(rows, 100_000, 90_000, ["assignment"])
    gaps = rows.groupBy("assignment").agg(F.count_if(F.col("check_elapsed_ms").isNull()).alias("u"))
    out = out.drop("unknown").join(gaps, "assignment")
    known = F.col("u") == 0
    return out.select("assignment", "machine", "human", F.col("u").alias("unknown"), F.when(known, F.col("total")).alias("total"), F.when(known, F.col("state")).otherwise("unknown").alias("state"))


@query("agg30_effectiveness", "SELECT repo, count(*) AS cases, count(*) FILTER (WHERE base_complete) AS complete_pairs, sum(base_mismatches) AS base_mismatches, sum(cand_mismatches) AS cand_mismatches, CASE WHEN bool_and(base_complete) THEN sum(base_mismatches - cand_mismatches) END AS improvement FROM eval_cases GROUP BY repo")
def agg30(spark, d):
    return stats.effectiveness(A.eval_cases(spark, d), ["repo"])


@query("agg31_paired_decision", "SELECT repo, CASE WHEN count(DISTINCT kind) < 3 OR NOT bool_and(base_complete) THEN 'incomplete' WHEN count(*) FILTER (WHERE cand_mismatches > base_mismatches) > 0 OR count(*) FILTER (WHERE cand_mismatches < base_mismatches) < 2 THEN 'block' ELSE 'pass' END AS decision, count(*) FILTER (WHERE cand_mismatches < base_mismatches) AS improved, count(*) FILTER (WHERE cand_mismatches > base_mismatches) AS worse FROM eval_cases GROUP BY repo")
def agg31(spark, d):
    return stats.paired_decision(A.eval_cases(spark, d), 2, ["repo"])


@query("agg32_history", "SELECT sha256(concat(c_mktsegment, chr(0), CAST(c_nationkey AS VARCHAR))) AS inputs, count(*) AS reports, min(c_custkey) AS first, max(c_custkey) AS last FROM customer GROUP BY c_mktsegment, c_nationkey")
def agg32(spark, d):
    return stats.history(table(spark, d, "customer").withColumn("at", F.col("c_custkey")), ["c_mktsegment", "c_nationkey"])


_P = "greatest(least(probability, 1 - 1e-12), 1e-12)"
_LOSS = f"round(avg(-(label::INT * ln({_P}) + (1 - label::INT) * ln(1 - {_P}))), 6)"


@query("agg33_proper_scores", f"SELECT count(*) AS n, round(avg(power(probability - label::INT, 2)), 6) AS brier, {_LOSS} AS log_loss FROM judgments")
def agg33(spark, d):
    return stats.proper_scores(A.judgments(spark, d))


@query("agg34_reliability", "SELECT b AS bin, count(probability) AS n, round(avg(probability), 6) AS mean_probability, round(avg(label::INT), 6) AS mean_label FROM (SELECT unnest(range(0, 5)) AS b) LEFT JOIN judgments ON least(CAST(floor(probability * 5) AS INT), 4) = b GROUP BY b")
def agg34(spark, d):
    return stats.reliability(A.judgments(spark, d))


@query("agg35_risk_coverage", "SELECT share, count(*) AS n, round(avg(wrong), 6) AS risk FROM (SELECT CAST((probability >= 0.5) <> label AS INT) AS wrong, row_number() OVER (ORDER BY greatest(probability, 1 - probability) DESC, decision_id) AS place, count(*) OVER () AS n FROM judgments), (SELECT unnest([0.25, 0.5, 0.75, 1.0]) AS share) WHERE place <= ceil(share * n) GROUP BY share")
def agg35(spark, d):
    return stats.risk_coverage(A.judgments(spark, d))


@query("agg36_near_threshold", "SELECT rule, count(*) AS n, round(avg(abs(probability - label::INT)), 6) AS error FROM judgments WHERE abs(probability - threshold) <= 0.1 GROUP BY rule")
def agg36(spark, d):
    return stats.near_threshold_error(A.judgments(spark, d), keys=["rule"])


@query("agg37_slices", f"SELECT rule, language, count(*) AS n, round(avg(power(probability - label::INT, 2)), 6) AS brier, {_LOSS} AS log_loss FROM judgments GROUP BY rule, language")
def agg37(spark, d):
    return stats.proper_scores(A.judgments(spark, d), ["rule", "language"])


@query("agg38_calibration_status", "SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'revoked' WHEN c_custkey <= 100 THEN 'stale' WHEN c_nationkey < 5 THEN 'insufficient' WHEN c_mktsegment = 'BUILDING' THEN 'out_of_domain' ELSE 'valid' END AS status FROM customer")
def agg38(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k.alias("id"), (k % 11 == 0).alias("revoked"), k.alias("expires"), (F.col("c_nationkey") + 25).alias("samples"), (F.col("c_mktsegment") != "BUILDING").alias("in_domain"))
    return stats.calibration_status(c, 100).select("id", "status")


@query("agg40_test_inventory_gaps", "SELECT file, name, 'skipped' AS gap FROM cases WHERE outcome = 'skipped' UNION ALL SELECT f, NULL, 'uncovered' FROM (SELECT unnest(range(90, 110)) AS f) WHERE f NOT IN (SELECT file FROM cases)")
def agg40(spark, d):
    files = spark.range(90, 110).select(F.col("id").alias("file"))
    return gates.test_inventory_gaps(A.test_cases(spark, d).withColumn("name", F.col("name").cast("string")), files)


@query("agg41_clause_totals", "SELECT repo, count(*) FILTER (WHERE s = 'failed') AS failed, count(*) FILTER (WHERE s = 'verified') AS verified, 0 AS not_applicable, count(*) FILTER (WHERE s = 'pending') AS pending, count(*) FILTER (WHERE required) AS required, bool_and(NOT required OR s = 'verified') AS held FROM (SELECT *, CASE verdict WHEN 'fail' THEN 'failed' WHEN 'pass' THEN 'verified' ELSE 'pending' END AS s FROM checks) GROUP BY repo")
def agg41(spark, d):
    s = F.when(F.col("verdict") == "fail", "failed").when(F.col("verdict") == "pass", "verified").otherwise("pending")
    return gates.clause_totals(A.checks(spark, d).withColumn("status", s), ["repo"])


@query("agg42_fingerprints", "SELECT event_id, sha256(concat(length(coalesce(tool, '')), CASE WHEN tool IS NULL THEN '-' ELSE ':' END, coalesce(tool, ''), length(rule), ':', rule, length(file), ':', file, 1, ':', 'm')) AS fingerprint FROM issues")
def agg42(spark, d):
    i = A.issues(spark, d)
    return i.select("event_id", gates.fingerprint(F.col("tool"), F.col("rule"), F.array("file", "file"), F.lit("m")).alias("fingerprint"))


@query("agg43_capacity", "SELECT path, size FROM (SELECT path, size, row_number() OVER (ORDER BY path) AS n FROM (SELECT path, max(size) AS size FROM (SELECT path, octet_length(encode(content)) AS size FROM base UNION ALL SELECT path, octet_length(encode(content)) FROM head) GROUP BY path) WHERE size > 5000) WHERE n <= 100")
def agg43(spark, d):
    files = sets.chain(A.base_files(spark, d), A.head_files(spark, d)).select("path", F.octet_length("content").cast("long").alias("size"))
    return gates.capacity(files, 5000)[0]
