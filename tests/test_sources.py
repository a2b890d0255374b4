"""Good and malformed reports of every format."""

from decimal import Decimal

import pytest

from sluice.sources import json_reports as j, text_reports as t, xml_reports as x

CASES = {
    "junit": (
        lambda raw: x.junit(raw),
        ['<testsuites><testsuite name="s" tests="2" failures="1"><testcase classname="A" name="t1"><failure message="m1" type="T"/><failure message="m2"/></testcase><testcase classname="A" name="t2"/></testsuite></testsuites>','<testsuite tests="3"><testcase name="q"/></testsuite>','<broken'],
        [[('0', 'junit', 'failure', None, None, 'm1; m2', 'A#t1')], [('1', 'counters differ'), ('2', 'malformed')]],
    ),
    "checkstyle": (
        lambda raw: x.checkstyle(raw),
        ['<checkstyle version="8"><file name="a.java"><error line="3" message="mm" source="S.R"/></file></checkstyle>','oops'],
        [[('0', 'checkstyle', 'S.R', 'a.java', 3, 'mm', None)], [('1', 'malformed')]],
    ),
    "pmd": (
        lambda raw: x.pmd(raw),
        ['<pmd version="6"><file name="a.java"><violation beginline="4" rule="R">text </violation></file><suppressedviolation filename="b.java" suppressiontype="nopmd" msg="x"/></pmd>'],
        [[('0', 'pmd', 'R', 'a.java', 4, 'text', None), ('0', 'pmd', 'pmd-suppressed', 'b.java', None, 'x', None)], []],
    ),
    "spotbugs": (
        lambda raw: x.spotbugs(raw),
        ['<BugCollection version="4"><BugInstance type="NP"><ShortMessage>s</ShortMessage><LongMessage>lm</LongMessage><SourceLine sourcepath="a" start="1"/><SourceLine sourcepath="b" start="7" primary="true"/></BugInstance></BugCollection>'],
        [[('0', 'spotbugs', 'NP', 'b', 7, 'lm', None)], []],
    ),
    "cobertura": (
        lambda raw: x.cobertura(raw),
        ['<coverage lines-valid="3" branches-covered="3"><packages><package name="k"><classes><class filename="k/u.py"><methods><method name="f"><lines><line number="4" hits="7"/></lines></method></methods><lines><line number="4" hits="7" branch="true" condition-coverage="75% (3/4)"/><line number="5" hits="0"/></lines></class><class filename="v.py"><lines><line number="4" hits="1" branch="false"/></lines></class></classes></package></packages></coverage>','<coverage lines-valid="9" lines-covered="1"><packages></packages></coverage>'],
        [[('0', 'k/u.py', 4, 7, 4, 3), ('0', 'k/u.py', 5, 0, 0, 0), ('0', 'v.py', 4, 1, 0, 0)], [('1', 'totals differ')]],
    ),
    "jacoco": (
        lambda raw: x.jacoco(raw),
        ['<report name="all"><group name="g"><group name="h"><package name="k/m"><sourcefile name="Z.java"><line nr="8" mi="2" ci="5" mb="0" cb="3"/><line nr="9" mi="6"/><counter type="INSTRUCTION" missed="8" covered="5"/><counter type="LINE" missed="1" covered="1"/><counter type="BRANCH" missed="0" covered="3"/></sourcefile><counter type="INSTRUCTION" missed="8" covered="5"/><counter type="LINE" missed="1" covered="1"/><counter type="BRANCH" missed="0" covered="3"/></package><counter type="INSTRUCTION" missed="8" covered="5"/><counter type="LINE" missed="1" covered="1"/><counter type="BRANCH" missed="0" covered="3"/></group><counter type="INSTRUCTION" missed="8" covered="5"/><counter type="LINE" missed="1" covered="1"/><counter type="BRANCH" missed="0" covered="3"/></group><counter type="INSTRUCTION" missed="8" covered="5"/><counter type="LINE" missed="1" covered="1"/><counter type="BRANCH" missed="0" covered="3"/><counter type="METHOD" missed="1" covered="0"/></report>'],
        [[('0', 'k/m/Z.java', 8, 5, 3, 3), ('0', 'k/m/Z.java', 9, 0, 0, 0)], []],
    ),
    "api": (
        lambda raw: x.api_compatibility(raw),
        ['<japi old="a"><classes><class fullyQualifiedName="A" binaryCompatible="false" sourceCompatible="true"/><class fullyQualifiedName="B" binaryCompatible="false" sourceCompatible="false"><member name="m" binaryCompatible="false" sourceCompatible="true" change="REMOVED"/></class></classes></japi>'],
        [[('0', 'B', 'm', 'REMOVED'), ('0', 'A', None, 'CLASS_INCOMPATIBLE')], []],
    ),
    "sarif": (
        lambda raw: j.sarif(raw),
        ['{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"T","rules":[{"id":"R1","messageStrings":{"d":{"text":"bad {0} in {1}"}}}]}},"results":[{"ruleIndex":0,"message":{"id":"d","arguments":["x","y"]},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"a.c"},"region":{"startLine":3}}}]},{"ruleId":"R1","kind":"pass","message":{"text":"t"}}]}]}','{"version":"2.0"}','nope'],
        [[('0', 'T', 'R1', 'a.c', 3, 'bad x in y', [('a.c', 3, None)])], [('1', 'version'), ('2', 'malformed')], [('0', 0, 2, 1, 1, 0)]],
    ),
    "covpy": (
        lambda raw: j.coverage_py(raw),
        ['{"meta":{"format":3},"files":{"a.py":{"executed_lines":[1,2],"missing_lines":[3],"excluded_lines":[],"executed_branches":[[1,2]],"missing_branches":[[1,3]]}},"totals":{"covered_lines":2,"num_statements":3}}'],
        [[('0', 'a.py', 1, 1, 2, 1, False), ('0', 'a.py', 2, 1, 0, 0, False), ('0', 'a.py', 3, 0, 0, 0, False)], []],
    ),
    "clippy": (
        lambda raw: j.cargo_clippy(raw),
        ['{"reason":"compiler-message","message":{"message":"m","level":"warning","code":{"code":"clippy::x"},"spans":[{"file_name":"a.rs","line_start":4,"is_primary":true}]}}\n{"reason":"build-finished","success":true}\n','{"reason":"x"}'],
        [[('0', 'clippy', 'clippy::x', 'a.rs', 4, 'm', None)], [('1', 'no single end')]],
    ),
    "eslint": (
        lambda raw: j.eslint(raw),
        ['[{"filePath":"a.js","errorCount":1,"warningCount":0,"messages":[{"ruleId":"r","severity":2,"message":"m","line":3}]}]','{}'],
        [[('0', 'eslint', 'r', 'a.js', 3, 'm', None)], [('1', 'malformed')]],
    ),
    "golangci": (
        lambda raw: j.golangci(raw,['staticcheck','lll']),
        ['{"Issues":[{"FromLinter":"staticcheck","Text":"SA1019: old","Pos":{"Filename":"a.go","Line":2}},{"FromLinter":"lll","Text":"long: x","Pos":{"Filename":"a.go","Line":3}}],"Report":{}}'],
        [[('0', 'golangci-lint', 'SA1019', 'a.go', 2, 'SA1019: old', None), ('0', 'golangci-lint', 'lll', 'a.go', 3, 'long: x', None)], []],
    ),
    "ruff": (
        lambda raw: j.ruff(raw),
        ['[{"code":"F401","filename":"a.py","message":"m","location":{"row":1,"column":5},"end_location":{"row":1,"column":9}}]','[{"code":null,"filename":"a.py","message":"m","location":{"row":1}}]'],
        [[('0', 'ruff', 'F401', 'a.py', 1, 'm', None)], [('1', 'syntax or io error')]],
    ),
    "pyright": (
        lambda raw: j.pyright(raw),
        ['{"generalDiagnostics":[{"file":"a.py","severity":"warning","message":"m","rule":"reportDeprecated","range":{"start":{"line":0}}}],"summary":{"errorCount":0,"warningCount":1,"informationCount":0}}'],
        [[('0', 'pyright', 'reportDeprecated', 'a.py', 1, 'm', None)], []],
    ),
    "diag": (
        lambda raw: j.diagnostics(raw),
        ['{"tool":"t","executed":2,"failures":1,"issues":[{"rule":"r","file":"a","line":1,"message":"m"}]}','{"tool":"t","executed":0,"failures":1,"issues":[]}'],
        [[('0', 't', 'r', 'a', 1, 'm', None)], [('1', 'failures')]],
    ),
    "facts": (
        lambda raw: j.tool_facts(raw,'p','t'),
        ['{"project":"p","target":"t","metrics":[{"id":"1","file":"a","metric":"crap","value":"1.50","unit":"u","measurement":"m"}]}','{"project":"q","target":"t","metrics":[]}'],
        [[('0', '1', 'a', 'crap', Decimal('1.500000000000000000'), 'u', 'm')], [('1', 'envelope')]],
    ),
    "lcov": (
        lambda raw: t.lcov(raw),
        ['SF:a.c\nDA:1,2\nBRDA:1,0,0,1\nBRDA:1,0,1,-\nend_of_record\nSF:a.c\nDA:1,3\nend_of_record\n','SF:a\nDA:1,1\n'],
        [[('0', 'a.c', 1, 5, 2, 1)], [('1', 'malformed')]],
    ),
    "javac": (
        lambda raw: t.javac(raw),
        ['A.java:3: warning: [deprecation] f() is old\n  f();\n   ^\n1 warning\n','Note: A.java uses deprecated API.\n'],
        [[('0', 'javac', 'deprecation', 'A.java', 3, 'f() is old', None)], [('1', 'note')]],
    ),
}


def _with(text, *changes):
    for old, new in changes:
        assert old in text, old
        text = text.replace(old, new, 1)
    return text


GOOD = {name: reports[0] for name, (_, reports, _) in CASES.items()}
#: Reports that lack evidence or contradict themselves, by format: each must be a gap for this reason.
GAPS = {
    "junit": [
        ("<html/>", "wrong root"), ("<testsuites><testcase name='a'/></testsuites>", "out of place"), ("<testsuite errors='5'/>", "counters differ"), ("<testsuite skipped='1'><testcase name='a'/></testsuite>", "counters differ"),
        ("<testsuites tests='3'><testsuite><testsuite tests='1'><testcase name='a'/></testsuite></testsuite></testsuites>", "counters differ"), ("<testsuite><failure/></testsuite>", "out of place"), ("<testsuite tests='x'/>", "counters differ"),
        ("<testsuite><testcase name='a'><failure/><skipped/></testcase></testsuite>", "contradictory outcomes"), ("<testsuite><testcase name='a'><error/><error/></testcase></testsuite>", "contradictory outcomes"), ("", "malformed"), ("<testsuite><testcase line='x'/></testsuite>", "line"),
    ],
    "checkstyle": [("<html/>", "wrong root"), ("<checkstyle><error source='r' message='m'/></checkstyle>", "out of place"), ("<checkstyle><file><error source='r' message='m'/></file></checkstyle>", "file without name"), ("<checkstyle><file name='a'><exception>boom</exception></file></checkstyle>", "execution error"), (_with(GOOD["checkstyle"], ('line="3"', 'line="x"')), "line"), (_with(GOOD["checkstyle"], (' source="S.R"', "")), "error without source")],
    "pmd": [("<html/>", "wrong root"), ("<pmd><error filename='a' msg='m'/></pmd>", "execution error"), ("<pmd><configerror rule='r' msg='m'/></pmd>", "execution error"), ("<pmd><violation rule='r'>t</violation></pmd>", "out of place"), (_with(GOOD["pmd"], (' msg="x"', "")), "suppression without fields"), (_with(GOOD["pmd"], (' rule="R"', "")), "rule or message")],
    "spotbugs": [("<html/>", "wrong root"), ("<BugCollection><Errors><Error><ErrorMessage>m</ErrorMessage></Error></Errors></BugCollection>", "execution error"), ("<BugCollection><Project><BugInstance type='t'/></Project></BugCollection>", "out of place"), ("<BugCollection><BugInstance/></BugCollection>", "bug without type")],
    "cobertura": [
        ("<html/>", "wrong root"), ("<coverage/>", "no file"), (_with(GOOD["cobertura"], ('branches-covered="3"', 'branches-covered="4"')), "branch totals differ"), (_with(GOOD["cobertura"], ("75% (3/4)", "75% (1/4)")), "branches"), (_with(GOOD["cobertura"], ('number="5"', 'number="4"')), "line given twice"),
        (_with(GOOD["cobertura"], ('condition-coverage="75% (3/4)"', "")), "branches"), (_with(GOOD["cobertura"], ("<packages>", "<packages><line number='1' hits='1'/>")), "out of place"), (_with(GOOD["cobertura"], ('number="5"', 'number="x"')), "line"),
    ],
    "jacoco": [
        ("<html/>", "wrong root"), ("<report/>", "no source file"), ("<report><group name='g'/></report>", "no source file"), (_with(GOOD["jacoco"], ('mi="2"', 'mi="3"')), "counters differ"), (_with(GOOD["jacoco"], ('missed="0" covered="3"/></group>', 'missed="0" covered="2"/></group>')), "counters differ"),
        (_with(GOOD["jacoco"], ('nr="9"', 'nr="8"')), "line given twice"), (_with(GOOD["jacoco"], (' mi="6"', "")), "line without instructions"), (_with(GOOD["jacoco"], ('mi="6"', 'mi="6" cb="1"')), "branches"), (_with(GOOD["jacoco"], ("<group name=\"g\">", "<group name=\"g\"><line nr=\"1\"/>")), "out of place"), ("<report", "malformed"),
    ],
    "api": [("<html/>", "wrong root"), ("<japicmp/>", "no class"), (_with(GOOD["api"], ('fullyQualifiedName="B"', 'fullyQualifiedName="A"')), "class given twice"), (_with(GOOD["api"], (' binaryCompatible="false" sourceCompatible="true"/>', ' binaryCompatible="false"/>')), "flags"), (_with(GOOD["api"], ('"B" binaryCompatible="false"', '"B" binaryCompatible="true"')), "member contradicts class")],
    "sarif": [
        ("[]", "malformed"), ('{"version":"2.1.0"}', "no run"), ('{"version":"2.1.0","runs":[]}', "no run"), (_with(GOOD["sarif"], ('"name":"T",', "")), "run without tool"), ('{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"T"}}}]}', "run without results"),
        (_with(GOOD["sarif"], ('"results":', '"invocations":[{"executionSuccessful":false}],"results":')), "run failed"), (_with(GOOD["sarif"], ('"results":', '"invocations":[{}],"results":')), "run failed"),
        (_with(GOOD["sarif"], ('"results":', '"invocations":[{"executionSuccessful":true,"toolExecutionNotifications":[{"level":"error"}]}],"results":')), "run failed"), (_with(GOOD["sarif"], ('"results":', '"externalPropertyFileReferences":{"results":"x"},"results":')), "external properties"),
        (_with(GOOD["sarif"], ('"results":', '"baselineGuid":"x","results":')), "baseline"), (_with(GOOD["sarif"], ('"kind":"pass"', '"kind":"review"')), "undecided"), (_with(GOOD["sarif"], ('"kind":"pass"', '"kind":"odd"')), "kind"), (_with(GOOD["sarif"], ('"x","y"', '"x"')), "message"), (_with(GOOD["sarif"], ('"ruleIndex":0', '"ruleIndex":4')), "rule"),
        (_with(GOOD["sarif"], ('"ruleIndex":0', '"ruleIndex":0,"ruleId":"Q"')), "rule"), (_with(GOOD["sarif"], ('"startLine":3', '"startLine":3,"endLine":2')), "location"), (_with(GOOD["sarif"], ('"uri":"a.c"', '"uri":""')), "location"), (_with(GOOD["sarif"], ('"rules":[', '"rules":[{"id":"R1"},')), "rules"), ('{"version":"2.1.0","runs":', "malformed"),
    ],
    "covpy": [
        ("{}", "format"), ('{"meta":{"format":3},"totals":{"covered_lines":0,"num_statements":0}}', "no file"), (_with(GOOD["covpy"], ('"missing_lines":[3],', "")), "lists missing"), (_with(GOOD["covpy"], ('"missing_lines":[3]', '"missing_lines":[2]')), "lists overlap"), (_with(GOOD["covpy"], ('"excluded_lines":[]', '"excluded_lines":[3]')), "lists overlap"),
        (_with(GOOD["covpy"], ("[1,2],", "[1,1],")), "lists repeat"), (_with(GOOD["covpy"], ("[[1,2]]", "[[3,2]]")), "branches"), (_with(GOOD["covpy"], ('"num_statements":3', '"num_statements":4')), "totals differ"), (_with(GOOD["covpy"], (',"totals":{"covered_lines":2,"num_statements":3}', "")), "no totals"), ("[]", "malformed"),
    ],
    "clippy": [("", "malformed"), ("{}", "malformed")],
    "eslint": [
        ("[]", "no file"), (_with(GOOD["eslint"], ('"errorCount":1', '"errorCount":2')), "counts differ"), ('[{"filePath":"a.js","errorCount":2,"warningCount":0}]', "no messages"), (_with(GOOD["eslint"], ('"errorCount":1,', "")), "counts differ"), (_with(GOOD["eslint"], ('"filePath":"a.js",', "")), "file without path"),
        (_with(GOOD["eslint"], ('"errorCount":1', '"fatalErrorCount":1,"errorCount":1')), "fatal"), (_with(GOOD["eslint"], ('"ruleId":"r"', '"ruleId":null')), "message"), (_with(GOOD["eslint"], ('"line":3', '"line":0')), "message"), ("[{", "malformed"),
    ],
    "golangci": [("{}", "no report"), ('{"Report":{}}', "no issues"), ('{"Report":{"Linters":[{"Name":"lll"}]},"Issues":[]}', "linters"), ('{"Report":{"Error":"x"},"Issues":[]}', "error"), (_with(GOOD["golangci"], ('"Line":2', '"Line":0')), "issue"), (_with(GOOD["golangci"], ('"lll"', '"typecheck"')), "typecheck")],
    "ruff": [("{}", "malformed"), (_with(GOOD["ruff"], ('"row":1', '"col":1')), "entry"), (_with(GOOD["ruff"], ('"column":5', '"column":0')), "entry"), (_with(GOOD["ruff"], ('"column":9', '"column":4')), "entry"), ('[] boom ]', "malformed")],
    "pyright": [("{}", "no diagnostics"), ('{"generalDiagnostics":[]}', "no summary"), ('{"generalDiagnostics":[],"summary":{}}', "counts differ"), ('{"generalDiagnostics":[],"summary":{"errorCount":0,"warningCount":0,"informationCount":0,"filesAnalyzed":0}}', "no file"), (_with(GOOD["pyright"], ('"file":"a.py",', "")), "diagnostic"), (_with(GOOD["pyright"], ('"warning"', '"hint"')), "counts differ")],
    "diag": [("{}", "no issues"), ('{"issues":[]}', "no tool"), (_with(GOOD["diag"], ('"line":1', '"line":0')), "issue"), (_with(GOOD["diag"], ('"line":1', '"line":1,"locations":[{"file":"b","line":1}]')), "issue")],
    "facts": [("{}", "envelope"), ('{"project":"p","target":"t"}', "no facts"), (_with(GOOD["facts"], ('"1.50"', '"1.5x"')), "value"), (_with(GOOD["facts"], ('"project"', '"complete":false,"project"')), "incomplete"), ('{"project":"p","target":"t","clones":[{"id":"1","similarity":"2","left":{"file":"a","start":1,"end":2,"nodes":1},"right":{"file":"b","start":1,"end":2,"nodes":1}}]}', "clone pair")],
    "lcov": [
        ("", "malformed"), ("DA:1,1\nend_of_record\n", "section without file"), ("SF:a\nDA:1,1\nLF:2\nend_of_record\n", "counters differ"), ("SF:a\nDA:1,1\nLH:0\nend_of_record\n", "counters differ"), ("SF:a\nDA:1,1\nBRF:1\nend_of_record\n", "counters differ"), ("SF:a\nDA:1,1\nBRDA:1,0,0,1\nBRH:0\nend_of_record\n", "counters differ"),
        ("SF:a\nend_of_record\n", "empty section"), ("SF:a\nDA:1,1\nDA:1,2\nend_of_record\n", "record given twice"), ("SF:a\nDA:1,1\nBRDA:2,0,0,1\nend_of_record\n", "branch without line"), ("SF:a\nDA:x,1\nend_of_record\n", "record"), ("SF:a\nDA:1,1\nBRDA:1,0,1\nend_of_record\n", "record"), ("SF:a\nSF:b\nDA:1,1\nend_of_record\n", "section without file"), ("SF:a\nDA:1,1\nend_of_record\nDA:2,2\n", "open section"),
        ("SF:a\nDA:1,1\nLF: 1\nend_of_record\n", "counters differ"), ("SF:a\nDA: 1,1\nend_of_record\n", "record"), ("SF:a\nDA:1,-1\nend_of_record\n", "record"), ("SF:a\nDA:1\nend_of_record\n", "record"),
    ],
    "javac": [
        (" \n", "cut"), (GOOD["javac"].rstrip("\n"), "cut"), (_with(GOOD["javac"], ("1 warning\n", "")), "total differs"), (_with(GOOD["javac"], ("1 warning", "2 warnings")), "total differs"), (_with(GOOD["javac"], ("   ^\n", "")), "caret"), (_with(GOOD["javac"], (":3:", ":0:")), "place"), (_with(GOOD["javac"], (":3:", ":x:")), "place"),
        (GOOD["javac"] + "only showing the first 1 warnings, of 2 total\n", "text after the total"), (GOOD["javac"] + "\n", "text after the total"), ("warning: [removal] gone\n1 warning\n", "warning without line"), ("Note: Some input files use or override a deprecated API.\n", "note"), ("Note: Recompile with -Xlint:removal for details.\n", "note"),
        (_with(GOOD["javac"], ("[deprecation]", "[deprecation")), "label"), ("A.java:1: error: cannot find symbol\n1 error\n", "unexpected line"), ("A.java:1:1: compiler.warn.has.been.deprecated: Old, pkg\n1 warning\n", "unexpected line"), ("A.java:1: warning: [removal] x\n", "caret"), ("0 warnings\n", "total differs"), ("x warnings\n", "total"),
    ],
}


@pytest.mark.parametrize("name", GAPS)
def test_missing_evidence_is_never_clean(spark, name):
    cases = [*GAPS[name], (None, "malformed")]
    raw = spark.createDataFrame([(str(i), s) for i, (s, _) in enumerate(cases)], "report_id string, content string")
    facts, gaps, *_ = CASES[name][0](raw)
    assert facts.count() == 0
    got = {r.report_id: r.reason for r in gaps.collect()}
    assert [(s, got.get(str(i))) for i, (s, _) in enumerate(cases)] == cases


def test_nested_suites(spark):
    deep = "<testsuite tests='1' failures='1'>" * 300 + "<testcase file='f' classname='C' name='n' line='7'><failure type='T'>why</failure></testcase>" + "</testsuite>" * 300
    ns = "<?xml version='1.0'?><!-- a --><testsuites xmlns='urn:x'><testsuite><testcase name='m' file='g'><skipped/></testcase></testsuite></testsuites>"
    raw = spark.createDataFrame([("0", deep), ("1", ns)], "report_id string, content string")
    facts, gaps = x.junit(raw)
    assert [tuple(r) for r in facts.collect()] == [("0", "junit", "failure", "f", 7, "why", "C#n")] and gaps.count() == 0
    cases = {(r.report_id, r.name, r.outcome) for r in x.junit_cases(raw)[0].collect()}
    assert cases == {("0", "n", "failure"), ("1", "m", "skipped")}
    raw = spark.createDataFrame([("0", "<testsuite><testcase name='m'/></testsuite>")], "report_id string, content string")
    assert [r.reason for r in x.junit_cases(raw)[1].collect()] == ["case without file or name"] and x.junit(raw)[1].count() == 0


def test_clone_pairs_and_classes(spark):
    side = '{"file":"%s","start":1,"end":9,"nodes":4}'
    raw = spark.createDataFrame([("0", '{"project":"p","target":"t","clones":[{"id":"1","similarity":"0.85","left":%s,"right":%s}]}' % (side % "a", side % "b"))], "report_id string, content string")
    assert [tuple(r) for r in j.tool_clones(raw, "p", "t")[0].collect()] == [("0", "1", Decimal("0.850000000000000000"), "a", 1, 9, 4, "b", 1, 9, 4)]
    raw = spark.createDataFrame([(k, GOOD["api"]) for k in "012"], "report_id string, content string")
    expected = spark.createDataFrame([("0", "A"), ("0", "B"), ("1", "A")], "report_id string, class string")
    facts, gaps = x.api_compatibility(raw, expected=expected)
    assert {r.report_id for r in facts.collect()} == {"0"} and {(r.report_id, r.reason) for r in gaps.collect()} == {("1", "other classes than expected"), ("2", "other classes than expected")}


#: What may not follow, or be in, a JSON report: each makes a good one malformed.
NOT_WHOLE = [lambda s: s + " boom ]", lambda s: s + s, lambda s: s + '{"cut":', lambda s: s + "]", lambda s: s[:-1], lambda s: s.replace("{", '{"twice":1,"twice":{},', 1), lambda s: s + "] [" if s[0] == "[" else s + "} {"]


@pytest.mark.parametrize("name", ["sarif", "covpy", "eslint", "golangci", "ruff", "pyright", "diag", "facts", "clippy"])
def test_json_is_read_to_its_end(spark, name):
    good = GOOD[name].rstrip("\n")
    raw = spark.createDataFrame([(str(i), f(good)) for i, f in enumerate(NOT_WHOLE)] + [("good", f" \t{good}\r\n ")], "report_id string, content string")
    facts, gaps, *_ = CASES[name][0](raw)
    assert {r.report_id for r in facts.collect()} == {"good"}
    if name != "clippy":  # a line each: what follows may be another's
        assert {(r.report_id, r.reason) for r in gaps.collect()} == {(str(i), "malformed") for i in range(len(NOT_WHOLE))}


@pytest.mark.parametrize(("name", "parse"), [*((n, "from_json(") for n in ("sarif", "covpy", "eslint", "pyright", "clippy")), ("cobertura", "from_xml("), ("lcov", "split(content"), ("javac", "aggregate(")])
def test_a_report_is_parsed_once(spark, name, parse):
    raw = spark.createDataFrame([("0", GOOD[name])], "report_id string, content string")
    for part in CASES[name][0](raw)[:2]:
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(parse) <= 2, name  # at most once on each side of a join


def test_sarif_is_read_in_one_pass(spark):
    """Good and bad reports part without a second parse or a join, and a message is filled in once."""
    raw = spark.createDataFrame([("0", GOOD["sarif"])], "report_id string, content string")
    for part in j.sarif(raw):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert (plan.count("from_json("), plan.count("regexp_extract_all("), plan.count("Join ")) == (1, 1, 0)


def test_javac_takes_excerpts_for_no_warnings(spark):
    text = "warning: [options] no modules\r\na/B.java:4: warning: [removal] x] y\r\nC.java:9: warning: [deprecation] in an excerpt\r\n  ^\r\nNote: other\r\n\r\n2 warnings\r\n"
    facts, gaps = t.javac(spark.createDataFrame([("0", text), ("1", "")], "report_id string, content string"))
    assert [tuple(r) for r in facts.collect()] == [("0", "javac", "removal", "a/B.java", 4, "x] y", None)] and gaps.count() == 0


def test_lcov_branch_coverage(spark):
    counted = "SF:a\nDA:1,1\nBRDA:1,0,0,1\nBRF:1\nBRH:1\nend_of_record\n"
    raw = spark.createDataFrame([("0", counted), ("1", counted + "SF:b\nDA:1,1\nend_of_record\n"), ("2", "SF:a\nDA:1,1\nBRF:0\nBRH:0\nend_of_record\n")], "report_id string, content string")
    assert {(r.report_id, r.branch_coverage) for r in t.lcov_branch_coverage(raw).collect()} == {("0", True), ("1", False), ("2", False)}


@pytest.mark.parametrize("name", CASES)
def test_reader(spark, name):
    read, reports, want = CASES[name]
    raw = spark.createDataFrame([(str(i), s) for i, s in enumerate(reports)], "report_id string, content string")
    got = [sorted((tuple([tuple(y) for y in v] if isinstance(v, list) else v for v in r) for r in part.collect()), key=str) for part in read(raw)]
    assert got == [sorted(w, key=str) for w in want]


@pytest.mark.parametrize("name", CASES)
def test_reader_without_reports(spark, name):
    raw = spark.createDataFrame([], "report_id string, content string")
    assert [part.count() for part in CASES[name][0](raw)] == [0] * len(CASES[name][2])


def test_lcov_sections_are_dealt_finely(spark):
    """What is grouped by report is held in memory: tasks grow with the reports, not with how few parts their bytes fill."""
    raw = spark.range(50).selectExpr("id AS report_id", "concat('SF:a.c\nDA:1,', id, '\nend_of_record\nSF:a.c\nDA:1,1\nDA:2,0\nend_of_record\n') AS content")
    got, gaps = t.lcov(raw)
    assert ", 32), REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert gaps.count() == 0 and sorted((r["report_id"], r["line"], r["hits"]) for r in got.collect()) == sorted(x for i in range(50) for x in ((i, 1, i + 1), (i, 2, 0)))
