import pytest
from pyspark.sql import functions as F

from sluice.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(("text", "want"), [("", []), ("a\nb\n", ["a", "b"]), ("a\r\nb", ["a", "b"]), ("\n", [""]), ("a\n\n", ["a", ""])])
def test_lines(spark, text, want):
    assert one(spark, text, T.lines) == want


@pytest.mark.parametrize(("glob", "path", "hit"), [
    ("*.py", "a.py", True), ("*.py", "x/a.py", False), ("**/*.py", "a.py", True), ("**/*.py", "x/y/a.py", True), ("src/**", "src/a/b", True), ("a?c", "abc", True), ("a?c", "a/c", False),
    ("{a,b}/*.{c,d}", "b/x.d", True), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("a.b", "axb", False),
])
def test_glob(spark, glob, path, hit):
    assert one(spark, path, lambda c: T.any_glob(c, [glob])) is hit


@pytest.mark.parametrize(("text", "want"), [("1.50", "1.500000000000000000"), ("-0.1", "-0.100000000000000000"), ("01", None), ("1e3", None), ("1." + "1" * 19, None), ("", None), (None, None)])
def test_exact_decimal(spark, text, want):
    got = one(spark, text, T.exact_decimal)
    assert (None if got is None else str(got)) == want


@pytest.mark.parametrize("text", ["", "a" * 256, "a" * 257, "é" * 200, "a" + "日" * 100, "😀" * 80])
def test_truncate(spark, text):
    want = text.encode()[:256].decode(errors="ignore")
    assert one(spark, text, T.truncate_utf8) == want


def test_eol_and_extension(spark):
    assert [one(spark, t, T.eol) for t in ("", "a", "a\n", "a\r\n", "a\r\nb\n")] == ["none", "none", "lf", "crlf", "mixed"]
    assert [one(spark, t, T.extension) for t in ("a.PY", "x/.bashrc", "a.b/c", "a.tar.gz")] == [".py", "", "", ".gz"]


def test_fields_interpreter_marker(spark):
    assert one(spark, "@ai(a: 1, b='x y', c: 2, c: 3)", T.fields) == {"a": "1", "b": "x y", "c": ""}
    assert [one(spark, t, T.interpreter) for t in ("#!/bin/sh -e", "#!/usr/bin/env -S bash", "# no")] == ["sh", "bash", ""]
    assert [one(spark, t, lambda c: T.marker_line(c, "@ai")) for t in ("// @ai", "/* @ai: x", "@air", "x @ai")] == [True, True, False, False]


def test_one_line_and_branches(spark):
    assert one(spark, "a\tb c", T.one_line) == "a b c"
    assert one(spark, "x" * 600, T.one_line) == "x" * 512 + "…"
    assert [one(spark, t, T.branch_counts) for t in ("50% (1/2)", "50% (3/2)", "x", None)] == [(1, 2), None, None, None]


def test_required_texts():
    from sluice.functions.text import required_texts as of
    from sluice.operators.rule_data import PATTERN_RULES

    assert of("a(?:bc|bd)+e*") == (("c", "d"), False) or of("a(?:bc|bd)+e*") is None  # one letter is no text
    assert of(r"\bfoo\s*\(bar\)") == (("(bar)",), False) and of("(?i)Foo|BAR") == (("bar", "foo"), True) and of("[ab]+") is None and of("x{0,1}") is None and of(r"\x{1F300}") is None
    assert of("(?i)straße") is None  # cases fold otherwise elsewhere
    known = [of(p) for r in PATTERN_RULES for ps in r[5].values() for p in ps]
    assert sum(x is not None for x in known) > 95
