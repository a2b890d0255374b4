"""Globs as a table against each glob on each path."""

import random
import re

from sluice.functions.text import glob_regex
from sluice.operators import globs

GLOBS = ["**", "*", "a/b.py", "a/*", "**/b.py", "a/**/c.*", "*.py", "**/*.{py,txt}", "{a,b/c}/x.py", "[ab]/b.py", "?/b.py", "a/b/**", "**/*[0-9].py", "a/{b,c}.py", "b/[!x]*/d", "**/.hidden", "", "a/b.tar.gz", "**/*.gz", "x*y", "a[/]b.py", "{a/b,c}.py"]


def test_against_each_on_each(spark):
    rnd = random.Random(2)
    paths = ["", "a", "b.py", "a/b.py", "b/c/x.py", "a/x.py", "a/c.py", "a/q/r/c.txt", "b/y1/d", ".hidden", "a/.hidden", "a/b.tar.gz", "xyzzy", "a/b/c/d.py"]
    paths += ["/".join(rnd.choice(["a", "b", "c", "x1", "b.py", "c.txt", "d7.py"]) for _ in range(rnd.randrange(1, 5))) for _ in range(60)]
    table = spark.createDataFrame([(i, g) for i, g in enumerate([*GLOBS, None])], "number int, glob string")
    got = sorted((r.path, r.number) for r in globs.glob_matches(spark.createDataFrame([(p,) for p in [*paths, None]], "path string"), table).collect())
    assert got == sorted((p, i) for p in paths for i, g in enumerate(GLOBS) if re.search(glob_regex(g), p))


def test_keys_and_empty_tables(spark):
    paths = spark.createDataFrame([("r", "a.py"), ("s", "a.py"), (None, "a.py")], "repo string, path string")
    table = spark.createDataFrame([("r", "*.py", 1), (None, "a.*", 2)], "repo string, glob string, text int")
    assert sorted(map(tuple, globs.glob_matches(paths, table, ["repo"]).collect()), key=str) == sorted([("r", "a.py", "*.py", 1), (None, "a.py", "a.*", 2)], key=str)
    assert globs.glob_matches(paths.limit(0), table).count() == 0 and globs.glob_matches(paths, table.limit(0)).count() == 0


def test_counts_without_pairs(spark):
    """A glob of 20,000 rows that 20,000 paths fit: 400 million pairs, 20,000 counts."""
    paths = spark.range(20_000).selectExpr("concat('src/', id, '.txt') AS path")
    table = spark.range(20_002).selectExpr("id AS number", "CASE WHEN id < 20000 THEN 'src/**' WHEN id = 20000 THEN '*/7.txt' ELSE 'no/**' END AS glob")
    got = globs.glob_counts(paths, table)
    assert got.columns == ["number", "glob", "paths"]
    assert {tuple(r) for r in got.groupBy("glob", "paths").count().collect()} == {("src/**", 20_000, 20_000), ("*/7.txt", 1, 1)}


def test_counts_are_those_of_the_matches(spark):
    paths = spark.createDataFrame([("r", "a.py"), ("r", "a.py"), ("r", "b.py"), ("s", "a.py"), (None, "a.py"), ("r", None)], "repo string, path string")
    table = spark.createDataFrame([("r", "*.py", 1), ("r", "*.py", 1), ("r", "a.*", 2), (None, "a.*", 2), ("s", None, 3), ("s", "b*", 4)], "repo string, glob string, number int")
    for keys in ([], ["repo"]):
        cut = (lambda t: t) if keys else (lambda t: t.drop("repo"))
        rows = globs.glob_matches(cut(paths), cut(table), keys).groupBy(*keys, "glob", "number").count().collect()
        counts = globs.glob_counts(cut(paths), cut(table), keys).groupBy(*keys, "glob", "number").sum("paths").collect()
        assert rows and sorted(map(tuple, rows), key=str) == sorted(map(tuple, counts), key=str)
