"""The rules' patterns as the registered SQL states them, against the rules, on lines with words of any language."""

import random

import duckdb

from sluice.operators import rules
from sluice.plans import queries

ODD = ["é", "desé", "édes ", "é", "́", "ß", "9", "89", "٣", "中", "_", " ", " ", "\x0b", "\r", " ", "(", "-", "ſ", "K", ".", "²"]


def test_sql_of_patterns(spark):
    rnd = random.Random(3)
    patterns = sorted({p for r in rules.PATTERN_RULES for several in r[5].values() for p in several})
    texts = {"deséoieauan", "sha1é", "édes", "md5", "deś", "ſhal1", "9l", "8l", "x = 19l;", "trap 9", "9.5"}
    for p in patterns:
        whole = queries._sample(p)
        for _ in range(12):
            i = rnd.choice([0, len(whole), rnd.randrange(len(whole) + 1)])
            texts.add(whole[:i] + rnd.choice(ODD) + whole[i:] + rnd.choice(["", *ODD]))
    texts = sorted(texts)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line_no int, text string")
    one = [("r", "k", "error", True, [], {"all": patterns})]
    got = {(r["line_no"], patterns[r["pattern"]]) for r in rules.pattern_findings(rows.selectExpr("'a' AS path", "'x' AS language", "line_no", "text"), rules=one).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (n INT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    columns = ", ".join(f"{queries._matches(p)} AS p{i}" for i, p in enumerate(patterns))
    cur = con.execute(f"SELECT n, {columns} FROM (SELECT *, {queries._MARKED} AS marked FROM t)")
    want = {(row[0], patterns[i]) for row in cur.fetchall() for i, yes in enumerate(row[1:]) if yes}
    assert {(texts[n], p) for n, p in got} == {(texts[n], p) for n, p in want} and len(got) > 500
