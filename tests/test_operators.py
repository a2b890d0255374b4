import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sluice.operators import diff, expressions as X, gates, graph, rules, scope, sets, stats, windows
from sluice.tables import keep


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(frame, *cols):
    return sorted((tuple(r) for r in frame.select(*cols).collect()), key=str)


FILES = "repo string, path string, content string, executable boolean"


def test_snapshot_diff_matches_copies_one_to_one(spark):
    base = df(spark, [("r", "a", "1", False), ("r", "b", "X", False), ("r", "c", "X", False), ("r", "m", "q", False), ("s", "a", "1", False)], FILES)
    head = df(spark, [("r", "a", "1", True), ("r", "d", "X", False), ("r", "e", "X", False), ("r", "f", "X", False), ("r", "m", "q", False)], FILES)
    got = rows(diff.snapshot_diff(base, head, ["repo"]), "repo", "path", "kind", "old_path")
    assert got == sorted([("r", "a", "modified", "a"), ("r", "d", "renamed", "b"), ("r", "e", "renamed", "c"), ("r", "f", "added", None), ("r", "m", "unchanged", "m"), ("s", "a", "deleted", "a")], key=str)


def test_snapshot_diff_of_nothing(spark):
    empty = df(spark, [], FILES)
    assert diff.snapshot_diff(empty, empty, ["repo"]).count() == 0


def test_shortest_edits():
    rnd = random.Random(3)
    for _ in range(2000):
        k = rnd.choice([1, 2, 3, 8])
        a, b = ([rnd.randrange(k) for _ in range(rnd.randint(0, 12))] for _ in range(2))
        gone, fresh = diff.edits(a, b)
        left = [x for i, x in enumerate(a) if i not in gone]
        assert left == [x for i, x in enumerate(b) if i not in fresh]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert len(left) == t[-1][-1]
    many = [f"line {i}" for i in range(60_000)]
    assert diff.edits(many, [x for i, x in enumerate(many) if i % 1000] + ["end"]) == (list(range(0, 60_000, 1000)), [60_000 - 60])
    assert diff.edits(many, [x + "!" for x in many]) == (list(range(60_000)), list(range(60_000)))


def test_line_ends_are_part_of_lines(spark):
    pairs = df(spark, [("a", "x", "x\n"), ("b", "x\r\ny\n", "x\ny\n"), ("c", "x\ry", "x\rz\ry"), ("d", "", None)], "path string, old string, new string")
    assert rows(diff.line_diff(pairs), "path", "op", "line_no") == sorted([("a", "removed", 1), ("a", "added", 1), ("b", "removed", 1), ("b", "added", 1), ("c", "added", 2)], key=str)


def test_rules_without_rows(spark):
    lines = df(spark, [("a.py", "python", 1, "TODO eval(x)")], "path string, language string, line_no int, text string")
    assert rules.pattern_findings(lines, rules=[]).count() == 0 and rules.pattern_findings(lines, kind="no such kind").count() == 0
    none = df(spark, [], "id string, paths array<string>, inputs array<string>, languages array<string>")
    assert rules.triggered(none, df(spark, [("a.py", "python")], "path string, language string")).count() == 0


def test_subset_by_keys(spark):
    left = df(spark, [("a", 1), ("a", 2), ("b", 1), (None, None)], "k string, v int")
    right = df(spark, [("a", 1), ("b", 1), (None, None)], "k string, v int")
    assert rows(sets.subset(left, right, ["k"]), "k", "lacking", "subset") == sorted([("a", 1, False), ("b", 0, True), (None, 0, True)], key=str)
    assert rows(sets.subset(left, left), "lacking", "subset") == [(0, True)]


def test_long_and_impossible_ranges(spark):
    ranges = df(spark, [("p", "all", 0, 2**31 - 1), ("p", "one", 7, 7), ("p", "back", 9, 3), ("p", "open", 5, None), ("p", "mid", 5000, 90_000), ("q", "all", 0, 2**31 - 1)], "path string, id string, start_line int, end_line int")
    lines = df(spark, [("p", 7), ("p", 80_000)], "path string, line_no int")
    assert rows(scope.range_overlap(ranges, lines, ["path"]), "id") == [("all",), ("mid",), ("one",)]
    spread = df(spark, [("p", str(a), a * 37, a * 37 + a * a) for a in range(300)], "path string, id string, start_line int, end_line int")
    few = df(spark, [("p", x) for x in (5, 4000, 30_000, 70_001)], "path string, line_no int")
    want = sorted((str(a),) for a in range(300) if any(a * 37 <= x <= a * 37 + a * a for x in (5, 4000, 30_000, 70_001)))
    assert rows(scope.range_overlap(spread, few, ["path"]), "id") == want


def test_line_diff_gives_a_valid_script(spark):
    pairs = df(spark, [("p", "a\nb\nc\n", "a\nx\nc\nd\n"), ("z", "a\0", "b"), ("e", None, "n\n")], "path string, old string, new string")
    assert rows(diff.line_diff(pairs), "path", "op", "line_no") == sorted([("p", "removed", 2), ("p", "added", 2), ("p", "added", 4), ("e", "added", 1)], key=str)


def test_new_issues_spend_credits_on_retained_first(spark):
    s = "fingerprint string, ord int, retained boolean"
    base = df(spark, [("f", 1, False)], s)
    head = df(spark, [("f", 1, False), ("f", 2, True), ("g", 3, False)], s)
    assert rows(diff.new_issues(base, head), "ord") == [(1,), (3,)]


def test_tree_digest_depends_on_every_part(spark):
    one = lambda *r: diff.tree_digest(df(spark, list(r), FILES), ["repo"]).first()["digest"]
    a = one(("r", "a", "1", False))
    assert len({a, one(("r", "a", "2", False)), one(("r", "b", "1", False)), one(("r", "a", "1", True)), one(("r", "a", "1", False), ("r", "b", "", False))}) == 5
    assert a == one(("r", "a", "1", False))


def test_ratchet_has_null_safe_keys_and_no_offsets(spark):
    s = "tool string, rule string, n long"
    got = gates.ratchet(df(spark, [(None, "a", 2), ("t", "b", 1)], s), df(spark, [(None, "a", 1), ("t", "c", 1)], s))
    assert rows(got, "tool", "rule", "baseline", "current", "increased") == sorted([(None, "a", 2, 1, False), ("t", "b", 1, 0, False), ("t", "c", 0, 1, True)], key=str)


CHECKS = "id string, required boolean, severity string, applicability string, status string, reason string, verdict string, finding_count long"
OK = ("a", True, "error", "applicable", "completed", None, "pass", 0)


@pytest.mark.parametrize(("checks", "required", "want"), [
    ([OK], [], "pass"), ([], [], "incomplete"), ([OK], ["b"], "incomplete"), ([OK, OK], [], "incomplete"),
    ([("a", True, "error", "applicable", "completed", None, "fail", 1)], [], "fail"), ([("a", True, "warning", "applicable", "completed", None, "fail", 1)], [], "pass"),
    ([("a", True, "error", "applicable", "failed", "x", None, 0), OK[:0] + ("b",) + OK[1:]], [], "incomplete"), ([("a", True, "error", "applicable", "completed", None, "pass", 3)], [], "incomplete"),
    ([("s", True, "error", "not_applicable", "not_run", "none here", "skipped", 0), OK], [], "pass"), ([("s", True, "error", "not_applicable", "not_run", " ", "skipped", 0), OK], [], "incomplete"),
    ([("o", False, "error", "applicable", "failed", None, None, 0), OK], [], "pass"),
])
def test_gate(spark, checks, required, want):
    got = gates.gate(df(spark, checks, CHECKS), df(spark, [(x,) for x in required], "id string")).collect()
    assert [r["decision"] for r in got] == [want] if got else want == "incomplete"


@pytest.mark.parametrize("total", [0, 1, 3, 200, 10**15])
def test_threshold_is_exact(spark, total):
    t = df(spark, [(h, total, th) for h in {0, 1, total // 2, max(total - 1, 0), total} for th in range(0, 101, 5)], "hit long, total long, th int")
    for r in t.withColumn("b", gates.below(F.col("hit"), F.col("total"), F.col("th"))).collect():
        assert r["b"] == (r["total"] > 0 and r["th"] > 0 and r["hit"] * 100 < r["total"] * r["th"])


def test_distribution_is_unknown_with_a_gap(spark):
    t = df(spark, [("a", x) for x in range(1, 21)] + [("b", 1), ("b", None)], "k string, v long")
    assert rows(stats.distribution(t, "v", ["k"]), "k", "samples", "unknown", "median", "p95") == [("a", 20, 0, 10.5, 19), ("b", 1, 1, None, None)]


def test_range_overlap_touches_both_ends_and_crosses_buckets(spark):
    r = df(spark, [(1, "p", 60, 70), (2, "p", 71, 80), (3, "q", 1, 500), (4, "p", 300, 300)], "id int, path string, start_line int, end_line int")
    l = df(spark, [("p", 70), ("q", 500), ("p", 64)], "path string, line_no int")
    assert rows(scope.range_overlap(r, l, ["path"]), "id") == [(1,), (3,)]


def test_report_paths(spark):
    inv = df(spark, [("src/a/X.java",), ("lib/a/X.java",), ("src/b/Y.java",), ("Z.java",)], "path string")
    got = scope.map_report_paths(df(spark, [("a/X.java",), ("b/Y.java",), ("Z.java",), ("Y.jav",), ("./src/a/X.java",)], "file string"), inv)
    assert dict(rows(got, "file", "path")) == {"a/X.java": None, "b/Y.java": "src/b/Y.java", "Z.java": "Z.java", "Y.jav": None, "./src/a/X.java": "src/a/X.java"}


def test_clone_pairs_against_all_pairs(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base[:57] + ["x", "y", "z"]), " ".join(base[20:] + base[:20]), "short one", "short one", "", " ".join(base[:30])]
    got = scope.clone_pairs(df(spark, list(enumerate(texts)), "id int, text string"), 0.8)
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    want = [(i, j) for i in range(7) for j in range(i + 1, 7) if texts[i] != texts[j] and len(grams(texts[i]) & grams(texts[j])) / len(grams(texts[i]) | grams(texts[j])) >= 0.8]
    assert rows(got, "left_id", "right_id") == want


def test_clone_pairs_move_few_shingles(spark):
    """Texts are cut once, and shingles of one text only go no further than where they are counted."""
    t = spark.range(400).selectExpr("id", "array_join(transform(sequence(0, 199), i -> if(id < 4 and i > 0, i, 1000 * id + i)), ' ') AS text").union(spark.createDataFrame([(600, None), (500, "1000 1001 x"), (501, "1000 1001 X")], "id long, text string"))
    got = scope.clone_pairs(t, 0.8)
    assert [(r.left_id, r.right_id, round(r.similarity, 6)) for r in got.orderBy("left_id", "right_id").collect()] == [(i, j, round(195 / 197, 6)) for i in range(4) for j in range(i + 1, 4)] + [(500, 501, 1.0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "shingles-" in got._jdf.queryExecution().executedPlan().toString()  # the pairs read the kept shingles
    kept = [f for f in got.inputFiles() if "/shingles-" in f]
    assert spark.read.parquet(*kept).count() == 6


def test_graph_cycles_and_gaps(spark):
    nodes = df(spark, [(x,) for x in "abcde"], "id string")
    edges = df(spark, [("b", "a"), ("c", "b"), ("d", "e"), ("e", "d"), ("c", "zz"), ("b", "a")], "id string, depends_on string")
    level, gaps = graph.levels(nodes, edges)
    assert rows(level, "id", "level") == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(gaps, "id", "gap") == [("b", "repeated"), ("c", "unknown"), ("d", "cycle"), ("e", "cycle")]
    assert rows(graph.closure(edges, df(spark, [("d",)], "root string")), "id", "depth") == [("d", 0), ("e", 1)]


def test_origins_over_a_merge(spark):
    commits = df(spark, [("1", []), ("2", ["1"]), ("3", ["1"]), ("4", ["2", "3"])], "oid string, parents array<string>")
    e = df(spark, [("1", "f", "x"), ("2", "f", "y"), ("3", "f", "y"), ("4", "f", "y")], "oid string, entity string, bytes string")
    order = df(spark, [("1", 0), ("2", 1), ("3", 1), ("4", 2)], "oid string, level int")
    assert rows(graph.origins(commits, e, order), "oid", "origin") == [("1", "1"), ("2", "2"), ("3", "3"), ("4", "2"), ("4", "3")]


def test_attempt_audit(spark):
    a = df(spark, [("x", 1, 10, ["a", "b"]), ("x", 2, 10, ["a"]), ("x", 3, 10, None), ("x", 4, 10, ["c"]), ("x", 5, 10, ["a", "c"]), ("x", 6, 10, [])], "assignment string, number int, elapsed_ms long, debt array<string>")
    got = rows(windows.attempt_audit(a, limit=3, max_attempts=5), "number", "elapsed", "progress", "streak", "stop_after", "deviations")
    assert got == [(1, 10, False, 1, 5, ""), (2, 20, True, 0, 5, ""), (3, 30, False, 1, 5, ""), (4, 40, False, 2, 5, ""), (5, 50, False, 3, 5, ""), (6, 60, True, 0, 5, "continued_after_no_progress,attempt_or_time_budget_exceeded")]


def test_greedy_fit_skips_what_is_too_large(spark):
    t = df(spark, [("s", 1, 4), ("s", 2, 9), ("s", 3, 3), ("s", 4, 3)], "k string, n int, size int")
    assert rows(windows.greedy_fit(t, "size", ["k"], ["n"], 10), "used", "places") == [(10, "1,3,4")]


def test_greedy_fit_looks_at_every_row(spark):
    import random

    rnd, want, made = random.Random(4), [], []
    for k in ("a", "b", None, "none"):
        used, places = 0, []
        for n in range(1, 701):
            size = 5000 if k == "none" else 2000 if 3 < n < 400 else rnd.choice([None, 0, 1, 7, 60, 300, 900])
            made.append((k, n, size))
            if size is not None and used + size <= 3000:
                used, places = used + size, [*places, n]
        want.append((k, used, len(places), ",".join(map(str, places))))
    assert any(int(p.split(",")[-1]) > 256 for *_, p in want if p)
    rnd.shuffle(made)
    got = windows.greedy_fit(df(spark, made, "k string, n int, size int"), "size", ["k"], ["n"], 3000).collect()
    assert {(r.k, r.used, r.kept, r.places) for r in got} == set(want) and len(got) == 4


def test_greedy_fit_takes_few_rounds(spark, monkeypatch):
    made = [(n, 1 if n % 2 else 200 - n // 2) for n in range(1, 300)]
    used, places = 0, []
    for n, size in made:
        if used + size <= 200:
            used, places = used + size, [*places, n]
    tables = []
    monkeypatch.setattr(windows, "keep", lambda df, name: tables.append(name) or keep(df, name))
    got = windows.greedy_fit(df(spark, made, "n int, size int"), "size", [], ["n"], 200).collect()
    assert [(r.used, r.places) for r in got] == [(used, ",".join(map(str, places)))]
    assert tables.count("live") <= 9  # 200 has eight bits


def test_shared_fit(spark):
    made = [("a", "x", i, 30, i == 1) for i in range(5)] + [("a", "y", 0, 200, False), ("a", "other", 0, 1, True), ("b", "y", 0, 10, None), (None, "x", 0, 10, True)]
    got = windows.shared_fit(df(spark, made, "k string, s string, n int, size int, cut boolean"), "size", ["k"], "s", ["n"], 200, ["x", "y"], "cut")
    assert rows(got, "k", "s", "total", "kept", "omitted", "used", "truncated") == sorted([("a", "x", 5, 3, 2, 90, True), ("a", "y", 1, 0, 1, 0, True), ("b", "x", 0, 0, 0, 0, False), ("b", "y", 1, 1, 0, 10, False), (None, "x", 1, 1, 0, 10, True), (None, "y", 0, 0, 0, 0, True)], key=str)
    assert windows.shared_fit(df(spark, [], "k string, s string, n int, size int"), "size", ["k"], "s", ["n"], 200, ["x", "y"]).count() == 0


def test_distribution_without_keys(spark):
    t = df(spark, [(float("nan"),), (1.0,), (1.0,), (-0.5,)], "v double")
    assert rows(stats.distribution(t, "v"), "samples", "median") == [(4, 1.0)]
    assert stats.distribution(df(spark, [], "k string, v double"), "v", ["k"]).count() == 0
    nulls = df(spark, [(None, 3), (None, 1), ("a", 2)], "k string, v int")
    assert rows(stats.distribution(nulls, "v", ["k"]), "k", "median", "p95") == sorted([(None, 2.0, 3), ("a", 2.0, 2)], key=str)


def test_shuffled_files_are_compared_by_bits():
    import random
    import time

    rnd, began = random.Random(3), time.perf_counter()
    old = [f"line {rnd.randrange(30_000)}" for _ in range(20_000)]
    new = rnd.sample(old, len(old))
    gone, fresh = diff.edits(old, new)
    left = [x for i, x in enumerate(old) if i not in set(gone)]
    assert left == [x for i, x in enumerate(new) if i not in set(fresh)] and len(gone) == len(fresh)
    codes = {x: i for i, x in enumerate(old)}
    assert len(left) == diff._common([codes[x] for x in old], [codes[x] for x in new])[-1]
    assert time.perf_counter() - began < 60


def test_halving_finds_shortest_scripts(monkeypatch):
    import random

    monkeypatch.setattr(diff, "FEW", 1)
    rnd = random.Random(8)
    for _ in range(300):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(30))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert diff._common(a, b).tolist() == best[len(a)]
        gone, fresh = diff.edits(a, b)
        assert len(a) - len(gone) == len(b) - len(fresh) == best[len(a)][len(b)]


def test_output_budget(spark):
    made = [("a", i, 9) for i in range(12)] + [("b", 1, 200), ("b", 2, 1), (None, 1, 5), ("n", 1, 5), ("n", 2, None), ("n", 3, 5)]
    got = rows(windows.output_budget(df(spark, made, "k string, n int, size int"), F.col("size"), ["k"], ["n"], 4, 100), "k", "n", "complete")
    assert got == sorted([*[("a", i, False) for i in range(4)], (None, 1, True), ("n", 1, False)], key=str)
    got = rows(windows.output_budget(df(spark, made, "k string, n int, size int"), F.col("size"), ["k"], ["n"], 40, 100), "k", "n")
    assert got == sorted([*[("a", i) for i in range(10)], (None, 1), ("n", 1)], key=str)
    assert windows.output_budget(df(spark, [], "k string, n int, size int"), F.col("size"), ["k"], ["n"], 4, 100).count() == 0


def test_new_texts_and_issues_of_groups(spark):
    base = df(spark, [("r", "x", 1), ("r", "x", 2), ("r", None, 1), ("r", "gone", 1)], "k string, text string, ord int")
    head = df(spark, [("r", "x", i) for i in range(5)] + [("r", None, 7), ("r", None, 8), ("r", "new", 1), ("r", "new", 1), ("s", "x", 1)], "k string, text string, ord int")
    assert rows(diff.new_texts(base, head, ["k"]), "k", "text", "ord") == sorted([("r", "x", 2), ("r", "x", 3), ("r", "x", 4), ("r", None, 8), ("r", "new", 1), ("r", "new", 1), ("s", "x", 1)], key=str)
    b = df(spark, [("f", 1), ("g", 1)], "fingerprint string, ord int")
    h = df(spark, [("f", 1, False), ("f", 2, True), ("g", 1, None), ("h", 1, True)], "fingerprint string, ord int, retained boolean")
    assert rows(diff.new_issues(b, h), "fingerprint", "ord") == [("f", 1), ("h", 1)]
    assert diff.new_texts(base, head.limit(0), ["k"]).count() == 0 and diff.new_issues(b.limit(0), h).count() == 4


def _levels(n, edges):
    """By relaxation; None for ids on or behind a cycle."""
    up = {i: {b for a, b in edges if a == i and 0 <= b < n} for i in range(n)}
    out = {}
    while True:
        ready = [i for i in up if i not in out and up[i] <= out.keys()]
        if not ready:
            return out
        for i in ready:
            out[i] = max((out[b] + 1 for b in up[i]), default=0)


def test_graphs_against_plain_search(spark):
    rnd = random.Random(7)
    for n, m, back in ((30, 25, 0), (30, 45, 2), (12, 30, 3), (1, 0, 0), (20, 19, 0)):
        edges = {(a, rnd.randrange(a)) for a in (rnd.randrange(1, n) for _ in range(m))} | {(rnd.randrange(n), rnd.randrange(n)) for _ in range(back)}
        if m == 19:
            edges = {(i, i - 1) for i in range(1, 20)} | {(3, 9)}  # a run into a circle and out of it
        e, nodes = df(spark, [*edges], "id int, depends_on int"), df(spark, [(i,) for i in range(n)], "id int")
        placed, gaps = graph.levels(nodes, e)
        want = _levels(n, edges)
        assert {r.id: r.level for r in placed.collect()} == want
        assert {r.id for r in gaps.where("gap = 'cycle'").collect()} == set(range(n)) - want.keys()
        dist = {}
        for root in (0, n // 2, n - 1):
            dist[root, root], todo = 0, [root]
            for i in todo:
                for b in {b for a, b in edges if a == i}:
                    if (root, b) not in dist:
                        dist[root, b] = dist[root, i] + 1
                        todo.append(b)
        roots = df(spark, sorted({(0,), (n // 2,), (n - 1,)}), "root int")
        assert {(r.root, r.id): r.depth for r in graph.closure(e, roots).collect()} == dist
        got = graph.reached(e, roots.select(F.col("root").alias("id"))).collect()
        assert sorted(r.id for r in got) == sorted({i for _, i in dist})


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(graph, "keep", lambda frame, name: tables.append(name) or keep(frame, name))
    ids = spark.range(10_000).select(F.col("id"))
    e = ids.where("id > 0").select("id", (F.col("id") - 1).alias("depends_on"))
    placed, gaps = graph.levels(ids, e)
    assert placed.where("level <> id").isEmpty() and placed.count() == 10_000 and gaps.isEmpty()
    assert len(tables) < 30
    tables.clear()
    depth = graph.closure(e, df(spark, [(9_999,), (5,)], "root long"))
    assert depth.where("depth <> root - id").isEmpty() and depth.count() == 10_006 and len(tables) < 40


def test_origins_along_runs_and_merges(spark):
    commits = df(spark, [("a", []), ("b", ["a"]), ("c", ["b"]), ("d", ["b"]), ("m", ["c", "d"]), ("n", ["m"])], "oid string, parents array<string>")
    entities = df(spark, [(o, "e", x) for o, x in (("a", "1"), ("b", "1"), ("c", "2"), ("d", "2"), ("m", "2"), ("n", "2"))] + [("n", "f", "9")], "oid string, entity string, bytes string")
    order = df(spark, [(o, i) for i, o in enumerate("abcdmn")], "oid string, level int")
    got = rows(graph.origins(commits, entities, order), "oid", "entity", "origin")
    assert got == sorted([("a", "e", "a"), ("b", "e", "a"), ("c", "e", "c"), ("d", "e", "d"), ("m", "e", "c"), ("m", "e", "d"), ("n", "e", "c"), ("n", "e", "d"), ("n", "f", "n")], key=str)


def test_many_roots(spark):
    inventory = df(spark, [(f"r{i}/src/a.py",) for i in range(100)] + [("r7/b.py",), ("c.py",), ("r1/x/c.py",)], "path string")
    roots = df(spark, [(f"r{i}/src",) for i in range(100)] + [("r7",), ("",), ("r1/x",)], "root string")
    got = rows(scope.map_with_roots(df(spark, [("a.py",), ("b.py",), ("c.py",), ("r5/src/a.py",), ("none",)], "file string"), inventory, roots), "file", "path", "candidates")
    assert got == sorted([("a.py", None, 100), ("b.py", "r7/b.py", 1), ("c.py", None, 2), ("r5/src/a.py", "r5/src/a.py", 1), ("none", None, 0)], key=str)


def test_sets_of_nothing(spark):
    none, some = df(spark, [], "x int"), df(spark, [(1,)], "x int")
    assert rows(sets.subset(none, some), "lacking", "subset") == [(0, True)]
    assert rows(sets.equal(none, some), "left_only", "right_only", "equal") == [(0, 1, False)]


def test_expressions_are_checked_before_reading():
    price, other = X.column("a", X.Kind("number", dimension=("eur", "m"))), X.literal(1)
    for wrong in (
        lambda: X.compare("lt", price, other), lambda: X.compare("lt", X.literal("a"), X.literal("b")), lambda: X.all_of(), lambda: X.all_of(other), lambda: X.matches(other, "a"),
        lambda: X.matches(X.literal("a"), "(?=a)"), lambda: X.get("no", X.var("r", X.Kind("record"))), lambda: X.literal(Decimal("0." + "1" * 19)), lambda: X.one_of(X.literal("a"), other), lambda: X.count(other),
    ):
        with pytest.raises(X.RuleTypeError):
            wrong()


def test_empty_collections(spark):
    many = X.scalars("xs", X.STRING)
    t = df(spark, [([],), (["a"],)], "xs array<string>")
    yes = lambda x: X.compare("eq", x, X.literal("b"))
    got = t.select(X.for_all(many, "x", yes).column().alias("all"), X.for_any(many, "x", yes).column().alias("any"), X.count(many).column().cast("int").alias("n")).collect()
    assert [tuple(r) for r in got] == [(True, False, 0), (False, False, 1)]
    with pytest.raises(X.RuleTypeError):
        X.for_all(many, "x", lambda x: X.for_any(many, "x", yes)).column()


def test_every_bundled_pattern_compiles(spark):
    lines = df(spark, [("a.py", "python", 1, "eval(x)  # TODO now"), ("t/tests/a.c", "c", 2, "sleep(3); gets(b);")], "path string, language string, line_no int, text string")
    got = {r["rule"] for r in rules.pattern_findings(lines).collect()}
    assert {"todo-marker", "py-eval-exec", "security-sensitive-api", "no-test-sleep", "no-unsafe-string"} <= got


def test_binary_files(spark):
    cut = "a" * 4095 + "é"
    t = df(spark, [("a.jar", b"x"), ("b", b"a\0b"), ("c", b"\xff\xfe"), ("d", cut.encode()), ("e", b""), ("f", "é".encode()[:1])], "path string, content binary")
    assert rows(rules.binary_files(t), "path", "reason") == [("a.jar", "suffix"), ("b", "nul"), ("c", "utf8"), ("f", "utf8")]


def test_obligation_conflicts_without_pairs(spark):
    """Two texts of 20,000 rows and more: 200 million conflicts, counted and reported without making them."""
    t = spark.range(40_001).selectExpr("id", "CASE WHEN id % 4 = 0 OR id = 3 THEN 'must' ELSE 'must_not' END AS modality", "CASE WHEN id = 3 THEN ' b' WHEN id % 400 = 1 THEN 'b ' ELSE 'a' END AS text")
    got = scope.obligation_conflicts(t).collect()
    theirs = [i for i in range(40_001) if i % 4 and i != 3 and i % 400 != 1]
    assert [(r["must"], r["must_not"]) for r in got] == [(0, i) for i in theirs[:128]] and {r["conflicts"] for r in got} == {10_001 * len(theirs) + 100}


def test_obligation_conflicts_against_all_pairs(spark):
    rnd = random.Random(5)
    for _ in range(4):
        data = [(rnd.randrange(30), rnd.choice(["must", "must_not", "may"]), rnd.choice(["a", " a ", "b", "c"])) for _ in range(40)]
        pairs = sorted((x, y) for x, m, t in data if m == "must" for y, n, u in data if n == "must_not" and t.strip() == u.strip())
        for most in (1, 7, 1000):
            got = [(r["must"], r["must_not"], r["conflicts"]) for r in scope.obligation_conflicts(df(spark, data, "id int, modality string, text string"), most).collect()]
            assert got == [(*p, len(pairs)) for p in pairs[:most]]


def test_graph_rounds_are_not_broadcast(spark, monkeypatch):
    """What a round adds does not go through the driver: with rounds, broadcasts of small tables add up to the graph."""
    nodes = df(spark, [(i,) for i in range(1, 64)], "id int")
    edges = df(spark, [(i, i // 2) for i in range(2, 64)], "id int, depends_on int")
    commits = df(spark, [(i, [i // 2] if i > 1 else []) for i in range(1, 64)], "oid int, parents array<int>")
    entities = df(spark, [(i, "a", i.bit_length() // 2) for i in range(1, 64)], "oid int, entity string, bytes int")
    plans, kept = [], graph.keep

    def seen(t, name):
        plans.append(t._jdf.queryExecution().sparkPlan().toString())
        return kept(t, name)

    monkeypatch.setattr(graph, "keep", seen)
    order = graph.levels(nodes, edges)[0].select(F.col("id").alias("oid"), "level")
    found = graph.origins(commits, entities, order)
    top = lambda i: i if i.bit_length() % 2 == 0 or i == 1 else i // 2
    assert rows(found, "oid", "origin") == sorted(((i, top(i)) for i in range(1, 64)), key=str)
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_inventory_gaps_are_dealt_finely(spark):
    """Nearly each case is a group of its own: tasks grow with the table, not with how few parts its bytes fill."""
    cases = spark.range(4000).selectExpr("id % 5 AS file", "cast(id % 3990 AS string) AS name", "CASE id % 100 WHEN 1 THEN 'skipped' WHEN 2 THEN 'error' ELSE 'passed' END AS outcome")
    got = gates.test_inventory_gaps(cases, spark.range(3, 7).selectExpr("id AS file"))
    assert "hashpartitioning(file" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 32), REPARTITION_BY_NUM" in plan
    assert {r["gap"]: r["count"] for r in got.groupBy("gap").count().collect()} == {"duplicate": 10, "skipped": 40, "error": 40, "uncovered": 2}
