"""Counts, ratchets, coverage and decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sluice.tables import FINE, partitions


def bucket_counts(issues: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-4. Issues with multiplicity by (tool, rule); tool may be null."""
    return issues.groupBy(*keys, "tool", "rule").agg(F.count(F.lit(1)).alias("n"))


def ratchet(baseline: DataFrame, current: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """JOIN-1. Counts of both sides by (tool, rule); a bucket that one side lacks counts 0 there; buckets never offset."""
    by = [*keys, "tool", "rule"]
    b, c = baseline.alias("b"), current.alias("c")
    on = F.lit(True)
    for k in by:
        on = on & F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}"))
    joined = b.join(c, on, "full").select(
        *[F.coalesce(f"b.{k}", f"c.{k}").alias(k) for k in by],
        F.coalesce("b.n", F.lit(0)).alias("baseline"), F.coalesce("c.n", F.lit(0)).alias("current"),
    )
    return joined.withColumn("increased", F.col("current") > F.col("baseline"))


def gate(checks: DataFrame, required: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-1, AGG-3. checks (keys, id, required, severity, applicability, status, reason, verdict, finding_count) and
    required ids (keys, id) -> keys, decision, gaps, failures, completed, blockers.

    Incomplete if a result is doubled or inconsistent, a required check is neither completed nor validly skipped, or
    missing, or nothing completed; else fail if a completed check of severity error fails; else pass."""
    k = list(keys)
    done = (F.col("applicability") == "applicable") & (F.col("status") == "completed") & F.col("verdict").isin("pass", "fail")
    skip = (F.col("applicability") == "not_applicable") & (F.col("status") == "not_run") & (F.col("verdict") == "skipped")
    skip = skip & (F.trim(F.coalesce("reason", F.lit(""))) != "") & (F.col("finding_count") == 0)
    c = checks.select("*", F.coalesce(done, F.lit(False)).alias("_done"), F.coalesce(skip, F.lit(False)).alias("_skip"))
    if required is not None:
        must = required.select(*k, "id").distinct().withColumn("_must", F.lit(True))
        c = c.join(must, [*k, "id"], "left").withColumn("_must", F.col("required") | F.coalesce("_must", F.lit(False)))
    else:
        c = c.withColumn("_must", F.col("required"))
    odd = F.col("verdict").isNotNull() & ~F.col("_done") & ~F.col("_skip") | F.coalesce(F.col("verdict") == "pass", F.lit(False)) & (F.col("finding_count") > 0)
    per = c.groupBy(*k, "id").agg(
        (F.count(F.lit(1)) - 1).alias("doubled"), F.count_if(odd).alias("odd"),
        F.count_if(F.col("_must") & ~F.col("_done") & ~F.col("_skip")).alias("open"), F.count_if("_done").alias("done"),
        F.count_if(F.col("_done") & (F.col("verdict") == "fail") & (F.col("severity") == "error")).alias("failed"),
    )
    if required is not None:
        lost = required.select(*k, "id").distinct().join(checks.select(*k, "id").distinct(), [*k, "id"], "left_anti")
        zero = F.lit(0).cast("long")
        per = per.unionByName(lost.select(*k, "id", zero.alias("doubled"), zero.alias("odd"), F.lit(1).cast("long").alias("open"), zero.alias("done"), zero.alias("failed")))
    bad = F.col("doubled") + F.col("odd") + F.col("open")
    out = per.groupBy(*k).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in ((bad, "_gaps"), (F.col("failed"), "failures"), (F.col("done"), "completed"))],
        F.count_if((bad > 0) | (F.col("failed") > 0)).alias("blockers"),
    )
    out = out.withColumn("gaps", F.col("_gaps") + F.when(F.col("completed") == 0, 1).otherwise(0)).drop("_gaps")
    decision = F.when(F.col("gaps") > 0, "incomplete").when(F.col("failures") > 0, "fail").otherwise("pass")
    return out.select(*k, decision.alias("decision"), "gaps", "failures", "completed", "blockers")


def blockers(checks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-1. The checks that hold a gate: required ones without a usable result, and failed ones of severity error."""
    done = F.coalesce((F.col("status") == "completed") & F.col("verdict").isin("pass", "fail"), F.lit(False))
    why = F.when(F.col("required") & ~done, "gap").when(done & (F.col("verdict") == "fail") & (F.col("severity") == "error"), "failure")
    return checks.select(*keys, "id", why.alias("why")).where("why is not null")


def summary(checks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-2. Totals by verdict and of findings."""
    v = F.col("verdict")
    return checks.groupBy(*keys).agg(
        F.count_if(v == "pass").alias("passed"), F.count_if(v == "fail").alias("failed"), F.count_if(v == "skipped").alias("skipped"),
        F.count_if(v.isNull()).alias("incomplete"), F.sum("finding_count").alias("findings"),
    )


def route(gates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-3. accept, review (findings that do not fail the gate), block or inspect_gap. gates hold decision and findings."""
    to = F.when(F.col("decision") == "incomplete", "inspect_gap").when(F.col("decision") == "fail", "block").when(F.col("findings") > 0, "review").otherwise("accept")
    return gates.withColumn("route", to)


def merge_coverage(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-7. Observations (keys, file, line, hits, branches_found, branches_hit) merged by line: hits add, branches take the most."""
    return lines.groupBy(*keys, "file", "line").agg(F.sum("hits").alias("hits"), F.max("branches_found").alias("branches_found"), F.max("branches_hit").alias("branches_hit"))


def duplicate_lines(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-8. Gaps: lines that more than one producer reports."""
    return lines.groupBy(*keys, "file", "line").agg(F.count(F.lit(1)).alias("reports")).where("reports > 1")


def below(hit: Column, total: Column, threshold: Column) -> Column:
    """AGG-6. Exact: hit * 100 < total * threshold; a total or threshold of 0 never fails."""
    d = lambda c: c.cast("decimal(20,0)")
    return (total > 0) & (d(hit) * 100 < d(total) * threshold.cast("decimal(7,4)"))


def coverage_totals(lines: DataFrame, keys: Sequence[str] = (), threshold: float = 100) -> DataFrame:
    """AGG-5, AGG-6. Totals of the lines in scope; excluded lines are counted apart."""
    live = ~F.coalesce(F.col("excluded"), F.lit(False)) if "excluded" in lines.columns else F.lit(True)
    out = lines.groupBy(*keys).agg(
        F.count_if(live).alias("lines"), F.count_if(live & (F.col("hits") > 0)).alias("hit"), F.count_if(~live).alias("excluded"),
        F.coalesce(F.sum(F.when(live, F.col("branches_found"))), F.lit(0)).alias("branches"), F.coalesce(F.sum(F.when(live, F.col("branches_hit"))), F.lit(0)).alias("branches_hit"),
    )
    return out.withColumn("below", below(F.col("hit"), F.col("lines"), F.lit(threshold)))


def diff_size(changed: DataFrame, keys: Sequence[str] = (), limit: int = 500) -> DataFrame:
    """AGG-9. Added lines; over the limit or not."""
    return changed.groupBy(*keys).agg(F.count_if(F.col("op") == "added").alias("added")).withColumn("too_large", F.col("added") > limit)


def file_inventory(files: DataFrame, keys: Sequence[str] = (), max_lines: int = 1000, min_count: int = 1, max_words: int = 1 << 62) -> DataFrame:
    """AGG-10. files (keys, path, n_lines, n_words) -> totals and what is out of bounds."""
    out = files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"), F.sum("n_lines").alias("lines"), F.sum("n_words").alias("words"), F.count_if(F.col("n_lines") > max_lines).alias("long_files")
    )
    return out.withColumn("too_few", F.col("files") < min_count).withColumn("too_many_words", F.col("words") > max_words)


def repeated_shapes(entities: DataFrame, keys: Sequence[str] = (), least: int = 3) -> DataFrame:
    """AGG-11. Added entities that are not parameterized, by owner and shape; groups of at least `least`."""
    by = [*keys, "owner", "shape_digest"]
    plain = entities.where("kind = 'added' and not parameterized")
    return plain.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("symbol").alias("first_symbol")).where(F.col("n") >= max(least, 2))


#: Annotations that make a test parameterized.
PARAMETERIZED = ["ParameterizedTest", "parametrize", "rstest", "parameterized", "test_case"]


def test_count(cases: DataFrame, keys: Sequence[str] = (), minimum: int = 1) -> DataFrame:
    """AGG-12. Executed, failed and skipped cases; too few executed or any failure fails."""
    o = F.col("outcome")
    out = cases.groupBy(*keys).agg(F.count_if(o != "skipped").alias("executed"), F.count_if(o.isin("failure", "error")).alias("failures"), F.count_if(o == "skipped").alias("skipped"))
    return out.withColumn("too_few", F.col("executed") < minimum).withColumn("failed", F.col("failures") > 0)


def rollup_mismatches(cases: DataFrame, declared: DataFrame, levels: Sequence[str]) -> DataFrame:
    """AGG-13, AGG-14. Counters summed over each level of `levels` against the declared ones (levels with null for "all",
    counter columns as in cases): rows that differ or stand on one side only."""
    counters = [c for c in cases.columns if c not in levels]
    real = cases.rollup(*levels).agg(*[F.sum(c).alias(c) for c in counters]).alias("r")
    on = F.lit(True)
    for c in levels:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"d.{c}"))
    differ = F.lit(False)
    for c in counters:
        differ = differ | ~F.col(f"r.{c}").eqNullSafe(F.col(f"d.{c}"))
    joined = real.join(declared.alias("d"), on, "full").where(differ)
    return joined.select(*[F.coalesce(f"r.{c}", f"d.{c}").alias(c) for c in levels], *[F.col(f"r.{c}").alias(f"actual_{c}") for c in counters], *[F.col(f"d.{c}").alias(f"declared_{c}") for c in counters])


def summary_mismatches(lines: DataFrame, declared: DataFrame, keys: Sequence[str] = ("report_id",)) -> DataFrame:
    """AGG-15. Reports whose declared line and branch totals are not those of their lines."""
    k = list(keys)
    real = lines.groupBy(*k).agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("hits") > 0).alias("b"), F.sum("branches_found").alias("c"), F.sum("branches_hit").alias("d"))
    both = declared.join(real, k, "left")
    bad = F.lit(False)
    for have, want in (("a", "lines_valid"), ("b", "lines_covered"), ("c", "branches_valid"), ("d", "branches_covered")):
        bad = bad | (F.col(want).isNotNull() & (F.coalesce(have, F.lit(0)) != F.col(want)))
    return both.where(bad).select(*k)


def run_summary(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-16. Results, violations, other results and suppressed ones of each run."""
    fail = F.col("kind") == "fail"
    return results.groupBy(*keys, "run").agg(
        F.count(F.lit(1)).alias("results"), F.count_if(fail & ~F.col("suppressed")).alias("violations"), F.count_if(~fail).alias("non_violations"), F.count_if(fail & F.col("suppressed")).alias("suppressed")
    )


def missing_metrics(entities: DataFrame, metrics: DataFrame, facts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-17. Gaps: (entity, metric) pairs without a fact. metrics is the list of wanted metrics, a few rows of rule data."""
    listed = metrics.agg(F.sort_array(F.collect_set("metric")).alias("_metrics"))  # one row
    wanted = entities.select(*keys, "id").distinct().crossJoin(listed).select(*keys, "id", F.explode("_metrics").alias("metric"))
    return wanted.join(facts.select(*keys, "id", "metric").distinct(), [*keys, "id", "metric"], "left_anti")


def pair_completeness(entities: DataFrame, pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-17. Whether unfiltered pair facts number n (n - 1) / 2 and come once each."""
    k = list(keys)
    n = entities.groupBy(*k).agg(F.countDistinct("id").alias("n"))
    p = pairs.groupBy(*k).agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct(F.struct(F.least("left_id", "right_id"), F.greatest("left_id", "right_id"))).alias("different"))
    out = n.join(p, k, "left") if k else n.crossJoin(p)
    want = F.expr("n * (n - 1) div 2")
    return out.select(*k, "n", F.coalesce("pairs", F.lit(0)).alias("pairs"), (want != F.coalesce("pairs", F.lit(0))).alias("incomplete"), F.coalesce(F.col("pairs") != F.col("different"), F.lit(False)).alias("repeated"))


def fingerprint(tool: Column, rule: Column, files: Column, message: Column) -> Column:
    """AGG-42. Identity of an issue over tool, rule, the set of its files and the message; lines play no part."""
    places = F.array_join(F.array_sort(F.array_distinct(files)), "\n")
    framed = [F.concat(F.octet_length(F.coalesce(x, F.lit(""))), F.when(x.isNull(), "-").otherwise(":"), F.coalesce(x, F.lit(""))) for x in (tool, rule, places, message)]
    return F.sha2(F.concat(*framed), 256)


def finding_id(rule: Column, file: Column, identity: Column) -> Column:
    """The rule and the first 16 digits of the digest of rule, file and identity, parted by zero bytes."""
    return F.concat(rule, F.lit(":"), F.substring(F.sha2(F.concat_ws("\0", rule, F.coalesce(file, F.lit("")), identity), 256), 1, 16))


def counterexamples(current: DataFrame, baseline: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """JOIN-16, AGG-39. Test cases (keys, file, name, outcome) of both versions -> (executed and counterexamples by file: cases
    that pass now and fail on the baseline, gaps: cases of one side only)."""
    by = [*keys, "file", "name"]
    pair = current.select(*by, F.col("outcome").alias("now")).join(baseline.select(*by, F.col("outcome").alias("was")), by, "full")
    proof = pair.where("now is not null and was is not null").groupBy(*keys, "file").agg(
        F.count(F.lit(1)).alias("executed"), F.count_if((F.col("now") == "passed") & (F.col("was") == "failure")).alias("counterexamples")
    )
    return proof, pair.where("now is null or was is null").select(*by)


def test_inventory_gaps(cases: DataFrame, files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-40. Gaps: doubled identities, errors, skipped cases, and files without a case. Cases are dealt by identity once and
    finely, as nearly each is a group of its own: a task holds its groups in memory."""
    by = [*keys, "file", "name"]
    dealt = cases.select(*by, "outcome").repartition(FINE * partitions(cases.sparkSession), *by)
    one = dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.bool_or(F.col("outcome") == x).alias(x) for x in ("error", "skipped")])
    found = F.array(F.when(F.col("n") > 1, "duplicate"), *[F.when(F.col(x), x) for x in ("error", "skipped")])
    stated = one.select(*by, F.explode(F.filter(found, lambda g: g.isNotNull())).alias("gap"))
    bare = files.select(*keys, "file").distinct().join(cases.select(*keys, "file").distinct(), [*keys, "file"], "left_anti").select(*keys, "file", F.lit(None).cast("string").alias("name"), F.lit("uncovered").alias("gap"))
    return stated.unionByName(bare)


def clause_totals(clauses: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-41. Clauses by status, all and required ones, and whether all required ones hold."""
    s, must = F.col("status"), F.col("required")
    out = [F.count_if(s == x).alias(x) for x in ("failed", "verified", "not_applicable", "pending")]
    good = ~must | s.isin("verified", "not_applicable")
    return clauses.groupBy(*keys).agg(*out, F.count_if(must).alias("required"), F.bool_and(good).alias("held"))


def capacity(files: DataFrame, limit: int = 2 << 20, most: int = 8 << 20, keys: Sequence[str] = (), shown: int = 100) -> tuple[DataFrame, DataFrame]:
    """AGG-43. files (keys, path, size) of head and worktree -> (files over the limit, the first `shown` by path; total and
    the recommended limit in MiB, or null above `most`)."""
    from pyspark.sql import Window

    largest = files.groupBy(*keys, "path").agg(F.max("size").alias("size"))
    over = largest.where(F.col("size") > limit)
    rows = over.withColumn("_n", F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("path"))).where(F.col("_n") <= shown).drop("_n")
    mib = F.ceil(F.max("size") / (1 << 20))
    total = largest.groupBy(*keys).agg(F.count_if(F.col("size") > limit).alias("over"), F.when(F.max("size") <= most, mib).alias("recommended_mib"))
    return rows, total
