"""Statistics around gates. What is unknown stays unknown: a rate with unknown cases has no value."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.tables import keep, partitions, running


def rate(n: Column, d: Column, unknown: Column) -> Column:
    """AGG-18."""
    return F.when((d > 0) & (unknown == 0), n / d)


def distribution(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-19. Samples, unknown, median (mean of the middle two) and nearest-rank p95; null with any unknown.

    Exact and without a buffer of a group: equal values are counted first, the counts are added up in order in range parts,
    and the values are taken whose running counts span the wanted ranks."""
    k = [f"_k{i}" for i in range(len(keys))]
    same = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(keys, k, strict=True)], F.lit(True))
    named = [F.col(a).alias(b) for a, b in zip(keys, k, strict=True)]
    totals = rows.groupBy(*keys).agg(F.count(value).alias("samples"), F.count_if(F.col(value).isNull()).alias("unknown"))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    dealt = counts.repartitionByRange(partitions(rows.sparkSession), *keys, "_v").withColumn("_piece", F.spark_partition_id())
    spans = running(keep(dealt, "value-counts"), list(keys), "_piece", ["_v"], F.col("_c"), "_before")
    whole = keep(totals, "totals")
    spans = spans.join(whole.where("unknown = 0").select(*named, F.col("samples").alias("_of")), same)
    holds = lambda rank: (F.col("_before") < rank) & (rank <= F.col("_before") + F.col("_c"))
    at = {"_low": F.expr("(_of + 1) div 2"), "_high": F.expr("_of div 2 + 1"), "p95": F.expr("(95 * _of + 99) div 100")}
    found = spans.groupBy(*keys).agg(*[F.min(F.when(holds(rank), F.col("_v"))).alias(name) for name, rank in at.items()])
    found = found.select(*named, ((F.col("_low").cast("double") + F.col("_high")) / 2).alias("median"), "p95")
    return whole.join(found, same, "left").select(*keys, "samples", "unknown", "median", "p95")


def success(rows: DataFrame, flag: str, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-20. Share of true among true, false and unknown."""
    c = F.col(flag)
    out = rows.groupBy(*keys).agg(F.count_if(c).alias("numerator"), F.count(F.lit(1)).alias("denominator"), F.count_if(c.isNull()).alias("unknown"))
    return out.withColumn("value", rate(F.col("numerator"), F.col("denominator"), F.col("unknown")))


def usage(attempts: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-21. Known sum, attempts without a value, and the total if there are none."""
    out = attempts.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0)).alias("known"), F.count_if(F.col(value).isNull()).alias("unknown"))
    return out.withColumn("total", F.when(F.col("unknown") == 0, F.col("known")))


def cost(attempts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-22. Micros in one currency at one price date, else no total; and per accepted task."""
    one = (F.countDistinct("currency") == 1) & (F.countDistinct("priced_at") == 1) & (F.count_if(F.col("micros").isNull()) == 0)
    out = attempts.groupBy(*keys).agg(
        F.countDistinct("currency").alias("currencies"), F.countDistinct("priced_at").alias("price_dates"),
        F.when(one, F.sum("micros")).alias("total"), F.count_if("accepted").alias("accepted"),
    )
    return out.withColumn("per_accepted", F.try_divide("total", "accepted"))


def cohorts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """AGG-23. rows (by, seeded, detected, false_positive, findings, reviewed, eligible_repair, repaired, completed) ->
    rates by cohort."""
    t = lambda c: F.count_if(F.col(c))
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("seeded") & F.col("detected")).alias("detected"), t("seeded").alias("seeded"),
        F.count_if(F.col("seeded") & F.col("detected").isNull()).alias("seeded_unknown"), F.count_if(~F.col("seeded") & F.col("false_positive")).alias("false_positives"),
        F.count_if(~F.col("seeded")).alias("clean"), F.count_if(F.col("eligible_repair") & F.col("repaired")).alias("repaired"), t("eligible_repair").alias("eligible"),
        F.count_if(F.col("completed")).alias("completed"), F.count_if(F.col("completed").isNull()).alias("completed_unknown"),
        F.sum("findings").alias("findings"), F.sum("reviewed").alias("reviewed"),
    )
    zero = F.lit(0)
    return out.select(
        *by, "tasks", rate(F.col("detected"), F.col("seeded"), F.col("seeded_unknown")).alias("detection"), rate(F.col("false_positives"), F.col("clean"), zero).alias("false_positive"),
        rate(F.col("repaired"), F.col("eligible"), zero).alias("repair"), rate(F.col("completed"), F.col("tasks"), F.col("completed_unknown")).alias("completion"),
        rate(F.col("reviewed"), F.col("findings"), zero).alias("review"),
    )


def distinct_findings(findings: DataFrame, key: Sequence[str], value: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """AGG-24. (one row per key, gaps: keys whose copies differ)."""
    n = F.countDistinct(F.struct(*[F.coalesce(F.col(v).cast("string"), F.lit("\0")) for v in value]))
    out = findings.groupBy(*key).agg(n.alias("versions"), *[F.min(v).alias(v) for v in value])
    return out.where("versions = 1").drop("versions"), out.where("versions > 1").select(*key, "versions")


def attributions(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-25. Counts by attribution; none is unclassified."""
    return rows.groupBy(*keys, F.coalesce("attribution", F.lit("unclassified")).alias("attribution")).agg(F.count(F.lit(1)).alias("n"))


def stability(runs: DataFrame, keys: Sequence[str] = (), item: str = "input_id") -> DataFrame:
    """AGG-26. Inputs run more than once, and those of them with every run accepted."""
    per = runs.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("n"), F.bool_and("accepted").alias("all"), F.count_if(F.col("accepted").isNull()).alias("u")).where("n > 1")
    out = per.groupBy(*keys).agg(F.count_if(F.col("all") & (F.col("u") == 0)).alias("numerator"), F.count(F.lit(1)).alias("denominator"), F.count_if(F.col("u") > 0).alias("unknown"))
    return out.withColumn("value", rate(F.col("numerator"), F.col("denominator"), F.col("unknown")))


def compare_cohorts(rows: DataFrame, key: Sequence[str], workflow: str, base: str, item: str = "input_id") -> DataFrame:
    """JOIN-15, AGG-27. rows (key, workflow, item, median, p95, cost) summed per cohort elsewhere -> ratios to the cohort of
    workflow `base`, only where both have the same multiset of items (`inventory`)."""
    b = rows.where(F.col(workflow) == base).select(*key, *[F.col(c).alias(f"b_{c}") for c in ("inventory", "median", "p95", "cost", "review")])
    pair = rows.where(F.col(workflow) != base).join(b, list(key)).withColumn("comparable", F.col("inventory") == F.col("b_inventory"))
    r = lambda c: F.when(F.col("comparable"), F.try_divide(F.col(c), F.col(f"b_{c}")))
    return pair.select(*key, workflow, "comparable", r("median").alias("median_ratio"), r("p95").alias("p95_ratio"), r("cost").alias("cost_ratio"), (1 - r("review")).alias("review_reduction"))


def inventory(rows: DataFrame, keys: Sequence[str], item: str = "input_id") -> DataFrame:
    """A digest of each group's multiset of items, by way of counts, so that no row gathers the items themselves."""
    counts = rows.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("n"))
    code = F.xxhash64(F.col(item), F.col("n"))
    return counts.groupBy(*keys).agg(F.concat_ws(":", F.count(F.lit(1)), F.sum(code.cast("decimal(38,0)")), F.bit_xor(code)).alias("inventory"))


def assess(rates: DataFrame, limits: Sequence[tuple[str, str, float]], keys: Sequence[str] = ()) -> DataFrame:
    """AGG-28. Pools rates (keys, name, numerator, denominator, unknown) over groups and holds them against limits (name, ">="
    or "<=", value): met, not_met or unknown, and over all with not_met before unknown before met."""
    pooled = rates.groupBy(*keys, "name").agg(F.sum("numerator").alias("n"), F.sum("denominator").alias("d"), F.sum("unknown").alias("u"))
    state = F.lit(None).cast("string")
    for name, sign, value in limits:
        good = (F.col("n") / F.col("d") >= value) if sign == ">=" else (F.col("n") / F.col("d") <= value)
        state = F.when(F.col("name") == name, F.when((F.col("d") == 0) | (F.col("u") > 0), "unknown").when(good, "met").otherwise("not_met")).otherwise(state)
    return pooled.withColumn("state", state).where("state is not null").drop("u")


def overall(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    s = F.col("state")
    return states.groupBy(*keys).agg(F.when(F.bool_or(s == "not_met"), "not_met").when(F.bool_or(s == "unknown"), "unknown").otherwise("met").alias("state"))


def budget(rows: DataFrame, limit_micros: int, hourly_micros: int, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-29. Model and infrastructure micros and the human cost, ceil(ms * hourly / 3,600,000), against a limit."""
    human = F.ceil(F.sum("human_ms").cast("decimal(20,0)") * hourly_micros / 3_600_000).cast("long")
    unknown = F.count_if(F.col("micros").isNull() | F.col("human_ms").isNull())
    out = rows.groupBy(*keys).agg(F.sum("micros").alias("machine"), human.alias("human"), unknown.alias("unknown"))
    total = F.when(F.col("unknown") == 0, F.col("machine") + F.col("human"))
    return out.withColumn("total", total).withColumn("state", F.when(F.col("total").isNull(), "unknown").when(F.col("total") <= limit_micros, "met").otherwise("not_met"))


def effectiveness(cases: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-30. cases (keys, id, base_complete, base_mismatches, cand_complete, cand_mismatches) -> measures per side, complete
    pairs and the oracle improvement (null while a case is incomplete)."""
    whole = F.col("base_complete") & F.col("cand_complete")
    return cases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(whole).alias("complete_pairs"), F.sum("base_mismatches").alias("base_mismatches"), F.sum("cand_mismatches").alias("cand_mismatches"),
        F.when(F.bool_and(whole), F.sum(F.col("base_mismatches") - F.col("cand_mismatches"))).alias("improvement"),
    )


def paired_decision(cases: DataFrame, minimum: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-31. incomplete without all three kinds or with an incomplete case; block if a case got worse or too few got better;
    else pass."""
    whole = F.col("base_complete") & F.col("cand_complete")
    kinds = F.bool_or(F.col("kind") == "replay") & F.bool_or(F.col("kind") == "held_out") & F.bool_or(F.col("kind") == "anchor")
    out = cases.groupBy(*keys).agg(
        (kinds & F.bool_and(whole)).alias("_whole"), F.count_if(F.col("cand_mismatches") < F.col("base_mismatches")).alias("improved"), F.count_if(F.col("cand_mismatches") > F.col("base_mismatches")).alias("worse")
    )
    d = F.when(~F.col("_whole"), "incomplete").when((F.col("worse") > 0) | (F.col("improved") < minimum), "block").otherwise("pass")
    return out.select(*keys, d.alias("decision"), "improved", "worse")


def history(reports: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """AGG-32. Reports grouped by the digest of their matched inputs, with first and last time."""
    d = F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in inputs]), 256)
    return reports.groupBy(d.alias("inputs")).agg(F.count(F.lit(1)).alias("reports"), F.min("at").alias("first"), F.max("at").alias("last"))


def proper_scores(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-33, AGG-37. rows (keys, probability, label) -> Brier score and log loss, probabilities kept off 0 and 1 by 1e-12."""
    y = F.col("label").cast("int")
    p = F.least(F.greatest(F.col("probability"), F.lit(1e-12)), F.lit(1 - 1e-12))
    loss = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.pow(F.col("probability") - y, 2)), 6).alias("brier"), F.round(F.avg(loss), 6).alias("log_loss"))


def reliability(rows: DataFrame, bins: int = 5) -> DataFrame:
    """AGG-34. Count, mean probability and mean label in equal bins; empty bins stay."""
    b = F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).cast("int")
    have = rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("probability"), 6).alias("mean_probability"), F.round(F.avg(F.col("label").cast("int")), 6).alias("mean_label"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(have, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_probability", "mean_label")


def risk_coverage(rows: DataFrame, shares: Sequence[float] = (0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """AGG-35. Error share among the most confident ceil(share * n), ties by decision_id. Confidences are counted first and
    places given to groups of equal (confidence, id prefix), so that no single task ranks all rows."""
    conf = F.greatest(F.col("probability"), 1 - F.col("probability"))
    wrong = ((F.col("probability") >= 0.5) != F.col("label")).cast("int")
    r = rows.select(conf.alias("c"), "decision_id", wrong.alias("wrong")).withColumn("part", F.floor(F.col("c") * 512).cast("int"))
    sizes = r.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # 513 rows at most
    before = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("c").desc(), "decision_id"))
    ranked = r.withColumn("at", place).join(F.broadcast(first), "part").withColumn("place", F.col("at") + F.col("first"))
    cuts = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    kept = ranked.withColumn("share", cuts).where(F.col("place") <= F.ceil(F.col("share") * F.col("all")))
    return kept.groupBy("share").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("wrong"), 6).alias("risk"))


def near_threshold_error(rows: DataFrame, within: float = 0.1, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-36. Mean |p - label| of rows within 0.1 of their threshold."""
    near = rows.where(F.abs(F.col("probability") - F.col("threshold")) <= within)
    return near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("probability") - F.col("label").cast("int"))), 6).alias("error"))


def calibration_status(records: DataFrame, now: int, least: int = 30) -> DataFrame:
    """AGG-38. revoked, stale, insufficient, out_of_domain or valid, in this order."""
    s = (
        F.when(F.col("revoked"), "revoked").when(F.col("expires") <= now, "stale").when(F.col("samples") < least, "insufficient")
        .when(~F.col("in_domain"), "out_of_domain").otherwise("valid")
    )
    return records.withColumn("status", s)


def audit_sample(rows: DataFrame, seed: str, fraction: float, item: str = "decision_id") -> DataFrame:
    """SRT-3. The max(1, ceil(n * fraction)) rows of least SHA-256 of `seed:id`. Only rows whose hash begins low enough to
    matter are ranked: places are given within groups of equal first hash digits."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(item).cast("string")), 256)
    r = rows.withColumn("_h", h).withColumn("_part", F.substring("_h", 1, 3))
    sizes = r.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # 4,096 rows at most
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(every).alias("_all"))
    out = r.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy("_h", item))).join(F.broadcast(first), "_part")
    return out.where(F.col("_first") + F.col("_at") <= F.greatest(F.lit(1), F.ceil(F.col("_all") * fraction))).select(*rows.columns)
