"""Ordered folds: audits of attempts and schedules, output budgets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.tables import keep, numbered, partitions, running


def attempt_audit(attempts: DataFrame, keys: Sequence[str] = (), limit: int = 3, max_attempts: int = 10, max_ms: int = 3_600_000) -> DataFrame:
    """WIN-2. attempts (keys, assignment, number, elapsed_ms, debt array<string> or null) -> per attempt: elapsed so far,
    progress (the debt is a proper subset of the last known one), the streak without progress, and deviations: going on after
    the streak reached `limit`, or beyond the budget of attempts or time."""
    by = [*keys, "assignment"]
    w = Window.partitionBy(*by).orderBy("number")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    a = attempts.withColumn("elapsed", F.sum("elapsed_ms").over(so_far)).withColumn("_before", F.last("debt", ignorenulls=True).over(past))
    smaller = (F.size("debt") < F.size("_before")) & (F.size(F.array_except("debt", "_before")) == 0)
    a = a.withColumn("progress", F.coalesce(smaller, F.lit(False)))
    n = F.row_number().over(w)
    a = a.withColumn("_n", n).withColumn("_last", F.max(F.when(F.col("progress"), F.col("_n"))).over(so_far))
    a = a.withColumn("streak", F.col("_n") - F.coalesce("_last", F.lit(0)))
    a = a.withColumn("stop_after", F.min(F.when(F.col("streak") >= limit, F.col("number"))).over(Window.partitionBy(*by)))
    late = F.coalesce(F.col("number") > F.col("stop_after"), F.lit(False))
    over = (F.col("number") > max_attempts) | (F.col("elapsed") > max_ms)
    why = F.concat_ws(",", F.when(late, "continued_after_no_progress"), F.when(over, "attempt_or_time_budget_exceeded"))
    return a.select(*by, "number", "elapsed", "progress", "streak", "stop_after", why.alias("deviations"))


def attempt_results(attempts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """WIN-3. attempts (keys, assignment, number, accepted or null) -> first, last and any; a gap makes what it may touch
    unknown."""
    got = attempts.groupBy(*keys, "assignment").agg(
        F.count(F.lit(1)).alias("attempts"), F.min_by("accepted", "number").alias("first"), F.max_by("accepted", "number").alias("last"),
        F.bool_or("accepted").alias("_any"), F.count_if(F.col("accepted").isNull()).alias("_u"),
    )
    return got.select(*keys, "assignment", "attempts", "first", "last", F.when(F.col("_any"), True).when(F.col("_u") > 0, F.lit(None)).otherwise(False).alias("any"))


def schedule_audit(plan: DataFrame, observed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """WIN-4. plan (keys, run_order array<string>), observed (keys, assignment, sequence) -> planned place, observed place and
    state: matched, moved or missing."""
    want = plan.select(*keys, F.posexplode("run_order").alias("place", "assignment")).withColumn("place", F.col("place") + 1)
    out = want.join(observed.select(*keys, "assignment", "sequence"), [*keys, "assignment"], "left")
    state = F.when(F.col("sequence").isNull(), "missing").when(F.col("sequence") == F.col("place"), "matched").otherwise("moved")
    return out.withColumn("state", state)


def execution_order(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """WIN-5. Runs that do not start later than the run before them in sequence."""
    before = F.lag("started_at").over(Window.partitionBy(*keys).orderBy("sequence"))
    return runs.withColumn("_before", before).where(F.col("started_at") <= F.col("_before")).drop("_before")


def output_budget(rows: DataFrame, size: Column, keys: Sequence[str], order: Sequence[str], records: int = 10_000, total: int = 8 << 20) -> DataFrame:
    """WIN-6. The longest prefix within both limits, each record one byte more than its text; `complete` says if it is all.
    Sizes are not negative; a null size, and all that follows it, does not fit. Places and sizes are added up in range parts,
    so that a large section is spread over tasks."""
    named = rows.withColumn("__b", size.cast("long") + 1)
    by = [F.col(c) for c in [*keys, *order]]
    dealt = named.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    placed = keep(dealt.withColumn("__piece", F.shiftright("__at", 33)), "output")
    unknown = F.when(F.col("__b").isNull(), total + 1).otherwise(F.col("__b"))
    placed = running(running(placed, list(keys), "__piece", ["__at"], F.lit(1), "__n"), list(keys), "__piece", ["__at"], unknown, "__used")
    fits = F.coalesce((F.col("__n") < records) & (F.col("__used") + F.col("__b") <= total), F.lit(False))
    placed = keep(placed.withColumn("__fits", fits), "fitted")
    whole = placed.groupBy(*keys).agg(F.min("__fits").alias("complete")).select(*_named(keys), "complete")
    out = placed.where("__fits").join(whole, _same(keys)).select(*rows.columns, "complete")
    return out


def _same(keys: Sequence[str]) -> Column:
    """Null-safe equality with what _named renamed."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))


def _named(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]


def _fitting(rows: DataFrame, size: str, keys: Sequence[str], order: Sequence[str], budget: int) -> tuple[DataFrame, DataFrame]:
    """(items that fit: keys, __n, __s; all items). With between 2^k and 2^(k+1) - 1 left, every item below 2^k fits as long as
    2^k are left, and at most one larger one does, as less is left after it. So a round takes, in each section, the small items
    in order up to the first place where less than 2^k are left or a larger item fits: running sums made in pieces and a least
    place. After it a bit of what was left is gone for good, so there are no more rounds than the budget has bits."""
    slim = rows.select(*keys, *[c for c in order if c not in keys], F.col(size).cast("long").alias("__s"))
    dealt = slim.repartitionByRange(partitions(rows.sparkSession), *keys, *order).withColumn("_piece", F.spark_partition_id())
    items = running(keep(dealt, "items"), list(keys), "_piece", list(order), F.lit(1), "__n").select(*keys, "_piece", (F.col("__n") + 1).alias("__n"), "__s")
    items = keep(items, "numbered")
    state = keep(items.groupBy(*keys).agg(F.lit(budget).cast("long").alias("_left"), F.lit(0).cast("long").alias("_at")), "sections")
    live, taken = items, items.limit(0)
    while True:
        live = live.join(state.select(*_named(keys), "_left", "_at"), _same(keys)).where("__n > _at and __s <= _left").select(*items.columns, "_left")
        bit = F.expr("shiftleft(1L, length(bin(greatest(_left, 1L))) - 1)")
        live = live.withColumn("_small", F.col("__s") < bit).withColumn("_bit", bit)
        live = keep(running(live, list(keys), "_piece", ["__n"], F.when(F.col("_small"), F.col("__s")).otherwise(0), "_before"), "live")
        if live.isEmpty():
            break
        left = F.col("_left") - F.col("_before")
        ends = F.when(F.col("_small"), (F.col("_left") > 0) & (left - F.col("__s") < F.col("_bit"))).otherwise(F.col("__s") <= left)
        stop = live.groupBy(*keys).agg(F.min(F.when(ends, F.col("__n"))).alias("_stop")).select(*_named(keys), "_stop")
        fits = live.join(stop, _same(keys)).where("__n = _stop or _small and (_stop is null or __n < _stop)")
        fits = keep(fits.select(*keys, "__n", "__s", "_left", "_stop"), "fits")
        taken = taken.select(*keys, "__n", "__s").unionByName(fits.select(*keys, "__n", "__s"))
        state = fits.where("_stop is not null").groupBy(*keys).agg((F.first("_left") - F.sum("__s")).alias("_left"), F.max("_stop").alias("_at"))
        live = live.select(*items.columns)
    return taken.select(*keys, "__n", "__s"), items


def greedy_fit(rows: DataFrame, size: str, keys: Sequence[str], order: Sequence[str], budget: int) -> DataFrame:
    """WIN-7. In order, each item that still fits is kept; a large one is skipped and later smaller ones may fit. keys, used,
    kept, places (from 1, joined by commas). Sizes are not negative; a null size never fits. Takes as many rounds as the budget
    has bits at most, however many items there are; a section is spread over tasks."""
    taken, items = _fitting(rows, size, keys, order, budget)
    kept = taken.groupBy(*keys).agg(F.sum("__s").alias("used"), F.sort_array(F.collect_list("__n")).alias("_kept")).select(*_named(keys), "used", "_kept")
    places = F.coalesce(F.array_join(F.transform("_kept", lambda x: x.cast("string")), ","), F.lit(""))
    return items.select(*keys).distinct().join(kept, _same(keys), "left").select(
        *keys, F.coalesce("used", F.lit(0)).cast("long").alias("used"), F.coalesce(F.size("_kept"), F.lit(0)).alias("kept"), places.alias("places")
    )


def shared_fit(rows: DataFrame, size: str, keys: Sequence[str], section: str, order: Sequence[str], budget: int, sections: Sequence[str], cut: str | None = None) -> DataFrame:
    """WIN-7. One budget in equal shares for the named sections, so that no section's items hide another's: keys, section, total,
    kept, omitted, used, truncated. A section without items has a row too. truncated tells, for all sections of the keys alike,
    whether any item was left out or the text of a kept one was shortened (`cut`, a boolean column). Items of other sections
    count nowhere; a null `cut` counts as not shortened."""
    mine = rows.where(F.col(section).isin(list(sections)))
    by = [*keys, section]
    taken, _ = _fitting(mine, size, by, order, budget // len(sections))
    flag = F.coalesce(F.col(cut), F.lit(False)) if cut else F.lit(False)
    used = taken.groupBy(*by).agg(F.count(F.lit(1)).alias("kept"), F.sum("__s").alias("used")).select(*_named(by), "kept", "used")
    total = mine.groupBy(*by).agg(F.count(F.lit(1)).alias("total")).select(*_named(by), "total")
    all_sections = rows.select(*keys).distinct().select(*keys, F.explode(F.array(*map(F.lit, sections))).alias(section))
    out = all_sections.join(total, _same(by), "left").drop(*[f"_k{i}" for i in range(len(by))]).join(used, _same(by), "left").drop(*[f"_k{i}" for i in range(len(by))])
    for c in ("total", "kept", "used"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)).cast("long"))
    out = out.withColumn("omitted", F.col("total") - F.col("kept"))
    if cut:  # which items were kept is known by their places in order
        placed = numbered(mine.withColumn("_cut", flag).select(*by, *[c for c in order if c not in by], "_cut"), by, list(order), "_place")
        shortened = placed.where("_cut").select(*_named(by), F.col("_place")).join(taken, _same(by) & (F.col("_place") == F.col("__n")))
        shortened = shortened.select(*keys).distinct().withColumn("_shortened", F.lit(True)).select(*_named(keys), "_shortened")
    else:
        shortened = None
    whole = out.groupBy(*keys).agg((F.sum("omitted") > 0).alias("_omits")).select(*_named(keys), "_omits")
    names = [f"_k{i}" for i in range(len(keys))]
    out = out.join(whole, _same(keys)).drop(*names)
    if shortened is not None:
        out = out.join(shortened, _same(keys), "left").drop(*names).withColumn("_omits", F.col("_omits") | F.coalesce("_shortened", F.lit(False)))
    return out.select(*keys, section, "total", "kept", "omitted", "used", F.col("_omits").alias("truncated"))


def first_observations(rows: DataFrame, keys: Sequence[str], order: Sequence[str], most: int = 64) -> DataFrame:
    """WIN-9. The first `most` rows of each group, with the number of all. Rows are counted and limited before they are dealt,
    so that a large group does not meet in one task."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n").alias("r")
    of = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("observed")).alias("g")
    same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys], F.lit(True))
    return first.join(of, same).select("r.*", "observed")


def newest_page(rows: DataFrame, order: Sequence[str], offset: int, size: int) -> DataFrame:
    """SRT-2. A page of at most 256 rows, newest first."""
    return rows.orderBy(*[F.col(c).desc() for c in order]).offset(offset).limit(max(1, min(size, 256)))
