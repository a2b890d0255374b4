"""Set operations on inventories."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def chain(*frames: DataFrame) -> DataFrame:
    """SET-1. All rows of all frames; columns meet by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def difference(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """SET-2. Distinct expected rows that were not observed."""
    return expected.subtract(observed.select(*expected.columns))


def subset(left: DataFrame, right: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """SET-3. One row, or one for each of left's keys: how many distinct left rows lack in right, and whether none does. Nulls
    are equal."""
    mine, theirs = left.distinct().alias("a"), right.select(*left.columns).distinct().withColumn("_there", F.lit(True)).alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in left.columns])
    lacks = F.count_if(F.col("_there").isNull())
    rows = mine.join(theirs, same, "left").select(*[F.col(f"a.{k}") for k in keys], "_there")
    return rows.groupBy(*keys).agg(lacks.alias("lacking"), (lacks == 0).alias("subset"))


def equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """SET-4. One row: rows of one side only, and whether there are none."""
    a, b = left.distinct().withColumn("_a", F.lit(1)), right.select(*left.columns).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, left.columns, "full")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("left_only"), F.count_if(F.col("_a").isNull()).alias("right_only")).withColumn("equal", (F.col("left_only") + F.col("right_only")) == 0)


def disjoint(a: Column, b: Column) -> Column:
    """SET-5. Whether two arrays share nothing."""
    return ~F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def first_occurrences(rows: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """SET-6. One row per distinct value, its first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, value).orderBy(*order))).where("_n = 1").drop("_n")
