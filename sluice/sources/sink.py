"""SNK-1. The report sink: checks, findings and gates as tables by repository and snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def write_report(tables: dict[str, DataFrame], path: str, keys: Sequence[str] = ("repo", "snapshot"), mode: str = "overwrite") -> None:
    """Each table under path/name, partitioned by keys; rows of a partition are dealt over several files by their content."""
    for name, df in tables.items():
        by = [k for k in keys if k in df.columns]
        df.write.mode(mode).partitionBy(*by).parquet(f"{path}/{name}")


def as_json(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One JSON text per row, keys apart."""
    return df.select(*keys, F.to_json(F.struct(*[c for c in df.columns if c not in keys])).alias("json"))
