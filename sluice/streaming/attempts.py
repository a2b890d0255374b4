"""ST-1. The attempt audit on a stream: one state per assignment, the same rows as the batch form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "number int, elapsed long, progress boolean, streak int, stop_after int, deviations string"
STATE = "last int, debt array<string>, known boolean, elapsed long, streak int, stop int"


def audit_stream(attempts: DataFrame, limit: int = 3, max_attempts: int = 10, max_ms: int = 3_600_000) -> DataFrame:
    """attempts (assignment, number, elapsed_ms, debt array<string> or null), streaming. stop_after is the attempt at which
    the streak first reached the limit, as known so far; an attempt that comes after a later one is a gap row."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, debt, known, elapsed, streak, stop = state.get if state.exists else (0, [], False, 0, 0, -1)
        out = []
        rows = pd.concat(list(batches)).sort_values("number")
        for r in rows.itertuples(index=False):
            if r.number <= last:
                out.append((key[0], int(r.number), None, None, None, None, "out_of_order"))
                continue
            last, elapsed = int(r.number), int(elapsed + r.elapsed_ms)
            new = set(r.debt) if isinstance(r.debt, (list, np.ndarray)) else None
            progress = new is not None and known and len(new) < len(debt) and new <= set(debt)
            if new is not None:
                debt, known = list(r.debt), True
            streak = 0 if progress else streak + 1
            late = stop >= 0
            if streak >= limit and stop < 0:
                stop = last
            why = ["continued_after_no_progress"] * late + ["attempt_or_time_budget_exceeded"] * (last > max_attempts or elapsed > max_ms)
            out.append((key[0], last, elapsed, progress, int(streak), stop if stop >= 0 else None, ",".join(why)))
        state.update((last, list(debt), known, int(elapsed), int(streak), stop))
        frame = pd.DataFrame(out, columns=["assignment", *(x.split()[0] for x in OUTPUT.split(", "))])
        yield frame.astype({"number": "Int32", "elapsed": "Int64", "progress": "boolean", "streak": "Int32", "stop_after": "Int32"})

    schema = f"assignment {attempts.schema['assignment'].dataType.simpleString()}, {OUTPUT}"
    return attempts.groupBy("assignment").applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.NoTimeout)
