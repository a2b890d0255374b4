"""Diffs of two versions and one-to-one matching of multisets. `keys` (for example repo, snapshot) lead every table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.tables import keep, numbered


def _same(left: str, right: str, cols: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def snapshot_diff(base: DataFrame, head: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """DIF-1. base, head (keys, path, content, executable?) -> keys, path, kind, old_path.

    A path on both sides is modified if bytes or executable bit differ. A new path whose bytes equal those of a removed
    one is renamed, each removed path once, in path order; what is left is added or deleted."""
    k = list(keys)

    def slim(df: DataFrame, side: str) -> DataFrame:
        flag = F.col("executable") if "executable" in df.columns else F.lit(False)
        return df.select(*k, "path", F.sha2(F.col("content").cast("binary"), 256).alias("bytes"), flag.alias("exec")).alias(side)

    pair = slim(base, "b").join(slim(head, "h"), [*k, "path"], "full").select(
        *k, "path", F.col("b.bytes").alias("was"), F.col("h.bytes").alias("now"),
        (~F.col("b.exec").eqNullSafe(F.col("h.exec"))).alias("mode"),
    )
    both = pair.where("was is not null and now is not null")
    kind = F.when((F.col("was") != F.col("now")) | F.col("mode"), "modified").otherwise("unchanged")
    both = both.select(*k, "path", kind.alias("kind"), F.col("path").alias("old_path"))
    nth = lambda c: F.row_number().over(Window.partitionBy(*k, c).orderBy("path"))
    gone = pair.where("now is null").select(*k, F.col("path").alias("old_path"), F.col("was").alias("bytes"), nth("was").alias("n"))
    new = pair.where("was is null").select(*k, "path", F.col("now").alias("bytes"), nth("now").alias("n"))
    moved = gone.join(new, [*k, "bytes", "n"], "full").select(
        *k, F.coalesce("path", "old_path").alias("path"),
        F.when(F.col("path").isNull(), "deleted").when(F.col("old_path").isNull(), "added").otherwise("renamed").alias("kind"),
        "old_path",
    )
    return both.unionByName(moved)


FEW = 256  #: edits up to which a greedy search looks for the script; beyond, rows of common lengths are made by bits


def _middle(a: list[int], b: list[int]) -> tuple[int, int] | None:
    """A point in the middle of a shortest edit script, met by two greedy searches from both ends, in linear space; None if
    they did not meet within FEW steps."""
    n, m = len(a), len(b)
    delta, most = n - m, min((n + m + 1) // 2, FEW)
    forth, back = {1: 0}, {1: 0}
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            if k < -m or k > n:
                continue
            x = forth[k + 1] if k == -d or (k != d and forth.get(k - 1, -1) < forth.get(k + 1, -1)) else forth.get(k - 1, -1) + 1
            if k != -d and x < forth.get(k - 1, -1) + 1:
                x = forth[k - 1] + 1
            while 0 <= x < n and 0 <= x - k < m and a[x] == b[x - k]:
                x += 1
            forth[k] = x
            if delta % 2 and abs(delta - k) < d and x + back.get(delta - k, -1) >= n:
                return x, x - k
        for k in range(-d, d + 1, 2):
            if k < -m or k > n:
                continue
            x = back[k + 1] if k == -d or (k != d and back.get(k - 1, -1) < back.get(k + 1, -1)) else back.get(k - 1, -1) + 1
            while 0 <= x < n and 0 <= x - k < m and a[n - 1 - x] == b[m - 1 - (x - k)]:
                x += 1
            back[k] = x
            if not delta % 2 and abs(delta - k) <= d and x + forth.get(delta - k, -1) >= n:
                return n - x, m - (x - k)
    return None


def _common(a: list[int], b: list[int]) -> np.ndarray:
    """The length of the longest common subsequence of a and each prefix of b. A row of the usual table differs from place to
    place by 0 or 1, so it is kept as one number of len(b) bits, and a line of a changes all of it by an addition: a zero bit
    is a place where the length grows."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    size, every = (len(b) + 7) // 8, (1 << len(b)) - 1
    row = every
    for x in a:
        if x in places:
            bits = bytearray(size)
            for j in places[x]:
                bits[j >> 3] |= 1 << (j & 7)
            hit = row & int.from_bytes(bits, "little")
            row = ((row + hit) | (row - hit)) & every
    flat = np.unpackbits(np.frombuffer(row.to_bytes(size, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(1 - flat.astype(np.int64)))


def _halves(a: list[int], b: list[int]) -> tuple[int, int]:
    """A point of a shortest edit script in the middle of a: where the common lengths of both halves add up to the most."""
    if len(a) == 1:
        return 0, b.index(a[0]) if a[0] in b else 0
    x = len(a) // 2
    return x, int((_common(a[:x], b) + _common(a[x:][::-1], b[::-1])[::-1]).argmax())


def edits(old: list, new: list) -> tuple[list[int], list[int]]:
    """Places removed from old and added to new by a shortest edit script. What stands on one side only is set aside first."""
    both = set(old) & set(new)
    left, right = [i for i, x in enumerate(old) if x in both], [i for i, x in enumerate(new) if x in both]
    names = {x: i for i, x in enumerate(both)}
    a, b = [names[old[i]] for i in left], [names[new[i]] for i in right]
    gone, fresh, boxes = set(range(len(old))) - set(left), set(range(len(new))) - set(right), [(0, len(a), 0, len(b), False)]
    while boxes:
        i, j, m, n, many = boxes.pop()  # many: the box around it had too many edits to search greedily
        while i < j and m < n and a[i] == b[m]:
            i, m = i + 1, m + 1
        while i < j and m < n and a[j - 1] == b[n - 1]:
            j, n = j - 1, n - 1
        if i == j or m == n:
            gone.update(left[i:j])
            fresh.update(right[m:n])
            continue
        met = None if many and j - i + n - m > 2 * FEW else _middle(a[i:j], b[m:n])
        x, y = met or _halves(a[i:j], b[m:n])
        if (x, y) in ((0, 0), (j - i, n - m)):  # nothing in common
            gone.update(left[i:j])
            fresh.update(right[m:n])
        else:
            boxes += [(i, i + x, m, m + y, met is None), (i + x, j, m + y, n, met is None)]
    return sorted(gone), sorted(fresh)


def line_diff(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """DIF-2. pairs (keys, path, old, new) -> keys, path, op (added, removed), line_no. Files with a NUL byte have none.

    Lines end with \\n, \\r\\n or \\r and are compared with their ends, so a last line that gets an end is another line. The
    script is a shortest one: few edits are found by greedy search from both ends; where there are many, the file is halved
    where the common lengths, a row of them held as the bits of one number, add up to the most. Space is linear and time grows
    with the product of the lengths over the bits of a word: two shuffled files of 100,000 lines take half a minute. Only
    changed files are cut into lines; each is one task's work, as its edits depend on one another."""
    schema = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in [*keys, "path"]) + ", op string, line_no int"
    lead = [*keys, "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ops, numbers = [], [], []
            for i, (old, new) in enumerate(zip(b.column("_old").to_pylist(), b.column("_new").to_pylist(), strict=True)):
                gone, fresh = edits(old or [], new or [])
                rows += [i] * (len(gone) + len(fresh))
                ops += ["removed"] * len(gone) + ["added"] * len(fresh)
                numbers += [x + 1 for x in (*gone, *fresh)]
            taken = [b.column(c).take(pa.array(rows, pa.int64())) for c in lead]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(ops, pa.string()), pa.array(numbers, pa.int32())], [*lead, "op", "line_no"])

    cut = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+"), F.lit(0))
    changed = pairs.where(~F.col("old").eqNullSafe(F.col("new")) & ~F.coalesce(F.col("old").contains("\0"), F.lit(False)) & ~F.coalesce(F.col("new").contains("\0"), F.lit(False)))
    return changed.select(*lead, cut(F.col("old")).alias("_old"), cut(F.col("new")).alias("_new")).mapInArrow(run, schema)


def tree_digest(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """DIF-3. One digest of all files, by path: each file is framed by the lengths of its path and bytes."""
    flag = F.col("executable") if "executable" in files.columns else F.lit(False)
    content = F.col("content").cast("binary")
    frame = F.sha2(F.concat_ws("\n", F.octet_length("path"), "path", flag.cast("int"), F.octet_length(content), F.sha2(content, 256)), 256)
    leaf = files.select(*keys, "path", frame.alias("leaf"))
    # folded by the first three digits of the path's hash, so that no row gathers all files
    part = leaf.groupBy(*keys, F.substring(F.sha2("path", 256), 1, 3).alias("part")).agg(F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("path", "leaf"))), lambda x: x["leaf"])), 256).alias("leaf"), F.count(F.lit(1)).alias("n"))
    top = part.groupBy(*keys).agg(F.sum("n").alias("files"), F.array_sort(F.collect_list(F.struct("part", "leaf"))).alias("all"))
    return top.select(*keys, "files", F.concat(F.lit("sha256:"), F.sha2(F.concat_ws(",", F.transform("all", lambda x: x["leaf"])), 256)).alias("digest"))


def match_entities(base: DataFrame, head: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """DIF-4. base, head (keys, path, language, symbol, ord, body_digest, annotations) -> head rows with kind, base_path,
    base_symbol, ambiguous.

    Three passes, k-th with k-th: by (path, language, symbol); by (language, symbol, body); by (language, body). What a pass
    matches takes no part in the next. No match is added; a match of the later passes is renamed; one of the first is
    modified if body or annotations differ, else unchanged."""
    cols = ["path", "language", "symbol", "ord", "body_digest", "annotations"]
    b, h, found = base.select(*keys, *cols), head.select(*keys, *cols), None
    for number, by in enumerate((["path", "language", "symbol"], ["language", "symbol", "body_digest"], ["language", "body_digest"])):
        group = [*keys, *by]
        order = Window.partitionBy(*group).orderBy("path", "ord", "symbol")
        every = Window.partitionBy(*group)
        left = h.withColumn("_n", F.row_number().over(order)).alias("h")
        right = b.withColumn("_n", F.row_number().over(order)).withColumn("_of", F.count(F.lit(1)).over(every)).alias("b")
        pair = left.join(right, _same("h", "b", [*group, "_n"]))
        same = F.col("h.body_digest").eqNullSafe(F.col("b.body_digest")) & F.col("h.annotations").eqNullSafe(F.col("b.annotations"))
        kind = F.lit("renamed") if number else F.when(same, "unchanged").otherwise("modified")
        pair = pair.select(
            *[F.col(f"h.{c}").alias(c) for c in [*keys, *cols]], kind.alias("kind"), F.col("b.path").alias("base_path"),
            F.col("b.symbol").alias("base_symbol"), F.col("b.ord").alias("base_ord"), (F.col("b._of") > 1).alias("ambiguous"),
        )
        found = pair if found is None else found.unionByName(pair)
        at = [*keys, "path", "symbol", "ord"]
        h = h.join(pair.select(*at), at, "left_anti")
        used = pair.select(*keys, F.col("base_path").alias("path"), F.col("base_symbol").alias("symbol"), F.col("base_ord").alias("ord"))
        b = b.join(used, at, "left_anti")
    new = h.select(
        *keys, *cols, F.lit("added").alias("kind"), F.lit(None).cast("string").alias("base_path"),
        F.lit(None).cast("string").alias("base_symbol"), F.lit(None).cast(base.schema["ord"].dataType).alias("base_ord"), F.lit(False).alias("ambiguous"),
    )
    return found.unionByName(new)


def _beyond(base: DataFrame, head: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The head rows beyond the number of base rows of their group, in order. Rows are numbered, in range parts of all of them,
    only in groups that have some rows that are old and some that are new."""
    slim = [F.col(c).alias(f"_b{i}") for i, c in enumerate(by)]
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)])
    names = [f"_b{i}" for i in range(len(by))]
    was = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_was")).select(*slim, "_was")
    now = head.groupBy(*by).agg(F.count(F.lit(1)).alias("_now"))
    mixed = keep(now.join(was, same).where("_now > _was").select(*names, "_was"), "mixed")
    fresh = head.join(was.select(*names), same, "left_anti")
    some = numbered(head.join(mixed, same).drop(*names), by, order, "_nth").where("_nth > _was").select(*head.columns)
    return fresh.unionByName(some)


def new_texts(base: DataFrame, head: DataFrame, keys: Sequence[str] = (), text: str = "text", order: Sequence[str] = ("ord",)) -> DataFrame:
    """DIF-5, SET-7. The head rows beyond the number of equal texts in base; the first ones in order count as old."""
    return _beyond(base, head, [*keys, text], list(order))


def new_issues(base: DataFrame, head: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """DIF-6. base, head (keys, fingerprint, ord, retained in head) -> head rows that no baseline occurrence covers.
    Retained historical issues use up the credits of a fingerprint first."""
    first = head.withColumn("_late", F.when(F.col("retained"), 0).otherwise(1))
    return _beyond(base, first, [*keys, "fingerprint"], ["_late", "ord"]).drop("_late")


def inventory_by_reason(rows: DataFrame, keys: Sequence[str] = (), most: int = 64) -> DataFrame:
    """DIF-7, SRT-4. rows (keys, reason, path) -> full count by reason and its first `most` paths, with a flag if cut."""
    by = [*keys, "reason"]
    n = F.row_number().over(Window.partitionBy(*by).orderBy("path"))
    # rows are limited before they are dealt, so that a large group does not meet in one task
    first = rows.withColumn("_n", n).where(F.col("_n") <= most).groupBy(*by).agg(F.array_sort(F.collect_list("path")).alias("shown"))
    paths = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("paths"))
    out = paths.alias("p").join(first.alias("f"), _same("p", "f", by)).select("p.*", "shown")
    return out.withColumn("truncated", F.col("paths") > most)
