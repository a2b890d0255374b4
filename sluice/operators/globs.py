"""JOIN-7. Globs as a table: however many there are, paths meet them by equality and are then tested by the whole glob."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluice.functions.text import glob_regex

WILD = frozenset("*?[{")


def parts(glob: str) -> tuple[str, str]:
    """What a path must have to fit a glob, as (kind, text): its last segment (last), its first segments (under), how its last
    segment ends (end), or nothing that can be looked up (any). Of braces that hold slashes only what stands before them can."""
    for begin, end in ("{}", "[]"):
        at = glob.find(begin)
        if at >= 0 and "/" in glob[at : glob.rfind(end) + 1]:  # the directories before them still hold
            directory = glob[:at].rpartition("/")[0]
            if not directory:
                return "any", ""
            glob = f"{directory}/**/*"
    segments = glob.split("/")
    plain = [not WILD & set(s) for s in segments]
    if plain[-1] and segments[-1]:
        return "last", segments[-1]
    first = next((i for i, p in enumerate(plain) if not p), len(plain))
    if first:
        return "under", "/".join(segments[:first])
    tail = segments[-1]
    for i in range(len(tail) - 1, -1, -1):
        if tail[i] in WILD or tail[i] in "]},":
            tail = tail[i + 1 :]
            break
    if "." in tail and not any(c in segments[-1] for c in "{["):
        return "end", tail[tail.rindex(".") :]
    return "any", ""


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        globs = b.column("glob").to_pylist()
        kinds = [parts(g) for g in globs]
        cols = [pa.array([glob_regex(g) for g in globs], pa.string()), pa.array([k for k, _ in kinds], pa.string()), pa.array([t for _, t in kinds], pa.string())]
        yield pa.RecordBatch.from_arrays([b.column("glob"), *cols], ["glob", "regex", "kind", "text"])


def glob_matches(paths: DataFrame, globs: DataFrame, keys: Sequence[str] = (), path: str = "path", glob: str = "glob") -> DataFrame:
    """paths (keys, path), globs (keys, glob, ..) -> keys, path and the columns of globs, a row for each glob that a path fits.

    Each distinct glob is read once, where it is; a path brings its last segment, that segment's ending, and its leading
    directories, as many rows as it is deep and two. Globs that begin and end in wildcards (**/*, *a*/b*) meet every path. Null
    paths and globs fit nothing; repeated rows give a row each; empty tables give an empty table."""
    out = paths.select(*keys, path).join(_fits(paths, globs, path, glob), F.col(path) == F.col("_path"))
    return _with_globs(out, globs, keys, glob).select(*keys, path, *[c for c in globs.columns if c not in keys])


def glob_counts(paths: DataFrame, globs: DataFrame, keys: Sequence[str] = (), path: str = "path", glob: str = "glob", name: str = "paths") -> DataFrame:
    """The rows of globs that a path fits, each with how many rows of paths do: as counting the rows of glob_matches, but
    counted by distinct glob before the rows that repeat it are met, so that a glob of many rows is not paired with its paths."""
    fits = _fits(paths, globs, path, glob)
    n = paths.select(*keys, path).join(fits, F.col(path) == F.col("_path")).groupBy(*keys, "_glob").agg(F.count(F.lit(1)).alias("_n"))
    return _with_globs(n, globs, keys, glob).select(*keys, *[c for c in globs.columns if c not in keys], F.col("_n").alias(name))


def _fits(paths: DataFrame, globs: DataFrame, path: str, glob: str) -> DataFrame:
    """(_path, _glob), each path with each glob that it fits, both distinct and whatever their keys."""
    read = globs.where(F.col(glob).isNotNull()).select(F.col(glob).cast("string").alias("glob")).distinct().mapInArrow(_looked_up, "glob string, regex string, kind string, text string")
    segments = F.split("_path", "/", -1)
    last = F.element_at(segments, -1)
    pair = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    under = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: pair("under", F.array_join(F.slice(segments, 1, i), "/")))
    ends = F.filter(F.array(pair("last", last), pair("end", F.regexp_extract(last, r"(\.[^.]*)$", 1)), pair("any", F.lit(""))), lambda p: (p["kind"] != "end") | (p["text"] != ""))
    named = paths.where(F.col(path).isNotNull()).select(F.col(path).alias("_path")).distinct()
    looked = named.select("_path", F.explode(F.concat(under, ends)).alias("_p")).select("_path", "_p.kind", "_p.text")
    return looked.join(read, ["kind", "text"]).where(F.rlike("_path", F.col("regex"))).select("_path", F.col("glob").alias("_glob")).distinct()


def _with_globs(rows: DataFrame, globs: DataFrame, keys: Sequence[str], glob: str) -> DataFrame:
    """rows (keys, _glob, ..) with the rows of globs of the same keys and glob."""
    wanted = globs.where(F.col(glob).isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in globs.columns if c not in keys])
    return rows.join(wanted, (F.col("_glob") == F.col(glob)) & _same(keys) if keys else F.col("_glob") == F.col(glob))


def _same(keys: Sequence[str]):
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return out
