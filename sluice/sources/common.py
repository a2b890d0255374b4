"""Shared shapes of the report readers.

Every reader takes raw reports (report_id, content) and returns (facts, gaps). Gaps hold report_id and a reason; a report
with a gap gives no facts, so that missing evidence is never counted as clean: another root, a field that must be there and
is not, and a condition that cannot be judged are gaps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

_ROOT = r"\A\x{FEFF}?(?:\s++|<\?(?s:.*?)\?>|<!--(?s:.*?)-->|<!DOCTYPE[^>\[]*(?:\[[^\]]*\]\s*)?>)*+<(?:[\w.-]+:)?([\w.-]+)"
_NO_MARKUP = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>"


def parsed_xml(raw: DataFrame, roots: str, schema: str) -> DataFrame:
    """report_id, r, ok, root: r holds the root element's attributes (_name) and children; ok is false for malformed text,
    and `root` true if the root element is one of `roots`."""
    r = F.from_xml("content", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    out = once(raw, "r", r).withColumn("root", F.regexp_extract("content", _ROOT, 1).isin(roots.split()))
    return out.withColumn("ok", F.col("r").isNotNull() & F.col("r._corrupt").isNull())


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row however often it is used: a generator's output, unlike a projected column, is
    not put in place of its uses when filters and projections are moved."""
    made = f"_{name}_once"
    return rows.select("*", F.explode(F.array(F.struct(value.alias("it")))).alias(made)).withColumn(name, F.col(f"{made}.it")).drop(made)


def _bare(text: Column) -> Column:
    """How many brackets, commas, colons and values a JSON text has, strings being one value each."""
    strings = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", "e"), '"[^"]*"', "v")
    return F.length(F.regexp_replace(F.regexp_replace(strings, r'[^\s\[\]{}:,"]+', "v"), r"\s+", ""))


def whole_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else, and no object in it has a key twice. A parser stops at the end of the
    first value; what follows shows in that the text has more parts than the value written anew. Values beyond 128 MiB, and
    ones nested deeper than the parser goes, are not told from broken ones."""
    value = F.try_parse_json(text)
    return F.coalesce(_bare(F.to_json(value)) == _bare(text), F.lit(False))


def parsed_json(raw: DataFrame, schema: str) -> DataFrame:
    """As parsed_xml; the text must be one value from its first to its last character."""
    first = "[" if schema.startswith("array") else "{"
    content = F.col("content").cast("string")
    root = content.rlike(rf"^[ \t\r\n]*\{first}")
    if first == "[":
        parsed = F.struct(F.from_json(content, schema).alias("r"), whole_json(content).alias("whole"))
        out = once(raw, "parsed", parsed).select("*", root.alias("root"), F.col("parsed.r").alias("r"), F.col("parsed.whole").alias("ok")).drop("parsed")
        return out.withColumn("ok", F.col("ok") & F.col("r").isNotNull() & F.col("root"))
    parsed = F.struct(F.from_json(content, f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"), whole_json(content).alias("whole"))
    out = once(raw, "parsed", parsed).select("*", root.alias("root"), F.col("parsed.r").alias("r"), F.col("parsed.whole").alias("ok")).drop("parsed")
    return out.withColumn("ok", F.col("ok") & F.col("r").isNotNull() & F.col("r._corrupt").isNull())


def tags(name: str) -> Column:
    """How many elements of this name the report holds, wherever they stand. Fewer that were read means some out of place."""
    return F.regexp_count(F.regexp_replace("content", _NO_MARKUP, ""), F.lit(rf"<(?:[\w.-]+:)?{name}(?=[\s/>])"))


def split(rows: DataFrame, faults: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows without a fault, and gaps (report_id, reason) of the others by the first fault that holds or is null."""
    rows = rows.withColumn("_why", first_fault(rows, faults))
    return rows.where("_why is null").drop("_why"), rows.where("_why is not null").select("report_id", F.col("_why").alias("reason"))


def first_fault(rows: DataFrame, faults: dict[str, Column]) -> Column:
    """The reason of the first fault that holds or is null, null if there is none."""
    why = F.when(~F.coalesce("ok", F.lit(False)), "malformed")
    if "root" in rows.columns:
        why = why.when(~F.coalesce("root", F.lit(False)), "wrong root")
    for reason, bad in faults.items():
        why = why.when(F.coalesce(bad, F.lit(True)), reason)
    return why


def line(value: Column) -> Column:
    """A line number; null unless it is at least 1."""
    n = value.try_cast("int")
    return F.when(n >= 1, n)


def bad_number(value: Column, least: int = 0) -> Column:
    """Whether a text that may be missing is there and no whole number of at least `least`."""
    return F.coalesce(F.when(value.isNotNull(), F.coalesce(value.try_cast("long") < least, F.lit(True))), F.lit(False))


def differs(declared: Column, counted: Column) -> Column:
    """Whether a counter that may be missing is there and is another number."""
    return F.coalesce(F.when(declared.isNotNull(), F.coalesce(declared.try_cast("long") != counted, F.lit(True))), F.lit(False))


def blank(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit("")) == ""


def elements(content: str | None) -> list[tuple[ElementTree.Element, int]] | None:
    """All elements in document order, each with the place of its parent (-1 for the root); None if the text is malformed.
    Works without recursion, as elements may be nested very deep."""
    try:
        root = ElementTree.fromstring(content or "")
    except (ElementTree.ParseError, ValueError):
        return None
    out, todo = [], [(root, -1)]
    while todo:
        e, up = todo.pop()
        e.tag = e.tag.rsplit("}", 1)[-1]
        todo += [(c, len(out)) for c in reversed(e)]
        out.append((e, up))
    return out


def flattened(raw: DataFrame, schema: str, read: Callable[[str | None], dict]) -> DataFrame:
    """report_id and the fields of `schema` that `read` finds in each content, for formats that nest to any depth."""
    fields = StructType.fromDDL(schema).fields
    out = StructType([raw.schema["report_id"], *[StructField(f.name, f.dataType) for f in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            rows = [read(x) for x in b.column("content").to_pylist()]
            arrays = [b.column("report_id"), *(pa.array([r.get(f.name) for r in rows], to_arrow_type(f.dataType)) for f in fields)]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in out.fields])

    return raw.select("report_id", F.col("content").cast("string")).mapInArrow(run, out)
