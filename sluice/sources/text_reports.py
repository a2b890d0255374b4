"""LCOV records and javac warnings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sluice.functions.text import lines
from sluice.sources.common import blank, once, split
from sluice.tables import FINE, keep, partitions

_NUMBER = r"^\+?[0-9]+$"
_COUNTERS = ("LF", "LH", "BRF", "BRH")


def _whole(text: Column, kind: str) -> Column:
    """A whole number of digits only; null for spaces around it, signs below zero and what the kind cannot hold."""
    return F.when(text.rlike(_NUMBER), text.try_cast(kind))


def _section(ls: Column) -> Column:
    """The records of a section's lines: files, whether SF comes first, lines (da), branches (br) and the four counters as texts."""
    of = lambda kind: F.transform(F.filter(ls, lambda l: l.startswith(f"{kind}:")), lambda l: F.substring(l, len(kind) + 2, 1 << 30))
    cells = lambda kind: F.transform(of(kind), lambda x: F.split(x, ",", -1))
    da = F.transform(cells("DA"), lambda c: F.struct(F.when(F.size(c).isin(2, 3), _whole(c[0], "int")).alias("line"), F.when(F.size(c).isin(2, 3), _whole(c[1], "long")).alias("hits")))

    def branch(c: Column) -> Column:
        sound = (F.size(c) == 4) & ~blank(F.get(c, F.lit(1))) & ~blank(F.get(c, F.lit(2)))
        hit = F.when(F.get(c, F.lit(3)) == "-", F.lit(False)).otherwise(_whole(F.get(c, F.lit(3)), "long") > 0)
        return F.struct(F.when(sound, _whole(F.get(c, F.lit(0)), "int")).alias("line"), F.concat_ws(",", F.get(c, F.lit(1)), F.get(c, F.lit(2))).alias("branch"), hit.alias("hit"))

    return F.struct(of("SF").alias("files"), F.get(ls, F.lit(0)).startswith("SF:").alias("first"), da.alias("da"), F.transform(cells("BRDA"), branch).alias("br"), *[of(k).alias(k) for k in _COUNTERS])


def _judged(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections, parsed; report_id, the first fault's number `why`, branch_coverage; gaps)."""
    rows = once(raw.select("report_id", F.col("content").cast("string").alias("content")), "s", F.split("content", r"(?m)^end_of_record\r?$", -1)).withColumn("ok", F.size("s") > 1)
    closed, gaps = split(rows, {"open section": ~blank(F.regexp_replace(F.element_at("s", -1), r"\s+", " "))})
    texts = closed.select("report_id", F.posexplode("s").alias("at", "text"), F.size("s").alias("of")).where("at < of - 1")
    records = once(texts, "ls", F.filter(lines(F.col("text")), lambda l: l.rlike(r"^(?:SF|DA|BRDA|LF|LH|BRF|BRH):")))
    parsed = once(records, "x", _section(F.col("ls"))).select("report_id", "x.*")
    twice = lambda a: F.size(F.array_distinct(a)) != F.size(a)
    has = {"LF": F.size("da"), "LH": F.size(F.filter("da", lambda d: d["hits"] > 0)), "BRF": F.size("br"), "BRH": F.size(F.filter("br", lambda b: b["hit"]))}
    differs = lambda k: (F.size(k) > 1) | (F.size(k) == 1) & F.coalesce(_whole(F.get(k, F.lit(0)), "int") != has[k], F.lit(True))
    faults = {
        "section without file": (F.size("files") != 1) | (F.get("files", F.lit(0)) == "") | ~F.coalesce("first", F.lit(False)),
        "record": F.exists("da", lambda d: F.coalesce(d["line"] < 1, F.lit(True)) | d["hits"].isNull()) | F.exists("br", lambda b: F.coalesce(b["line"] < 1, F.lit(True)) | b["hit"].isNull()),
        "record given twice": twice(F.transform("da", lambda d: d["line"])) | twice(F.transform("br", lambda b: F.struct(b["line"], b["branch"]))),
        "branch without line": F.size(F.array_except(F.transform("br", lambda b: b["line"]), F.transform("da", lambda d: d["line"]))) > 0,
        "empty section": (F.size("da") == 0) & ~F.coalesce(F.get("LF", F.lit(0)).rlike(r"^\+?0+$"), F.lit(False)),
        "counters differ": reduce(lambda a, b: a | b, map(differs, _COUNTERS)),
    }
    why = F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), i) for i, bad in enumerate(faults.values())])
    counted = (F.size("BRF") == 1) & (F.size("BRH") == 1)
    judged = once(parsed, "why", F.struct(why.alias("why"), counted.alias("counted"))).select("report_id", F.get("files", F.lit(0)).alias("file"), "da", "br", "why.*")
    judged = keep(judged, "lcov-sections")  # read for the verdict and for the facts
    verdict = judged.groupBy("report_id").agg(F.min("why").alias("why"), (F.bool_and("counted") & F.bool_or(F.size("br") > 0)).alias("branch_coverage"))
    reason = F.element_at(F.array(*map(F.lit, faults)), F.col("why") + 1)
    gaps = gaps.unionByName(verdict.where("why is not null").select("report_id", reason.alias("reason")))
    return judged, verdict, gaps


def lcov_branch_coverage(raw: DataFrame) -> DataFrame:
    """SRC-12. report_id, branch_coverage of the reports without a gap: whether branches were measured, that is, every section
    counts them (BRF and BRH) and some record names one."""
    return _judged(raw)[1].where("why is null").select("report_id", "branch_coverage")


def lcov(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-12, AGG-7, AGG-15. A section, from SF to end_of_record, is a row and is parsed once. Hits add by line over the
    sections of a file, a branch is hit if one of its records says so.

    No section, one that is not closed, without a file or with several, records outside sections, malformed or repeated
    records (numbers are digits only), branches on lines without one, an empty section that does not say LF:0, and counters
    (LF, LH, BRF, BRH) that differ are gaps; a report has one, the first of these that holds in a section of it."""
    judged, verdict, gaps = _judged(raw)
    # sections are dealt finely: what follows groups in memory by report and is not dealt again
    dealt = judged.repartition(FINE * partitions(raw.sparkSession), "report_id")
    good = dealt.join(verdict.where("why is null").select("report_id"), "report_id")
    hits = F.transform("da", lambda d: F.struct(d["line"].alias("line"), d["hits"].alias("hits"), F.lit(None).cast("string").alias("branch"), F.lit(None).cast("boolean").alias("hit")))
    arms = F.transform("br", lambda b: F.struct(b["line"].alias("line"), F.lit(None).cast("long").alias("hits"), b["branch"].alias("branch"), b["hit"].alias("hit")))
    by_branch = good.select("report_id", "file", F.explode(F.concat(hits, arms)).alias("r")).groupBy("report_id", "file", "r.line", "r.branch").agg(F.sum("r.hits").alias("hits"), F.bool_or("r.hit").alias("hit"))
    out = by_branch.groupBy("report_id", "file", "line").agg(F.sum("hits").alias("hits"), F.count("branch").cast("int").alias("branches_found"), F.count_if("hit").cast("int").alias("branches_hit"))
    return out, gaps


_PLACED = r"^(.*):([^:]*): warning: (?!.*: warning: )(.*)$"
_LABELLED = r"^\[(.+?)\] (.*\S.*)$"
EXCERPT, CARET = 2, 1  # lines that must still follow a warning with a place


def _judge(s: Column, x: Column) -> Column:
    """The next state of a javac report after the line x: what must follow, warnings, the total, the first fault."""
    message = F.when(x.startswith("warning: "), F.substring(x, 10, 1 << 30)).otherwise(F.regexp_extract(x, _PLACED, 3))
    label = F.regexp_extract(message, _LABELLED, 1)
    about = F.when(F.trim(message) == "", "message").when(message.startswith("[") & (label == ""), "label")
    total = F.regexp_extract(x, r"^(\S*) warnings?$", 1)
    file, number = F.regexp_extract(x, _PLACED, 1), F.regexp_extract(x, _PLACED, 2)
    counts = x.rlike(r"^[^ ]* warnings?$")
    fault = (
        F.when(s["need"] == EXCERPT, F.lit(None)).when(s["need"] == CARET, F.when(F.trim(x) != "^", "caret"))
        .when(s["total"].isNotNull(), "text after the total").when(F.trim(x) == "", F.lit(None))
        .when(counts, F.when(_whole(total, "int").isNull(), "total"))
        .when(x.startswith("Note: "), F.when(x.contains("deprecated API") | x.contains("-Xlint:deprecation") | x.contains("-Xlint:removal"), "note"))
        .when(x.startswith("warning: "), F.coalesce(about, F.when(label.isin("deprecation", "removal"), "warning without line")))
        .when(~x.rlike(_PLACED), "unexpected line").when(~file.endswith(".java") | ~F.coalesce(_whole(number, "int") > 0, F.lit(False)), "place").otherwise(about)
    )
    plain = (s["need"] == 0) & (F.trim(x) != "") & ~x.startswith("Note: ")
    warned = plain & ~counts
    return F.struct(
        F.when(s["need"] > 0, s["need"] - 1).when(warned & ~x.startswith("warning: "), EXCERPT).otherwise(0).alias("need"), (s["warned"] + F.when(warned, 1).otherwise(0)).alias("warned"),
        F.when(plain & counts, _whole(total, "int")).otherwise(s["total"]).alias("total"), F.coalesce(s["fault"], fault).alias("fault"),
    )


def javac(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-21. Deprecation and removal warnings, read as a fold over the lines that knows what may follow what: a warning with
    a place is followed by its excerpt and a caret, the total comes last and once. An empty report is clean.

    Compiler errors and any other line, warnings of these kinds without a place, notes that are not expanded, labels and
    messages that are cut, a missing caret, text after the total, a total that is missing or differs, and a report that does
    not end in a line break are gaps."""
    start = F.struct(F.lit(0).alias("need"), F.lit(0).alias("warned"), F.lit(None).cast("int").alias("total"), F.lit(None).cast("string").alias("fault"))
    content = F.col("content").cast("string")
    rows = once(raw.select("report_id", content.alias("content")), "l", lines(F.col("content")))
    rows = once(rows, "end", F.aggregate("l", start, _judge)).withColumn("ok", F.col("content").isNotNull())
    cut = (F.col("content") != "") & ((F.trim(F.regexp_replace("content", r"\s+", " ")) == "") | ~F.col("content").endswith("\n"))
    unequal = ~F.col("end.total").eqNullSafe(F.when(F.col("end.warned") > 0, F.col("end.warned")))
    found = F.coalesce("end.fault", F.when(F.col("end.need") > 0, "caret"))
    why = F.when(~F.col("ok"), "malformed").when(cut, "cut").when(found.isNotNull(), found).when(unequal, "total differs")
    judged = once(rows, "why", why)
    gaps = judged.where("why is not null").select("report_id", F.col("why").alias("reason"))
    # in a sound report a warning's excerpt follows it, so of two lines in a row that look like warnings the second is an excerpt
    w = judged.where("why is null").select("report_id", "l", F.posexplode("l").alias("at", "w"))
    placed = lambda x: x.rlike(_PLACED) & ~x.startswith("warning: ") & ~x.startswith("Note: ")
    w = w.where(placed(F.col("w")) & ~F.coalesce(placed(F.get("l", F.col("at") - 1)), F.lit(False)))
    message = F.regexp_extract("w", _PLACED, 3)
    w = w.select("report_id", F.regexp_extract(message, _LABELLED, 1).alias("rule"), F.regexp_extract("w", _PLACED, 1).alias("file"), F.regexp_extract("w", _PLACED, 2).cast("int").alias("line"), F.regexp_extract(message, _LABELLED, 2).alias("message"))
    return w.where(F.col("rule").isin("deprecation", "removal")).select("report_id", F.lit("javac").alias("tool"), "rule", "file", "line", "message", F.lit(None).cast("string").alias("symbol")), gaps
