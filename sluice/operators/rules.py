"""Rules on files, lines, commits and entities. Findings are rows; what cannot be judged is a gap, never a pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.functions import text as T
from sluice.operators.rule_data import PATTERN_RULES

# Suffixes, file names, names of languages and default patterns.
RESOURCE_SUFFIXES = (
    "pdf doc docx xls xlsx ppt pptx odt ods odp rtf png jpg jpeg gif webp bmp tif tiff ico avif heic heif mp3 wav flac aac ogg "
    "m4a mp4 mov avi mkv webm mpeg mpg"
).split()
BINARY_SUFFIXES = ".class .jar .war .ear .so .dll .dylib .exe .o .a .lib .pyc .pyo .wasm".split()
EXTENSION_LANGUAGE = {
    "java": "java", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript",
    "mjs": "typescript", "cjs": "typescript", "go": "go", "rs": "rust", "sh": "shell", "bash": "shell",
}
TEXT_LANGUAGE = {"c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp"}
SHELLS = ["sh", "bash", "dash", "ksh", "zsh"]
COMMIT_SUBJECT = r"^\[[^\]]+\](feat|fix|docs|test|refactor|build|ci|chore): .+"
NAME_PATTERNS = {
    "java": r"^should_[A-Za-z0-9_]+_when_[A-Za-z0-9_]+$", "python": r"^test_[a-z0-9_]+$", "go": r"^Test[A-Z_][A-Za-z0-9_]*$",
    "rust": r"^[a-z][a-z0-9_]*$",
}
OTHER_NAME = r"^\S.+$"
CODE_COMMENT = r"^\s*#\s*(?:(?:if|for|while|case|function|return|exit|local|export|readonly)\b|[A-Za-z_][A-Za-z0-9_]*\s*=)"
BUILD_INPUTS = (
    "Cargo.toml Cargo.lock build.rs rust-toolchain rust-toolchain.toml rustfmt.toml .rustfmt.toml clippy.toml .clippy.toml pom.xml "
    "build.gradle build.gradle.kts settings.gradle settings.gradle.kts gradle.properties gradle.lockfile libs.versions.toml "
    "gradle-wrapper.properties pyproject.toml setup.py setup.cfg Pipfile Pipfile.lock poetry.lock uv.lock tox.ini pytest.ini ruff.toml "
    ".ruff.toml mypy.ini .mypy.ini .flake8 package.json package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml "
    "pnpm-workspace.yaml .npmrc .yarnrc.yml .eslintignore .prettierignore go.mod go.sum go.work go.work.sum .golangci.yml "
    ".golangci.yaml .golangci.toml .golangci.json CMakeLists.txt CMakePresets.json Makefile makefile .clang-format .clang-tidy BUILD "
    "BUILD.bazel WORKSPACE WORKSPACE.bazel MODULE.bazel MODULE.bazel.lock .bazelrc .bazelversion"
).split()
BUILD_INPUT_FORM = (
    r"(?:^|/)(?:requirements[^/]*\.txt|tsconfig[^/]*\.json|eslint\.config\.[^/]*|\.eslintrc(?:\.[^/]*)?|prettier\.config\.[^/]*"
    r"|\.prettierrc(?:\.[^/]*)?|[^/]*\.bzl|[^/]*\.cmake|\.cargo/config(?:\.toml)?)$"
)


def include(df: DataFrame, globs: list[str], path: str = "path") -> DataFrame:
    """FLT-1. Rows whose path fits one of the globs; no globs keep all."""
    return df.where(T.any_glob(F.col(path), globs))


def exclude(df: DataFrame, globs: list[str], path: str = "path") -> DataFrame:
    """FLT-2. Rows whose path fits none of the globs; a negated glob is an error."""
    if any(g.startswith("!") for g in globs):
        raise ValueError("exclusions cannot be negated")
    return df.where(~T.any_glob(F.col(path), globs, empty=False))


def exclusion_reason(path: Column, explicit: list[str], retained: list[str], enabled: bool = True) -> Column:
    """FLT-3. explicit, resource (a document or media suffix, unless retained) or null."""
    suffix = F.ltrim(T.extension(path), F.lit("."))
    resource = suffix.isin(RESOURCE_SUFFIXES) & ~T.any_glob(path, retained, empty=False) & F.lit(enabled)
    return F.when(T.any_glob(path, explicit, empty=False), "explicit").when(resource, "resource")


def protected_exclusions(excluded: DataFrame, protected: list[str]) -> DataFrame:
    """FLT-4. Gaps: excluded paths that are protected."""
    return excluded.where(T.any_glob(F.col("path"), protected, empty=False))


def language(path: Column, content: Column | None = None, c_family: bool = False) -> Column:
    """FLT-5. By extension, then by a shell's #! line in the first 256 bytes; c_family adds C and C++."""
    known = {**EXTENSION_LANGUAGE, **(TEXT_LANGUAGE if c_family else {})}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    found = F.element_at(table, F.nullif(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1), F.lit("")))
    if content is None:
        return found
    first = F.regexp_extract(F.substring(content, 1, 256), r"\A([^\r\n]*)", 1)
    has_extension = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1) != ""
    return F.coalesce(found, F.when(~has_extension & T.interpreter(first).isin(SHELLS), "shell"))


def line_endings(changes: DataFrame, base: DataFrame, head: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """FLT-7. Changed text files whose line ends are not those of their base version (a new file: lf)."""
    now = head.select(*keys, "path", F.col("content").alias("now"))
    was = base.select(*keys, F.col("path").alias("old_path"), F.col("content").alias("was"))
    rows = changes.where("kind in ('added', 'modified', 'renamed')").join(now, [*keys, "path"]).join(was, [*keys, "old_path"], "left")
    rows = rows.where(~F.col("now").contains("\0")).select(*keys, "path", T.eol(F.col("now")).alias("actual"), F.when(F.col("was").isNull(), "lf").otherwise(T.eol(F.col("was"))).alias("was"))
    rows = rows.withColumn("expected", F.when(F.col("was") == "none", "lf").otherwise(F.col("was"))).drop("was")
    return rows.where("actual <> 'none' and actual <> expected")


def binary_files(added: DataFrame, limit: int = 4096) -> DataFrame:
    """FLT-8. Added files that are binary: by suffix, else a NUL byte or invalid UTF-8 in the first bytes (a character cut by
    the limit is no fault)."""
    content = F.col("content").cast("binary")
    head = content.substr(1, limit)
    whole = F.octet_length(content) <= limit
    cut = lambda n: F.is_valid_utf8(head.substr(F.lit(1), F.greatest(F.octet_length(head) - n, F.lit(0))).cast("string"))
    valid = F.is_valid_utf8(head.cast("string")) | ~whole & (cut(1) | cut(2) | cut(3))
    suffix = T.extension(F.col("path")).isin(BINARY_SUFFIXES)
    nul = head.cast("string").contains("\0")
    reason = F.when(suffix, "suffix").when(nul, "nul").when(~valid, "utf8")
    return added.withColumn("reason", reason).where("reason is not null")


def oversized_files(added: DataFrame, limit: int = 1_048_576, allow: list[str] | None = None) -> DataFrame:
    """FLT-9. Added files of more than `limit` bytes; the limit itself passes."""
    return added.where((F.octet_length(F.col("content").cast("binary")) > limit) & ~T.any_glob(F.col("path"), allow or [], empty=False))


def pattern_findings(lines: DataFrame, kind: str | None = None, rules: list | None = None) -> DataFrame:
    """FLT-10, FLT-11. lines (.., path, language, line_no, text) -> one row per (line, rule, pattern), all rules in one scan.
    source-pattern rules expect added lines, file-pattern rules the lines of added files; a pattern given twice counts once.
    rules None are all rules; of an empty list, or a kind that no rule has, there are no findings.

    A pattern is tried only on lines that hold a text which all its matches must hold; these are plain searches."""
    hits = []
    folded = F.lower("text")
    for rule, of, severity, required, paths, patterns in PATTERN_RULES if rules is None else rules:
        if kind and of != kind:
            continue
        for lang, several in patterns.items():
            for number, pattern in enumerate(dict.fromkeys(several)):
                applies = F.col("text").rlike(pattern) & T.any_glob(F.col("path"), paths)
                if needs := T.required_texts(pattern):
                    applies = reduce(lambda a, b: a | b, [(folded if needs[1] else F.col("text")).contains(x) for x in needs[0]]) & applies
                applies = applies if lang == "all" else (F.col("language") == lang) & applies
                hits.append(F.when(applies, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(required).alias("required"), F.lit(number).alias("pattern"))))
    none = F.array().cast("array<struct<rule: string, severity: string, required: boolean, pattern: int>>")
    rows = lines.withColumn("_hit", F.explode(F.filter(F.array(*hits) if hits else none, lambda h: h.isNotNull())))
    return rows.select(*lines.columns, "_hit.*")


def missing_shebang(lines: DataFrame) -> DataFrame:
    """FLT-12. First lines of added shell files, or changed first lines, that do not begin with #!."""
    return lines.where("line_no = 1").where(~F.col("text").startswith("#!"))


def commit_subjects(commits: DataFrame, pattern: str = COMMIT_SUBJECT, keys: Sequence[str] = ()) -> DataFrame:
    """FLT-13, SRC-2. Commits whose first line does not fit the pattern."""
    subject = F.element_at(F.split("message", "\n", -1), 1)
    return commits.select(*keys, "oid", subject.alias("subject")).where(~F.col("subject").rlike(pattern))


def commit_verdict(commits: DataFrame, pattern: str = COMMIT_SUBJECT) -> DataFrame:
    """FLT-13. One row: skipped without commits, else fail or pass."""
    bad = F.count_if(~F.element_at(F.split("message", "\n", -1), 1).rlike(pattern))
    return commits.agg(F.count(F.lit(1)).alias("commits"), bad.alias("bad")).select(
        "commits", "bad", F.when(F.col("commits") == 0, "skipped").when(F.col("bad") > 0, "fail").otherwise("pass").alias("verdict")
    )


def name_findings(entities: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """FLT-14. Added entities whose name does not fit their language's pattern."""
    patterns = {**NAME_PATTERNS, **(patterns or {})}
    good = F.lit(None)
    for lang, pattern in patterns.items():
        good = F.when(F.col("language") == lang, F.col("name").rlike(pattern)).otherwise(good)
    return entities.where("kind = 'added'").where(~F.coalesce(good, F.col("name").rlike(OTHER_NAME)))


def import_classes(imports: DataFrame, forbidden: dict[str, list[str]], declared: dict[str, list[str]], undeclared: str = "report") -> DataFrame:
    """FLT-15. imports (.., language, text) -> class: forbidden, declared, undeclared or gap (a language without patterns).
    `undeclared` says what becomes of an import in neither list: report (a finding), incomplete (a gap) or off."""

    def fits(table: dict[str, list[str]]) -> Column:
        out = F.lit(False)
        for lang, patterns in table.items():
            out = out | (F.col("language") == lang) & F.col("text").rlike("|".join(f"(?:{p})" for p in patterns))
        return out

    known = F.col("language").isin(sorted({*forbidden, *declared}))
    rest = {"report": "undeclared", "incomplete": "gap", "off": "ignored"}[undeclared]
    return imports.withColumn("class", F.when(~known | F.col("language").isNull(), "gap").when(fits(forbidden), "forbidden").when(fits(declared), "declared").otherwise(rest))


def comment_findings(comments: DataFrame, wanted: str = "english", exempt: str | None = None) -> DataFrame:
    """FLT-16. english forbids CJK characters; chinese asks for some, or fewer than three ASCII words."""
    text = F.col("text")
    bad = T.has_cjk(text) if wanted == "english" else ~T.has_cjk(text) & (T.ascii_words(text) >= 3)
    return comments.where(bad & ~text.rlike(exempt) if exempt else bad)


def name_assertions(entities: DataFrame, name_pattern: str | None = None, forbid: str | None = None, require: str | None = None) -> DataFrame:
    """FLT-17. Findings of the three assertions, stacked."""
    out = None
    for assertion, bad in (
        ("name_pattern", ~F.col("name").rlike(name_pattern) if name_pattern else None),
        ("forbid_pattern", F.col("text").rlike(forbid) if forbid else None),
        ("require_pattern", ~F.col("text").rlike(require) if require else None),
    ):
        if bad is not None:
            part = entities.where(bad).withColumn("assertion", F.lit(assertion))
            out = part if out is None else out.unionByName(part)
    return out


def missing_marker_fields(entities: DataFrame, wanted: list[str], text: str = "text") -> DataFrame:
    """FLT-18, FN-6. Entities whose marker lacks fields or leaves them empty; `missing` lists them."""
    value = T.fields(F.col(text))
    absent = F.filter(F.array(*map(F.lit, wanted)), lambda f: F.coalesce(F.trim(F.element_at(value, f)), F.lit("")) == "")
    return entities.withColumn("missing", F.array_join(absent, ",")).where("missing <> ''")


def select_changes(entities: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """FLT-19. By change kind; "any" is added, modified or renamed, "all" keeps the unchanged too."""
    wanted = {x for k in kinds for x in (["added", "modified", "renamed"] if k == "any" else [k])}
    return entities if "all" in wanted else entities.where(F.col("kind").isin(sorted(wanted)))


def metric_facts(facts: DataFrame, metric: str, unit: str, measurement: str) -> tuple[DataFrame, DataFrame]:
    """FLT-26. (facts of the metric in the wanted unit and measurement, gaps: its facts in others)."""
    of = facts.where(F.col("metric") == metric)
    good = (F.col("unit") == unit) & (F.col("measurement") == measurement)
    return of.where(good), of.where(~F.coalesce(good, F.lit(False)))


def clone_facts(pairs: DataFrame, floor: str, min_lines: int = 0, min_nodes: int = 0) -> DataFrame:
    """FLT-27. Pairs at or above the floor, with enough lines and nodes on both ends."""
    size = lambda s: F.col(f"{s}_end") - F.col(f"{s}_start") + 1
    return pairs.where(
        (F.col("similarity") >= F.lit(floor).cast("decimal(38,18)")) & (size("left") >= min_lines) & (size("right") >= min_lines)
        & (F.col("left_nodes") >= min_nodes) & (F.col("right_nodes") >= min_nodes)
    )


def floor_covers(acquired: Column, requested: Column) -> Column:
    """FLT-28. Whether pairs acquired at one floor hold all of a requested one, as similarities are rounded to 12 digits:
    a value that rounds to the requested floor may lie half a unit below it."""
    half = F.lit("0.0000000000005").cast("decimal(38,18)")
    return acquired.cast("decimal(38,18)") <= requested.cast("decimal(38,18)") - half


def rule_query(rules: DataFrame, category: str | None = None, lang: str | None = None) -> DataFrame:
    """FLT-29. Rules by category and language; a rule without languages fits every language."""
    if category:
        rules = rules.where(F.col("category") == category)
    return rules.where((F.size("languages") == 0) | F.array_contains("languages", lang)) if lang else rules


def triggered(checks: DataFrame, changes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """FLT-30, JOIN-7. checks (id, paths array<regex>, inputs array<regex>, languages) x changes (keys, path, language) ->
    keys, id, evidence (least path): a change fits an input, or a path and the language. The checks are few and rule data;
    each change is tested against them in its own row, without a join."""
    # the pattern side is the policy's rules, read in the driver and compiled to literals
    out = []
    for c in checks.select("id", "paths", "inputs", "languages").collect():
        fits = lambda xs, empty: F.col("path").rlike("|".join(f"(?:{x})" for x in xs)) if xs else F.lit(empty)
        lang = F.col("language").isin(list(c["languages"])) if c["languages"] else F.lit(True)
        hit = F.when(fits(c["inputs"], False) | fits(c["paths"], not c["inputs"]) & lang, F.lit(c["id"]))
        out.append(hit)
    none = F.array().cast(f"array<{checks.schema['id'].dataType.simpleString()}>")
    rows = changes.withColumn("id", F.explode(F.filter(F.array(*out) if out else none, lambda x: x.isNotNull())))
    return rows.groupBy(*keys, "id").agg(F.min("path").alias("evidence"), F.count(F.lit(1)).alias("changes"))


def shared_build_input(path: Column) -> Column:
    """FLT-31. Files that every check depends on."""
    return F.element_at(F.split(path, "/", -1), -1).isin(BUILD_INPUTS) | path.rlike(BUILD_INPUT_FORM)


def in_scope(roles: Column, tasks: Column, role: str, task: str) -> Column:
    """FLT-32. An empty list fits any."""
    return ((F.size(roles) == 0) | F.array_contains(roles, role)) & ((F.size(tasks) == 0) | F.array_contains(tasks, task))


def commented_code(lines: DataFrame, added: DataFrame, keys: Sequence[str] = (), least: int = 3) -> DataFrame:
    """WIN-1. Runs of at least `least` consecutive code-like comment lines that touch an added line."""
    by = [*keys, "path"]
    code = lines.where(F.col("text").rlike(CODE_COMMENT)).join(added.select(*by, "line_no").distinct().withColumn("_added", F.lit(True)), [*by, "line_no"], "left")
    island = F.col("line_no") - F.row_number().over(Window.partitionBy(*by).orderBy("line_no"))
    runs = code.withColumn("_island", island).groupBy(*by, "_island").agg(
        F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce("_added", F.lit(False))).alias("touched")
    )
    return runs.where((F.col("n") >= least) & F.col("touched")).drop("_island", "touched")


def comment_above(comments: DataFrame, entities: DataFrame, blanks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """WIN-8. comments, blanks (keys, path, line_no), entities (keys, path, symbol, start_line) -> the first and last comment
    line of the block right above each entity; blank lines do not end a block, code does."""
    by = [*keys, "path"]
    soft = comments.select(*by, "line_no", F.lit(1).alias("c")).unionByName(blanks.select(*by, "line_no", F.lit(0).alias("c")))
    island = F.col("line_no") - F.row_number().over(Window.partitionBy(*by).orderBy("line_no"))
    blocks = soft.withColumn("_i", island).groupBy(*by, "_i").agg(
        F.max("line_no").alias("_last"), F.min(F.when(F.col("c") == 1, F.col("line_no"))).alias("first_line"), F.max(F.when(F.col("c") == 1, F.col("line_no"))).alias("last_line")
    )
    at = entities.withColumn("_last", F.col("start_line") - 1)
    return at.join(blocks, [*by, "_last"]).where("first_line is not null").select(*by, "symbol", "start_line", "first_line", "last_line")
