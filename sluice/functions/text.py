"""Text and digest functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def lines(text: Column) -> Column:
    """Lines without their ends; an empty text has none, and a last line end opens no further line."""
    cut = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(cut, r"\r?\n", -1))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+", -1), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def extension(path: Column) -> Column:
    """Lower-case last extension with its dot; empty if the file name has none but a leading dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def digest(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def glob_regex(glob: str) -> str:
    """A glob as a whole-path regex: * and ? stay within a directory, ** crosses them, {a,b} and [..] choose."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
            continue
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        i += 1
    return f"^{out}$"


def any_glob(path: Column, globs: list[str], empty: bool = True) -> Column:
    """Whether one of the globs fits; with no glob at all, `empty`."""
    if not globs:
        return F.lit(empty)
    return path.rlike("|".join(glob_regex(g) for g in globs))


def eol(content: Column) -> Column:
    """none, lf, crlf or mixed."""
    crlf, lf = content.rlike(r"\r\n"), content.rlike(r"(?s)(?:^|[^\r])\n")
    return F.when(crlf & lf, "mixed").when(crlf, "crlf").when(lf, "lf").otherwise("none")


def exact_decimal(value: Column, scale: int = 18) -> Column:
    """A plain decimal of at most 18 decimals as decimal(38, 18); null (a gap) for anything else, never a rounded value."""
    plain = value.rlike(r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]{1,%d})?$" % scale)
    return F.when(plain, value.try_cast(f"decimal(38,{scale})"))


def has_cjk(text: Column) -> Column:
    return text.rlike(r"[\x{3400}-\x{9FFF}]")


def ascii_words(text: Column) -> Column:
    """Number of runs of ASCII letters."""
    return F.regexp_count(text, F.lit("[A-Za-z]+"))


def truncate_utf8(text: Column, most: int = 256) -> Column:
    """The longest prefix of at most `most` UTF-8 bytes that ends between characters."""
    head = F.encode(text, "UTF-8").substr(1, most)
    for _ in range(3):  # a cut character leaves at most three bytes
        head = F.when(F.is_valid_utf8(head.cast("string")), head).otherwise(head.substr(F.lit(1), F.octet_length(head) - 1))
    return F.when(F.octet_length(text) <= most, text).otherwise(head.cast("string"))


def truncated_utf8(text: Column, most: int = 256) -> Column:
    """FN-9. struct<text, truncated>: the prefix of truncate_utf8, and whether something was cut off."""
    return F.struct(truncate_utf8(text, most).alias("text"), (F.octet_length(text) > most).alias("truncated"))


def one_line(text: Column, most: int = 512) -> Column:
    """Control characters and line separators become spaces; cut to `most` characters with an ellipsis."""
    flat = F.regexp_replace(text, r"[\x00-\x1F\x7F-\x9F\x{2028}\x{2029}]", " ")
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def branch_counts(condition: Column) -> Column:
    """`50% (1/2)` -> struct<hit, found>; null if it has another form or more hits than branches."""
    hit = F.regexp_extract(condition, r"^\s*\d+(?:\.\d+)?%\s*\((\d+)/(\d+)\)\s*$", 1).try_cast("int")
    found = F.regexp_extract(condition, r"^\s*\d+(?:\.\d+)?%\s*\((\d+)/(\d+)\)\s*$", 2).try_cast("int")
    return F.when((hit <= found) & (found > 0), F.struct(hit.alias("hit"), found.alias("found")))


def interpreter(first_line: Column) -> Column:
    """The program that a #! line names, also behind env and env -S; empty without one."""
    by_env = F.regexp_extract(first_line, r"^#!\s*\S*/env\s+(?:-S\s+)?(?:\S+=\S*\s+)*([^\s/]+)", 1)
    direct = F.regexp_extract(first_line, r"^#!\s*(?:\S*/)?([^\s/]+)", 1)
    return F.when(by_env != "", by_env).otherwise(direct)


def marker_line(line: Column, name: str) -> Column:
    """Whether a comment line is the marker `name`: the name, then the end, a space, a colon or a bracket."""
    return line.rlike(r"^[\s/*#]*" + re.escape(name) + r"(?:$|[ :(])")


def fields(text: Column) -> Column:
    """map of `key: value` and `key = 'quoted'` pairs; a key that comes twice has an empty value."""
    pairs = F.regexp_extract_all(text, F.lit(r"""([A-Za-z_][A-Za-z0-9_-]*)\s*[:=]\s*("[^"]*"|'[^']*'|[^\s,;)]+)"""), F.lit(0))
    key = lambda p: F.regexp_extract(p, r"^([A-Za-z_][A-Za-z0-9_-]*)", 1)
    value = lambda p: F.regexp_replace(F.regexp_replace(p, r"^[A-Za-z_][A-Za-z0-9_-]*\s*[:=]\s*", ""), "^[\"']|[\"']$", "")
    keys = F.transform(pairs, key)
    entries = F.transform(
        F.array_distinct(keys),
        lambda k: F.struct(
            k.alias("key"),
            F.when(F.size(F.filter(keys, lambda x: x == k)) == 1, F.element_at(F.transform(F.filter(pairs, lambda p: key(p) == k), value), 1)).otherwise("").alias("value"),
        ),
    )
    return F.map_from_entries(entries)


def required_texts(pattern: str) -> tuple[tuple[str, ...], bool] | None:
    """Texts of which every match of a regex holds at least one, and whether in any case; None if there are none of two
    characters or more. Of what must be in a match the set is taken whose shortest text is longest."""
    from re import _constants as c, _parser

    try:
        tree = _parser.parse(pattern)
    except re.error:  # another engine's syntax
        return None
    fold = bool(tree.state.flags & re.IGNORECASE)

    def best(sets: list[frozenset[str]]) -> frozenset[str] | None:
        return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=None)

    def of(items) -> frozenset[str] | None:
        found, run = [], ""
        for op, arg in items:
            if op is c.LITERAL:
                run += chr(arg)
                continue
            if op is c.AT:  # takes no room
                continue
            found, run = [*found, frozenset([run])] if run else found, ""
            inner = None
            if op is c.SUBPATTERN:
                inner = of(arg[3])
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and arg[0] >= 1:
                inner = of(arg[2])
            elif op is c.ATOMIC_GROUP:
                inner = of(arg)
            elif op is c.BRANCH:
                parts = [of(x) for x in arg[1]]
                inner = None if None in parts else frozenset().union(*parts)
            found += [inner] if inner else []
        return best([*found, frozenset([run])] if run else found)

    texts = of(tree)
    if not texts or min(map(len, texts)) < 2 or fold and not all(x.isascii() or x.lower() == x.upper() for x in texts):
        return None
    return tuple(sorted({x.lower() if fold else x for x in texts})), fold
