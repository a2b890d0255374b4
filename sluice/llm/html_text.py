"""Layout-aware rendering of HTML to text.

A tree builder supplies implied tags and drops stray ones; visibility rules leave out what a browser would not show: by
element, attribute, style and the page's own style sheets, as far as their selectors are of one element. The renderer keeps
block spacing, list markers and nesting, preformatted lines, and table columns aligned by padding, with cells that span rows
or columns in their place.
"""

from __future__ import annotations

import html
import re
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluice.tables import table

WRAP = 60  # characters of a table's column: longer lines of cells are wrapped at spaces, a longer word has a line of its own

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas svg datalist title select rp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset".split())  # a blank line around
BLOCK = SPACED | frozenset(
    "html body div section article aside header footer nav main address form li dt dd tr caption details summary figcaption legend center hgroup search dialog menu thead tbody tfoot".split()
)
#: What an opening tag ends: the open elements it closes, and those that it does not look beyond.
_TABLE = frozenset(["table"])
CLOSES: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"]) | _TABLE),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"]) | _TABLE),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"]) | _TABLE),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select", "datalist"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr"]) | _TABLE),
    "th": (frozenset(["td", "th"]), frozenset(["tr"]) | _TABLE),
    "tr": (frozenset(["tr", "caption", "colgroup"]), _TABLE),
    **{x: (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), _TABLE) for x in ("tbody", "thead", "tfoot")},
    "body": (frozenset(["head"]), frozenset()),
}
BARRIER = frozenset(["table", "td", "th", "button", "caption", "select", "datalist", "object", "template", "svg"])  # a paragraph's end tag is not implied beyond these

_TOKEN = re.compile(r"<!--(?:.*?-->|.*$)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
_DECLARED = re.compile(r"(?:^|[;{\s])(display|visibility)\s*:\s*([a-z-]+)", re.I)
_SELECTOR = re.compile(r"(?:\*|[a-z][a-z0-9-]*)?(?:[.#][A-Za-z_-][\w-]*)*", re.I)
_BRACE = re.compile(r"[{}]")
_SPACE = " \t\n\f\r"  # white space that HTML folds; no-break and other spaces are characters
_WORD = re.compile(r"[^ \t\n\f\r]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)


def declared(style: str) -> dict[str, str]:
    """display and visibility as a style sets them, the last one of each."""
    return {k.lower(): v.lower() for k, v in _DECLARED.findall(_COMMENT.sub(" ", style))}


def _for_screens(head: str) -> bool:
    media = head.lower().split()
    return media[0] == "@media" and "not" not in media and (len(media) == 1 or bool({"all", "screen", "all,", "screen,"} & set(media)))


class Sheet:
    """The rules of a page's style sheets that hide or show: those for a tag, classes and an id of one element. Rules of
    media other than screens, and other selectors, are left out."""

    def __init__(self):
        self.rules: dict[str, list[tuple]] = {}
        self.count = 0

    def add(self, css: str) -> None:
        """One pass over the braces. A block holds its own text, without the blocks in it; one that is not closed ends with the
        sheet. Rules in a block that is not for screens, or within a selector's block, are left out."""
        css, at, blocks = _COMMENT.sub(" ", css), 0, [("", [], True)]  # head, own text, whether rules in it count

        def end() -> None:
            head, own, _ = blocks.pop()
            if not head.startswith("@") and blocks[-1][2] and (found := declared("".join(own))):
                for selector in head.split(","):
                    self._rule(selector.strip(), found)

        for brace in _BRACE.finditer(css):
            text, at = css[at : brace.start()], brace.end()
            if brace[0] == "}":
                blocks[-1][1].append(text)
                if len(blocks) > 1:
                    end()
                continue
            own, _, head = text.rpartition(";")
            blocks[-1][1].append(own + ";")
            head = head.strip()
            blocks.append((head, [], blocks[-1][2] and head.startswith("@") and _for_screens(head)))
        blocks[-1][1].append(css[at:])
        while len(blocks) > 1:
            end()

    def _rule(self, selector: str, found: dict[str, str]) -> None:
        if not selector or not _SELECTOR.fullmatch(selector):
            return
        tag = re.match(r"[^.#]*", selector)[0].lower()
        names = re.findall(r"([.#])([\w-]+)", selector)
        classes, ids = {n for k, n in names if k == "."}, {n for k, n in names if k == "#"}
        self.count += 1
        key = f"#{min(ids)}" if ids else f".{min(classes)}" if classes else tag
        self.rules.setdefault(key, []).append((len(ids), len(classes), tag not in ("", "*"), self.count, tag, classes, ids, found))

    def style(self, node: Node) -> dict[str, str]:
        if not self.rules:
            return {}
        classes, own = set(node.attrs.get("class", "").split()), node.attrs.get("id", "")
        fits = [r for key in (f"#{own}", *(f".{c}" for c in classes), node.tag, "*") for r in self.rules.get(key, ()) if r[4] in ("", "*", node.tag) and r[5] <= classes and r[6] <= {own}]
        out: dict[str, str] = {}
        for r in sorted(fits, key=lambda r: r[:4]):
            out |= r[7]
        return out


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """("text" or "open" or "close", text or name, attributes)."""
    at = 0
    while at < len(source):
        m = _TOKEN.search(source, at)
        if not m:
            break
        if m.start() > at:
            yield "text", html.unescape(source[at : m.start()]), ""
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        yield ("close" if m[1] else "open"), name, m[3]
        if not m[1] and name in RAW:
            close = _END[name].search(source, at)
            end = close.start() if close else len(source)
            body = source[at:end]
            yield "text", html.unescape(body) if name in ("textarea", "title") else body, ""
            at = end
    if at < len(source):
        yield "text", html.unescape(source[at:]), ""


def parse(source: str) -> Node:
    root = Node("html", {})
    stack = [root]
    places: dict[str, list[int]] = {}  # where elements of each name are open

    def last(names: frozenset[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def close(names: frozenset[str], stop: frozenset[str]) -> bool:
        """Closes the innermost open element of these names, unless one of `stop` is open within it."""
        k = last(names)
        if not k or k < last(stop):
            return False
        for node in stack[k:]:
            places[node.tag].pop()
        del stack[k:]
        return True

    def push(tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag not in VOID:
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)

    for kind, value, rest in _tokens(source):
        if kind == "text":
            stack[-1].children.append(value)
        elif kind == "open":
            attrs = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)} if rest.strip(" /\n") else {}
            if value == "html" or value == "body" and places.get("body"):  # there is one of each: what it lacks is added
                only = root if value == "html" else stack[places["body"][0]]
                only.attrs = attrs | only.attrs
                continue
            if value in CLOSES:
                close(*CLOSES[value])
                if value == "tr" or value in ("tbody", "thead", "tfoot"):
                    close(CLOSES["td"][0], _TABLE)
                    close(*CLOSES[value])
            if value in BLOCK:
                close(frozenset(["p"]), BARRIER)
                close(frozenset(["head"]), frozenset())
            if value in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                push("tr", {})
            push(value, attrs)
        elif value == "p":
            if not close(frozenset(["p"]), BARRIER):
                stack[-1].children.append(Node("p", {}))
        elif value == "br":
            stack[-1].children.append(Node("br", {}))
        elif value not in ("html", "body"):
            close(frozenset([value]), frozenset() if value in BARRIER else frozenset(["table"]) if value not in BLOCK else frozenset())
    return root


def displayed(node: Node, sheet: Sheet) -> tuple[bool, bool | None]:
    """Whether an element is displayed, and whether it says that it is visible (None: as what it stands in)."""
    a = node.attrs
    style = {**sheet.style(node), **(declared(a["style"]) if "style" in a else {})}
    by_itself = not ("hidden" in a or node.tag == "dialog" and "open" not in a)
    shown = node.tag not in HIDDEN and (style["display"] != "none" if "display" in style else by_itself)
    seen = {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility", ""))
    return shown, seen


def sheets(root: Node) -> Sheet:
    out, todo = Sheet(), [root]
    while todo:
        node = todo.pop()
        if node.tag == "style" and re.fullmatch(r"\s*|.*\b(?:all|screen)\b.*", node.attrs.get("media", ""), re.I | re.S):
            out.add("".join(c for c in node.children if isinstance(c, str)))
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


class _Page:
    """Lines of text with a margin; blank lines between blocks are kept to one."""

    def __init__(self):
        self.lines: list[str] = []
        self.now, self.margin, self.marker = "", "", ""
        self.gap, self.space = 0, False

    def br(self) -> None:
        """Ends the line; a second one leaves a blank line."""
        self.end(1 if self.now.strip(_SPACE) else 2)

    def words(self, text: str) -> None:
        parts = _WORD.findall(text)
        if not parts:
            self.space = self.space or bool(text)
            return
        lead = self.space or text[0] in _SPACE
        self._begin()
        self.now += (" " if lead and self.now.strip(_SPACE) and not self.now.endswith(" ") else "") + " ".join(parts)
        self.space = text[-1] in _SPACE

    def _begin(self) -> None:
        if not self.now:
            if self.gap and self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            self.now = self.marker or self.margin
            self.marker = ""

    def line(self, text: str) -> None:
        self.end(0)
        self._begin()
        self.now += text
        self.end(1)

    def end(self, gap: int) -> None:
        """Ends the line if one is begun; gap 2 asks for a blank line before the next."""
        if self.now.strip(_SPACE):
            self.lines.append(self.now.rstrip(_SPACE))
        self.now, self.space, self.gap = "", False, max(self.gap, gap)

    def text(self) -> str:
        self.end(0)
        return "\n".join(self.lines)


def _rows(node: Node, sheet: Sheet, captions: list[Node]) -> Iterator[tuple[Node, int]]:
    """The rows of a table with the number of their section; what a table may not hold is shown before it."""
    todo, section = [(c, 0) for c in reversed(node.children)], 0
    while todo:
        child, of = todo.pop()
        if isinstance(child, str):
            if child.strip(_SPACE):
                captions.append(_stray(child))
        elif not displayed(child, sheet)[0]:
            continue
        elif child.tag == "tr":
            yield child, of
        elif child.tag in ("tbody", "thead", "tfoot"):
            section += 1
            todo += [(c, section) for c in reversed(child.children)]
        elif child.tag not in VOID:
            captions.append(child)


def _stray(text: str) -> Node:
    node = Node("caption", {})
    node.children.append(text)
    return node


def _span(value: str | None, most: int) -> int:
    return min(int(value), most) if re.fullmatch(r"\d{1,9}", value or "") else 1


def _wrapped(line: str) -> list[str]:
    """A line in parts of WRAP characters at most, cut at spaces; a longer word is a part of its own."""
    if len(line) <= WRAP:
        return [line]
    lead = line[: len(line) - len(line.lstrip(_SPACE))]
    out, now = [], lead
    for word in _WORD.findall(line):
        if now.strip(_SPACE) and len(now) + 1 + len(word) > WRAP:
            out.append(now)
            now = ""
        now += (" " if now.strip(_SPACE) else "") + word
    return [*out, now]


def place(rows: list[tuple[int, list[tuple[int, int]]]]) -> list[list[int]]:
    """rows: (section, cells as (columns, rows) they span) -> the column where each cell begins. A cell that spans rows, to
    the end of its section at most (0: all the way), keeps its columns from the cells of the rows below."""
    out, taken, now = [], {}, None
    for section, cells in rows:
        if section != now:
            taken, now = {}, section  # column -> rows it is still taken for
        at, places, fresh = 0, [], {}
        for columns, down in cells:
            while taken.get(at, 0):
                at += 1
            places.append(at)
            for c in range(at, at + columns) if down != 1 else ():
                fresh[c] = max(fresh.get(c, 0), (1 << 30) if down == 0 else down)
            at += columns
        out.append(places)
        taken = {c: n - 1 for c, n in {**taken, **fresh}.items() if n > 1}
    return out


def _table(node: Node, seen: bool, sheet: Sheet) -> Generator:
    """The lines of a table, as a step of _run."""
    captions: list[Node] = []
    rows, shown = [], []
    for row, section in _rows(node, sheet, captions):
        says = displayed(row, sheet)[1]
        cells, texts = [], []
        for c in row.children:
            if isinstance(c, str):
                captions += [_stray(c)] if c.strip(_SPACE) else []
            elif not displayed(c, sheet)[0]:
                continue
            elif c.tag not in ("td", "th"):
                captions.append(c)
            else:
                cells.append((max(1, _span(c.attrs.get("colspan"), 1000)), _span(c.attrs.get("rowspan"), 65534)))
                own = displayed(c, sheet)[1]
                state = own if own is not None else says if says is not None else seen
                texts.append([x for line in (yield _text(c, state, sheet)).split("\n") for x in _wrapped(line)])
        rows.append((section, cells))
        shown.append(texts)
    starts = place(rows)
    width: dict[int, int] = {}
    for (_, cells), places, texts in zip(rows, starts, shown, strict=True):
        for (columns, _), at, lines in zip(cells, places, texts, strict=True):
            if columns == 1:
                width[at] = max(width.get(at, 0), min(WRAP, max(map(len, lines))))
    for (_, cells), places, texts in zip(rows, starts, shown, strict=True):
        for (columns, _), at, lines in zip(cells, places, texts, strict=True):
            if columns > 1:  # the last of the columns that a wide cell spans takes what the others lack
                over = [c for c in range(at, at + columns) if c in width]
                lacks = min(WRAP, max(map(len, lines))) - sum(width[c] for c in over) - 2 * max(len(over) - 1, 0)
                if lacks > 0:
                    width[over[-1] if over else at] = lacks + (width[over[-1]] if over else 0)
    offset, at = {}, 0  # columns that no cell begins in, or only wide ones do, take no room of their own
    for c in sorted({*width, *(p for places in starts for p in places)}):
        offset[c] = at
        at += width[c] + 2 if c in width else 0
    out = []
    for c in captions:
        own = displayed(c, sheet)[1]
        out += (yield _text(c, seen if own is None else own, sheet)).split("\n")
    for places, texts in zip(starts, shown, strict=True):
        for k in range(max(map(len, texts), default=0)):
            line = ""
            for at, lines in zip(places, texts, strict=True):
                if k >= len(lines) or not lines[k]:
                    continue
                if line and len(line) + 2 > offset[at]:  # what stands before runs over: go on in the next line
                    if len(line) > offset[at] or offset[at] == 0:
                        out.append(line)
                        line = ""
                line = line.ljust(offset[at]) + lines[k]
            out.append(line.rstrip(_SPACE))
    return [x for x in out if x.strip(_SPACE)]


def _render(node: Node, page: _Page, pre: bool, depth: int, seen: bool, sheet: Sheet) -> Generator:
    """Puts the children on the page, as a step of _run. seen: whether text that stands here is visible."""
    step = -1 if "reversed" in node.attrs else 1
    first = 1 if step > 0 else sum(isinstance(c, Node) and c.tag == "li" and displayed(c, sheet)[0] for c in node.children)
    number = int(node.attrs["start"]) if re.fullmatch(r"-?\d{1,6}", node.attrs.get("start", "")) else first
    for child in node.children:
        if isinstance(child, str):
            if not seen:
                continue
            if pre:
                *ended, last = child.split("\n")
                for x in ended:
                    page._begin()
                    page.now += x
                    page.lines.append(page.now.rstrip(_SPACE))
                    page.now = ""
                if last:
                    page._begin()
                    page.now += last
            else:
                page.words(child)
            continue
        tag = child.tag
        shown, says = displayed(child, sheet)
        if not shown:
            continue
        state = seen if says is None else says
        if tag == "br":
            page.br()
        elif tag == "wbr" or tag in VOID - {"hr"}:
            continue
        elif tag == "table":
            page.end(2)
            for x in (yield _table(child, state, sheet)):
                page.line(x)
            page.end(2)
        elif tag == "details" and "open" not in child.attrs:
            summary = Node("details", {})
            summary.children = [c for c in child.children if isinstance(c, Node) and c.tag == "summary"][:1]
            page.end(1)
            yield _render(summary, page, pre, depth, state, sheet)
            page.end(1)
        elif tag == "li":
            margin, ordered = page.margin, node.tag == "ol"
            number = int(child.attrs["value"]) if ordered and re.fullmatch(r"-?\d{1,6}", child.attrs.get("value", "")) else number
            mark = f"{number}. " if ordered else "- "
            number += step
            page.end(1)
            page.marker, page.margin = margin + mark, margin + " " * len(mark)
            yield _render(child, page, pre, depth + 1, state, sheet)
            page.end(1)
            page.marker, page.margin = "", margin
        elif tag in ("blockquote", "dd"):
            margin = page.margin
            page.end(2 if tag == "blockquote" else 1)
            page.margin = margin + "  "
            yield _render(child, page, pre, depth + 1, state, sheet)
            page.end(2 if tag == "blockquote" else 1)
            page.margin = margin
        elif tag == "textarea":
            page.end(1)
            yield _render(child, page, True, depth, state, sheet)
            page.end(1)
        elif tag in BLOCK:
            gap = 1 if tag in ("ul", "ol", "menu") and depth or tag not in SPACED else 2
            page.end(gap)
            yield _render(child, page, pre or tag == "pre", depth, state, sheet)
            page.end(gap)
        else:
            if tag == "q" and state:
                page.words("\u201c")
            yield _render(child, page, pre, depth, state, sheet)
            if tag == "q" and state:
                page.words("\u201d")
            if tag in ("td", "th"):
                page.space = True


def _text(node: Node, seen: bool, sheet: Sheet) -> Generator:
    page = _Page()
    yield _render(node, page, False, 0, seen, sheet)
    return page.text()


def _run(step: Generator):
    """Runs a step and the steps that it yields on a stack of its own, as elements may be nested deeper than calls."""
    steps, value = [step], None
    while steps:
        try:
            steps.append(steps[-1].send(value))
            value = None
        except StopIteration as e:
            steps.pop()
            value = e.value
    return value


def render(node: Node) -> str:
    sheet = sheets(node)
    shown, says = displayed(node, sheet)
    return _run(_text(node, says is not False, sheet)) if shown else ""


def extract(source: str | None) -> str:
    return render(parse(source or ""))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(x) for x in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, text. A null or empty html gives an empty text; null ids stay null; repeated rows are
    rendered each; an empty table gives an empty table; further columns are ignored; long pages are rendered whole, in time
    and memory that grow with their length; broken markup never fails."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extracted, "page_id long, text string")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    out = extract_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
