"""WARC archives, HTML pages, embeddings, toxicity and the pipeline."""

import gzip
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from llm_rows import SCHEMA, EDGES
from sluice.llm import embedding_dedup, html_text, simhash, toxicity, warc
from sluice.tables import fresh_path

DATA = "/root/testdata/sf0.001"
BIG = "<p>" + "x" * 200 + "</p>"


def _record(i, payload=b"hello"):
    return warc.record_bytes(i, "http://x/", payload, "d", None, False)


def test_archives_round_trip(spark):
    rows = [(5, BIG, "http://a/\r\nX: y"), (2, BIG, None), (9, BIG, "u"), (2, BIG, None), (3, "short", "u"), (4, "short", "u"), (6, None, "u"), (7, "", "u"), (None, BIG, "u"), (8, "é" * 60, "u"), (10, "é" * 60, "u")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string").withColumnRenamed("url", "url")
    path = fresh_path(spark, "warc-test")
    warc.write_archives(pages, path)
    got = warc.read_archives(spark, path).collect()
    assert not any(r.gap for r in got)
    first = {BIG: 2, "é" * 60: 8}
    want = Counter()
    for i, h, _ in rows:
        f = first.get(h)
        again = f is not None and i != f
        want[i, len((h or "").encode()), "revisit" if again else "response", f if again else None, None if again else (h or "").encode()] += 1
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want
    assert {r.url for r in got if r.page_id == 5} == {"http://a/%0D%0AX: y"}
    for name in os.listdir(path.removeprefix("file:")):
        if name.startswith("part-"):
            gzip.decompress(open(f"{path.removeprefix('file:')}/{name}", "rb").read())  # plain members, end to end


def test_no_pages(spark):
    path = fresh_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], "page_id long, html string, url string"), path)
    assert warc.read_archives(spark, path).count() == 0
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, html string")).count() == 0


@pytest.mark.parametrize("packed", [False, True])
def test_salvage_finds_all_but_the_broken_record(packed):
    whole = [warc.member(_record(i)) if packed else _record(i) for i in range(6)]
    rnd = random.Random(7)
    for broken in range(6):
        for _ in range(30):
            bad = bytearray(whole[broken])
            how = rnd.random()
            if how < 0.4:
                bad[rnd.randrange(len(bad))] ^= 1 << rnd.randrange(8)
            elif how < 0.7:
                del bad[rnd.randrange(1, len(bad)) :]
            else:
                bad = bytearray(rnd.randbytes(rnd.randint(1, 60)))
            data = b"".join([*whole[:broken], bytes(bad), *whole[broken + 1 :]])
            items = list(warc.salvage(data))
            ids = [warc._page(h.get("warc-record-id")) for *_, h in items if h is not None]
            assert {i for i in range(6) if i != broken} <= set(ids)
            gaps = [(a, z) for a, z, _, h in items if h is None]
            start = len(b"".join(whole[:broken]))
            assert all(start <= a < z <= start + len(bad) for a, z in gaps)
            assert gaps or len(ids) == 6  # a plain record's header has no digest: it may come back altered


def test_salvage_of_large_and_mixed_input():
    large = os.urandom(1 << 20) * 17
    data = warc.member(_record(1, large)) + _record(2) + b"junk" + warc.member(_record(3)) + b"\x1f\x8b\x08"
    items = list(warc.salvage(data))
    assert [warc._page(h.get("warc-record-id")) for *_, h in items if h is not None] == [1, 2, 3]
    assert [data[a:z] for a, z, _, h in items if h is None] == [b"junk", b"\x1f\x8b\x08"]
    assert warc.member(_record(1, large))[-1] == 0
    assert list(warc.salvage(b"")) == []


def test_salvage_within_a_member_of_many_records():
    def ids(data):
        items = list(warc.salvage(data))
        return [warc._page(h.get("warc-record-id")) for *_, h in items if h is not None], [(a, z, why) for a, z, why, h in items if h is None]

    whole = [_record(i, os.urandom(3000)) for i in range(6)]
    damaged = whole[2][:-20] + b"x" + whole[2][-19:]
    data = gzip.compress(b"".join([*whole[:2], damaged, *whole[3:]]))
    a, z = len(b"".join(whole[:2])), len(b"".join(whole[:3]))
    assert ids(data + whole[0]) == ([0, 1, 3, 4, 5, 0], [(0, len(data), f"block digest differs (bytes {a} to {z} of the member's content)")])
    data = gzip.compress(b"".join(whole))
    got, gaps = ids(data[: len(data) * 3 // 4])
    assert got == [0, 1, 2, 3] and gaps[-1] == (0, len(data) * 3 // 4, "member cut short")
    got, gaps = ids(data[:-8] + b"12345678" + warc.member(_record(9)))  # checksum
    assert got == [0, 1, 2, 3, 4, 5, 9] and gaps[-1][:2] == (0, len(data))


def test_false_starts_take_time_in_proportion():
    import time

    def seconds(n):
        began = time.perf_counter()
        items = list(warc.salvage(b"WARC/1.1\r\n" * n + _record(1)))
        assert len(items) == 2 and items[1][3]
        return time.perf_counter() - began

    assert seconds(32_000) < 20 * max(seconds(4_000), 0.01)


def test_large_members_are_read_as_they_come(monkeypatch):
    whole = [_record(i, os.urandom(3000)) for i in range(40)]
    damaged = whole[7][:-20] + b"x" + whole[7][-19:]
    content = b"".join([*whole[:7], damaged, b"junk WARC/1.0\r\n", *whole[8:]])
    packed = gzip.compress(content)
    cases = [content, packed, packed + warc.member(_record(99)), packed[: len(packed) // 2], packed[:-8] + b"12345678" + warc.member(_record(99)), warc.member(_record(1)) + gzip.compress(bytes(300_000)) + warc.member(_record(2)), gzip.compress(content + b"WARC/1.1\r\n" * 3)]

    def found(data):
        items = list(warc.salvage(data))
        return [warc._page(h.get("warc-record-id")) for *_, h in items if h is not None], sorted((a, why) for a, _, why, h in items if h is None)

    want = [found(c) for c in cases]
    monkeypatch.setattr(warc, "HELD_BYTES", 10_000)
    monkeypatch.setattr(warc, "PIECE", 5_000)
    got = [found(c) for c in cases]
    assert [g[0] for g in got] == [w[0] for w in want]
    for k in (0, 1, 2, 3, 4, 6):
        assert got[k][1] == want[k][1], k
    assert got[5][1][0][1].startswith("no version line")  # of the zeros
    monkeypatch.setattr(warc, "RECORD_BYTES", 10_000)
    large = gzip.compress(b"".join([*whole[:3], _record(50, os.urandom(20_000)), *whole[3:6]]))
    ids, gaps = found(large)
    assert ids == [0, 1, 2, 3, 4, 5] and len(gaps) == 1 and gaps[0][1].startswith("record too large")


def test_unpacked_content_is_not_held():
    import tracemalloc

    data = gzip.compress(b"".join(_record(i, bytes(50_000)) for i in range(4000)))  # 200 MB
    tracemalloc.start()
    n = sum(head is not None for *_, head in warc.salvage(data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 4000 and peak < 130 << 20


def test_files_end_by_bytes(spark):
    pages = spark.createDataFrame([(i, os.urandom(400).hex(), "x", "y") for i in range(40)], "page_id long, html string, member string, gap string").coalesce(1)
    path = fresh_path(spark, "warc-test")
    warc.write_archives(pages, path, file_bytes=2000)
    files = [f for f in os.listdir(path.removeprefix("file:")) if f.startswith("part-")]
    assert len(files) > 5
    got = warc.read_archives(spark, path).collect()
    assert sorted(r.page_id for r in got) == list(range(40)) and not any(r.gap for r in got)


@pytest.mark.parametrize(("source", "want"), [
    (None, ""), ("", ""), ("plain", "plain"), ("a<b>b</b> c", "ab c"), ("<p>one<p>two", "one\n\ntwo"), ("a<br>b", "a\nb"), ("<div>a</div><div>b</div>", "a\nb"), ("<script>x</script>a<style>y</style>", "a"),
    ("<p hidden>a</p><p style='display: none'>b</p>c", "c"), ("<!-- <p>x</p> -->y", "y"), ("&lt;&eacute;&#65;", "<éA"), ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"), ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
    ("<pre>a\n  b</pre>", "a\n  b"), ("<table><tr><td>a<td>long<tr><td>bbb<td>c</table>", "a    long\nbbb  c"), ("<table><tr><td colspan=2>wide<td>x<tr><td>a<td>b<td>y</table>", "wide  x\na  b  y"),
    ("<head><title>t</title></head><body>x", "x"), ("</p>a", "a"), ("<td>loose", "loose"), ("<details><summary>s</summary>no</details>", "s"), ("<p>a\xa0 b", "a b"), ("<a href='x>y'>k</a>", "k"), ("a < b", "a < b"), ("<blockquote>q</blockquote>z", "  q\n\nz"),
])
def test_rendering(source, want):
    got = html_text.extract(source)
    if "colspan" in (source or ""):
        assert [x.split() for x in got.split("\n")] == [x.split() for x in want.split("\n")] and got.split("\n")[0].index("x") == got.split("\n")[1].index("y")
    else:
        assert got == want


def test_rendering_never_fails_and_keeps_every_word():
    rnd = random.Random(3)
    tags = ["p", "div", "b", "ul", "li", "table", "tr", "td", "th", "ol", "span", "h1", "blockquote", "dl", "dt", "dd", "section", "tbody", "caption", "form"]
    for _ in range(400):
        out, words = "", []
        for k in range(rnd.randint(1, 40)):
            r = rnd.random()
            if r < 0.4:
                out += f"<{rnd.choice(tags)}>"
            elif r < 0.6:
                out += f"</{rnd.choice(tags)}>"
            else:
                words.append(f"w{k}q")
                out += f" w{k}q "
        got = html_text.extract(out)
        assert Counter(got.replace("- ", " ").split()) >= Counter(words), (out, got)
    assert "deep" in html_text.extract("<div>" * 5000 + "deep")
    html_text.extract("<" * 10_000 + "<a href=\"" * 100)


def test_deep_elements_stay_hidden_and_laid_out():
    got = html_text.extract("<span>" * 300 + "a<script>leak()</script><div style='display:none'>no</div><pre>x  y\n z</pre><style>.q{}</style><table><tr><td>c<td>d</table>b")
    assert got == "a\n\nx  y\n z\n\nc  d\n\nb"


@pytest.mark.parametrize(("source", "want"), [
    ("<p>\u0130\u0130\u0130\u0130\u0130\u0130\u0130\u0130</p><script>x</script>abc", "\u0130\u0130\u0130\u0130\u0130\u0130\u0130\u0130\n\nabc"), ("<script>a</SCRIPT >b</scripty>c", "bc"),
    ("<p>a<select><option>One</select>b", "ab"), ("<p>a<select><optgroup><option>One<option>Two</select>b<datalist><option>x</datalist>c", "abc"),
    ("<i>" * 400 + "<div style='display:none'>" + "<i>" * 400 + "SECRET", ""), ("a<br><br>b<br>c<br><br><br>d", "a\n\nb\nc\n\nd"),
    ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</div>d", "b\nd"), ("<div style='display:none'>a<b style='display:block;visibility:visible'>b</b></div>d", "d"),
    ("<style>.x{display:none} #y{visibility:hidden} p.z{color:red;display:none}</style><b class='w x'>a</b><b id=y>b</b><b class=z>c</b><p class=z>d</p>", "c"),
    ("<style media=print>b{display:none}</style><style>@media print{i{display:none}} @media screen{u{display:none}} /* b{display:none} */ div b{display:none}</style><b>a</b><i>b</i><u>c</u>", "ab"),
    ("<style>b{display:none} b.on{display:inline}</style><b>a</b><b class=on>b</b><b style='display:inline'>c</b>", "bc"), ("<textarea>a\n  b</textarea>c", "a\n  b\nc"),
    ("<table><tr><td rowspan=2>AA<td>B<td>C<tr><td>D<td>E</table>", "AA  B  C\n    D  E"), ("<table><tr><td>a<td rowspan=0>b<tr><td>c<tr><td>d<td>e</table>", "a  b\nc\nd     e"),
    ("<table><thead><tr><td rowspan=9>h<td>i</thead><tbody><tr><td>j<td>k</table>", "h  i\nj  k"), ("<ol><li value=7>a<li>b</ol>", "7. a\n8. b"),
])
def test_what_a_browser_shows(source, want):
    assert html_text.extract(source) == want


def test_long_cells_keep_the_columns():
    words = " ".join(f"w{i}" for i in range(60))
    got = html_text.extract(f"<table><tr><td>{words}<td>r1<tr><td>{'x' * 90}<td>r2<tr><td>c<td>r3</table>")
    lines = got.split("\n")
    at = {line.index(r) for r in ("r1", "r2", "r3") for line in lines if r in line.split()}
    assert len(at) == 1 and "x" * 90 in lines and " ".join(got.replace("r1", "").replace("r2", "").replace("r3", "").split()) == f"{words} {'x' * 90} c"
    assert len(html_text.extract("<table>" + f"<tr><td>{'y' * 5000}<td>z" * 500 + "</table>")) < 5200 * 500  # no padding by the longest word


def _tree(rnd, depth, words, shown):
    """Markup of a random tree; the words that are to be seen are appended in order."""
    out = ""
    for _ in range(rnd.randint(1, 4)):
        r = rnd.random()
        if r < 0.4 or depth > 12:
            words.append(w := f"w{len(words)}q" if shown[0] and shown[1] else None)
            out += f" {w or 'hidden'} "
            continue
        display, state, attribute = shown[0], shown[1], ""
        k = rnd.random()
        if k < 0.1:
            display, attribute = False, rnd.choice([" hidden", " style='display : NONE'", " class='gone a'"])
        elif k < 0.2:
            state, attribute = False, " style='color:red; visibility:hidden'"
        elif k < 0.3:
            state, attribute = True, rnd.choice([" style='visibility:visible'", " id=seen"])
        tag = rnd.choice(["div", "span", "b", "section", "ul", "blockquote", "article"])
        out += f"<{tag}{attribute}>{_tree(rnd, depth + 1, words, (display, state))}</{tag}>"
    return out


def test_random_trees_show_what_is_visible():
    rnd = random.Random(12)
    for _ in range(300):
        words: list = []
        body = _tree(rnd, 0, words, (True, True))
        wrapped = "<u>" * 250 + body if rnd.random() < 0.2 else body
        got = html_text.extract("<style>.gone{display:none}#seen{visibility:visible}</style>" + wrapped)
        assert got.split() == [w for w in words if w], body


def test_random_tables_keep_their_columns():
    rnd = random.Random(13)
    for _ in range(300):
        rows, source = [], "<table>"
        for r in range(rnd.randint(1, 6)):
            source += "<tr>"
            rows.append([])
            for c in range(rnd.randint(0, 5)):
                wide, down = (rnd.choice([1, 1, 1, 2, 3]) for _ in range(2))
                rows[-1].append((f"r{r}c{c}" + "x" * rnd.randint(0, 9), wide, down))
                source += f"<td colspan={wide} rowspan={down}>{rows[-1][-1][0]}"
        used, begins = set(), {}
        for r, cells in enumerate(rows):  # the grid, square by square
            c = 0
            for name, wide, down in cells:
                while (r, c) in used:
                    c += 1
                begins[name] = (r, c)
                used |= {(r + i, c + k) for i in range(down) for k in range(wide)}
                c += wide
        got = html_text.extract(source + "</table>").split("\n")
        assert " ".join(got).split() == [n for cells in rows for n, *_ in cells]
        at: dict = {}
        for name, (_, c) in begins.items():
            at.setdefault(c, set()).add(next(line.index(name) for line in got if name in line.split()))
        assert all(len(x) == 1 for x in at.values()), (source, got)
        assert [min(at[c]) for c in sorted(at)] == sorted(min(at[c]) for c in at)


def test_pages_through_spark(spark):
    html = "<p>one<table><tr><td>a<td>b</table>"
    rows = [(1, html, "x"), (1, html, "x"), (None, html, None), (2, None, None), (3, "", None), (4, "<b>" + "long text " * 60_000, None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string").withColumnRenamed("text", "n_chars")
    got = Counter((r.page_id, r.text) for r in html_text.extract_pages(df).collect())
    assert got == Counter((i, html_text.extract(h)) for i, h, _ in rows) and len(max((t for _, t in got), key=len)) == len("long text " * 60_000) - 1


def test_rendering_takes_time_in_proportion():
    import time

    def seconds(n):
        began = time.perf_counter()
        html_text.extract("<p><table><tr><td>" + "<span>" * n + "<div>x" * n + "<b class=k>" * n)
        return time.perf_counter() - began

    assert seconds(8000) < 20 * max(seconds(2000), 0.01)


def test_near_vectors_against_all_pairs(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(30, 8))
    rows = [(i, (base[i % 30] + rnd.normal(size=8) * (0.15 if i >= 30 else 0)).tolist()) for i in range(150)]
    rows += [(150, rows[0][1]), (151, rows[0][1]), (152, None), (153, [0.0] * 8), (154, [float("nan")] * 8), (155, [None] * 8), (156, [1.0, 2.0]), (157, [2.0, 4.0]), (158, []), (159, [1e300] * 8), (160, [float("inf")] + [1.0] * 7), (None, [5.0, 1.0, 9.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, node int, cell int")
    good = {i: np.array(v) / max(map(abs, v)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    near = {a: [b for b in good if b != a and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.9] for a in good}
    label = {i: i for i, _ in rows}
    key = lambda i: (i is None, i or 0)
    while (new := {i: min([label[i], *(label[b] for b in near.get(i, []))], key=key) for i in label}) != label:
        label = new
    for block, nearest in ((1024, 3), (16, 64)):
        got = embedding_dedup.near_groups(df, cell=20, block=block, nearest=nearest).collect()
        assert len(got) == len(rows)
        assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(i, len(near.get(i, [])), label[i], label[i] == i) for i in label}
    assert embedding_dedup.near_groups(df.limit(0)).count() == 0


def _toxic_table(n, seed=1):
    rnd = random.Random(seed)
    plain, rude = [f"w{i}" for i in range(400)], ["vile", "scurvy", "rotten"]
    docs, labels = [], []
    for i in range(n):
        bad = rnd.random() < 0.25
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))]
        for _ in range(rnd.randint(2, 4) if bad else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(rude))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = _toxic_table(600)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(d, spark.createDataFrame([(i, 0, t) for i, t in labels], "doc_id long, quality int, toxic int")).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == set(held)
    assert sum(got[i].predicted == t for i, t in labels if i in held) >= 0.98 * len(held)
    # labels of held-out rows change nothing
    flipped = [(i, 0, 1 - t if i in held else t) for i, t in labels]
    again = {r.doc_id: r.score for r in toxicity.score(d, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_toxicity_of_edge_rows(spark):
    e = spark.createDataFrame(EDGES, SCHEMA.format(extra="score"))
    for labels in ([], [(1, 0, 1)], [(1, 0, None), (99, 1, 1)], [(1, 0, 0), (9, 1, 1), (9, 1, 0), (None, 0, 1)]):
        rows = toxicity.score(e, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
        assert toxicity.score(e.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
        kept = toxicity.drop_toxic(e, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert kept.columns == e.columns and kept.count() == sum(not r.predicted for r in rows)


def _kneser_ney(texts, train, strength):
    """P_c(w | v) by order 1 and 2, straight from the definition."""
    cut = lambda t: toxicity.words(pa.array([t]))[0].as_py() if toxicity.words(pa.array([t]))[0].as_py() != [""] else []
    n = Counter(w for t in texts for w in cut(t))
    n_p, types = Counter(), Counter()
    for w, k in n.items():
        n_p[w[:5]] += k
        types[w[:5]] += 1
    models = []
    for c in (0, 1):
        pair = Counter((v, w) for t, y in train if y == c for v, w in zip([None, *cut(t)], cut(t)))
        models.append((pair, Counter(w for _, w in pair), Counter(v for v, _ in pair)))
    known = {w for m in models for w in m[1]}

    def p(c, v, w, order):
        if not any(x[:5] == w[:5] for x in known):
            return 1.0  # neither model tells about it
        pair, before, after = models[c]
        begun = Counter(x[:5] for x in before)
        share = types[w[:5]] / len(n)
        part = n[w] / n_p[w[:5]] if w in known else 1.0
        d, t = 0.75, strength
        base = (max(begun[w[:5]] - d, 0) + (d * len(begun) + t * len(before)) * share) / ((1 + t) * len(before))
        alone = (max(before[w] - d, 0) + (d * len(before) + t * len(pair)) * base * part) / ((1 + t) * len(pair))
        total = sum(k for (a, _), k in pair.items() if a == v)
        if order == 1 or not total:
            return alone
        return (max(pair[v, w] - d, 0) + (d * after[v] + t * total) * alone) / ((1 + t) * total)

    return p, cut


def test_models_against_the_definition(spark):
    rnd = random.Random(8)
    stock = ["vile", "vilest", "vilely", "mild", "mildly", "so", "É", "straße", "x1y"]
    make = lambda k: " ".join(rnd.choice(stock[:k]) for _ in range(rnd.randint(0, 9)))
    train = [(make(9 if i % 3 else 4), int(i % 3 == 0)) for i in range(30)] + [(None, 0), ("", 1), ("12 --", 1)]
    texts = [t for t, _ in train] + ["unseen vilified words so mild", "mildewed so so", None, "VILE!", "novel"]
    model = toxicity.count(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(train, "text string, toxic int"))
    for strength in (0.25, 4.0):
        p, cut = _kneser_ney(texts, train, strength)
        for order in (1, 2):
            for share in (0.03, 1.0):
                got = model.evidence(pa.array(texts, pa.string()), [(order, strength, share)])[:, 0]
                for x, t in zip(got, texts, strict=True):
                    ws = cut(t)
                    ratios = [p(1, v, w, order) / p(0, v, w, order) for v, w in zip([None, *ws], ws)]
                    assert x == pytest.approx(sum(np.log(1 - share + share * r) for r in ratios) / max(len(ws), 1), abs=1e-9)
    p, _ = _kneser_ney([t for t, _ in train], train, 1.0)
    vocabulary = {w for t, _ in train for w in cut(t)}
    for c in (0, 1):  # each context's probabilities sum to one over all words
        assert sum(p(c, "so", w, 2) for w in vocabulary) == pytest.approx(1.0) and sum(p(c, None, w, 1) for w in vocabulary) == pytest.approx(1.0)


def test_every_toxic_expression_counts_at_every_size(spark):
    rnd = random.Random(5)
    docs, labels = [], []
    for i in range(6000):
        bad = i % 10 == 0
        words = [f"w{chr(97 + rnd.randrange(20))}{chr(97 + rnd.randrange(20))}" for _ in range(12)] + (["vile"] if bad and i % 20 else []) + ([f"rare{chr(97 + i // 20 % 20)}{'xyz'[i // 400 % 3]}"] if bad else [])
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    scorer = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int")).value
    assert scorer.b > 0
    rare = [f"rare{chr(97 + k)}{x}" for k in range(20) for x in "xyz"]
    assert (scorer.model.evidence(pa.array(rare), [(1, 0.25, 1.0)])[:, 0] > 0.5).all()  # each in few toxic rows and no other
    assert scorer.model.evidence(pa.array(["rarest"]), [(1, 0.25, 1.0)])[0, 0] > 0  # unseen: by its beginning
    assert (scorer.scores(pa.array(["wab " * 12 + x for x in rare])) > scorer.scores(pa.array(["wab " * 13]))[0]).all()


def _stage_rows(extras):
    rnd = random.Random(21)
    stock = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for i in range(120):
        words = [rnd.choice(stock) for _ in range(rnd.randint(20, 60))]
        if i % 4 == 0:
            words[::7] = ["scurvy"] * len(words[::7])
        text = rnd.choice([" ", "\n", "  "]).join(words)
        rows.append((i, text, "en", "ab"[i % 2], len(text), 1))
        if i % 5 == 1:
            rows.append((1000 + i, text, "de", "b", len(text), 2))  # a copy
        if i % 6 == 1:
            words[len(words) // 2] = "other"
            rows.append((2000 + i, " ".join(words), "en", None, 0, 3))  # a near copy
    rows += [(3000, None, None, None, None, None), (3001, "", "en", "a", 0, 1), (None, "text without an id and some more words", "fr", "c", 1, 1)] + [(3002, "twice the same row of the table", "en", "a", 5, 1)] * 2
    rows = [(*r, *[r[-1]] * (len(extras) - 1)) for r in rows]
    return rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} int" for x in extras)


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline as cp
    from sluice.llm import pieces

    rows, schema = _stage_rows(["row", "_id", "_sha", "_hash", "_words", "_pieces", "_source", "key", "sha", "own", "id", "node", "times"])
    docs = spark.createDataFrame(rows, schema)
    labels = [(r[0], 0, int(r[0] % 4 == 0)) for r in rows if r[0] is not None and r[0] < 120]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    clean = cp.drop_toxic(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    stay, left = Counter(r for r in rows if "scurvy" not in (r[1] or "")), Counter(map(tuple, clean.collect()))
    assert not left - stay and (stay - left).total() <= 2  # few rows to learn from
    assert cp.drop_toxic(spark, docs.limit(0), str(tmp_path)).count() == 0
    rows = [r for r in rows if "scurvy" not in (r[1] or "")]
    docs = spark.createDataFrame(rows, schema)
    once = cp.drop_copies(spark, docs, "")
    best = {}
    for i, t, *_ in rows:
        best[t or ""] = max([i, best.get(t or "")], key=lambda x: (x is not None, x))
    got = once.collect()
    assert once.columns == docs.columns and Counter((r.doc_id, r.text or "") for r in got) == Counter((i, t) for t, i in best.items()) and {tuple(r) for r in got} <= set(rows)
    rows = [tuple(r) for r in got]
    docs = spark.createDataFrame(rows, schema)
    near = cp.drop_near_copies(spark, docs, "")
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t, *_ in rows}
    fps = {i: simhash.fingerprint(t, 5) for i, t, *_ in rows}
    label = {i: i for i in sets}
    low = lambda *x: min(x, key=lambda v: (v is None, v))
    linked = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 7 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    while (new := {a: low(label[a], *(label[b] for b in sets if b != a and linked(a, b))) for a in sets}) != label:
        label = new
    got = near.collect()
    assert near.columns == docs.columns and {tuple(r) for r in got} == {r for r in rows if label[r[0]] == r[0]} and len(got) < len(rows)
    rows = [tuple(r) for r in got]
    docs = spark.createDataFrame(rows, schema)
    mixed = cp.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns
    whole, got = {r[0]: r for r in rows}, mixed.collect()
    for r in got:
        was = whole[r.doc_id]
        assert (r.lang, r.source, r[5]) == (was[2], was[3], was[5]) and r.n_chars == len(r.text) and r.text.split() and len(r.text) <= len(was[1])
    assert max(Counter(r.doc_id for r in got).values()) <= 3 and any(r.text == whole[r.doc_id][1] for r in got)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    out = cp.encode_pieces(spark, spark.createDataFrame([tuple(r) for r in got], schema), "")
    assert Counter((r.doc_id, r.n_tokens) for r in out.collect()) == Counter((r.doc_id, len(library.encode(r.text))) for r in got)
    for stage in (cp.drop_copies, cp.drop_near_copies, cp.mix_sources, cp.encode_pieces):
        assert stage(spark, docs.limit(0), "").count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_pipeline_runs_its_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing sources", "SentencePiece"]
    for _, stage in cp.STAGES:
        before, docs = docs.columns, stage(spark, docs, DATA)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == before or stage is cp.STAGES[-1][1]
    assert Counter(map(tuple, cp.run(spark, DATA).collect())) == Counter(map(tuple, docs.collect()))


def test_style_sheets_never_fail():
    deep = "@media screen{" * 5000 + ".a{display:none}"
    assert html_text.extract(f"<style>{deep}</style><p class=a>no<p>yes") == "yes"
    assert html_text.extract("<style>" + "a{" * 3000 + "}" * 4000 + ".b{display:none}</style><p class=b>no<p>yes") == "yes"
    assert html_text.extract("<style>@media print{.a{display:none}}@media screen{.b{display:none}.c{color:red;.d{display:none}}}.e{display:none;x{y:z}</style><p class=a>1<p class=b>2<p class=c>3<p class=d>4<p class=e>5") == "1\n\n3\n\n4"
    rnd = random.Random(11)
    for _ in range(500):
        css = "".join(rnd.choice(["{", "}", ";", ".a", "#b", "@media ", "screen", "print", "not ", "display:none", "visibility:hidden", "/*", "*/", "<!--", ",", " ", "p", "\n"]) for _ in range(rnd.randrange(60)))
        assert isinstance(html_text.extract(f"<style>{css}</style><p class=a id=b>text"), str)


@pytest.mark.parametrize(("source", "want"), [
    ("a   b　c \t\n d ", "a   b　c d "), ("<table><tr><td>a b<td>c", "a b  c"), ("<pre>a \n b </pre>", "a \n b"),
    ("<html style='display:none'>gone", ""), ("<html style='visibility:hidden'>gone<p style='visibility:visible'>seen", "seen"), ("<p>a<html hidden>", ""), ("<body class=x><p>a<body hidden>b", ""), ("<style>.x{display:none}</style><html class=x><p>a", ""),
    ("<ruby>a<rp>(</rp><rt>b</rt><rp>)</rp></ruby>", "ab"), ("he said <q>so it is</q>.", "he said “so it is”."), ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"), ("<ol reversed start=9><li>a<li>b</ol>", "9. a\n8. b"),
])
def test_spaces_roots_and_quotes(source, want):
    assert html_text.extract(source) == want
