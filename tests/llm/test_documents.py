"""Operators on documents: the edge rows against brute force, and empty tables."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from llm_rows import CLASHING, EDGES
from sluice.llm import exact_dedup, mixing, pieces, sharding, simhash, suffix_dedup
from sluice.llm.components import components

ALL = pytest.mark.parametrize("extra", CLASHING[:3])


def test_empty_tables(no_docs):
    for out in (
        exact_dedup.exact_groups(no_docs), simhash.near_groups(no_docs), sharding.assign(no_docs), mixing.mix(no_docs)["documents"], mixing.mix(no_docs)["slots"], pieces.digests(no_docs), suffix_dedup.remove_repeats(no_docs),
        exact_dedup.drop_copies(no_docs), simhash.drop_near_copies(no_docs), simhash.drop_near_copies(no_docs, similarity=0.8), mixing.mixed_documents(no_docs), pieces.encode(no_docs),
    ):
        assert out.count() == 0


@ALL
def test_exact_groups(edge_docs, extra):
    rows = exact_dedup.exact_groups(edge_docs[extra]).collect()
    assert len(rows) == len(EDGES)
    texts: dict[str, list] = {}
    for i, t, *_ in EDGES:
        texts.setdefault(t or "", []).append(i)
    want = Counter()
    for t, ids in texts.items():
        best = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows) == want
    assert sorted(exact_dedup.drop_copies(edge_docs[extra]).columns) == sorted(edge_docs[extra].columns)
    assert exact_dedup.drop_copies(edge_docs[extra]).count() == len(texts)


@pytest.mark.parametrize("capacity", [1, 3])
def test_directory_splits_only_overfull_buckets(spark, capacity):
    rnd = random.Random(9)
    keys = sorted({rnd.getrandbits(64) for _ in range(40)} | {(7 << 60) + i for i in range(9)} | {(1 << 64) - 1, (1 << 64) - 2, 0})
    inside = lambda bits, depth: [k for k in keys if k >> (64 - depth) == bits]
    count = lambda halves: [len(inside(*b)) for b in halves]
    want = exact_dedup.grow(count, len(keys), capacity)
    assert sum(1 << (64 - d) for _, d in want) == 1 << 64  # the buckets cover all keys
    for bits, depth in want:
        assert len(inside(bits, depth)) <= capacity or depth == 64
        assert depth == 0 or len(inside(bits >> 1, depth - 1)) > capacity  # no split without need
    signed = [(k - (1 << 64) if k >> 63 else k,) for k in keys]
    df = spark.createDataFrame(signed, "h long")
    assert exact_dedup._directory(df, capacity) == want
    starts = exact_dedup._starts(want)
    for k, at in zip(keys, exact_dedup._bucket(starts, np.array(keys, np.uint64).view(np.int64)), strict=True):
        assert k in inside(*want[at])


def test_exact_groups_of_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HELD", 100)
    docs = [(i, f"text {i % 37}" if i % 3 else "hot") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("id", F.lit(2))
    got = exact_dedup.exact_groups(df, capacity=2).collect()
    best, size = {}, Counter(t for _, t in docs)
    for i, t in docs:
        best[t] = max(best.get(t, -1), i)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == Counter((i, best[t], size[t]) for i, t in docs)
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(best.values())


def _fingerprint(text, width):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t", "one", "one two", "One TWO three four one two three", "É x \x0b y z é", "a b " * 5000])
@pytest.mark.parametrize("width", [3, 5])
def test_fingerprint(text, width):
    assert simhash.fingerprint(text, width) == _fingerprint(text, width)


def _components(fps, bits):
    label = {f: f for f in fps}
    order = sorted(fps)
    for _ in order:
        new = {a: min(label[b] for b in order if (a ^ b).bit_count() <= bits) for a in order}
        if new == label:
            return label
        label = new
    return label


@ALL
def test_near_groups(edge_docs, extra):
    rows = simhash.near_groups(edge_docs[extra], width=3).collect()
    fp = {(i, t): _fingerprint(t, 3) for i, t, *_ in EDGES}
    label = _components(set(fp.values()), 3)
    least = {}
    for (i, _), f in fp.items():
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    want = Counter((i, f"{fp[i, t]:016x}", least.get(label[fp[i, t]])) for i, t, *_ in EDGES)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == want


@pytest.mark.parametrize("bits", [3, 7])
@pytest.mark.parametrize("limit", [1 << 16, 5])
def test_links_of_dense_groups(spark, bits, limit):
    rnd = random.Random(2)
    fps = {rnd.getrandbits(64) for _ in range(20)}
    for b in list(fps)[:4]:
        for _ in range(25):
            x = b
            for _ in range(rnd.randint(1, 4)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    got = {(r.node, r.component) for r in components(simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), bits, limit)).collect()}
    near = {a: [b for b in signed if ((a ^ b) & (2**64 - 1)).bit_count() <= bits] for a in signed}
    label = {a: a for a in signed}
    while (new := {a: min(label[b] for b in near[a]) for a in signed}) != label:
        label = new
    assert got == {(a, label[a]) for a in signed if len(near[a]) > 1}


def _near_by_text(docs, width, bits, least):
    """Groups of rows whose texts are within the bits and the Jaccard of shingles, chained: id -> least id."""
    sets, fps = {}, {}
    for _, t in docs:
        w = (t or "").lower().split()
        sets[t or ""] = {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()
        fps[t or ""] = _fingerprint(t, width)
    link = lambda a, b: a == b or ((fps[a] ^ fps[b]).bit_count() <= bits and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9)
    group = {t: {t} for t in sets}
    for a in sets:
        for b in sets:
            if group[a] is not group[b] and link(a, b):
                group[a] |= group[b]
                for t in group[b]:
                    group[t] = group[a]
    least_of = {id(g): min((i for i, t in docs if (t or "") in g and i is not None), default=None) for g in group.values()}
    return [(i, least_of[id(group[t or ""])]) for i, t in docs]


@pytest.mark.parametrize("block", [(1 << 15, 1 << 22), (100, 1 << 22), (100, 200)])
def test_near_groups_by_similarity(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", block)
    rnd = random.Random(6)
    docs = []
    for i in range(30):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(5, 120))]
        for _ in range(rnd.randint(1, 6)):
            docs.append((len(docs) * 3 % 101 + 1, " ".join(words)))
            words = [w if rnd.random() > 0.02 else "new" for w in words]
    docs += [(500, None), (501, ""), (501, ""), (None, docs[0][1]), (None, "alone here"), (7, "some other text of its own"), (7, docs[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("sha", F.lit(1)).withColumn("node", F.lit(2))
    want = _near_by_text(docs, 5, 7, 0.8)
    got = simhash.near_groups(df, bits=7, similarity=0.8).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter(want)
    kept = simhash.drop_near_copies(df, bits=7, similarity=0.8)
    assert kept.columns == df.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(i for i, _ in rows if i is not None) == sorted({g for _, g in want if g is not None}) and len(rows) == len({g for _, g in want})
    of = dict(zip(((i, t or "") for i, t in docs), (g for _, g in want), strict=True))
    assert all(of[i, t or ""] == i for i, t in rows)  # the row that stays is of the group it names
    assert simhash.near_groups(df.limit(0), bits=7, similarity=0.8).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (3, 4)]
    got = {(r.node, r.component) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(51)} | {(100 + i, 100) for i in range(40)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@ALL
@pytest.mark.parametrize("shards", [1, 2, 16, 1000])
def test_jump_shards(edge_docs, extra, shards):
    rows = sharding.assign(edge_docs[extra], shards, parts=3).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        key = (r.doc_id or 0) & (2**64 - 1)
        assert (r.shard, r.grown_shard, r.law) == (_jump(key, shards), _jump(key, shards + 1), "key")
        assert r.grown_shard in (r.shard, shards)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in EDGES)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def test_jump_of_large_and_negative_keys(spark):
    keys = [-1, -(2**63), 2**63 - 1, 0, 10**18]
    docs = spark.createDataFrame([(k, "x") for k in keys], "doc_id long, text string")
    assert {r.doc_id: r.shard for r in sharding.assign(docs, 16).collect()} == {k: _jump(k & (2**64 - 1), 16) for k in keys}


def _targets(sizes, weights, most):
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        rest = total - sum(stopped.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return {**stopped, **share}
        stopped |= {s: most * sizes[s] for s in over}


def _words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@ALL
def test_mix(edge_docs, extra):
    made = mixing.mix(edge_docs[extra], block=4)
    rows = made["documents"].collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, _words(t)) for i, t, *_ in EDGES)
    sizes: dict = {}
    for _, t, _, s, *_ in EDGES:
        sizes[s] = sizes.get(s, 0) + _words(t)
    want = _targets(sizes, (5, 2, 1), 3)
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
    for s, n in sizes.items():
        assert sum(r.taken for r in rows if r.source == s) == pytest.approx(want[s], abs=8)
    again = mixing.mix(edge_docs[extra], block=4)["documents"].collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    slots = made["slots"].collect()
    for shard in {x.shard for x in slots}:
        assert sorted(x.slot for x in slots if x.shard == shard) == list(range(sum(x.shard == shard for x in slots)))


def test_permutations_of_indices(spark):
    for n in (1, 2, 3, 10, 97, 256):
        for key in (3, 4):
            got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(key))).collect()]
            assert sorted(got) == list(range(n))
            assert n < 90 or sum(abs(a - b) == 1 for a, b in zip(got, got[1:])) < 12


def test_mixed_texts_hold_what_was_taken(spark):
    rnd = random.Random(4)
    space = lambda: rnd.choice([" ", "\n\n", "\t- ", "  "])
    docs = [(i, rnd.choice(["", "\n "]) + "".join(f"d{i}w{k}" + space() for k in range(rnd.randint(0, 90))), "en", rnd.choice("abc"), 0, "x") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, row string")
    taken = {r.doc_id: r.taken for r in mixing.mix(df)["documents"].collect()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    texts: dict = {}
    for r in out.collect():
        assert r.n_chars == len(r.text) and r.row == "x"
        texts.setdefault(r.doc_id, []).append(r.text)
    assert {i for i in texts} == {i for i, n in taken.items() if n}
    whole = {i: t for i, t, *_ in docs}
    for i, several in texts.items():
        assert sum(len(t.split(" ")) > 0 and _words(t) for t in several) == taken[i] and len(several) <= 3
        for t in several:
            names = [w for w in t.replace("-", " ").split()]
            assert len(set(names)) == len(names)  # nothing stands twice in a text
            assert names == [w for w in whole[i].replace("-", " ").split() if w in names]
            assert _words(t) < _words(whole[i]) or t == whole[i]
    same = spark.createDataFrame([(1, "a b\nc", "en", "s", 5)] * 2 + [(None, "x  y", "en", None, 4), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mixed_documents(same, block=1).collect()
    assert {r.text for r in got} <= {"a b\nc", "x  y"} and Counter(r.text for r in got)["a b\nc"] >= 2


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_pieces_as_the_library_has_them(library):
    model, rnd = pieces.load(pieces.default_model()), random.Random(1)
    parts = ["a", "b", " ", "  ", "the", "er", "\n", "▁", "é", "ü", "日", "中", "😀", ".", ",", "\t", " " * 20, "\x00", "<s>", "<0x0A>", "ing", "12", "�", "hello", "́", "²"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        ids = library.encode(t)
        assert model.encode(t) == ids and model.decode(ids) == library.decode(ids)
    for _ in range(500):
        ids = [rnd.randrange(3, 32000) if rnd.random() < 0.6 else rnd.randrange(3, 259) for _ in range(8)]
        assert model.decode(ids) == library.decode(ids)


@ALL
def test_piece_digests(edge_docs, extra, library):
    want = Counter()
    for i, t, *_ in EDGES:
        ids = library.encode(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(edge_docs[extra]).collect()) == want


def _brute(rows):
    seen, out = {}, {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            else:
                seen[w] = 1
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("many", [128, 3])
def test_repeats_against_all_windows(spark, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    rnd = random.Random(5)
    base, rows = "".join(rnd.choice("abc ") for _ in range(2000)), []
    for i in range(120):
        k, a = rnd.random(), rnd.randint(0, 1800)
        if k < 0.3:
            t = base[a : a + rnd.randint(0, 400)]
        elif k < 0.5:
            t = "x" * rnd.randint(0, 150) + base[a : a + rnd.randint(90, 300)] + "é" * rnd.randint(0, 80)
        elif k < 0.8:
            t = "".join(rnd.choice("pq") for _ in range(rnd.randint(0, 20))) + base[500 : 500 + rnd.randint(100, 120)] + "".join(rnd.choice("pq") for _ in range(rnd.randint(0, 120)))
        else:
            t = rnd.choice(["", "ab" * 200, "z" * 1000, base[:100], base[:99], base, None])
        rows.append((i, t))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == _brute(rows)


def _stages(spark):
    """What each stage that is known wrote to shuffles and tables, in bytes."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(x := stages.apply(i)).stageId(): x.shuffleWriteBytes() + x.outputBytes() for i in range(stages.size())}


def test_passages_of_very_many_texts_are_not_multiplied_on_disk(spark, tmp_path):
    """Around each of their anchors many windows have to be told apart; that must not take a row for each, again and again."""
    rnd = random.Random(8)
    prose = lambda n: "".join(rnd.choice("etaoin shrdlu") for _ in range(n))
    passage = prose(160)
    rows = [(i, prose(rnd.randint(60, 120)) + passage[rnd.randint(0, 9) :] + prose(rnd.randint(60, 120))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs.write.parquet(str(tmp_path / "in"))
    before = max(_stages(spark))
    suffix_dedup.remove_repeats(spark.read.parquet(str(tmp_path / "in"))).write.parquet(str(tmp_path / "out"))
    written = sum(x for k, x in _stages(spark).items() if k > before)
    assert written < 6 * sum(len(t) for _, t in rows)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == _brute(rows)


def _gone_here(rows, size):
    """Removed bytes of each document, by the steps of op2 in this process, where its limits can be set."""
    whole = pa.table({"doc": [i for i, _ in rows], "text": [t for _, t in rows]})
    step = lambda f, t, *by: pa.Table.from_batches(list(f(iter((t.sort_by([(c, "ascending") for c in by]) if by else t).to_batches(size)))))
    settled = step(suffix_dedup._settle, step(suffix_dedup._find, whole), "key", "context", "stop", "doc", "place").to_pylist()
    wants = {}
    for r in settled:
        if r["kind"] in (suffix_dedup.SORT, suffix_dedup.HOT):
            wants.setdefault(r["doc"], []).append(r)
    assert {w["kind"] for x in wants.values() for w in x} == {suffix_dedup.SORT, suffix_dedup.HOT}
    around = pa.table({"doc": list(wants), "text": [dict(rows)[i] for i in wants], "wants": list(wants.values())})
    gone = step(suffix_dedup._sorted, step(suffix_dedup._spots, around), "kind", "key", "doc", "place").to_pylist()
    gone += [{"doc": r["doc"], "start": r["place"], "stop": r["stop"]} for r in settled if r["kind"] == suffix_dedup.GONE]
    out = {i: set() for i, _ in rows}
    for r in gone:
        out[r["doc"]].update(range(r["start"], r["stop"]))
    return {i: len(x) for i, x in out.items()}


@pytest.mark.parametrize(("held", "size", "seed"), [(20_000, 10_000, 1), (20_000, 40, 2), (30, 40, 3), (5, 7, 4)])
def test_windows_around_anchors_of_many_contexts(monkeypatch, held, size, seed):
    """Which anchors stand in a window depends on what is around it, but for its least-hashed one; and groups of strips are
    folded as they are read."""
    monkeypatch.setattr(suffix_dedup, "MANY", 3)
    monkeypatch.setattr(suffix_dedup, "HELD", held)
    rnd = random.Random(seed)
    bases, rows = ["".join(rnd.choice("ab ") for _ in range(700)) for _ in range(3)], []
    for i in range(300):
        parts = []
        for _ in range(rnd.randint(1, 3)):
            a, base = rnd.randint(0, 600), rnd.choice(bases)
            parts += ["".join(rnd.choice("ab ") for _ in range(rnd.choice([0, 1, 2, 3, 40]))), base[a : a + rnd.randint(60, 260)]]
        if len(t := "".join(parts)) >= 100:
            rows.append((i, t))
    rows += [(1000, "y" * 300), (1001, "y" * 101 + bases[0][:99]), (1002, bases[0][:100] + "y" * 100)]
    assert _gone_here(rows, size) == {i: x[1] for i, x in _brute(rows).items()}


def test_shuffle_files_of_a_kept_table_can_go_at_once(spark):
    from sluice.tables import CLEANUP, keep

    def shuffled():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {name for i in range(blocks.size()) if (name := blocks.apply(i).name()).startswith("shuffle")}

    was, before = spark.conf.get(CLEANUP), shuffled()
    kept = keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts", free=True)
    for _ in range(100):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(CLEANUP) == was
    assert {r["k"]: r["count"] for r in kept.collect()} == {k: 143 if k < 6 else 142 for k in range(7)}


@ALL
def test_repeats_of_edge_rows(edge_docs, extra):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(edge_docs[extra]).collect())
    want = _brute(list(dict.fromkeys((i, t) for i, t, *_ in sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0)))))
    assert got == Counter((i, *want[i][:3]) for i, *_ in EDGES)


def test_deep_shallow_orders_as_sorting_does():
    rnd = random.Random(3)
    for _ in range(60):
        n = rnd.randint(1, 40)
        group = np.array([rnd.randint(0, 3) for _ in range(n)])
        s = [bytes(rnd.choice(b"ab") for _ in range(rnd.choice([100, 100, 50, 7]))) if rnd.random() < 0.5 else b"a" * rnd.randint(0, 100) for _ in range(n)]
        order, common = suffix_dedup.deep_shallow(group, s, 0, 100)
        assert sorted(order.tolist()) == list(range(n))
        for k in range(1, n):
            a, b = order[k - 1], order[k]
            lcp = next((j for j in range(min(len(s[a]), len(s[b]))) if s[a][j] != s[b][j]), min(len(s[a]), len(s[b])))
            assert common[k] == (lcp if group[a] == group[b] else -1)


ORACLE_SIZE = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(ORACLE_SIZE), reason="no tables")
def test_many_buckets_and_cells_at_the_size_of_the_oracle(spark):
    """The registered queries have one bucket and one cell there; with smaller ones the results are the same."""
    from oracle import connect, rows_of, rows_of_sql
    from sluice.llm import embedding_dedup
    from sluice.tables import table

    con, docs = connect(ORACLE_SIZE), table(spark, ORACLE_SIZE, "documents")
    keys = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct()
    directory = exact_dedup._directory(keys, 16)
    assert len(directory) > 40 and len({depth for _, depth in directory}) > 1
    assert rows_of(exact_dedup.exact_groups(docs, capacity=16)) == rows_of_sql(con, exact_dedup.ORACLE)
    vectors = table(spark, ORACLE_SIZE, "embeddings")
    assert rows_of(embedding_dedup.near_groups(vectors, cell=25, block=16)) == rows_of_sql(con, embedding_dedup.ORACLE)


def test_owners_hold_ranges_of_keys(spark):
    docs = spark.createDataFrame([(i, f"text {i % 300}") for i in range(900)], "doc_id long, text string")
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("sha"), "text")
    index, _ = exact_dedup.build_index(rows, rows.select("h").distinct(), 8)
    by_file = index.select(F.input_file_name().alias("file"), F.expr("shiftrightunsigned(h, 1)").alias("k")).groupBy("file").agg(F.min("k").alias("low"), F.max("k").alias("high")).orderBy("low").collect()
    assert len(by_file) == 4 and all(a.high < b.low for a, b in zip(by_file, by_file[1:], strict=False))
