"""op11: windows of 50 words against brute force, whichever way they take through the buckets."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_rows import CLASHING, EDGES
from sluice.llm import substring_dedup


def brute(docs, window=50):
    """docs: (id, text), ids not null and unique."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def _corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "日本", "\x00", "a b"]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.choice([49, 50, 51, 80, 130]))] for _ in range(6)]
    hot = ["the"] * 70
    docs = []
    for i in range(120):
        parts = []
        for _ in range(rnd.randrange(5)):
            kind = rnd.randrange(4)
            parts += rnd.choice(passages) if kind == 0 else hot[: rnd.randrange(71)] if kind == 1 else [rnd.choice(vocabulary) for _ in range(rnd.randrange(90))] if kind == 2 else rnd.choice(passages)[rnd.randrange(30) :]
        docs.append((i * 3 - 50, rnd.choice(["", " ", "\n"]) + rnd.choice([" ", "  ", "\t", "\r\n"]).join(parts)))
    docs += [(1000 + i, docs[40][1]) for i in range(15)] + [(2000, None), (2001, ""), (2002, " ".join(["x"] * 5000)), (2003, " ".join(["x"] * 5000))]
    return docs


@pytest.mark.parametrize(("rows", "chunk"), [(4096, 4 << 20), (3, 200), (1, 1), (40, 1000)])
def test_against_brute_force(spark, rows, chunk):
    docs = _corpus(rows)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("key", F.lit(1)).withColumn("place", F.lit("x"))
    want = brute(docs)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in substring_dedup.remove_repeats(df, rows=rows, chunk=chunk).collect()}
    assert sum(x[1] for x in want.values()) > 3000 and got == want


def test_crowded_buckets_are_cut_to_whole_windows(spark):
    """One minimiser in all texts, and one window of sixty-word texts too: more strings than a task may sort."""
    rnd = random.Random(5)
    head = [f"h{i}" for i in range(40)]
    docs = [(i, " ".join([f"a{rnd.randrange(3)}" for _ in range(10)] + head + [f"b{rnd.randrange(3)}" for _ in range(10)])) for i in range(200)]
    docs += [(1000 + i, " ".join(head + [f"c{i % 2}"] * 10)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in substring_dedup.remove_repeats(df, rows=2, chunk=1).collect()}
    assert got == brute(docs)


def test_super_kmers_cover_each_window_once():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(200))).encode() for _ in range(40)]
    w = substring_dedup.Words(texts)
    for run in substring_dedup.RUNS:
        text, start, words, key = w.super_kmers(run)
        spans = sorted((t, s - w.start[t], s - w.start[t] + n - 49) for t, s, n in zip(text.tolist(), start.tolist(), words.tolist(), strict=True))
        assert [(t, k) for t, a, z in spans for k in range(a, z)] == [(t, k) for t in range(len(texts)) for k in range(w.count[t] - 49)]
        by_window: dict[bytes, set] = {}
        for s, n, k in zip(start.tolist(), words.tolist(), key.tolist(), strict=True):
            for a in range(s, s + n - 49):
                by_window.setdefault(w.string(a, 50), set()).add(k)
        assert all(len(keys) == 1 for keys in by_window.values())  # equal windows meet in one bucket
    again = substring_dedup.Words(texts[::-1])
    assert set(again.super_kmers(16)[3].tolist()) == set(w.super_kmers(16)[3].tolist())  # wherever they are read


def test_repeated_within_a_document_stays():
    text = " ".join(f"w{i % 60}" for i in range(200)).encode()
    doc, start, stop = substring_dedup.repeated(np.array([1, 1]), np.array([0, 0]), [text, text])
    assert len(doc) == 0
    doc, start, stop = substring_dedup.repeated(np.array([2, 1]), np.array([7, 0]), [text, text])
    assert (doc.tolist(), start.tolist(), stop.tolist()) == ([2], [7], [207])


@pytest.mark.parametrize("extra", CLASHING[:3])
def test_edge_rows(edge_docs, extra):
    rows = substring_dedup.remove_repeats(edge_docs[extra]).collect()
    # the row without an id comes first; copies of one row are one document
    ids = {(None, "no id here"): -1}
    want = Counter()
    judged = brute(sorted({(ids.get((i, t), i), t or "") for i, t, *_ in EDGES}))
    for i, t, *_ in EDGES:
        want[i, *judged[ids.get((i, t), i)][:3]] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == want


def test_ids_that_clash(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [(5, long), (5, long + " more"), (None, long), (6, long), (6, long)]
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == Counter({(None, 60, 0): 1, (5, 60, 60): 1, (5, 61, 60): 1, (6, 60, 60): 2})


def test_empty_table(no_docs):
    assert substring_dedup.remove_repeats(no_docs).count() == 0
