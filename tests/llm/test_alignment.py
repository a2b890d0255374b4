"""op13: groups, links and counts against the two libraries and a plain walk over their tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_rows import CLASHING, EDGES
from sluice.llm import alignment

ODD = [
    None, "", " ", "a  b", "▁x", "x▁ y", "\n\n a  b  x", "<|endoftext|> <s> </s> <unk>", "é😀 日本語 x\x00y", " " * 700 + "x", "═" * 500 + "a", "a\t" + " " * 500 + "\n" * 300 + " b", "Ａ﷽ ﬁ é ﻿ x\u0085 y", "don't  we'll I'M 1234567 a_b", " lead", "trail ", "  x　 y", "a" * 5000, "x\x1c y",
]


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.default_paths()
    a_lib, b_lib = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_lib.encode_special_tokens = True
    letters, found, count = alignment._byte_of_letter(), [], Counter()
    for text in texts:
        a, b = (a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)) if text else ([], [])
        sizes, whole = [], []
        for ids, of in ((a, lambda i: bytes(letters[c] for c in a_lib.id_to_token(i))), (b, lambda i: bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode())):
            parts = [of(i) for i in ids]
            sizes.append(np.cumsum([len(p) for p in parts]).tolist())
            whole.append(b"".join(parts))
        if not text or not whole[0] == whole[1] == (" " + text).encode():
            found.append(None)
            continue
        groups, i, j = [], 0, 0
        for end in sorted(set(sizes[0]) & set(sizes[1])):
            x, y = sizes[0].index(end, i) + 1, sizes[1].index(end, j) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        links = Counter(p for ga, gb in groups for p in ((x, y) for x in ga for y in gb))
        count.update(links.keys())
        found.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[2])
        links = f[3]
        out.append((f[0], f[1], len(f[2]), sum(links.values()), sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


def _columns(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


def _texts():
    rnd = random.Random(1)
    syllables = ["the", "ing", "é", "ou", "tion", "x", "日", "9", "'s", "Qu", "-", "😀"]
    made = [rnd.choice([" ", "\n"]).join("".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(1, 80))) for _ in range(60)]
    return made + ODD + made[:10]


@pytest.mark.parametrize("batch", [alignment.BATCH, 300])
def test_against_the_libraries(spark, batch):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).withColumn("at", F.lit(1)).withColumn("batch", F.lit("b")).withColumn("pairs", F.lit(2))
    got = {r.doc_id: _columns(r) for r in alignment.align(df, batch=batch).collect()}
    assert got == dict(enumerate(brute(texts)))


@pytest.mark.parametrize("extra", CLASHING[:3])
def test_edge_rows(edge_docs, extra):
    want = Counter((i, *x) for (i, *_), x in zip(EDGES, brute([t for _, t, *_ in EDGES]), strict=True))
    assert Counter((r.doc_id, *_columns(r)) for r in alignment.align(edge_docs[extra]).collect()) == want


def test_empty_table(no_docs):
    assert alignment.align(no_docs).count() == 0


def test_large_groups_are_folded(monkeypatch):
    """Groups of repeated ids give the same links however they are paired."""
    rnd = random.Random(4)
    ga, gb = np.sort(np.array([rnd.randrange(4) for _ in range(300)] + [0, 1, 2, 3])), np.sort(np.array([rnd.randrange(4) for _ in range(200)] + [0, 1, 2, 3]))
    a, b = (np.array([rnd.randrange(5) for _ in g]) for g in (ga, gb))
    seen = []
    for most in (1, 3000, 1 << 40):
        monkeypatch.setattr(alignment, "PAIRS", most)
        g, pair, times = alignment._pairs(ga, gb, a, b, np.bincount(ga), np.bincount(gb))
        seen.append(Counter())
        for x, p, n in zip(g.tolist(), pair.tolist(), times.tolist(), strict=True):
            seen[-1][x, p] += n
    assert seen[0] == seen[1] == seen[2] and sum(seen[0].values()) == sum(int((ga == k).sum() * (gb == k).sum()) for k in range(4))
    assert len(alignment._pairs(ga, gb, a, b, np.bincount(ga), np.bincount(gb))[1]) > len(seen[0])


def test_words_join_where_white_space_does():
    words, number, counts = alignment._words(["a b", "a  b", "", "x\n y", " a", "a b"])
    assert [[words[k] for k in number[s : s + c]] for s, c in zip(np.cumsum(counts) - counts, counts, strict=True)] == [[" a", " b"], [" a  b"], [" "], [" x\n y"], ["  a"], [" a", " b"]]


def test_other_vocabularies_are_refused(tmp_path):
    import public_tokenizers

    with pytest.raises((ValueError, KeyError)):
        alignment.ByteSide(public_tokenizers.path("word_bpe_49k.json"))
