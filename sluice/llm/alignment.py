"""Alignment of two tokenizers' tokens of the same texts, with pandas merge_asof per batch.

A batch of documents gives two frames of tokens, with the document and the byte where each token starts. merge_asof, keyed
by document, finds for each token start the token of the other side that covers it; the union of both directions is the
overlaps, and overlaps whose two tokens end at one byte end a group. Within a group every token of one side links to every
token of the other.

How many documents hold an id pair is counted corpus-wide: a batch brings its distinct pairs once, with how many of its
documents hold them, so what is shuffled for the counts, and sent back with them, does not repeat common pairs by document.

Tokens never reach over a single space between two words (the pre-tokenizer of the one side cuts there, and no piece of the
other holds a mark after another character), so the words of a batch are encoded once each.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sluice.tables import keep, table

BATCH = 1 << 20  # bytes of texts that are aligned together; a longer text is a batch of its own
PAIRS = 4096  # links of a group beyond which its repeated ids are folded before they are paired

_ROWS = "batch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at array<int>, times array<long>, pairs array<long>, docs array<long>"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write bytes that do not print as letters from U+0100 on, in byte order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteSide:
    """A byte-level BPE from a tokenizers file; ranks are the ids, as its merges come in id order (else it is refused)."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_of_letter()
        special = {t["id"] for t in spec["added_tokens"] if t.get("special")}
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if i not in special}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        kind = spec["pre_tokenizer"]
        if merged != sorted(merged) or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"] or spec["normalizer"] or spec["model"].get("ignore_merges"):
            raise ValueError("not a byte-level BPE whose ids are in merge order")
        self.bytes = {i: t for t, i in ranks.items()}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the library's ByteLevel
        self.encode = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class PieceSide:
    """A sentencepiece BPE model; it puts the space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces of this model reach over white space")
        self.bytes = {i: bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.encode = lambda text: lib.encode(text[1:], num_threads=1)


class Sides:
    def __init__(self, paths: tuple[str, str]):
        self.sides = (ByteSide(paths[0]), PieceSide(paths[1]))
        self.length = [self._lengths(s.bytes) for s in self.sides]
        top = max(max(s.bytes) for s in self.sides) + 1
        self.digits = np.array([f"{i}{end}".encode() for end in ",|;" for i in range(top)], object)
        self.top = top

    @staticmethod
    def _lengths(of: dict[int, bytes]) -> np.ndarray:
        out = np.zeros(max(of) + 1, np.int64)
        for i, t in of.items():
            out[i] = len(t)
        return out

    def tokens(self, side: int, words: list[str]) -> tuple[np.ndarray, np.ndarray, set[int]]:
        """The ids of all words, where each word's begin, and the words whose tokens' bytes differ from theirs (which have no
        tokens here). Words with white space at their ends are encoded alone, the others in one go."""
        s, length = self.sides[side], self.length[side]
        odd = [k for k, w in enumerate(words) if w[1:2].isspace() or w[-1].isspace()]
        alone = set(odd)
        plain = [k for k in range(len(words)) if k not in alone] if odd else range(len(words))
        each, bad = [[]] * len(words), set()
        joined = "".join([words[k] for k in plain])
        ids = s.encode(joined) if joined else []
        if b"".join(map(s.bytes.__getitem__, ids)) == joined.encode():
            ends = np.cumsum(length[np.array(ids, np.int64)])
            cuts = np.append(0, np.searchsorted(ends, np.cumsum([len(words[k].encode()) for k in plain])) + 1).tolist()
            if not odd:
                return np.array(ids, np.int64), np.array(cuts), bad
            for k, a, z in zip(plain, cuts, cuts[1:], strict=False):
                each[k] = ids[a:z]
        else:
            odd = range(len(words))
        for k in odd:
            each[k] = s.encode(words[k])
            if b"".join(map(s.bytes.__getitem__, each[k])) != words[k].encode():
                bad.add(k)
                each[k] = []
        return np.array(list(chain.from_iterable(each)), np.int64), np.cumsum([0, *map(len, each)]), bad


@lru_cache(maxsize=2)
def load(paths: tuple[str, str]) -> Sides:
    return Sides(paths)


def _words(texts: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, each with the space before it, and for each document the numbers of its words, laid end to end. Words
    part at single spaces between characters that are no white space; elsewhere they stay together."""
    split = [t.split(" ") for t in texts]
    coded = pa.array(chain.from_iterable(split), pa.string()).dictionary_encode()
    number, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    counts = np.array([len(s) for s in split], np.int64)
    starts = np.cumsum(counts) - counts
    open_front = np.array([not w or w[0].isspace() for w in distinct], bool)
    open_back = np.array([not w or w[-1].isspace() for w in distinct], bool)
    joins = np.zeros(len(number), bool)  # to the word before
    if len(number):
        joins[1:] = open_front[number[1:]] | open_back[number[:-1]]
        joins[starts] = False
    if not joins.any():
        return [" " + w for w in distinct], number, counts
    first = np.flatnonzero(~joins)
    size = np.diff(np.append(first, len(number)))
    code = {w: i for i, w in enumerate(distinct)}
    out = number[first]
    for k in np.flatnonzero(size > 1).tolist():
        w = " ".join([distinct[i] for i in number[first[k] : first[k] + size[k]]])
        out[k] = code.setdefault(w, len(code))
    counts = np.diff(np.append(np.searchsorted(first, starts), len(first)))
    used, out = np.unique(out, return_inverse=True)
    names = list(code)
    return [" " + names[i] for i in used.tolist()], out, counts


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, then the next."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _frame(sides: Sides, side: int, words: list[str], number: np.ndarray, doc: np.ndarray, gone: set[int]) -> pd.DataFrame:
    """Tokens of all words in order: doc, start, end (bytes of the batch's texts laid end to end), id."""
    ids, begins, bad = sides.tokens(side, words)
    gone |= bad
    size = np.diff(begins)[number]
    token = ids[_ranges(begins[:-1][number], size)]
    end = np.cumsum(sides.length[side][token])
    return pd.DataFrame({"doc": np.repeat(doc, size), "start": end - sides.length[side][token], "end": end, "id": token})


def groups(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group numbers of both frames' tokens, which run from 0 over all documents in order, and each group's document."""
    a, b = a.assign(a=np.arange(len(a))), b.assign(b=np.arange(len(b)))
    left = pd.merge_asof(a[["doc", "start", "a"]], b[["doc", "start", "b"]], on="start", by="doc")[["a", "b"]]
    right = pd.merge_asof(b[["doc", "start", "b"]], a[["doc", "start", "a"]], on="start", by="doc")[["a", "b"]]
    overlaps = np.concatenate([left.to_numpy(np.int64), right.to_numpy(np.int64)])  # a pair found both ways is here twice
    a_end, b_end = a["end"].to_numpy(), b["end"].to_numpy()
    same = overlaps[a_end[overlaps[:, 0]] == b_end[overlaps[:, 1]]]
    last_a, last_b = np.zeros(len(a) + 1, bool), np.zeros(len(b) + 1, bool)
    last_a[same[:, 0] + 1] = last_b[same[:, 1] + 1] = True  # the token after one that ends a group
    return np.cumsum(last_a[:-1]), np.cumsum(last_b[:-1]), a["doc"].to_numpy()[np.flatnonzero(last_a[1:])]


def _pairs(ga: np.ndarray, gb: np.ndarray, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """group, a << 32 | b and how many links, of all links of all groups; repeated ids of large groups are folded first."""
    large = na * nb > PAIRS
    ta = tb = None
    if large.any():
        def folded(g: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
            some = large[g]
            key, times = np.unique(g[some] << 32 | x[some], return_counts=True)
            g, x, t = np.append(g[~some], key >> 32), np.append(x[~some], key & 0xFFFFFFFF), np.append(np.ones((~some).sum(), np.int64), times)
            order = np.argsort(g, kind="stable")
            return g[order], x[order], t[order]

        ga, a, ta = folded(ga, a)
        gb, b, tb = folded(gb, b)
        nb = np.bincount(gb, minlength=len(nb))
    first = np.cumsum(nb) - nb
    size = nb[ga]
    right = _ranges(first[ga], size)
    times = np.ones(len(right), np.int64) if ta is None else np.repeat(ta, size) * tb[right]
    return np.repeat(ga, size), np.repeat(a, size) << 32 | b[right], times


def align_batch(texts: Sequence[str | None], sides: Sides) -> list[dict]:
    """For each text n_a, n_b, n_groups, n_links, groups_sha256 and its distinct pairs, as places `at` in the batch's list of
    pairs, with the number of links of each; last the batch's `pairs` with the number of its texts that hold each."""
    rows = [{"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "at": [], "times": []} for _ in texts]
    live = [i for i, t in enumerate(texts) if t]
    while True:
        words, number, counts = _words([texts[i] for i in live])
        doc = np.repeat(np.arange(len(live)), counts)
        gone: set[int] = set()
        a, b = (_frame(sides, side, words, number, doc, gone) for side in (0, 1))
        if not gone:
            break
        out = set(doc[np.isin(number, list(gone))].tolist())  # these texts' bytes are not what their tokens say
        live = [i for k, i in enumerate(live) if k not in out]
    if not live:
        return [*rows, {"pairs": [], "docs": []}]
    ga, gb, of = groups(a, b)
    ida, idb = a["id"].to_numpy(), b["id"].to_numpy()
    na, nb = np.bincount(ga), np.bincount(gb)
    g, pair, times = _pairs(ga, gb, ida, idb, na, nb)
    distinct, at = np.unique(pair, return_inverse=True)
    key, where = np.unique(of[g] * len(distinct) + at, return_inverse=True)
    times = np.bincount(where, times).astype(np.int64)
    at, owner = key % len(distinct), key // len(distinct)
    # a1,a2|b1;a3|b2,b3: a token ends in | or ; where it is its side's last of a group, and the text's last in nothing
    last_a, last_b = np.append(ga[1:] != ga[:-1], True), np.append(gb[1:] != gb[:-1], True)
    code = np.concatenate([ida + sides.top * last_a, idb + 2 * sides.top * last_b])
    side = np.argsort(np.concatenate([2 * ga, 2 * gb + 1]), kind="stable")
    text = np.take(sides.digits, code[side])
    per = [np.bincount(of, x, minlength=len(live)).astype(np.int64) for x in (na, nb, np.ones(len(of)), na * nb)]
    stops, cuts = np.cumsum(per[0] + per[1]), np.searchsorted(owner, np.arange(len(live) + 1))
    for k, i in enumerate(live):
        whole = b"".join(text[stops[k] - per[0][k] - per[1][k] : stops[k]])[:-1]
        rows[i] = {name: int(x[k]) for name, x in zip(("n_a", "n_b", "n_groups", "n_links"), per, strict=True)}
        rows[i] |= {"groups_sha256": hashlib.sha256(whole).hexdigest(), "at": at[cuts[k] : cuts[k + 1]], "times": times[cuts[k] : cuts[k + 1]]}
    return [*rows, {"pairs": distinct, "docs": np.bincount(at, minlength=len(distinct))}]


def _align(paths: tuple[str, str] | None, most: int):
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    fields = [f.rsplit(" ", 1) for f in _ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, number = load(paths or default_paths()), TaskContext.get().partitionId() << 32

        def done(ids: list, texts: list) -> pa.RecordBatch:
            rows = align_batch(texts, sides)
            rows = [{"doc_id": i, "batch": number} | r for i, r in zip([*ids, None], rows, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], [n for n, _ in fields])

        for b in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if ids and size + len(t or "") > most:
                    yield done(ids, texts)
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(i)
                texts.append(t)
                size += len(t or "")
            yield done(ids, texts)
            number += 1

    return run


def _counted(rows: pa.Table, pairs: pa.Table) -> pa.Table:
    """A batch's documents, and what its pairs count corpus-wide."""
    n = np.zeros(pairs.num_rows, np.int64)
    best = np.zeros(pairs.num_rows, np.int64)
    place = pairs.column("at").to_numpy()
    n[place], best[place] = pairs.column("n").to_numpy(), pairs.column("best").to_numpy()
    out = {name: [] for name in ("n_best", "count_sum")}
    for at, times in zip(rows.column("at").combine_chunks(), rows.column("times").combine_chunks(), strict=True):
        at, times = at.values.to_numpy(), times.values.to_numpy()
        out["n_best"].append(int((times * best[at]).sum()))
        out["count_sum"].append(int((times * n[at]).sum()))
    t = rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    for name, values in out.items():
        t = t.append_column(name, pa.array(values, pa.int64()))
    return t.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", batch: int = BATCH) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those whose tokens' bytes are not a space and the text, have no tokens: zeros and an empty
    string. Every row is a document: rows that repeat an id, or are repeated whole, count each in the pair counts; null ids
    stay null. An empty table gives an empty table; further columns are ignored. A task needs some 300 bytes of memory for
    each byte of a batch (BATCH bytes, or the longest text); the best counts of ids are broadcast: a row for each id of the
    first vocabulary at most."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    aligned = keep(rows.mapInArrow(_align(paths, batch), _ROWS), "aligned")
    own = aligned.where("pairs is not null").select("batch", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "p"))
    own = own.select(F.col("batch").alias("of_batch"), "at", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = own.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("pair", 32).cast("int"))
    counts = keep(counts, "pair-counts")
    most = keep(counts.groupBy("a").agg(F.max("n").alias("most")), "best-counts")
    judged = counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    found = own.join(judged, "pair").select("of_batch", "at", "n", "best")
    of_docs = aligned.where("pairs is null").drop("pairs", "docs")
    return of_docs.groupBy("batch").cogroup(found.groupBy("of_batch")).applyInArrow(_counted, _OUT)


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
