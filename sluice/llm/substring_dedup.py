"""Removal of 50-word windows that an earlier document holds, by super-k-mers.

A window's minimiser is the least-hashed run of a few words in it. Consecutive windows of a document with the same
minimiser make a super-k-mer: one string of words that holds them all. Equal windows have equal minimisers, so they meet in
the bucket of that minimiser, where the windows of all strings are sorted and counted exactly.

Before any string travels, the minimisers alone do (a few bytes for some twenty words): one that only a single document
holds cannot have a repeated window. Copies that a task reads together are settled there. In buckets with more than ROWS
strings, equal strings are first folded to their first document by a grouped minimum, and what is still too much for one
task is cut again, by minimisers of longer runs and at last of whole windows, so no task ever holds such a bucket.
Hashes only choose buckets; strings and windows are compared by their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluice.llm.suffix_dedup import _mixed, _powers, _slide
from sluice.tables import keep, partitions, table

WINDOW = 50  # words
RUNS = (16, 33, WINDOW)  # words of a minimiser, at first and when a bucket is cut again
ROWS = 4096  # strings of a bucket that one task sorts
HELD = 20_000  # strings of small buckets that are sorted together
CHUNK = 4 << 20  # bytes of texts that are hashed, and folded, together

_FOUND = "key long, doc long, place int, words int"
_PACKED = "key long, doc long, place int, words int, string binary"
_GONE = "doc long, start int, stop int"
_NONE = np.zeros(0, np.int64)


class Words:
    """The words of texts laid end to end; equal words have equal numbers, and a hash that depends on nothing but the word."""

    def __init__(self, texts: Sequence[bytes]):
        split = [t.split() for t in texts]  # bytes split at ASCII white space, and only there
        self.count = np.array([len(w) for w in split], np.int64)
        self.stop = np.cumsum(self.count)
        self.start = self.stop - self.count
        coded = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode()
        self.number = coded.indices.to_numpy().astype(np.int64)
        self.word = coded.dictionary.to_pylist()
        known = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in self.word], np.uint64)
        self.sums = np.zeros(len(self.number) + 1, np.uint64)
        up, self.down, _ = _powers(max(2 << 20, 1 << (len(self.sums)).bit_length()), 0)
        np.cumsum(known[self.number] * up[: len(self.number)], out=self.sums[1:])

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of runs of words."""
        return _mixed((self.sums[stop] - self.sums[start]) * self.down[start])

    def windows(self) -> np.ndarray:
        """Whether a window starts at a word, for all but the last 49 words."""
        inside = np.zeros(max(0, len(self.number) - WINDOW + 1), bool)
        for a, b in zip(self.start.tolist(), self.stop.tolist(), strict=True):
            inside[a : max(a, b - WINDOW + 1)] = True
        return inside

    def super_kmers(self, run: int) -> tuple[np.ndarray, ...]:
        """text, first word, words and minimiser of each."""
        inside = self.windows()
        if not inside.any():
            return (_NONE,) * 4
        at = np.arange(len(self.number) - run + 1)
        least = _slide(self.hash(at, at + run), WINDOW - run + 1, np.minimum).view(np.int64)
        text = np.searchsorted(self.stop, np.arange(len(inside)), "right")
        new = inside.copy()
        new[1:] &= (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(inside)) - 1
        stops = np.flatnonzero(inside & ~np.append(inside[1:], False))  # a text's last window
        last = np.minimum(last, stops[np.searchsorted(stops, first)])
        return text[first], first, last - first + WINDOW, least[first]

    def string(self, start: int, words: int) -> bytes:
        return b" ".join([self.word[i] for i in self.number[start : start + words]])


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    arrays = [pa.array(c if k == "binary" else np.asarray(c, np.int64).astype(np.int32 if k == "int" else np.int64), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def _chunks(docs: list, texts: list[bytes], most: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i == len(texts) - 1:
            yield np.array(docs[at : i + 1], np.int64), texts[at : i + 1]
            at, size = i + 1, 0


def _find(chunk: int):
    """Super-k-mers of whole texts as (key, doc, place, words). Those whose words a smaller document of the same chunk holds
    go at once: key null, the words from place on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, texts in _chunks(b.column("doc").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), chunk):
                w = Words(texts)
                text, start, words, key = w.super_kmers(RUNS[0])
                doc, place = docs[text], start - w.start[text]
                whole = w.hash(start, start + words)
                order = np.lexsort((place, doc, words, whole, key))
                start, words, key, doc, place, whole = (x[order] for x in (start, words, key, doc, place, whole))
                alike = np.zeros(len(key), bool)
                alike[1:] = (key[1:] == key[:-1]) & (whole[1:] == whole[:-1]) & (words[1:] == words[:-1])
                head = np.maximum.accumulate(np.where(alike, 0, np.arange(len(key))))  # the first of those with equal hashes
                gone = alike & (doc[head] != doc)
                for i in np.flatnonzero(gone).tolist():
                    a, z, n = start[i], start[head[i]], words[i]
                    gone[i] = (w.number[a : a + n] == w.number[z : z + n]).all()
                out = _batch(_FOUND, key, doc, place, words)
                yield out.set_column(0, "key", pa.array(key, pa.int64(), mask=gone))

    return run


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(_PACKED, *(list(zip(*rows, strict=True)) or [()] * 5))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[tuple] = []
        for doc, text, wants in zip(*(b.column(c).to_pylist() for c in ("doc", "text", "wants")), strict=True):
            words = text.encode().split()
            rows += [(w["key"], doc, w["place"], w["words"], b" ".join(words[w["place"] : w["place"] + w["words"]])) for w in wants]
            if len(rows) > HELD:
                yield _packed(rows)
                rows = []
        yield _packed(rows)


def _cut_again(run: int):
    """Strings as the super-k-mers of longer minimisers."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, place = (b.column(c).to_numpy() for c in ("doc", "place"))
            w = Words(b.column("string").to_pylist())
            text, start, words, key = w.super_kmers(run)
            strings = [w.string(a, n) for a, n in zip(start.tolist(), words.tolist(), strict=True)]
            yield _batch(_PACKED, key, doc[text], place[text] + start - w.start[text], words, strings)

    return out


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def repeated(doc: np.ndarray, place: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, ...]:
    """doc, start and stop of the runs of windows that a smaller document among these strings holds. Windows are sorted by
    ranks that double their length: 1, 2, 4 .. 32 words, then 32 and the last 32 of 50."""
    w = Words(strings)
    inside = w.windows()
    if not inside.any():
        return (_NONE,) * 3
    rank, length = w.number, 1
    while 2 * length <= WINDOW:
        rank = _ranks(rank[:-length] * (len(rank) + 1) + rank[length:])
        length *= 2
    if length < WINDOW:
        rank = _ranks(rank[: len(rank) - (WINDOW - length)] * (len(rank) + 1) + rank[WINDOW - length :])
    at = np.flatnonzero(inside)
    text = np.searchsorted(w.stop, at, "right")
    first = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, rank[at], doc[text])
    late = np.zeros(len(w.number) + 1, bool)
    late[at] = first[rank[at]] < doc[text]
    begin = late.copy()
    begin[1:] &= ~late[:-1] | np.isin(np.arange(1, len(late)), w.start)
    a = np.flatnonzero(begin)
    z = np.flatnonzero(late & ~np.append(late[1:] & ~begin[1:], False))
    text = np.searchsorted(w.stop, a, "right")
    shift = place[text] - w.start[text]
    return doc[text], a + shift, z + shift + WINDOW


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets, in key and string order. Of equal strings only those of the first document are sorted with others."""
    held: list[tuple[int, int, bytes]] = []  # doc, place, string
    bucket: list[tuple[int, int, bytes]] = []
    now, string, least, several = None, None, None, False

    def sort() -> pa.RecordBatch:
        docs, places, strings = list(zip(*held, strict=True)) or [()] * 3
        out = repeated(np.array(docs, np.int64), np.array(places, np.int64), list(strings))
        held.clear()
        return _batch(_GONE, *out)

    for b in batches:
        gone = []
        for key, doc, place, words, s in zip(*(b.column(c).to_pylist() for c in ("key", "doc", "place", "words", "string")), strict=True):
            if key != now:
                if several:
                    held.extend(bucket)
                bucket, now, string, several = [], key, None, False
                if len(held) > HELD:
                    yield sort()
            if s != string:
                several, string, least = string is not None, s, doc
            if doc == least:
                bucket.append((doc, place, s))
            else:
                gone.append((doc, place, place + words))
        yield _batch(_GONE, *(list(zip(*gone, strict=True)) or [()] * 3))
    if several:
        held.extend(bucket)
    yield sort()


def _bucketed(rows: DataFrame) -> DataFrame:
    by_key = rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "string", "doc", "place")
    return by_key.mapInArrow(_sort, _GONE)


def _crowded(rows: DataFrame, runs: Sequence[int], most: int) -> list[DataFrame]:
    """The removals of buckets with very many strings: copies fold by a grouped minimum, then buckets that still hold more than
    `most` strings are cut again; those of whole windows hold one string each, but for hashes that collide."""
    gone = []
    for run in [*runs, None]:
        first = keep(rows.groupBy("key", "string").agg(F.min("doc").alias("first")), "strings")
        sizes = keep(first.groupBy("key").agg(F.count(F.lit(1)).alias("strings")).where("strings > 1"), "strings-of-keys")
        named = keep(rows.join(first, ["key", "string"]), "named")
        gone.append(named.where("doc > first").select("doc", F.col("place").alias("start"), (F.col("place") + F.col("words")).alias("stop")))
        heads = keep(named.where("doc = first").drop("first").join(sizes, "key"), "heads")
        full = F.lit(False) if run is None else F.col("strings") > most
        gone.append(_bucketed(heads.where(~full).drop("strings")))
        rows = heads.where(full).drop("strings")
        if run is None or rows.isEmpty():
            break
        rows = keep(rows.mapInArrow(_cut_again(run), _PACKED), "cut-again")
    return gone


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
            words = text.encode().split()
            kept, at = [], 0
            for g in sorted((g["start"], g["stop"]) for g in gone or []):
                kept += words[at : g[0]] if g[0] > at else []
                at = max(at, g[1])
            kept += words[at:]
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode()))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, doc: a number of its own for each document, in id order."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    named = rows.select("doc_id", F.xxhash64("text").alias("h"))
    clash = named.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    if clash.where("a <> b or doc_id is null").isEmpty():
        return rows.withColumn("doc", F.col("doc_id"))
    names = keep(named.distinct().orderBy("doc_id", "h").withColumn("doc", F.monotonically_increasing_id()), "ids")
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.xxhash64("text") == F.col("h"))
    return rows.join(names.withColumnRenamed("doc_id", "i"), same).select("doc_id", "text", "doc")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by one space).

    Every word of a window that a document with a smaller id holds too is removed, judged on the input; a document's own
    repeats stay. A null text has no words. Null ids come first; rows that share an id but not the text count as documents
    of their own, in the order of their hashes; rows repeated whole are one document and get one result each. An empty table
    gives an empty table; further columns are ignored. A task needs some 20 bytes of memory for each byte of the longest
    text. `rows` is how many strings of a bucket one task sorts; buckets with more are cut again, to the same result."""
    read = _documents(docs, id_col, text_col)
    found = read.where(F.octet_length("text") >= 2 * WINDOW - 1).select("doc", "text").mapInArrow(_find(chunk), _FOUND)
    found = keep(found, "super-kmers")
    keys = found.where("key is not null").groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("z"), F.count(F.lit(1)).alias("n"))
    shared = keep(keys.where("a < z").select("key", (F.col("n") > rows).alias("crowded")), "shared")
    wanted = found.join(shared, "key").groupBy("doc").agg(F.collect_list(F.struct("key", "place", "words")).alias("wants"))
    packed = keep(read.select("doc", "text").join(wanted, "doc").select("doc", "text", "wants").mapInArrow(_pack, _PACKED), "packed")
    gone = found.where("key is null").select("doc", F.col("place").alias("start"), (F.col("place") + F.col("words")).alias("stop"))
    crowded = shared.where("crowded").select("key")
    if crowded.isEmpty():
        parts = [_bucketed(packed)]
    else:
        parts = [_bucketed(packed.join(crowded, "key", "left_anti")), *_crowded(packed.join(crowded, "key"), RUNS[1:], rows)]
    for part in parts:
        gone = gone.unionByName(part)
    gone = gone.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    return read.join(gone, "doc", "left").select("doc_id", "text", "gone").mapInArrow(
        _cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    )


def op11_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d),
s AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS s FROM win),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM s) WHERE first < doc_id),
hit AS (SELECT DISTINCT doc_id, i + k AS j FROM late, (SELECT unnest(range(0, 50)) AS k)),
g AS (SELECT doc_id, list(j) AS gone FROM hit GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n_words, len(coalesce(gone, [])) AS n_removed,
             list_filter(w, lambda x, j: NOT list_contains(coalesce(gone, []), j)) AS kept FROM d LEFT JOIN g ON g.doc_id = d.doc_id)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
