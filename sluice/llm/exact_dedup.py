"""Exact dedup through an extendible-hash index kept on shared files.

Keys are 64-bit text hashes. A bucket holds the keys that share its leading bits, so it is a key range; the directory lists
the buckets. It starts with one, and doubles: every bucket with more distinct keys than its capacity splits by one more bit,
round after round, until none is overfull or what is left is one key. The directory is made of counts before texts move, so no
bucket's file is written twice. Map tasks fold their copies of a text into one entry and look its bucket up in the directory;
owner tasks receive ranges of keys, all of them alike wide, in bucket and hash order, chain the entries of one hash, compare
them byte by byte and write what their range holds of each bucket. Documents look their group up by bucket, hash and digest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sluice.tables import keep, partitions, table

CAPACITY = 1 << 16  # distinct keys of a bucket at most
HELD = 64 << 20  # bytes of texts that a map task folds together

_ENTRY = "bucket long, h long, sha string, text string, keep_id long, n long"
_INDEX = "bucket long, h long, sha string, chain int, keep_id long, group_size long"


def grow(count: Callable[[list[tuple[int, int]]], list[int]], total: int, capacity: int) -> list[tuple[int, int]]:
    """The directory as buckets (leading bits, number of bits), in key order. `count` tells how many distinct keys begin with
    given bits; only buckets that are overfull are asked about again, as halves."""
    full, done = [((0, 0), total)], []
    while full:
        done += [b for b, n in full if n <= capacity or b[1] == 64]
        halves = [(2 * bits + i, depth + 1) for (bits, depth), n in full if n > capacity and depth < 64 for i in (0, 1)]
        full = list(zip(halves, count(halves), strict=True)) if halves else []
    return sorted(done, key=lambda b: b[0] << (64 - b[1]))


def _starts(directory: list[tuple[int, int]]) -> np.ndarray:
    return np.array([bits << (64 - depth) for bits, depth in directory], np.uint64)


def _bucket(starts: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.searchsorted(starts, h.view(np.uint64), "right") - 1


def _directory(keys: DataFrame, capacity: int) -> list[tuple[int, int]]:
    """keys (h), distinct. A round counts all halves of overfull buckets in one pass; only counts reach the driver, two for
    each bucket that splits."""
    spark = keys.sparkSession

    def count(halves: list[tuple[int, int]]) -> list[int]:
        depth = halves[0][1]
        parents = spark.createDataFrame([(bits - (1 << 64) if bits >= 1 << 63 else bits,) for bits, _ in halves[::2]], "top long")  # of overfull buckets: n / CAPACITY at most
        bits = keys.select(F.expr(f"shiftrightunsigned(h, {64 - depth})" if depth < 64 else "h").alias("bits")).withColumn("top", F.expr("(bits div 2) * 2") if depth < 64 else F.expr("bits & -2L"))
        found = {r["bits"] & (2**64 - 1): r["n"] for r in bits.join(F.broadcast(parents), "top").groupBy("bits").agg(F.count(F.lit(1)).alias("n")).collect()}
        return [found.get(b, 0) for b, _ in halves]

    return grow(count, keys.count(), capacity)


def _fold(starts: np.ndarray, most: int):
    """Copies that a task reads become one entry, as far as `most` bytes of texts go."""
    schema = pa.schema([("h", pa.int64()), ("sha", pa.string()), ("text", pa.string()), ("keep_id", pa.int64()), ("n", pa.int64())])

    def folded(held: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(held).group_by(["h", "sha", "text"], use_threads=False).aggregate([("keep_id", "max"), ("n", "sum")])
        return t.select(["h", "sha", "text", "keep_id_max", "n_sum"]).rename_columns(schema.names).cast(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.add_column(0, "bucket", pa.array(_bucket(starts, t.column("h").to_numpy()).astype(np.int64)))
            yield from t.combine_chunks().to_batches(max_chunksize=2000)

        held: list[pa.Table] = []
        for b in batches:
            new = pa.Table.from_arrays([b.column("h"), b.column("sha"), b.column("text"), b.column("doc_id"), pa.array(np.ones(b.num_rows, np.int64))], schema=schema)
            held.append(folded([new]))
            if sum(t.nbytes for t in held) > most:
                held = [folded(held)]
                if held[0].nbytes > most:
                    yield from out(held[0])
                    held = []
        if held:
            yield from out(folded(held))

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries arrive in hash order; those of one hash form a chain, compared by their bytes."""
    out: list[tuple] = []
    now, bucket, chain = None, None, {}

    def close() -> None:
        if len({sha for _, sha in chain}) < len(chain):
            raise ValueError(f"two texts share hash {now} and a SHA-256")
        for i, ((_, sha), (keep_id, n)) in enumerate(chain.items()):
            out.append((bucket, now, sha, i, keep_id, n))

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 6
        out.clear()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "h", "sha", "chain", "keep_id", "group_size"])

    for batch in batches:
        for at, h, sha, text, keep_id, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "h", "sha", "text", "keep_id", "n")), strict=True):
            if h != now:
                close()
                now, bucket, chain = h, at, {}
            old = chain.get((text, sha))  # a dict looks texts up by hash, then compares them whole
            ids = [x for x in (keep_id, old and old[0]) if x is not None]
            chain[text, sha] = (max(ids, default=None), n + (old[1] if old else 0))
        yield flush()
    close()
    yield flush()


def _keyed(starts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _bucket(starts, b.column("h").to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), *b.columns], ["bucket", *b.schema.names])

    return run


def build_index(rows: DataFrame, keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, np.ndarray]:
    """rows (doc_id, h, sha, text), keys (h) distinct -> the index by bucket, on shared files, and where its buckets begin.
    A text of which there are very many copies comes once from each task that read some, so its owner gets few entries."""
    starts = _starts(_directory(keys, capacity))
    entries = rows.select("doc_id", "h", "sha", "text").mapInArrow(_fold(starts, HELD), _ENTRY)
    n = partitions(rows.sparkSession)  # owners: the leading 32 bits of a key times n, over 2^32
    owned = entries.repartitionById(n, F.expr(f"cast(shiftrightunsigned(shiftrightunsigned(h, 32) * {n}L, 32) as int)")).sortWithinPartitions("bucket", "h")
    return keep(owned.mapInArrow(_chain, _INDEX), "index"), starts


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as the empty text. Of equal texts the row with the largest id stays. Null ids never win against
    another id; a group of null ids alone keeps them. Repeated rows (same id, same text) are one document: all carry
    kept = true. An empty table gives an empty table; further columns are ignored."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("sha"), "text")
    slim = keep(rows.select("doc_id", "h", "sha"), "keys")
    index, starts = build_index(rows, keep(slim.select("h").distinct(), "hashes"), capacity)
    looked_up = slim.mapInArrow(_keyed(starts), "bucket long, doc_id long, h long, sha string")
    found = looked_up.join(index.drop("chain"), ["bucket", "h", "sha"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns as they are; of rows with one id and one text only one."""
    groups = exact_groups(docs).where("kept").select(F.col("doc_id").alias("keep_id"), "text_sha256").distinct()
    groups = keep(groups, "kept")
    sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), sha.alias("own"))
    found = row.join(groups, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("own") == F.col("text_sha256")))
    return found.dropDuplicates(["id", "own"]).select("row.*")


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = max(doc_id) OVER w, true) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
