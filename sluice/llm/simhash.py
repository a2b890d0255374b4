"""SimHash near-dedup with deletion-variant signatures.

A 64-bit fingerprint is cut into fewer segments than bits may differ, so that one of them differs by at most one bit: two
segments for three bits, four for seven. Each fingerprint is indexed under every segment with one position made a
wildcard; rows of equal variants meet, and the whole fingerprints are compared. Only distinct fingerprints are indexed.
On request candidates are verified by the Jaccard similarity of their shingles before they count as links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sluice.llm.components import components
from sluice.tables import keep, partitions, table

MAX_BITS = 3
SEED = 42
BLOCK_SHINGLES = (1 << 15, 1 << 22)  # of a group's candidates in one block: from the first on it is cut, the second is a block's most
BLOCKS = 32  # into which a group is cut for speed; more only as its size demands, as each pair of blocks is compared
RUN_LIMIT = 1 << 16  # distinct fingerprints of one variant held by a task; larger runs are cut finer in another pass


def fingerprint(text: str | None, width: int = 3) -> int:
    """A bit is 1 if it is set in over half the shingle hashes. A-Z are lower-cased; words are runs outside
    space and \\x09-\\x0D; fewer words than `width` make one shingle; no word gives 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(len(words) - width + 1, 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:last].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, last)
    ones = np.zeros(64, np.int64)
    for at in range(0, last, 4096):
        ones += np.unpackbits(h[at : at + 4096, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, width) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("sha"), pa.array(fp.view(np.int64))], ["doc_id", "sha", "fp"])

    return run


def _stars(v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct fingerprints as one star per linked set, found breadth first: what is reached leaves the rest."""
    roots, leaves = [], []
    while len(v) > 1:
        root, v, queue = v[0], v[1:], [v[0]]
        while queue and len(v):
            near = np.bitwise_count(v ^ queue.pop()) <= bits
            if near.any():
                hit, v = v[near], v[~near]
                queue.extend(hit)
                roots.append(np.full(len(hit), root))
                leaves.append(hit)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(roots), np.concatenate(leaves)) if roots else (none, none)


def _link(bits: int, limit: int):
    """Rows (key, fp, rest) in key order -> links (over = false, a, b, 0); the rows of a run beyond the limit come out as
    they are (over = true, key, fp, rest)."""

    def batch(parts: list[tuple]) -> pa.RecordBatch:
        none = np.zeros(0, np.int64)
        over = np.concatenate([np.zeros(0, bool), *(np.full(len(p[1]), p[0]) for p in parts)])
        cols = [np.concatenate([none, *(p[i].view(np.int64) for p in parts)]) for i in (1, 2)]
        rest = np.concatenate([none, *(p[3] if p[0] else np.zeros(len(p[1]), np.int64) for p in parts)])
        return pa.RecordBatch.from_arrays([pa.array(over), *map(pa.array, cols), pa.array(rest)], ["over", "a", "b", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, rest = (np.zeros(0, np.int64) for _ in range(3))
        passing = None
        for x in batches:
            key, fp, rest = (np.concatenate([old, x.column(c).to_numpy()]) for old, c in ((key, "key"), (fp, "fp"), (rest, "rest")))
            out: list = []
            if passing is not None:
                stop = np.searchsorted(key, passing, "right")
                out.append((True, key[:stop], fp[:stop], rest[:stop]))
                passing = passing if stop == len(key) else None
                key, fp, rest = key[stop:], fp[stop:], rest[stop:]
            if len(key):
                last = np.searchsorted(key, key[-1], "left")
                out += _runs(key[:last], fp[:last], rest[:last], bits, limit)
                key, fp, rest = key[last:], fp[last:], rest[last:]
                if len(key) > limit:
                    out.append((True, key, fp, rest))
                    key, fp, rest, passing = key[:0], fp[:0], rest[:0], key[-1]
            yield batch(out)
        yield batch(_runs(key, fp, rest, bits, limit))

    return run


def _runs(key: np.ndarray, fp: np.ndarray, rest: np.ndarray, bits: int, limit: int) -> list:
    """The links within each run of equal keys."""
    if len(key) < 2:
        return []
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(at, len(key)))
    fp = fp.view(np.uint64)
    two = at[size == 2]
    two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= bits]
    out: list = [(False, fp[two], fp[two + 1])]
    for a, n in zip(at[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        out.append((True, key[a : a + n], fp[a : a + n], rest[a : a + n]) if n > limit else (False, *_stars(fp[a : a + n], bits)))
    return out


def near_links(fps: DataFrame, bits: int = MAX_BITS, limit: int = RUN_LIMIT) -> DataFrame:
    """fps (fp long), distinct -> edges (a, b) that join all fingerprints linked at `bits` (odd) or fewer differing bits.

    A run of one variant with more than `limit` fingerprints is cut again: the bits outside its segment become as many
    segments with wildcards of their own, and so on; nothing is capped."""
    n = partitions(fps.sparkSession)
    segments = (bits + 1) // 2
    widths, free = [], 64
    while free % segments == 0 and free // segments >= 4:
        widths.append(free // segments)
        free -= free // segments
    rows, edges = fps.select("fp", F.col("fp").alias("rest"), F.lit(0).cast("long").alias("key")), None
    for level, w in enumerate(widths):
        rows = rows.withColumn("i", F.explode(F.expr(f"sequence(0, {segments * w - 1})"))).withColumn("low", F.expr(f"cast((i div {w}) * {w} as int)"))
        part = f"shiftrightunsigned(rest, low) & {(1 << w) - 1}L & ~shiftleft(1L, i % {w})"
        above = f"if(low + {w} > 63, 0L, shiftleft(shiftrightunsigned(rest, least(63, low + {w})), low))"
        left = f"({above}) | (rest & (shiftleft(1L, low) - 1L))"
        rows = rows.select(F.expr(f"xxhash64(key, i, {part})").alias("key"), "fp", F.expr(left).alias("rest"))
        linked = rows.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(
            _link(bits, limit if level + 1 < len(widths) else 1 << 62), "over boolean, a long, b long, c long"
        )
        out = keep(linked, "links")
        found = out.where("not over").select("a", "b")
        edges = found if edges is None else edges.unionByName(found)
        rows = out.where("over").select(F.col("a").alias("key"), F.col("b").alias("fp"), F.col("c").alias("rest"))
        if rows.isEmpty():
            break
    return edges


def _shingles(width: int):
    """Texts -> the sorted 64-bit hashes of their distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = []
            for t in b.column("text").to_pylist():
                words = (t or "").encode("utf-8", "surrogatepass").lower().split()
                last = max(len(words) - width + 1, 1) if words else 0
                h = {xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(last)}
                sets.append(np.sort(np.fromiter(h, np.uint64, len(h))).view(np.int64))
            offsets = np.cumsum([0, *map(len, sets)])
            lists = pa.LargeListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))).cast(pa.list_(pa.int64()))
            keep_ = [b.column(c) for c in ("component", "node", "fp")]
            yield pa.RecordBatch.from_arrays([*keep_, lists, pa.array(np.diff(offsets))], ["component", "node", "fp", "shingles", "n"])

    return run


def _verify(bits: int, least: float):
    """A block, or two, of a group of candidates -> verified links (a, b) that join all texts that are linked within it.
    Breadth first: a text that is reached is compared with those not reached yet, by bits, by sizes, then by shingles."""

    def run(t: pa.Table) -> pa.Table:
        node, fp = t.column("node").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
        lists = t.column("shingles").combine_chunks()
        flat, at = lists.flatten().to_numpy(), np.append(0, np.cumsum(t.column("n").to_numpy()))
        sets = [flat[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]
        size, rest, edges = np.diff(at), np.arange(len(node)), []
        while len(rest) > 1:
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                one = queue.pop()
                low, high = np.minimum(size[rest], size[one]), np.maximum(size[rest], size[one])
                near = np.flatnonzero((np.bitwise_count(fp[rest] ^ fp[one]) <= bits) & (low >= least * high - 1e-9))
                hit = np.zeros(len(rest), bool)
                for k in near.tolist():
                    other = rest[k]
                    shared = len(np.intersect1d(sets[one], sets[other], assume_unique=True))
                    hit[k] = shared >= least * (size[one] + size[other] - shared) - 1e-9
                queue.extend(rest[hit])
                edges += [(node[one], node[x]) for x in rest[hit]]
                rest = rest[~hit]
        a, b = zip(*edges, strict=True) if edges else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _verified(candidates: DataFrame, width: int, bits: int, least: float) -> DataFrame:
    """candidates (component, node, fp, text) -> edges (a, b) of nodes within `bits` and at or above the similarity of
    shingles, enough of them to join all that are linked. A large group is cut into blocks of bounded size, and each pair of
    blocks is one piece of work."""
    sets = keep(candidates.mapInArrow(_shingles(width), "component long, node long, fp long, shingles array<long>, n long"), "shingles")
    small, most = BLOCK_SHINGLES
    size = F.sum(F.col("n") + 8)
    blocks = sets.groupBy("component").agg(F.greatest(F.ceil(size / most), F.least(F.ceil(size / small), F.lit(BLOCKS))).cast("int").alias("blocks"))
    dealt = sets.join(keep(blocks, "blocks"), "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    work = dealt.withColumn("pair", F.explode(pairs)).select("component", "pair.i", "pair.j", "node", "fp", "shingles", "n")
    return work.groupBy("component", "i", "j").applyInArrow(_verify(bits, least), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, bits: int = MAX_BITS, similarity: float | None = None) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lowercase hex digits), component_id (the least doc_id reachable), and
    text_sha256, which with the id names the row.

    Texts link by their fingerprints alone, or with a similarity by the Jaccard of their distinct shingles too.
    A null or wordless text has fingerprint zero and is linked like any other. Null ids never name a component unless
    nothing else is there. Repeated rows keep one row each; an empty table gives an empty table."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("sha", F.sha2("text", 256))
    fps = keep(rows.mapInArrow(_fingerprints(width), "doc_id long, sha string, fp long"), "fingerprints")
    distinct = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("sha").alias("one"), F.max("sha").alias("other")), "distinct")
    linked = keep(components(near_links(distinct.select("fp"), bits)), "components")
    named = distinct.join(linked, distinct.fp == linked.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"), (F.col("node").isNotNull() | (F.col("one") != F.col("other"))).alias("several"))
    if similarity is None:
        least = keep(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
        names = keep(named.select("fp", "component").join(least, "component").select("fp", "component_id"), "names")
        out = fps.join(names, "fp")
    else:
        some = keep(named.where("several").select("fp", "component"), "candidates")
        texts = fps.join(some, "fp").groupBy("sha", "fp", "component").agg(F.min("doc_id").alias("least"))
        texts = keep(texts.withColumn("node", F.monotonically_increasing_id()), "texts")  # one for equal texts
        whole = rows.select(F.col("sha").alias("s"), "text", F.col("doc_id").alias("i"))
        whole = whole.join(texts, (F.col("s") == F.col("sha")) & F.col("i").eqNullSafe(F.col("least"))).dropDuplicates(["node"])
        edges = _verified(whole.select("component", "node", "fp", "text"), width, bits, similarity)
        joined = keep(components(keep(edges, "verified")), "verified-components")
        groups = texts.join(joined.withColumnRenamed("component", "root"), "node", "left").select("sha", "least", F.coalesce("root", "node").alias("root"))
        ids = keep(groups.groupBy("root").agg(F.min("least").alias("component_id")), "least")
        names = keep(groups.join(ids, "root").select("sha", "component_id"), "names")
        alone = fps.groupBy("sha").agg(F.min("doc_id").alias("own"))  # texts without a candidate: equal ones are a group
        out = fps.join(keep(alone.join(names, "sha", "left").select("sha", F.when(F.col("component_id").isNull(), F.col("own")).otherwise(F.col("component_id")).alias("component_id")), "named"), "sha")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("sha").alias("text_sha256"))


def drop_near_copies(docs: DataFrame, width: int = 5, bits: int = MAX_BITS, similarity: float | None = None) -> DataFrame:
    """The rows of docs, all columns as they are, that name their group: those of its least id, and of these, if several
    texts have it, the one of the least hash. Of rows repeated with one id and text one stays."""
    groups = near_groups(docs, width=width, bits=bits, similarity=similarity).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays = keep(groups.groupBy("component_id").agg(F.min("text_sha256").alias("sha")), "kept")
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("own"))
    found = row.join(stays, F.col("id").eqNullSafe(F.col("component_id")) & (F.col("own") == F.col("sha")))
    return found.dropDuplicates(["id", "own"]).select("row.*")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), width=3).drop("text_sha256")
