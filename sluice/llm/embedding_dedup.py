"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative per group.

Equal vectors are folded first. Each vector joins the cells of its nearest centroids; a pair is compared in the least
cell that both joined. A cell is cut into blocks of bounded size and each pair of blocks is one group of work, so a cell
that holds a large part of all rows is spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluice.llm.components import components
from sluice.tables import keep, table

COSINE = 0.9
SAMPLE = 20_000  # vectors the centroids are fitted on, by the order of their hashes
CELL = 512  # vectors a cell should have
MOST_CELLS = 4096
NEAREST = 3  # cells a vector joins
BLOCK = 1024  # vectors in a block


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _padded(vectors: list, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : min(len(v), dim)] = v[:dim]
    return out


def centroids(vectors: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Spherical k-means; a cell that runs empty takes the vector that fits its own cell worst."""
    u = unit(vectors)
    c = u[np.random.default_rng(seed).choice(len(u), min(k, len(u)), replace=False)]
    for _ in range(rounds):
        close = u @ c.T
        home = close.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, u)
        worst = iter(np.argsort(close[np.arange(len(u)), home]))
        for empty in np.flatnonzero(np.sqrt((sums * sums).sum(axis=1)) < 1e-9):
            sums[empty] = u[next(worst)]
        c = unit(sums)
    return c


def _cells(c: np.ndarray, nearest: int):
    def run(batches):
        for b in batches:
            v = _padded(b.column("embedding").to_pylist(), c.shape[1])
            v[~v.any(axis=1), 0] = 1.0  # longer than the centroids and zero as far as they go: some cell will do
            n = min(nearest, len(c))
            top = np.argpartition(-(unit(v) @ c.T), n - 1, axis=1)[:, :n] if len(v) else np.zeros((0, n), int)
            cells = pa.ListArray.from_arrays(np.arange(0, n * len(v) + 1, n, dtype=np.int32), pa.array(np.sort(top, axis=1).ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, cells], [*b.schema.names, "cells"])

    return run


def _compare(least: float):
    """A pair of blocks of a cell -> (0, node, links found) and (1, node, node linked to it)."""

    def run(t: pa.Table) -> pa.Table:
        node, copies, block = (t.column(c).to_numpy() for c in ("node", "copies", "block"))
        u = unit(np.array(t.column("embedding").to_pylist(), dtype=np.float64))
        cell, i, j = (t.column(c)[0].as_py() for c in ("cell", "i", "j"))
        cells = t.column("cells").to_pylist()
        rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links, label, found = np.zeros(len(node), np.int64), np.arange(len(node)), []
        for at in range(0, len(rows), 512):
            a, b = np.nonzero(u[rows[at : at + 512]] @ u[cols].T >= least)
            a, b = rows[at : at + 512][a], cols[b]
            fresh = a < b if i == j else np.ones(len(a), bool)
            found.append((a[fresh], b[fresh]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (rows[:0], cols[:0])
        if len(a):
            wide = np.array(cells)
            same = (wide[a][:, :, None] == wide[b][:, None, :]).any(axis=2)
            first = np.where(same, wide[a], np.iinfo(np.int32).max).min(axis=1) == cell  # else it is counted in another cell
            a, b = a[first], b[first]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        while True:
            was = label.copy()
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (was == label).all():
                break
        some, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(label)))
        return pa.table({
            "kind": np.concatenate([np.zeros(len(some), np.int32), np.ones(len(moved), np.int32)]),
            "a": np.concatenate([node[some], node[moved]]),
            "b": np.concatenate([links[some], node[label[moved]]]),
        })

    return run


def near_groups(
    vectors: DataFrame, least: float = COSINE, nearest: int = NEAREST, cell: int = CELL, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing; so do vectors of unlike
    length. Equal vectors always link. Ids name vectors: rows with one id and one vector each count as a vector, null ids
    name a component only if it has no other. An empty table gives an empty table. Whatever links is found with a cosine
    of at least `least` in double precision; a pair is missed if it shares none of its `nearest` cells."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    plain = F.transform("embedding", lambda x: x + 0.0)  # minus zero becomes zero
    groups = rows.where("good").groupBy(plain.alias("embedding")).agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    groups = keep(groups.select(F.coalesce("least", F.xxhash64("embedding")).alias("node"), "least", "copies", "embedding"), "vectors")
    n = groups.count()
    k = max(1, min(MOST_CELLS, n // cell))
    sample = [r[0] for r in groups.select("embedding").orderBy(F.xxhash64("embedding")).limit(SAMPLE).collect()]
    c = centroids(_padded(sample, max(map(len, sample))), k) if sample else np.ones((1, 1))
    placed = groups.mapInArrow(_cells(c, nearest), "node long, least long, copies long, embedding array<double>, cells array<int>")
    placed = keep(placed.withColumn("dim", F.size("embedding")), "cells")
    member = placed.select("node", "copies", "embedding", "cells", "dim", F.explode("cells").alias("cell"))
    sizes = member.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    member = member.join(keep(sizes, "sizes"), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")),
    )
    work = member.withColumn("pair", F.explode(pairs)).select("dim", "cell", "pair.i", "pair.j", "block", "node", "copies", "embedding", "cells")
    found = keep(work.groupBy("dim", "cell", "i", "j").applyInArrow(_compare(least), "kind int, a long, b long"), "links")
    links = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    linked = components(found.where("kind = 1").select("a", "b"))
    named = placed.select("node", "least", "copies").join(linked, "node", "left").join(links, "node", "left")
    named = keep(named.select("node", "least", "copies", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links")), "named")
    least_of = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = keep(named.join(keep(least_of, "least"), "component").select("node", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links")), "names")
    by_vector = keep(groups.select("node", "embedding").join(named, "node").select("embedding", "component_id", "n_links"), "by_vector")
    out = rows.withColumn("plain", F.when(F.col("good"), plain)).select("vec_id", "plain")
    out = out.join(by_vector.withColumnRenamed("embedding", "plain"), "plain", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT p.a, r.c FROM r JOIN p ON p.b = r.vec_id),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN m ON m.vec_id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
