"""A corpus from documents to token ids: toxic documents go, copies go, near copies go, sources are mixed, texts encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet in the shared folder and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import exact_dedup, mixing, pieces, simhash, toxicity
from sluice.tables import drop_scratch, fresh_path, scratch_paths, table

NEAR_BITS = 7  #: differing bits of candidates, over five-word shingles: four segments are indexed
SIMILARITY = 0.8  #: Jaccard of five-word shingles from which a candidate is a near copy


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go; null and empty texts have no evidence and stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null counting as empty, the row with the largest id stays; of rows repeated whole, one."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are linked, however far, by NEAR_BITS and SIMILARITY the row with the least id stays."""
    return simhash.drop_near_copies(docs, bits=NEAR_BITS, similarity=SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that a document, or part of it, is drawn: three at most; wordless documents go."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row's text."""
    return pieces.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: SQL cannot express the models, the fingerprints or the token ids; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; a stage's scratch tables and its input go once its output is written."""
    docs, first = table(spark, sf_dir, "documents"), scratch_paths()
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        drop_scratch(spark, first, but=[path])
    return docs
