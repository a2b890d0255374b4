"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models, of toxic and of ordinary text, share their last backoff. For a class c, with words w, a
word's predecessor v (a mark of its own where a text begins) and a word's first letters p:

    P_c(w | v) = (max(n_c(v w) - D, 0) + (D N_c(v .) + T n_c(v)) P_c(w)) / ((1 + T) n_c(v)),   P_c(w) if n_c(v) = 0
    P_c(w)     = (max(N_c(. w) - D, 0) + (D W_c + T N_c) P_c(p) n(w) / n(p)) / ((1 + T) N_c)
    P_c(p)     = (max(W_c(p) - D, 0) + (D R_c + T W_c) S(p)) / ((1 + T) W_c)

n_c counts pairs. N_c(v .) and N_c(. w) count distinct followers and predecessors, N_c distinct pairs, W_c(p) distinct words
that begin with p, W_c words, R_c beginnings. n(w) and n(p) count words over all documents and S(p) is the share of all
documents' distinct words that begin with p: these shared counts come from the whole corpus, labelled or not. T is how much
of a context's weight goes to its backoff beyond the discounts.

A toxic text is taken as a mixture, as few of its words are: Q(w | v) = (1 - M) P_ordinary(w | v) + M P_toxic(w | v). A
text's evidence is the mean over its words of log Q(w | v) - log P_ordinary(w | v), that is the difference of both
length-normalised log-likelihoods. Words of which neither class has seen so much as
the beginning are left at 0. T, M and the order (2, or 1 for P_c(w) alone) are those of a fixed grid whose logistic
calibration fits best, on labelled rows that the counts do not hold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from sluice.tables import keep, table

DISCOUNT = 0.75
STRENGTHS = (0.25, 1.0, 4.0)  # T
SHARES = (0.003, 0.03, 0.3, 1.0)  # M
TRAIN_ROWS = 12_500  # labelled rows to fit on, by the order of their hashes: the bound of the sample
CALIBRATE = 5  # one of so many labelled rows calibrates, the others are counted
PREFIX = 5  # letters of a word's beginning
THRESHOLD = 0.3
CHUNK = 1 << 20  # bytes of text looked at together

START = np.uint64(0)  # the predecessor of a first word


def words(texts: pa.Array) -> pa.ListArray:
    """Runs of letters, in lower case; nulls and texts without letters have none."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    low = pc.utf8_trim(pc.replace_substring_regex(low, r"\PL+", " "), " ")
    return pc.split_pattern(low, " ")


def _hash(values: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x.as_buffer()) for x in values), np.uint64, len(values))


def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Cut:
    """The words of some texts in turn: text number, word, its predecessor and its beginning, as hashes."""

    def __init__(self, texts: pa.Array):
        lists = words(texts)
        flat = lists.flatten()
        size = np.diff(lists.offsets.to_numpy())
        text = np.repeat(np.arange(len(texts)), size)
        empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)  # a text without words is one empty string
        coded = flat.dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        word = _hash(coded.dictionary)
        begin = pc.utf8_slice_codeunits(coded.dictionary, 0, PREFIX).dictionary_encode()
        prefix = pairs(_hash(begin.dictionary), np.full(len(begin.dictionary), PREFIX, np.uint64))[begin.indices.to_numpy()]
        at = coded.indices.to_numpy()
        self.n = len(texts)
        self.text, at = text[~empty], at[~empty]
        self.word, self.prefix = word[at], prefix[at]
        first = np.append(True, self.text[1:] != self.text[:-1])[: len(self.text)]
        self.before = np.where(first, START, np.roll(self.word, 1))


def _chunks(texts: pa.Array) -> Iterator[pa.Array]:
    at = size = 0
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for i, n in enumerate(lengths):
        size += n
        if size >= CHUNK or i == len(lengths) - 1:
            yield texts.slice(at, i + 1 - at)
            at, size = i + 1, 0


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for v in columns.values()], list(columns))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word occurs, whatever the label."""
    for b in batches:
        for texts in _chunks(b.column("text")):
            cut = Cut(texts)
            word, first, n = np.unique(cut.word, return_index=True, return_counts=True)
            yield _batch(word=word, prefix=cut.prefix[first], n=n.astype(np.int64))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each pair occurs in ordinary and in toxic texts."""
    for b in batches:
        toxic, at = b.column("toxic").to_numpy(), 0
        for texts in _chunks(b.column("text")):
            cut = Cut(texts)
            bad = toxic[at : at + len(texts)][cut.text] == 1
            at += len(texts)
            key = pairs(cut.before, cut.word)
            _, first, back = np.unique(key, return_index=True, return_inverse=True)
            n1 = np.bincount(back, bad, len(first)).astype(np.int64)
            n0 = np.bincount(back, minlength=len(first)) - n1
            yield _batch(before=cut.before[first], word=cut.word[first], prefix=cut.prefix[first], n0=n0, n1=n1)


class Table:
    """Rows of counts by 64-bit key."""

    def __init__(self, keys: np.ndarray, *columns: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.columns = keys[order], [c[order] for c in columns]

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        """The counts of each key, zero where there are none."""
        if not len(self.keys):
            return [np.zeros(len(keys), c.dtype) for c in self.columns]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        seen = self.keys[at] == keys
        return [np.where(seen, c[at], 0) for c in self.columns]


class Model:
    """Both classes' counts, for ordinary (0) and toxic (1) text: words (N0, N1, n(w) / n(p)) with their beginnings,
    beginnings (W0, W1, S(p)), and for order 2 pairs (n0, n1) and contexts (n0, n1, followers0, followers1)."""

    def __init__(self, words_: Table, prefixes: Table, pairs_: Table | None = None, contexts: Table | None = None):
        self.words, self.prefixes, self.pairs, self.contexts = words_, prefixes, pairs_, contexts
        self.tokens = [float(x.sum()) for x in words_.columns[:2]]
        self.types = [float((x > 0).sum()) for x in words_.columns[:2]]
        self.begun = [float((x > 0).sum()) for x in prefixes.columns[:2]]

    def without_pairs(self) -> Model:
        return Model(self.words, self.prefixes)

    def _alone(self, word: np.ndarray, prefix: np.ndarray, strength: float) -> list[np.ndarray]:
        """P_c(w). Where neither class has seen a word, its share stands as one in both, as it is alike; a word of which they
        have not seen the beginning either is one that the models do not tell about, and as likely in both."""
        own, begin = self.words.find(word), self.prefixes.find(prefix)
        share, known = np.where(own[0] + own[1] > 0, own[2], 1.0), begin[0] + begin[1] > 0
        out = []
        for c, (tokens, types, begun) in enumerate(zip(self.tokens, self.types, self.begun, strict=True)):
            p = (np.maximum(begin[c] - DISCOUNT, 0) + (DISCOUNT * begun + strength * types) * begin[2]) / ((1 + strength) * types)
            p = (np.maximum(own[c] - DISCOUNT, 0) + (DISCOUNT * types + strength * tokens) * p * share) / ((1 + strength) * tokens)
            out.append(np.where(known, p, 1.0))
        return out

    def gains(self, cut: Cut, order: int, strength: float) -> np.ndarray:
        """log P_toxic - log P_ordinary of each word, after its predecessor for order 2; 0 if a class has no words at all."""
        if not all(self.tokens):
            return np.zeros(len(cut.word))
        _, first, back = np.unique(pairs(cut.before, cut.word) if order == 2 else cut.word, return_index=True, return_inverse=True)
        alone = self._alone(cut.word[first], cut.prefix[first], strength)
        if order == 2:
            pair, context = self.pairs.find(pairs(cut.before[first], cut.word[first])), self.contexts.find(cut.before[first])
            for c in (0, 1):
                n = np.maximum(context[c], 1)
                after = (np.maximum(pair[c] - DISCOUNT, 0) + (DISCOUNT * context[2 + c] + strength * n) * alone[c]) / ((1 + strength) * n)
                alone[c] = np.where((context[c] > 0) & (alone[c] < 1), after, alone[c])
        return (np.log(alone[1]) - np.log(alone[0]))[back]

    def evidence(self, texts: pa.Array, settings: Sequence[tuple[int, float, float]]) -> np.ndarray:
        """For each text and setting (order, T, M) the mean over its words, 0 without words."""
        parts = [np.zeros((0, len(settings)))]
        for some in _chunks(texts):
            cut = Cut(some)
            size, known, columns = np.maximum(np.bincount(cut.text, minlength=cut.n), 1), {}, []
            for order, strength, share in settings:
                if (order, strength) not in known:
                    known = {(order, strength): self.gains(cut, order, strength)}
                mixed = np.log1p(share * np.expm1(np.minimum(known[order, strength], 60.0)))
                columns.append(np.bincount(cut.text, mixed, cut.n) / size)
            parts.append(np.stack(columns, axis=1))
        return np.concatenate(parts)


#: What the calibration chooses from.
SETTINGS = tuple((order, strength, share) for order in (2, 1) for strength in STRENGTHS for share in SHARES)


def _scale(x: np.ndarray) -> np.ndarray:
    """Monotone; brings weak and strong evidence to a range that a logistic fit can use."""
    return np.copysign(np.log1p(1000 * np.abs(x)), x)


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic fit of labels y to x: intercept, slope and the loss reached. Newton steps, halved until they gain."""

    def loss(a: float, b: float) -> float:
        return float(np.logaddexp(0, np.where(y == 1, -1, 1) * (a + b * x)).sum()) + 5e-4 * b * b

    a, b, now = 0.0, 0.0, loss(0.0, 0.0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g0, g1, w = float((y - p).sum()), float(((y - p) * x).sum()) - 1e-3 * b, p * (1 - p)
        h00, h01, h11 = float(w.sum()) + 1e-6, float((w * x).sum()), float((w * x * x).sum()) + 1e-3
        det, size = h00 * h11 - h01 * h01, 1.0
        if det <= 1e-12:
            break
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        while size > 1e-6 and loss(a + size * da, b + size * db) >= now:
            size /= 2
        if size <= 1e-6:
            break
        a, b = a + size * da, b + size * db
        now = loss(a, b)
    return a, b, now


class Scorer:
    """A model, the chosen setting and its calibration."""

    def __init__(self, model: Model | None, setting: tuple[int, float, float], a: float, b: float):
        self.model, self.setting, self.a, self.b = model, setting, a, b

    def scores(self, texts: pa.Array) -> np.ndarray:
        x = _scale(self.model.evidence(texts, [self.setting])[:, 0]) if self.model else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.a + self.b * x, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model may see; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _evidence(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = model.value.evidence(b.column("text"), SETTINGS)
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def _table(df: DataFrame, key: str) -> Table:
    t = df.toArrow()
    return Table(t.column(key).to_numpy().view(np.uint64), *(t.column(c).to_numpy() for c in t.column_names if c != key))


def count(text: DataFrame, train: DataFrame) -> Model:
    """The model of train (text, toxic), with shared counts of all of text (text). The tables of counts are made by grouped
    aggregation. What reaches the driver is what the labelled sample holds: its pairs, contexts, words and beginnings."""
    every = keep(text.mapInArrow(_shared, "word long, prefix long, n long").groupBy("word").agg(F.min("prefix").alias("prefix"), F.sum("n").alias("n")), "words")
    begun = every.groupBy("prefix").agg(F.sum("n").alias("n_p"), F.count(F.lit(1)).alias("types"))
    counted = train.mapInArrow(_counted, "before long, word long, prefix long, n0 long, n1 long")
    counted = keep(counted.groupBy("before", "word").agg(F.min("prefix").alias("prefix"), F.sum("n0").cast("int").alias("n0"), F.sum("n1").cast("int").alias("n1")), "pairs")
    contexts = counted.groupBy("before").agg(F.sum("n0").cast("int"), F.sum("n1").cast("int"), F.count_if(F.col("n0") > 0).cast("int"), F.count_if(F.col("n1") > 0).cast("int"))
    seen = counted.groupBy("word").agg(F.min("prefix").alias("prefix"), F.count_if(F.col("n0") > 0).cast("int").alias("s0"), F.count_if(F.col("n1") > 0).cast("int").alias("s1"))
    seen = keep(seen, "seen")
    words_ = seen.select("word", "prefix", "s0", "s1").join(every.select("word", "n"), "word").join(begun, "prefix")
    prefixes = seen.groupBy("prefix").agg(F.count_if(F.col("s0") > 0).cast("int").alias("w0"), F.count_if(F.col("s1") > 0).cast("int").alias("w1"))
    prefixes = prefixes.join(begun, "prefix").select("prefix", "w0", "w1", F.col("types").cast("double") / every.count())
    both = counted.select(F.col("before"), F.col("word"), "n0", "n1").mapInArrow(_keyed, "key long, n0 int, n1 int")
    return Model(_table(words_.select("word", "s0", "s1", F.col("n") / F.col("n_p")), "word"), _table(prefixes, "prefix"), _table(both, "key"), _table(contexts, "before"))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key = pairs(b.column("before").to_numpy().view(np.uint64), b.column("word").to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column("n0"), b.column("n1")], ["key", "n0", "n1"])


def fit(docs: DataFrame, labels: DataFrame) -> Broadcast:
    """The Scorer, broadcast. Fits on at most TRAIN_ROWS labelled rows outside the held-out quarter; a fifth of them, by
    another hash, calibrates and is not counted, unless it or the rest lacks a class: then all rows do both.
    Labels that are null are left out, a document labelled twice is toxic if one label says so, labels without a document
    do nothing. Without a label of either class every document scores 1 or 0, as the labels there are."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    marked = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    apart = F.pmod(F.xxhash64(F.lit(CALIBRATE), "doc_id"), F.lit(CALIBRATE)) == 0
    train = keep(text.join(F.broadcast(sample), "doc_id").select("text", "toxic", apart.alias("apart")), "train")  # TRAIN_ROWS rows of two numbers
    n = {(r["apart"], r["toxic"]): r["n"] for r in train.groupBy("apart", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, plain = (sum(v for (_, t), v in n.items() if t == c) for c in (1, 0))
    if not toxic or not plain:
        return send(Scorer(None, SETTINGS[0], 30.0 if toxic else -30.0, 0.0))
    split = len(n) == 4
    model = count(text.select("text"), train.where("not apart") if split else train)
    rows = (train.where("apart") if split else train).mapInArrow(_evidence(send(model)), "toxic int, x array<double>").collect()
    rows.sort(key=lambda r: (r["toxic"], r["x"]))
    x, y = _scale(np.array([r["x"] for r in rows])), np.array([r["toxic"] for r in rows])
    fits = [calibrate(x[:, i], y) for i in range(len(SETTINGS))]
    best = min(range(len(SETTINGS)), key=lambda i: fits[i][2])
    setting = SETTINGS[best]
    return send(Scorer(model if setting[0] == 2 else model.without_pairs(), setting, *fits[best][:2]))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. A null or empty text has no evidence and gets the score
    of a difference of zero; repeated rows are scored each; an empty table gives an empty table."""
    scorer = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scorer.value.scores(b.column("text")))], ["doc_id", "score"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = text.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, whose score stays below the threshold; a null or empty text scores as one
    without evidence, and an empty table gives an empty table."""
    scorer = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scorer.value.scores(b.column("text")) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
