"""Mixing sources to target weights, in DataFrame expressions only.

Each source's documents are laid end to end and cut into blocks of a fixed number of words. A source's target gives its
number of draws. How many of them go to each output shard is drawn: every draw chooses a shard at random and the choices are
counted, so a shard's counts by source are multinomial given those totals, and the totals hold exactly. The counts give each
shard a range of each source's draws, and all else is arithmetic: draw j of a source with n blocks takes block
permuted(j mod n), and its slot is a permuted place of the shard. Blocks and documents meet by an equality join on the
block's index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.tables import keep, partitions, running, table

WEIGHTS = (5, 2, 1)
MOST = 3  # times a source's own size
BLOCK = 32  # words
PART = 1 << 16  # rows of one piece in which documents are laid end to end
ROUNDS = 24  # of a permutation of indices
WORD = r"[^\x20\x09-\x0D]+"
SPACED = rf"[\x20\x09-\x0D]*{WORD}(?:[\x20\x09-\x0D]+\z)?"  # a word with the white space before it, the last one with all
CHUNK = 1 << 16  # draws made from one row


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, source_size) -> also target double, draws_for long.

    Sources in code-point order, null last, weigh as `weights`, repeating, and share the sum of all sizes; a target stops
    at `most` times its source's size and the excess is shared by weight until none is above. That end is reached at once:
    sources stop in the order of size by weight, and the least number of stopped sources whose rest fits is the answer."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.orderBy("limit_by_weight", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("limit_by_weight", "rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("rank", F.row_number().over(order) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("limit", F.col("source_size") * most).withColumn("limit_by_weight", F.col("limit") / F.col("weight"))
    rows = rows.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.coalesce(F.sum("limit").over(before), F.lit(0)).alias("stopped"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left"),
    )
    rows = rows.withColumn("share", (F.col("total") - F.col("stopped")) / F.col("left"))  # words a unit of weight, with those before stopped
    level = F.min(F.when(F.col("share") <= F.col("limit_by_weight"), F.struct("limit_by_weight", "rank", "share"))).over(every)
    rows = rows.withColumn("level", level["share"])
    target = F.least(F.col("limit").cast("double"), F.col("weight") * F.coalesce("level", F.lit(0.0)))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def _many(rows: DataFrame, count: str, out: str, n: int, *keys: str) -> DataFrame:
    """A row for each number from 0 to count - 1, by way of chunks that are dealt out before they grow."""
    chunks = rows.where(f"{count} > 0").withColumn("_c", F.explode(F.expr(f"sequence(0L, ({count} - 1) div {CHUNK})")))
    chunks = chunks.repartition(n, *keys, "_c")
    last = F.expr(f"least({count} - 1, _c * {CHUNK} + {CHUNK - 1})")
    return chunks.withColumn(out, F.explode(F.sequence(F.col("_c") * CHUNK, last))).drop("_c")


def permuted(index: Column, n: Column, key: Column) -> Column:
    """The place of `index` in a pseudorandom permutation of 0 to n - 1 that `key` names, by swapping or not: each round pairs
    x with (k - x) mod n and a hash of the pair says whether to swap, so every round is a permutation of exactly n."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        swap = F.xxhash64(key, r, F.greatest(x, other)) < 0
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), step)


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    block: int = BLOCK,
    shards: int = 64,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> dict[str, DataFrame]:
    """"documents": doc_id, size, source, source_size, target, taken, one row per input row. "slots": the mix itself:
    shard, slot (gapless from 0), source, block, draw. "spans": which words of which document fill each block; "uses": how
    often each block is drawn.

    Sizes count runs of characters outside space and \\x09-\\x0D; a null text counts none. A null source is a source of
    its own, last in order. Rows without words take nothing. Repeated rows are laid down one by one. Null ids come first
    in their source. An empty table gives empty tables. Sources are few: their table is sorted in one task."""
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
    )
    rows = keep(rows, "sizes")
    parts = 1 << max(8, (rows.count() // PART).bit_length())
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    goals = keep(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    goals = goals.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    # whole rounds take every word; what is left of the target is so many more blocks
    rounds = F.expr("if(source_size = 0, 0L, cast(floor(target / source_size) as bigint))")
    rest = (F.col("target") - rounds * F.col("source_size")) / block
    goals = goals.withColumn("draws", rounds * F.col("blocks") + F.least(F.round(rest).cast("long"), F.col("blocks")))
    goals = goals.withColumn("draws", F.least("draws", F.col("blocks") * most))
    slim = goals.select(F.col("source").alias("_source"), "blocks", "draws", "source_size", "target")

    laid = running(rows.where("size > 0"), ["source"], "part", ["doc_id", "size", "text_hash"], F.col("size"), "start")
    laid = keep(laid, "laid")  # a source's starts differ
    spans = laid.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})"))).select(
        "source", "block", "doc_id", "text_hash", "start",
        F.expr(f"greatest(start, block * {block})").alias("from_word"),
        F.expr(f"least(start + size, (block + 1) * {block})").alias("to_word"),
    )

    draws = _many(slim.select("_source", "blocks", "draws"), "draws", "draw", n, "_source")
    chosen = F.pmod(F.xxhash64(F.lit(seed), "_source", "draw"), F.lit(shards)).cast("int")
    counts = keep(draws.groupBy("_source", "blocks", chosen.alias("shard")).agg(F.count(F.lit(1)).alias("n")), "counts")  # sources x shards
    earlier = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = counts.select(
        "*", earlier("_source", "shard").alias("first_draw"), earlier("shard", "_source").alias("first_slot"), F.sum("n").over(Window.partitionBy("shard")).alias("slots")
    )
    drawn = _many(keep(ranges, "ranges"), "n", "k", n, "_source", "shard").withColumn("draw", F.col("first_draw") + F.col("k"))
    drawn = drawn.select(
        "shard", permuted(F.col("first_slot") + F.col("k"), F.col("slots"), F.xxhash64(F.lit(seed + 1), "shard")).alias("slot"),
        F.col("_source").alias("source"), permuted(F.col("draw") % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed + 2), "_source")).alias("block"), "draw",
    )
    uses = drawn.groupBy("source", "block").agg(F.count(F.lit(1)).alias("uses")).select(F.col("source").alias("u_source"), F.col("block").alias("u_block"), "uses")
    uses = keep(uses, "uses")  # else the planner takes the rows of a count for as few as the counts
    taken = (
        spans.join(uses.hint("merge"), F.col("source").eqNullSafe(F.col("u_source")) & (F.col("block") == F.col("u_block")))
        .groupBy("source", "start")
        .agg(F.sum((F.col("to_word") - F.col("from_word")) * F.col("uses")).alias("taken"))
        .select(F.col("source").alias("t_source"), F.col("start").alias("t_start"), "taken")
    )
    some = laid.join(taken, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("start") == F.col("t_start")), "left")
    some = some.select("doc_id", "source", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    none = rows.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("taken"))
    out = some.unionByName(none).join(slim, F.col("source").eqNullSafe(F.col("_source")))
    return {
        "documents": out.select("doc_id", "size", "source", "source_size", "target", "taken"),
        "slots": drawn,
        "spans": spans,
        "uses": uses.select(F.col("u_source").alias("source"), F.col("u_block").alias("block"), "uses"),
    }


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, all columns as in docs. A document is given as often as the block of its that is drawn most; the
    k-th time with the words of the blocks that are drawn k times or more, in order and with the white space before them, so
    that a document whose blocks are all drawn comes whole and nothing stands twice within a text. n_chars, if there, is the
    new length. Documents of which nothing is taken go. Rows with one id, source and text are repeats of one row; each is
    given by what is taken of it, with the other columns of one of them. A null text has no words and goes; an empty table
    gives an empty table."""
    made = mix(docs, **options)
    uses = made["uses"].select(F.col("source").alias("u_source"), F.col("block").alias("u_block"), "uses")
    pieces = made["spans"].join(uses.hint("merge"), F.col("source").eqNullSafe(F.col("u_source")) & (F.col("block") == F.col("u_block")))
    piece = F.struct((F.col("from_word") - F.col("start")).cast("int").alias("skip"), (F.col("to_word") - F.col("from_word")).cast("int").alias("words"), "uses")
    pieces = pieces.groupBy("doc_id", "source", "text_hash", "start").agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.max("uses").alias("times"))
    name = lambda i, s, h: F.xxhash64(i, i.isNull(), s, s.isNull(), h)
    pieces = pieces.select(name(F.col("doc_id"), F.col("source"), F.col("text_hash")).alias("name"), F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("text_hash").alias("p_hash"), "pieces", "times")
    i, s, h = F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(F.col("text").cast("string"))
    row = docs.select(F.struct("*").alias("row"), i.alias("id"), s.alias("source_"), h.alias("hash"), name(i, s, h).alias("key"))
    row = row.repartition(partitions(docs.sparkSession), "key").dropDuplicates(["key", "id", "source_", "hash"])  # one shuffle with the join
    same = (F.col("key") == F.col("name")) & F.col("id").eqNullSafe(F.col("p_id")) & F.col("source_").eqNullSafe(F.col("p_source")) & (F.col("hash") == F.col("p_hash"))
    found = row.join(pieces.hint("merge"), same)
    words = F.regexp_extract_all(F.col("row.text").cast("string"), F.lit(SPACED), F.lit(0))
    found = found.select("row", "pieces", "times", F.explode(F.array(words)).alias("words"))  # cut once a row; else the planner would cut for every piece
    found = found.select("row", "pieces", "words", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("time"))
    again = F.filter("pieces", lambda p: p["uses"] >= F.col("time"))
    text = F.array_join(F.flatten(F.transform(again, lambda p: F.slice("words", p["skip"] + 1, p["words"]))), "")
    found = found.select("row", text.alias("text"))
    length = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    new = {"text": F.col("text").cast(docs.schema["text"].dataType), **length}
    return found.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))["documents"].select("doc_id", "size", "source_size", "target", "taken")
