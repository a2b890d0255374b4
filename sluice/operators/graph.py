"""Graph operators over edge tables. Each round is written to the checkpoint folder, so lineage stays short; only counts
reach the driver. Joins are merges of two shuffled sides: a round's table is often small enough to be broadcast, but its rows
would go through the driver, round for round, and the rounds' sum grows with the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.tables import keep


def _checkpointed(df: DataFrame) -> DataFrame:
    return keep(df, "graph")


def _jumps(e: DataFrame) -> list[DataFrame]:
    """Tables of jumps along nodes with a single edge: the k-th takes (_from, _to) 2^k edges on. There are as many as the longest
    run of such nodes has bits; where runs end in a circle, as many as the number of nodes has."""
    single = e.groupBy("_from").agg(F.min("_to").alias("_to"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    jumps = [_checkpointed(single)]
    for _ in range(jumps[0].count().bit_length()):
        last = jumps[-1]
        further = last.select("_from", F.col("_to").alias("_via")).join(last.select(F.col("_from").alias("_via"), "_to").hint("merge"), "_via").select("_from", "_to")
        further = _checkpointed(further)
        if further.isEmpty():
            break
        jumps.append(further)
    return jumps


def _expanded(front: DataFrame, jumps: list[DataFrame], cols: list[str]) -> DataFrame:
    """front (cols, id, depth) and what lies behind it along single edges, each at its least depth: by falling powers of two,
    every place of a run is met in as many joins as it has bits."""
    for k in reversed(range(len(jumps))):
        step = front.join(jumps[k].hint("merge"), front.id == jumps[k]._from).select(*cols, F.col("_to").alias("id"), (F.col("depth") + F.lit(1 << k)).alias("depth"))
        front = front.unionByName(step).groupBy(*cols, "id").agg(F.min("depth").alias("depth"))
        if k % 4 == 0:
            front = _checkpointed(front)
    return front


def _spread(edges: DataFrame, starts: DataFrame, cols: list[str]) -> DataFrame:
    """starts (cols, id, depth), distinct -> all ids that they reach, at their least depth. A round goes on from ids that are
    new, or nearer than they were: over one edge, then along all single edges behind it."""
    e = _checkpointed(edges.select(F.col("id").alias("_from"), F.col("depends_on").alias("_to")).distinct())
    jumps = _jumps(e)
    seen = front = _checkpointed(_expanded(starts, jumps, cols))
    while True:
        step = front.join(e.hint("merge"), front.id == e._from).select(*cols, F.col("_to").alias("id"), (F.col("depth") + 1).alias("depth"))
        step = step.groupBy(*cols, "id").agg(F.min("depth").alias("depth"))
        known = seen.select(*[F.col(c).alias(f"_{c}") for c in [*cols, "id"]], F.col("depth").alias("_was"))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*cols, "id"]])
        nearer = step.join(known.hint("merge"), same, "left").where("_was is null or depth < _was").select(*cols, "id", "depth")
        nearer = _checkpointed(nearer)
        if nearer.isEmpty():
            return seen
        front = _checkpointed(_expanded(nearer, jumps, cols))
        seen = _checkpointed(seen.unionByName(front).groupBy(*cols, "id").agg(F.min("depth").alias("depth")))


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """GRF-1. edges (id, depends_on), roots (root) -> (root, id, depth): all ids that each root reaches, itself at 0, at the
    least number of steps. Runs of nodes with a single edge are jumped along by powers of two, so rounds count branchings, not
    steps; cycles end, as only ids that are new or nearer go on."""
    starts = roots.select("root", F.col("root").alias("id"), F.lit(0).alias("depth")).distinct()
    return _spread(edges, starts, ["root"]).select("root", "id", "depth")


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Distinct ids that any start (id) reaches, the starts among them. Only ids are kept, not who reaches them."""
    return _spread(edges, starts.select("id", F.lit(0).alias("depth")).distinct(), []).select("id")


def prerequisites(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """GRF-4. Every check that a selected one (id) rests on, however far, and the selected ones themselves."""
    return reached(edges, selected)


def _ends(single: DataFrame) -> DataFrame:
    """single (id, to): nodes with one edge -> (id, end, steps): the first node without a single edge that each leads to, by
    pointers that double. Nodes that lead into a circle have no row."""
    hop = _checkpointed(single.select("id", F.col("to").alias("end"), F.lit(1).cast("long").alias("steps")))
    for _ in range(hop.count().bit_length()):
        on = hop.select(F.col("id").alias("_mid"), F.col("end").alias("_end"), F.col("steps").alias("_more"))
        joined = hop.join(on.hint("merge"), F.col("end") == F.col("_mid"), "left")
        if joined.where("_mid is not null").isEmpty():
            break
        hop = _checkpointed(joined.select("id", F.coalesce("_end", "end").alias("end"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps")))
    return hop.join(single.select(F.col("id").alias("end")).hint("merge"), "end", "left_anti")


def levels(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GRF-2. nodes (id), edges (id, depends_on) -> ((id, level): one more than the highest prerequisite, gaps (id, gap):
    repeated or unknown edges, and ids on or behind a cycle).

    A node with one prerequisite lies a known number of steps above the node where its run ends, found by pointers that double.
    What is left are nodes with none or several, joined by edges as long as the runs between them; a round settles those whose
    prerequisites are settled."""
    e = edges.groupBy("id", "depends_on").agg(F.count(F.lit(1)).alias("n"))
    repeated = e.where("n > 1").select("id", F.lit("repeated").alias("gap")).distinct()
    ids = _checkpointed(nodes.select("id").distinct())
    known = ids.select(F.col("id").alias("depends_on"))
    unknown = e.join(known.hint("merge"), "depends_on", "left_anti").select("id", F.lit("unknown").alias("gap")).distinct()
    e = _checkpointed(e.join(known.hint("merge"), "depends_on", "left_semi").join(ids.hint("merge"), "id", "left_semi").select("id", "depends_on"))
    single = _checkpointed(e.groupBy("id").agg(F.min("depends_on").alias("to"), F.count(F.lit(1)).alias("n")).where("n = 1").select("id", "to"))
    ends = _checkpointed(_ends(single))
    hubs = _checkpointed(ids.join(single.select("id").hint("merge"), "id", "left_anti"))
    below = e.join(single.select("id").hint("merge"), "id", "left_anti").join(ends.select(F.col("id").alias("depends_on"), "end", "steps").hint("merge"), "depends_on", "left")
    below = below.join(single.select(F.col("id").alias("depends_on"), F.lit(True).alias("run")).hint("merge"), "depends_on", "left")
    # a run that leads into a circle ends nowhere: its edge waits for ever
    below = below.select("id", F.when(F.col("run") & F.col("end").isNull(), F.col("id")).otherwise(F.coalesce("end", "depends_on")).alias("on"), (F.coalesce("steps", F.lit(0)) + 1).alias("far"))
    below = _checkpointed(below.groupBy("id", "on").agg(F.max("far").alias("far")))
    done = front = _checkpointed(hubs.join(below.select("id").hint("merge"), "id", "left_anti").select("id", F.lit(0).cast("long").alias("level")))
    while not front.isEmpty():
        of = done.select(F.col("id").alias("on"), "level")
        waiting = below.join(done.select("id").hint("merge"), "id", "left_anti").join(of.hint("merge"), "on", "left")
        ready = waiting.groupBy("id").agg(F.count_if(F.col("level").isNull()).alias("open"), F.max(F.col("level") + F.col("far")).alias("level"))
        front = _checkpointed(ready.where("open = 0").select("id", "level"))
        done = _checkpointed(done.unionByName(front))
    above = ends.join(done.select(F.col("id").alias("end"), "level").hint("merge"), "end").select("id", (F.col("level") + F.col("steps")).alias("level"))
    placed = _checkpointed(done.unionByName(above).select("id", F.col("level").cast("int").alias("level")))
    cycle = ids.join(placed.select("id").hint("merge"), "id", "left_anti").select("id", F.lit("cycle").alias("gap"))
    return placed, repeated.unionByName(unknown).unionByName(cycle)


def blocked(checks: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF-3. checks (id, passed) -> checks that rest, however far, on one that did not pass."""
    back = edges.select(F.col("depends_on").alias("id"), F.col("id").alias("depends_on"))
    first = back.join(checks.where("not passed").select("id").hint("merge"), "id").select(F.col("depends_on").alias("id"))
    return reached(back, first)


def origins(commits: DataFrame, entities: DataFrame, order: DataFrame) -> DataFrame:
    """GRF-5. commits (oid, parents array), entities (oid, entity, bytes), order (oid, level) -> (oid, entity, origin): an entity
    whose bytes equal a parent's inherits that parent's origins, over all such parents; else this commit is its origin."""
    e = entities.join(order.hint("merge"), "oid")
    parents = commits.select("oid", F.explode("parents").alias("parent"))
    from_parent = e.join(parents.hint("merge"), "oid").join(
        entities.select(F.col("oid").alias("parent"), "entity", F.col("bytes").alias("_was")).hint("merge"), ["parent", "entity"]
    ).where("bytes = _was").select("oid", "entity", "parent")
    from_parent = _checkpointed(from_parent)
    own = _checkpointed(e.join(from_parent.select("oid", "entity").distinct().hint("merge"), ["oid", "entity"], "left_anti").select("oid", "entity", F.col("oid").alias("origin")))
    # a commit with one such parent has that parent's origins: it looks them up where its run of such commits ends
    node = lambda oid: F.struct(F.col(oid).alias("oid"), F.col("entity").alias("entity"))
    up = _checkpointed(from_parent.select(node("oid").alias("id"), node("parent").alias("to")).distinct())
    single = _checkpointed(up.groupBy("id").agg(F.min("to").alias("to"), F.count(F.lit(1)).alias("n")).where("n = 1").select("id", "to"))
    ends = _checkpointed(_ends(single).select("id", "end"))
    merges = up.join(single.select("id").hint("merge"), "id", "left_anti").join(ends.select(F.col("id").alias("to"), "end").hint("merge"), "to", "left").select("id", F.coalesce("end", "to").alias("to")).distinct()
    merges = _checkpointed(merges)
    found = front = _checkpointed(own.select(node("oid").alias("id"), "origin"))
    while True:
        step = merges.join(front.select(F.col("id").alias("to"), "origin").hint("merge"), "to").select("id", "origin").distinct()
        front = _checkpointed(step.join(found.hint("merge"), ["id", "origin"], "left_anti"))
        if front.isEmpty():
            break
        found = _checkpointed(found.unionByName(front))
    runs = ends.join(found.select(F.col("id").alias("end"), "origin").hint("merge"), "end").select("id", "origin")
    return found.unionByName(runs).select("id.oid", "id.entity", "origin")


def declarations(origin: DataFrame, trailers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GRF-6. origin rows of GRF-5, trailers (oid, value) -> ((oid, entity, value): declared if every origin has the trailer,
    gaps: origins with the trailer twice)."""
    n = trailers.groupBy(F.col("oid").alias("origin")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value"))
    rows = origin.join(n.hint("merge"), "origin", "left")
    out = rows.groupBy("oid", "entity").agg(F.bool_and(F.coalesce(F.col("n") == 1, F.lit(False))).alias("every"), F.min("value").alias("value"))
    return out.where("every").select("oid", "entity", "value"), n.where("n > 1").select("origin")


def contaminated(cases: DataFrame, derived: DataFrame) -> DataFrame:
    """GRF-7. cases (id, kind, source), derived (id, depends_on) -> independent cases that descend from generated or tuning
    evidence, or share a source with it."""
    bad = cases.where("kind in ('generated', 'tuning')")
    back = derived.select(F.col("depends_on").alias("id"), F.col("id").alias("depends_on"))
    down = reached(back, bad)
    free = cases.where("kind = 'independent'")
    by_descent = free.join(down.hint("merge"), "id", "left_semi").select("id", F.lit("descends").alias("why"))
    by_source = free.join(bad.select("source").distinct().hint("merge"), "source", "left_semi").select("id", F.lit("shares_source").alias("why"))
    return by_descent.unionByName(by_source)


def participated(origin: DataFrame, actors: DataFrame, kind: str = "agent") -> DataFrame:
    """GRF-8. Entities of which an origin commit was made by an actor of this kind. actors: (oid, kind)."""
    of = actors.where(F.col("kind") == kind).select(F.col("oid").alias("origin")).distinct()
    return origin.join(of.hint("merge"), "origin", "left_semi").select("oid", "entity").distinct()
