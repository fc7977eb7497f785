"""Direct impact and blast radius of changed symbols: changed(repo, change_id, symbol)."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shockline.functions.lineage import cut, cut_by, shared_folder


def direct_impact(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """A row per incoming edge of each changed symbol, without self-edges."""
    origins = changed.select("repo", "change_id", F.col("symbol").alias("target")).distinct()
    met = origins.join(edges, ["repo", "target"]).where("source <> target")
    return met.select("repo", "change_id", F.col("target").alias("changed_symbol"), F.col("source").alias("impacted_symbol"), F.col("type").alias("dependency_type"), "lines", "occurrences")


def impacted_symbols(impact: DataFrame) -> DataFrame:
    """Per impacted symbol: its edges and its sorted distinct causes."""
    return impact.groupBy("repo", "change_id", "impacted_symbol").agg(
        F.sort_array(F.collect_list(F.struct("changed_symbol", "dependency_type", "lines", "occurrences"))).alias("edges"),
        F.sort_array(F.collect_set("changed_symbol")).alias("causes"),
    )


#: Origins that a word of a bitmap has lanes for.
LANES = 64
#: Origins whose names are broadcast; those of more are joined.
FEW_ORIGINS = 100_000


#: Nodes up to which they are broadcast to find the edges that touch them, and rounds of that after which the edges are written by source.
FEW_NODES = 1_000_000
SCANS = 3


@dataclass
class Reach:
    """Who reaches what, as bitmaps of origins.

    levels: repo, node, word, bits, depth; a bit is set at the shortest depth at which its origin reaches the node.
    lanes: repo, word, origins; bit k of a word stands for its k-th origin.
    """

    levels: DataFrame
    lanes: DataFrame
    n_origins: int

    def counted(self, rows: DataFrame) -> DataFrame:
        """repo, origin, depth, symbols: the number of rows(repo, word, bits, depth) with the bit of each origin; no row is split up for it."""
        sums = F.array(*(F.sum(F.getbit("bits", F.lit(k)).cast("long")) for k in range(LANES))).alias("sums")
        each = rows.groupBy("repo", "word", "depth").agg(sums).select("repo", "word", "depth", F.posexplode("sums").alias("bit", "symbols")).where("symbols > 0")
        return each.join(self.lanes, ["repo", "word"]).select("repo", F.get("origins", F.col("bit")).alias("origin"), "depth", "symbols")

    def named(self, rows: DataFrame) -> DataFrame:
        """rows(repo, word, bits, node, ...) with a row and ``origin`` for each bit that is set."""
        lanes, on = self.lanes, ["repo", "word"]
        if self.n_origins <= FEW_ORIGINS:
            lanes = F.broadcast(lanes)
        else:  # a word that very many nodes share is met in several tasks
            rows, on = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(16))), [*on, "salt"]
            lanes = lanes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
        set_ = F.filter("origins", lambda _, k: F.getbit(F.col("bits"), k) == 1)
        return rows.join(lanes, on).withColumn("origin", F.explode(set_)).drop("word", "bits", "origins", "salt")


def lanes_of(origins: DataFrame) -> DataFrame:
    """repo, origin, word, bit: origins(repo, origin) in order, LANES of them to a word, so that names that stand together share words."""
    rows = origins.select("repo", "origin").distinct().repartitionByRange("repo", "origin").sortWithinPartitions("repo", "origin")
    rows = cut(rows.withColumn("at", F.monotonically_increasing_id()))
    return rows.select("repo", "origin", F.expr(f"at div {LANES}").alias("word"), (F.col("at") % LANES).cast("int").alias("bit"))


def reach_levels(origins: DataFrame, steps: DataFrame, max_rounds: int = 10_000, starts: DataFrame | None = None, counted: bool = False) -> Reach:
    """Bit-parallel search backwards from every (repo, origin) at once, each at depth 0.

    starts(repo, origin, node) are where an origin begins; without them it is a
    node itself.  steps(repo, source, target) are distinct, without self-edges,
    and best bucketed by target.  ``counted``: steps have ``n``, their number
    of edges, and levels ``met``, the steps that arrive at a node as (bits, n).  A node's origins are a bitmap, so an edge is met once
    per node and word of 64 origins; bitmaps that arrive at a node are combined
    by ``bit_or`` before and after the shuffle.  What was seen before is taken
    off by joins with bucketed tables, which are merged as they grow, so that a
    level shuffles its frontier alone and a row is rewritten a logarithmic
    number of times.  ``max_rounds`` raises rather than leaving rows out.
    """
    key = ["node", "word", "repo"]  # sorts compare the first column's first bytes, and repositories are mostly alike
    lanes = lanes_of(origins)
    n_origins = lanes.count()
    folder = f"{shared_folder(origins.sparkSession)}/levels-{uuid.uuid4().hex}"
    bits = F.expr("bit_or(bits)").alias("bits")
    at = lanes.withColumn("node", F.col("origin")) if starts is None else lanes.join(starts, ["repo", "origin"])
    own = at.select("repo", "node", "word", F.expr("shiftleft(1L, bit)").alias("bits"), F.lit(0).alias("depth"))
    each = [F.collect_list(F.struct("bits", "n")).alias("met")] if counted else []
    more = ["met"] if counted else []
    spark = origins.sparkSession
    met_again = cut(steps.select("target", "repo").distinct())  # what nothing depends on is no frontier
    met_again = F.broadcast(met_again.withColumnRenamed("target", "node")) if met_again.count() <= FEW_NODES else None
    frontier = cut_by(own.groupBy(*key, "depth").agg(bits).select(*key, "bits", "depth"), *key, path=f"{folder}/0")
    paths, seen = [f"{folder}/0"], [(frontier, f"{folder}/0", n_origins)]
    for depth in range(1, max_rounds + 1):
        live = frontier if met_again is None else frontier.join(met_again, ["node", "repo"], "left_semi")
        met = live.select("repo", F.col("node").alias("target"), "word", "bits").join(steps.select("repo", "source", "target", *(["n"] if counted else [])), ["target", "repo"])
        met = met.groupBy(F.col("source").alias("node"), "word", "repo").agg(bits, *each)
        for earlier, *_ in seen:
            met = met.join(earlier.select(*key, F.col("bits").alias("old")), key, "left").select(*key, F.expr("bits & ~coalesce(old, 0L)").alias("bits"), *more)
        path = f"{folder}/{depth}"
        frontier = cut_by(met.where("bits <> 0").withColumn("depth", F.lit(depth)), *key, path=path, dealt=True)
        if not (n := frontier.count()):
            levels = spark.read.schema(frontier.schema).parquet(*paths)
            by_word = lanes.groupBy("repo", "word").agg(F.sort_array(F.collect_list(F.struct("bit", "origin"))).alias("o"))
            return Reach(levels, cut(by_word.select("repo", "word", _by_bit())), n_origins)
        paths.append(path)
        seen.append((frontier, path, n))
        while len(seen) > 1 and seen[-2][2] <= 2 * seen[-1][2]:
            (_, a, n), (_, b, m) = seen.pop(), seen.pop()
            # Read as plain files: a union of bucketed tables is planned as if it lay by their buckets, and does not.
            both = spark.read.schema(frontier.schema).parquet(a, b).groupBy(*key).agg(bits)
            path = f"{folder}/seen-{depth}-{len(seen)}"
            seen.append((cut_by(both.select(*key, "bits", F.lit(0).alias("depth")), *key, path=path, dealt=True), path, n + m))
    raise RuntimeError(f"blast radius not complete after {max_rounds} rounds")


def _by_bit() -> Column:
    """The origins of a word at their bits' places, up to the last one; a repository may begin within a word."""
    return F.transform(F.sequence(F.lit(0), F.array_max(F.col("o")["bit"])), lambda k: F.get(F.filter("o", lambda x: x["bit"] == k), F.lit(0))["origin"]).alias("origins")


def reach_depths(origins: DataFrame, steps: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """repo, origin, node, depth: what each (repo, origin) reaches backwards, itself included at 0."""
    found = reach_levels(origins, steps, max_rounds)
    return found.named(found.levels).select("repo", "origin", "node", "depth")


def reach(origins: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Walks edges backwards from each (repo, origin) to the fixed point.

    repo, origin, impacted, depth and the evidence: every edge (impacted -> target)
    that arrives at the shortest depth.  Edges whose target can't be on a
    frontier are left out first; the others are bucketed by target for all the
    levels' joins.  The evidence is joined once, at the end, on bitmaps too:
    its edges lead from one depth to the one before, for the origins that both
    ends share.
    """
    starts = origins.select("repo", F.col("origin").alias("target")).distinct()
    steps = edges.where("source <> target").select("repo", "source", "target", "type", "lines", "occurrences")
    live = steps.select("repo", F.col("source").alias("target")).unionByName(starts).distinct()
    steps = cut_by(steps.join(live, ["target", "repo"], "left_semi"), "target", "repo")
    ids = cut_by(steps.select("repo", "source", "target").distinct(), "target", "repo", dealt=True)
    found = reach_levels(origins, ids, max_rounds)
    return _evidence(found, steps, found.levels.where("depth > 0"))


def _evidence(found: Reach, steps: DataFrame, reached: DataFrame) -> DataFrame:
    """The evidence of the levels' rows that are reached, over steps(repo, source, target, type, lines, occurrences)."""
    later = reached.select("repo", F.col("node").alias("source"), "word", F.col("bits").alias("own"), "depth")
    back = found.levels.select("repo", F.col("node").alias("target"), "word", "bits", (F.col("depth") + 1).alias("depth"))
    rows = back.join(steps, ["target", "repo"]).join(later, ["source", "word", "depth", "repo"]).withColumn("bits", F.expr("bits & own")).where("bits <> 0").withColumnRenamed("source", "node")
    return found.named(rows).select("repo", "origin", F.col("node").alias("impacted"), "depth", "target", F.col("type").alias("dependency_type"), "lines", "occurrences")


def first_origins(changed: DataFrame, edges: DataFrame, shown: DataFrame) -> DataFrame:
    """The rows of ``blast_origins`` of few entries (repo, change_id, impacted_symbol) of each change."""
    own = changed.select("repo", "change_id", F.col("symbol").alias("origin")).distinct()
    found = reach_levels(own.select("repo", "origin").distinct(), pairs(edges))
    nodes = cut(shown.select("repo", F.col("impacted_symbol").alias("node")).distinct())
    few = F.broadcast if nodes.count() <= FEW_NODES else (lambda x: x)
    steps = cut(edges.where("source <> target").join(few(nodes.withColumnRenamed("node", "source")), ["source", "repo"], "left_semi"))
    ends = cut(steps.select("repo", F.col("target").alias("node")).distinct())
    near = Reach(found.levels.join(few(ends) if ends.count() <= FEW_NODES else ends, ["node", "repo"], "left_semi"), found.lanes, found.n_origins)
    rows = _evidence(near, steps, found.levels.where("depth > 0").join(few(nodes), ["node", "repo"], "left_semi"))
    rows = own.join(rows, ["repo", "origin"]).withColumnRenamed("impacted", "impacted_symbol").join(shown.select("repo", "change_id", "impacted_symbol"), ["impacted_symbol", "change_id", "repo"], "left_semi")
    return rows.select("repo", "change_id", "impacted_symbol", F.col("origin").alias("changed_symbol"), "depth", "target", "dependency_type", "lines", "occurrences")


def pairs(edges: DataFrame, counted: bool = False) -> DataFrame:
    """repo, target, source: the pairs of different nodes, in buckets of the target; ``counted``: with n, their number of types.

    An edge may be there many times, as in the sites that it comes from: what
    is needed of them is shuffled once.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["target", "repo", "source"]
    rows = edges.where("source <> target").select(*key, *(["type"] if counted else [])).repartition(parts, "target", "repo").distinct()
    return cut_by(rows.groupBy(*key).agg(F.count("*").alias("n")) if counted else rows, "target", "repo", dealt=True)


def edges_from(nodes: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The edges that lie within ``max_depth`` steps forwards from nodes(repo, node), or at any distance; self-edges are left out.

    As a walk backwards meets a node only over what that depends on, these are
    all the edges that walks to the nodes can take.  Each round reads the edges
    once, and few nodes are broadcast to the readers, so that nothing is
    shuffled but what they find.
    """
    here = cut(nodes.select("repo", "node").distinct())
    seen, found, rest, depth = here, None, edges.where("source <> target"), 0
    while (n := here.count()) and depth != max_depth:
        if depth == SCANS:
            rest = cut_by(rest, "source", "repo")
        depth += 1
        starts = here.withColumnRenamed("node", "source")
        part = cut(rest.join(F.broadcast(starts) if n <= FEW_NODES else starts, ["source", "repo"], "left_semi"))
        found = part if found is None else found.unionByName(part)
        here = cut(part.select("repo", F.col("target").alias("node")).distinct().join(seen, ["node", "repo"], "left_anti"))
        seen = seen.unionByName(here)
    return edges.where(F.lit(False)) if found is None else found


@dataclass
class Blast:
    """The blast radius of changes: a change walks from all its symbols at once, so the first depth it comes to a node at is that entry's.

    found: a lane is a change.
    """

    found: Reach

    def levels(self, nodes: DataFrame | None = None) -> DataFrame:
        rows = self.found.levels.where("depth > 0")
        return rows if nodes is None else rows.join(nodes.select("repo", "node").distinct(), ["node", "repo"], "left_semi")

    def entries(self, nodes: DataFrame | None = None) -> DataFrame:
        """What ``blast_depths`` gives, for all impacted symbols or those of nodes(repo, node)."""
        return self._entries(self.levels(nodes))

    def first_entries(self, n: int) -> DataFrame:
        """Entries of each change down to the depth that has its n-th, so its first n by depth are among them."""
        above = Window.partitionBy("repo", "origin").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
        shown = self.found.counted(self.levels()).withColumn("before", F.coalesce(F.sum("symbols").over(above), F.lit(0))).where(F.col("before") < n).groupBy("repo", "origin").agg(F.max("depth").alias("last"))
        lanes = self.found.lanes.select("repo", "word", F.posexplode("origins").alias("bit", "origin")).join(shown, ["repo", "origin"])
        lanes = lanes.select("repo", "word", F.explode(F.sequence(F.lit(1), "last")).alias("depth"), "bit").groupBy("repo", "word", "depth").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))
        rows = self.levels().join(lanes, ["repo", "word", "depth"]).withColumn("bits", F.expr("bits & mask")).where("bits <> 0").drop("mask")
        return self._entries(rows)

    def histogram(self, nodes: DataFrame | None = None) -> DataFrame:
        """repo, change_id, depth, symbols, as ``depth_histogram`` gives it, without the entries."""
        return self.found.counted(self.levels(nodes)).withColumnRenamed("origin", "change_id").select("repo", "change_id", "depth", "symbols")

    def _entries(self, rows: DataFrame) -> DataFrame:
        return self.found.named(rows).select("repo", F.col("origin").alias("change_id"), F.col("node").alias("impacted_symbol"), "depth")


def blast(changed: DataFrame, edges: DataFrame) -> Blast:
    starts = changed.select("repo", F.col("change_id").alias("origin"), F.col("symbol").alias("node")).distinct()
    return Blast(reach_levels(starts.select("repo", "origin").distinct(), pairs(edges), starts=starts))


def blast_counts(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """repo, change_id, impacted_symbol, depth, n_origins: the entries of ``blast_radius`` with the number of their origins.

    A node's evidence is the steps it is met by, as bitmaps, and it is counted
    by bits: rows of evidence are not made.
    """
    own = changed.select("repo", "change_id", F.col("symbol").alias("origin")).distinct()
    found = reach_levels(own.select("repo", "origin").distinct(), pairs(edges, counted=True), counted=True)
    masks = found.lanes.select("repo", "word", F.posexplode("origins").alias("bit", "origin")).join(own, ["repo", "origin"])
    masks = cut(masks.groupBy("repo", "word", "change_id").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask")))
    rows = found.levels.where("depth > 0").join(F.broadcast(masks) if masks.count() <= FEW_ORIGINS else masks, ["repo", "word"])
    rows = rows.withColumn("bits", F.expr("bits & mask")).where("bits <> 0")
    n = F.expr("aggregate(met, 0L, (n, x) -> n + bit_count(x.bits & bits) * x.n)")
    per = rows.select("repo", "change_id", F.col("node").alias("impacted_symbol"), "depth", n.alias("n")).groupBy("impacted_symbol", "change_id", "repo").agg(F.min("depth").alias("depth"), F.sum("n").alias("n_origins"))
    return per.join(own.withColumnRenamed("origin", "impacted_symbol"), ["impacted_symbol", "change_id", "repo"], "left_anti")


def origin_depths(changed: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """repo, change_id, changed_symbol, impacted_symbol, depth for the impacted symbols among nodes(repo, node), without the evidence.

    Only edges that lie on a way to one of them are walked.
    """
    own = changed.select("repo", "change_id", F.col("symbol").alias("origin")).distinct()
    nodes = cut(nodes.select("repo", "node").distinct())
    found = reach_levels(own.select("repo", "origin").distinct(), pairs(edges_from(nodes, edges)))
    rows = found.named(Blast(found).levels(nodes)).select("repo", "origin", F.col("node").alias("impacted_symbol"), "depth")
    met = own.join(rows, ["repo", "origin"]).join(own.withColumnRenamed("origin", "impacted_symbol"), ["repo", "change_id", "impacted_symbol"], "left_anti")
    return met.select("repo", "change_id", F.col("origin").alias("changed_symbol"), "impacted_symbol", "depth")


def blast_origins(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """Evidence rows per change, without symbols that are themselves changed in it.  Each origin is walked once for all changes."""
    origins = changed.select("repo", "change_id", F.col("symbol").alias("origin")).distinct()
    rows = origins.join(reach(origins, edges), ["repo", "origin"])
    own = origins.select("repo", "change_id", F.col("origin").alias("impacted"))
    rows = rows.join(own, ["repo", "change_id", "impacted"], "left_anti")
    return rows.select("repo", "change_id", F.col("impacted").alias("impacted_symbol"), F.col("origin").alias("changed_symbol"), "depth", "target", "dependency_type", "lines", "occurrences")


def blast_radius(origins: DataFrame) -> DataFrame:
    """Entries per change and impacted symbol: shortest depth, and its origins in order."""
    first = F.coalesce(F.get("lines", F.lit(0)), F.lit(0)).alias("line")
    each = F.struct("changed_symbol", "depth", "dependency_type", "target", first, "lines", "occurrences")
    return origins.groupBy("repo", "change_id", "impacted_symbol").agg(F.min("depth").alias("depth"), F.transform(F.sort_array(F.collect_list(each)), lambda x: x.dropFields("line")).alias("origins"))


def blast_depths(origins: DataFrame) -> DataFrame:
    """Shortest depth per change and impacted symbol, without the evidence; ``blast`` has them without origins."""
    return origins.groupBy("repo", "change_id", "impacted_symbol").agg(F.min("depth").alias("depth"))


def entries_at(entries: DataFrame, depth: int) -> DataFrame:
    return entries.where(F.col("depth") == depth)


def listed_entries(entries: DataFrame) -> DataFrame:
    return entries.orderBy("repo", "change_id", "depth", "impacted_symbol")


def depth_histogram(entries: DataFrame) -> DataFrame:
    return entries.groupBy("repo", "change_id", "depth").agg(F.count("*").alias("symbols"))
