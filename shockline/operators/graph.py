"""Typed dependency graphs.  An edge source -> target says that source depends on target."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockline.functions.lineage import cut
from shockline.functions.names import node_name


def build_edges(dependencies: DataFrame) -> DataFrame:
    """One edge per (repo, source, target, type); that of the smallest first line keeps its lines and occurrences."""
    best = F.min(F.struct(F.coalesce(F.element_at("lines", 1), F.lit(0)).alias("first"), "lines", "occurrences")).alias("best")
    return dependencies.groupBy("repo", "source", "target", "type").agg(best).select("repo", "source", "target", "type", "best.lines", "best.occurrences")


def build_nodes(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """All symbols as known nodes, and every other endpoint of an edge as an unknown one."""
    known = symbols.select("repo", F.col("fqn").alias("id"), "type", "name", "file", F.lit(True).alias("known"))
    ends = edges.select("repo", F.explode(F.array("source", "target")).alias("id")).distinct()
    unknown = ends.join(known, ["repo", "id"], "left_anti")
    text = F.lit(None).cast("string")
    return known.unionByName(unknown.select("repo", "id", text.alias("type"), node_name(F.col("id")).alias("name"), text.alias("file"), F.lit(False).alias("known")))


def dependent_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Incoming edges of the nodes (repo, id), in their own direction."""
    return edges.join(nodes.select("repo", F.col("id").alias("target")).distinct(), ["repo", "target"], "left_semi")


def dependents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """repo, id, dependent: the distinct sources of the nodes' incoming edges."""
    return dependent_edges(edges, nodes).select("repo", F.col("target").alias("id"), F.col("source").alias("dependent")).distinct()


def having_dependents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes (repo, id) with an incoming edge."""
    return nodes.join(edges.select("repo", F.col("target").alias("id")), ["repo", "id"], "left_semi")


def having_edge(wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows (repo, source, target, type) of wanted that are edges."""
    return wanted.join(edges, ["repo", "source", "target", "type"], "left_semi")


def listed_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("repo", "id")


def listed_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("repo", "source", "target", "type")


def reverse_adjacency(edges: DataFrame) -> DataFrame:
    """Per target with an incoming edge, its edges by (source, type)."""
    return edges.groupBy("repo", "target").agg(F.sort_array(F.collect_list(F.struct("source", "type", "lines", "occurrences"))).alias("edges"))


def ancestors(parents: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(repo, child, parent), one parent each -> (repo, child, ancestor, distance), itself included at 0.

    A cycle ends at the first id met again.  Pointers double, so a chain of any
    length takes a logarithmic number of rounds.
    """
    one = parents.where("child <> parent").groupBy("repo", "child").agg(F.min("parent").alias("ancestor"))
    ids = parents.select("repo", F.explode(F.array("child", "parent")).alias("child")).distinct()
    known = cut(ids.select("repo", "child", F.col("child").alias("ancestor"), F.lit(0).alias("distance")).unionByName(one.withColumn("distance", F.lit(1))))
    for r in range(max_rounds):
        reach = known.where(F.col("distance") == 2**r)
        if reach.isEmpty():
            return known
        far = known.where("distance > 0").select("repo", F.col("child").alias("ancestor"), F.col("ancestor").alias("beyond"), F.col("distance").alias("more"))
        new = reach.join(far, ["repo", "ancestor"]).select("repo", "child", F.col("beyond").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        new = new.groupBy("repo", "child", "ancestor").agg(F.min("distance").alias("distance"))
        known = cut(known.unionByName(new.join(known, ["repo", "child", "ancestor"], "left_anti")))
    raise RuntimeError(f"ancestors not complete after {max_rounds} rounds")


def inherited_marks(parents: DataFrame, marks: DataFrame) -> DataFrame:
    """repo, id, mask: the marks(repo, id, mask) of each id and of all its ancestors over parents(repo, child, parent), combined by ``bit_or``.

    Ids without a mark are left out; one parent each.  Every id points at an
    ancestor and holds the marks up to it; pointing on to the ancestor's own
    ancestor doubles the distance, so a chain of any length takes a logarithmic
    number of rounds, with one row per id in each.  On a cycle the marks of all
    its ids meet: when a round brings no id to its end, only cycles are left,
    and they are complete once the distance is their number of ids.
    """
    one = parents.where("child <> parent").groupBy("repo", F.col("child").alias("id")).agg(F.min("parent").alias("up"))
    none = F.lit(None).cast("string")
    ids = one.select("repo", "id", "up", F.lit(0).cast("long").alias("mask")).unionByName(one.select("repo", F.col("up").alias("id"), none.alias("up"), F.lit(0).cast("long").alias("mask")))
    ids = ids.unionByName(marks.select("repo", "id", none.alias("up"), F.col("mask").cast("long").alias("mask")))
    known = cut(ids.groupBy("repo", "id").agg(F.max("up").alias("up"), F.expr("bit_or(mask)").alias("mask")))
    reach, before = 1, None
    while (live := known.where("up is not null").count()) and not (live == before and reach >= live):
        above = known.select("repo", F.col("id").alias("up"), F.col("up").alias("further"), F.col("mask").alias("more"))
        moved = known.where("up is not null").join(above, ["repo", "up"])
        moved = moved.select("repo", "id", F.col("further").alias("up"), F.col("mask").bitwiseOR(F.col("more")).alias("mask"))
        known = cut(known.where("up is null").unionByName(moved))
        reach, before = 2 * reach, live
    return known.where("mask <> 0").select("repo", "id", "mask")
