"""The blast radius by bitmaps of changes and by counts, against the rows of evidence."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shockline.operators import affected_tests, flows, graph, impact, risk

EDGE = "repo string, source string, target string, type string, lines array<int>, occurrences int"
CHANGED = "repo string, change_id string, symbol string"


@pytest.fixture(scope="module")
def world(spark):
    """A graph with cycles, self-edges, edges of several types, two repositories, and 90 changes of up to five symbols."""
    rng = random.Random(4)
    rows = {(r, f"n{(a := rng.randint(0, 60))}", f"n{max(0, a - rng.randint(-2, 20))}", rng.choice(["extends", "method_call", "return_type"])) for r in "qr" for _ in range(90)}
    edges = spark.createDataFrame([(*x, [1], 1) for x in sorted(rows)], EDGE).localCheckpoint()
    ids = {(rng.choice("qr"), f"c{k}", f"n{rng.randint(0, 65)}") for k in range(90) for _ in range(rng.randint(1, 5))}
    changed = spark.createDataFrame(sorted(ids), CHANGED).localCheckpoint()
    return changed, edges, impact.blast_origins(changed, edges).localCheckpoint()


def rows_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_entries_are_counted_without_their_evidence(world):
    changed, edges, origins = world
    want = impact.blast_radius(origins).withColumn("n_origins", F.size("origins").cast("long"))
    columns = ["repo", "change_id", "impacted_symbol", "depth", "n_origins"]
    assert rows_of(impact.blast_counts(changed, edges), *columns) == rows_of(want, *columns)
    assert rows_of(impact.blast_counts(changed, edges.unionByName(edges)), *columns) == rows_of(want, *columns)  # as sites


def test_entries_and_their_counts_come_from_one_walk_per_change(world):
    changed, edges, origins = world
    found = impact.blast(changed, edges.unionByName(edges))
    columns = ["repo", "change_id", "impacted_symbol", "depth"]
    want = rows_of(impact.blast_depths(origins), *columns)
    assert rows_of(found.entries(), *columns) == want
    some = edges.select("repo", F.col("source").alias("node")).where("node like '%1'")
    assert rows_of(found.entries(some), *columns) == Counter({x: n for x, n in want.items() if x[2].endswith("1")})
    depths = rows_of(impact.depth_histogram(impact.blast_depths(origins)), "repo", "change_id", "depth", "symbols")
    assert rows_of(found.histogram(), "repo", "change_id", "depth", "symbols") == depths
    # The first ones are whole down to the depth that has the fifth.
    first = rows_of(found.first_entries(5), *columns)
    by_change = {}
    for r, c, s, d in want:
        by_change.setdefault((r, c), []).append((d, s))
    assert first == Counter((r, c, s, d) for (r, c), e in by_change.items() for d, s in e if d <= sorted(e)[:5][-1][0])
    shown = found.first_entries(5)
    evidence = ["repo", "change_id", "impacted_symbol", "changed_symbol", "depth", "target", "dependency_type"]
    keys = {x[:3] for x in first}
    assert rows_of(impact.first_origins(changed, edges, shown), *evidence) == Counter({x: n for x, n in rows_of(origins, *evidence).items() if x[:3] in keys})
    # Rules that are given the histogram read no entries.
    bare = risk.Context(changed, edges, changed.limit(0).select("repo", "change_id", F.col("symbol").alias("impacted_symbol"), F.lit(0).alias("depth")), None, found.histogram())
    rules = [risk.large_blast_radius, risk.deep_impact]
    assert rows_of(risk.risk_factors(bare, rules), "repo", "change_id", "code", "value") == rows_of(risk.risk_factors(risk.Context(changed, edges, impact.blast_depths(origins)), rules), "repo", "change_id", "code", "value")


def test_tests_are_met_over_what_they_depend_on(world):
    changed, edges, origins = world
    catalog = edges.select("repo", F.col("source").alias("id")).where("id like '%3'").distinct().withColumns({"kind": F.lit("method"), "file": F.lit("t")})
    columns = ["repo", "change_id", "changed_symbol", "test_symbol", "depth", "impact"]
    plain = affected_tests.test_impact(origins, catalog)
    assert rows_of(affected_tests.test_impact_of(changed, edges, catalog), *columns) == rows_of(plain, *columns)
    counts = ["repo", "change_id", "direct", "indirect"]
    assert rows_of(affected_tests.blast_test_counts(impact.blast(changed, edges), catalog), *counts) == rows_of(affected_tests.test_counts(plain), *counts)


def test_edges_of_flows_are_those_within_their_depth(spark):
    edges = spark.createDataFrame([("r", f"a{k}", f"a{k + 1}", "extends", [1], 1) for k in range(6)] + [("q", "a0", "b", "extends", [1], 1), ("r", "z", "a1", "extends", [1], 1), ("r", "a1", "a1", "extends", [1], 1)], EDGE)
    start = spark.createDataFrame([("r", "a0")], "repo string, node string")
    near = impact.edges_from(start, edges, 3)
    assert rows_of(near, "repo", "source", "target") == Counter(("r", f"a{k}", f"a{k + 1}") for k in range(3))
    assert impact.edges_from(start, edges).count() == 6
    ids = spark.createDataFrame([("r", "c", "a0")], CHANGED)
    (flow,) = flows.affected_flows(ids, edges, graph.build_nodes(edges.limit(0).select("repo", F.lit("").alias("fqn"), "type", F.lit("").alias("name"), F.lit("").alias("file")), edges)).collect()
    assert flow.terminal == "a3"
