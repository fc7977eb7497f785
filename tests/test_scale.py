"""Operators that split what used to be one row, one window or one group, against plain computations."""

import random
import re
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from shockline.operators import affected_tests, changed, churn, deps, diffs, flows, graph, impact, labels, reports
from shockline.sources import inputs, sinks

EDGE = "repo string, source string, target string, type string, lines array<int>, occurrences int"


def plain_numbering(text):
    """(file_no, side, number) of the changed lines, one line after another."""
    out, file_no, hunk, old, new = [], 0, False, 0, 0
    for line in re.split("\r\n|\n|\r", text):
        if line.startswith("diff --git "):
            file_no, hunk = file_no + 1, False
        elif not file_no or line.startswith(("new file mode ", "deleted file mode ", "rename from ", "rename to ", *diffs.IGNORED, "--- ", "+++ ")):
            pass
        elif line.startswith("@@ "):
            m = re.match(r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@", line)
            hunk, old, new = True, int(m[1]) if m else 0, int(m[2]) if m else 0
        elif line.startswith("\\") or not hunk:
            pass
        elif line.startswith("+"):
            out.append((file_no, "added", new))
            new += 1
        elif line.startswith("-"):
            out.append((file_no, "deleted", old))
            old += 1
        else:
            old, new = old + 1, new + 1
    return out


def random_diff(rng):
    lines = [rng.choice(["junk", "+early"])] * rng.randint(0, 2)
    for _ in range(rng.randint(0, 4)):
        lines.append(f"diff --git a/f{rng.randint(0, 9)} b/f{rng.randint(0, 9)}")
        lines += rng.sample(["new file mode 100644", "index 1..2", "rename from x", "rename to y", "+no hunk", "--- a/x", "+++ b/y", "--- /dev/null"], rng.randint(0, 5))
        for _ in range(rng.randint(0, 3)):
            lines.append(rng.choice([f"@@ -{rng.randint(0, 90)},3 +{rng.randint(0, 90)} @@ f", "@@ odd"]))
            lines += rng.choices(["+a", "-b", " c", "", "\\ No newline", "--- x", "+++ y", "index z"], k=rng.randint(0, 30))
    return "".join(x + rng.choice(["\n", "\n", "\r\n", "\r"]) for x in lines)


def facts_of(rows):
    return Counter((r.change_id, r.file_no, r.path, r.old_path, r.change_type, tuple(r.added_lines), tuple(r.deleted_lines)) for r in rows.collect())


def test_diffs_are_numbered_alike_in_parts_of_any_size(spark):
    rng = random.Random(3)
    texts = [("r", f"c{k}", random_diff(rng)) for k in range(60)]
    df = spark.createDataFrame(texts, "repo string, change_id string, diff_text string")
    want = Counter((c, *x) for _, c, t in texts for x in plain_numbering(t))
    whole = facts_of(diffs.changed_files(df))
    for part_lines in (1, 3, 10, 1000):
        rows = diffs.numbered(diffs.split_lines(df, part_lines))
        assert Counter((r.change_id, r.file_no, r.side, r.line) for r in diffs.diff_lines(rows).collect()) == want
        assert facts_of(diffs.files_of(rows)) == whole


def test_a_diff_file_is_read_and_numbered_by_many_tasks(spark, tmp_path):
    n = 200_000
    (tmp_path / "big.diff").write_text("diff --git a/v b/v\n--- a/v\n+++ b/v\n@@ -1 +1,9 @@\n" + "".join("+x\n" if k % 3 else " y\r\n" for k in range(n)) + "diff --git a/w b/w\n@@ -7 +8 @@\n-z\n+z")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        read = inputs.text_lines(spark, str(tmp_path / "big.diff"))
        assert read.rdd.getNumPartitions() > 8 and read.select("part").distinct().count() > 8
        lines = read.select(F.lit("r").alias("repo"), F.lit("c").alias("change_id"), "part", "pos", "line")
        files = diffs.files_of(diffs.numbered(lines)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r.path, tuple(r.deleted_lines)) for r in files} == {("v", ()), ("w", (7,))}
    assert {r.path: r.added_lines for r in files} == {"v": [k + 1 for k in range(n) if k % 3], "w": [8]}


def test_log_files_are_read_record_by_record(spark, tmp_path):
    rng = random.Random(4)
    record = lambda k: f"\x1e{k:08x}\x1fAl\x1fa@x\x1f2024-01-01T00:00:00Z\n\n" + "".join(f"{rng.randint(0, 9)}\t1\tf{j}\n" for j in range(rng.randint(0, 4)))
    texts = {"a": "".join(record(k) for k in range(3000)), "b": " \n", "c": "", "d": "\x1e \x1e", "e": "no mark\n", "f": "\n" + record(1), "g": record(2) + "\x1e\x1e" + "\x1ebad\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    logs = spark.createDataFrame([("r", k, t) for k, t in texts.items()], "repo string, path string, log_text string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        read = inputs.log_records(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 8
        records = read.select(F.lit("r").alias("repo"), F.regexp_extract("file", "([^/]+)$", 1).alias("path"), "record")
        got = Counter(map(tuple, churn.parse_records(records).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == Counter(map(tuple, churn.parse_log(logs).collect()))
    assert churn.commit_files(records, strict=False).where("path = 'a'").count() == 3000


def report_rows(spark):
    key = "repo string, change_id string, "
    scores = spark.createDataFrame([("r", "a/b é", 7, "low", [("x", 1)]), ("r", "none", 0, "low", []), ("q", "c", 60, "high", [])], key + "score int, level string, contributions array<struct<code:string,contribution:int>>")
    sections = ["files", *reports.LISTS, *reports.BY_CONTEXT.values()]
    items = [(r, c, s, [f"{k:03}"], f'{{"n":"{s} é{k % 7}"}}') for r, c in (("r", "a/b é"), ("q", "c")) for i, s in enumerate(sections) if i % 3 or c == "c" for k in range(40, 0, -1)]
    return scores, spark.createDataFrame(items, key + "section string, place array<string>, item string")


def test_report_files_hold_the_bytes_of_reports(spark, tmp_path):
    scores, items = report_rows(spark)
    symbols = spark.createDataFrame([("r", "A", "class", "A", "f.php", 1, 2, None, None, None, None, None)], inputs.SCHEMAS["symbols"])
    edges = spark.createDataFrame([("r", "A", "B", "extends", [1], 1), ("r", "C", "B", "extends", [2], 1), ("q", "A", "B", "extends", [1], 1)], EDGE)
    nodes = graph.build_nodes(symbols, edges)
    counts = spark.createDataFrame([("r", 1, 1, 2), ("q", 0, 0, 1)], "repo string, files long, symbols long, dependencies long")
    for name, graphs, parts, per in (("plain", None, None, None), ("graph", reports.graph_sections(nodes, edges, counts), reports.graph_items(nodes, edges), counts)):
        sinks.write_report_files(reports.fragments(scores, items, parts, per), str(tmp_path / name))
        want = {(r.repo, r.change_id): r.report for r in reports.json_report(scores, items, graphs).collect()}
        files = sorted(str(f.relative_to(tmp_path / name)) for f in (tmp_path / name).rglob("*") if f.is_file())
        assert files == ["q/c.json", "r/a%2Fb%20%C3%A9.json", "r/none.json"]
        got = {("q", "c"): files[0], ("r", "a/b é"): files[1], ("r", "none"): files[2]}
        assert {k: (tmp_path / name / f).read_text() for k, f in got.items()} == want


def test_a_failed_write_leaves_no_report(spark, tmp_path):
    scores, items = report_rows(spark)
    bad = reports.fragments(scores, items).withColumn("text", F.when((F.col("change_id") == "c") & (F.col("rank") == 9), F.raise_error(F.lit("stop"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop"):
        sinks.write_report_files(bad, str(tmp_path / "out"))
    assert [f for f in (tmp_path / "out").rglob("*") if f.is_file()] == []


def test_long_chains_of_renames(spark):
    n = 700
    rows = [("r", f"p{k}", f"p{k + 1}", 10 * (k + 1)) for k in range(n)] + [("s", "a", "b", 5), ("s", "b", "a", 9), ("s", "a", "b", 20), ("s", "x", "x2", 3), ("s", "x", "y", 30)]
    renames = spark.createDataFrame(rows, "repo string, old_path string, new_path string, ts long").withColumn("ts", F.timestamp_seconds("ts"))
    chains = churn.rename_chains(renames).select("repo", "path", "was", F.col("until").cast("long")).collect()
    assert {(r.path, r.was, r.until) for r in chains if r.repo == "r"} == {(f"p{n}", f"p{k}", 10 * (k + 1)) for k in range(n)}
    # b was a until 20, which was b until 9, which was a until 5; x2 and y were x until 3 and 30.
    best = defaultdict(int)
    for r in chains:
        if r.repo == "s":
            best[r.path, r.was] = max(best[r.path, r.was], r.until)
    assert best == {("b", "a"): 20, ("b", "b"): 9, ("x2", "x"): 3, ("y", "x"): 30}


def test_most_specific_symbols_equal_a_plain_search(spark):
    rng = random.Random(7)
    symbols = []
    for k in range(300):
        a = rng.randint(1, 900)
        symbols.append(("r", f"S{k}", rng.choice(["class", "method", "function", "trait"]), f"f{k % 3}.php", a, a + rng.choice([-1, 0, 0, 3, 20, 300])))
    symbols += [("r", f"C{k}", "class", "f0.php", 5, 5) for k in range(400)]
    lines = [("r", f"c{k % 2}", f"f{rng.randint(0, 3)}.php", rng.randint(-5, 1300)) for k in range(1500)]
    df = spark.createDataFrame(symbols, "repo string, fqn string, type string, file string, start_line int, end_line int")
    rows = changed.most_specific(spark.createDataFrame(lines, "repo string, change_id string, file string, line int"), df)
    want = set()
    for r, c, f, n in lines:
        held = min(((b - a, t not in ("method", "function"), name) for _, name, t, file, a, b in symbols if file == f and a <= n <= b), default=(0, 0, None))
        want.add((r, c, f, n, held[2]))
    got = rows.select("repo", "change_id", "file", "line", "fqn").collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_reach_of_many_origins_equals_plain_searches(spark):
    """More origins than a word has lanes, in two repositories that share names, with a long chain and cycles."""
    rng = random.Random(9)
    rows = {(repo, f"n{rng.randrange(100)}", f"n{rng.randrange(100)}", k) for repo in "rq" for k in ("extends", "method_call") for _ in range(90)}
    rows |= {("q", f"k{i + 1}", f"k{i}", "extends") for i in range(15)}
    origins = [(repo, f"n{i}") for repo in "rq" for i in range(75)] + [("q", "k0"), ("r", "missing")]
    edges = spark.createDataFrame([(*r, [1], 1) for r in rows], EDGE)
    found = impact.reach(spark.createDataFrame(origins, "repo string, origin string"), edges)
    back = defaultdict(set)
    for repo, s, t, k in rows:
        if s != t:
            back[repo, t].add((s, k))
    want = Counter()
    for repo, o in origins:
        depth, queue = {o: 0}, deque([o])
        while queue:
            n = queue.popleft()
            for m, _ in back[repo, n]:
                if m not in depth:
                    depth[m] = depth[n] + 1
                    queue.append(m)
        want.update((repo, o, m, depth[m], t, k) for t in depth for m, k in back[repo, t] if depth[m] == depth[t] + 1)
    assert Counter((r.repo, r.origin, r.impacted, r.depth, r.target, r.dependency_type) for r in found.collect()) == want
    assert max(r[3] for r in want) == 15
    few, impact.FEW_ORIGINS = impact.FEW_ORIGINS, 0
    try:
        salted = impact.reach(spark.createDataFrame(origins, "repo string, origin string"), edges)
        assert Counter((r.repo, r.origin, r.impacted, r.depth, r.target, r.dependency_type) for r in salted.collect()) == want
    finally:
        impact.FEW_ORIGINS = few


def test_marks_are_inherited_along_chains_and_cycles(spark):
    n = 2000
    parents = [("r", f"c{k}", f"c{k - 1}") for k in range(1, n)] + [("r", "c0", "Base")] + [("r", f"y{k}", f"y{(k + 1) % 5}") for k in range(5)] + [("r", "z", "y0"), ("r", "self", "self"), ("q", "c5", "Other")]
    marks = [("r", "Base", 1), ("r", "c1000", 2), ("r", "y3", 4), ("r", "alone", 8), ("r", "alone", 16), ("q", "Base", 1)]
    got = {(r.repo, r.id): r.mask for r in graph.inherited_marks(spark.createDataFrame(parents, "repo string, child string, parent string"), spark.createDataFrame(marks, "repo string, id string, mask int")).collect()}
    want = {("r", f"c{k}"): 3 if k >= 1000 else 1 for k in range(n)} | {("r", "Base"): 1, ("r", "alone"): 24, ("q", "Base"): 1, ("r", "z"): 4} | {("r", f"y{k}"): 4 for k in range(5)}
    assert got == want


def test_tests_at_any_height(spark):
    base = affected_tests.BASE_CLASS
    names = [f"T{k}" for k in range(60)] + ["Loop", "Plain", base]
    symbols = spark.createDataFrame([("r", x, "class", x, "t.php", 1, 9, None, None, None, None, None) for x in names], inputs.SCHEMAS["symbols"])
    links = [("T0", base)] + [(f"T{k}", f"T{k - 1}") for k in range(1, 60)] + [("Loop", "Loop2"), ("Loop2", "Loop"), ("Plain", "Gone")]
    found = affected_tests.test_catalog(symbols, spark.createDataFrame([("r", s, t, "extends", [1], 1) for s, t in links], EDGE))
    assert {r.id for r in found.collect()} == {f"T{k}" for k in range(60)}


def test_facades_and_calls_are_not_shuffled_for_names(spark):
    calls = spark.createDataFrame([("r", "f", f"S::{k}", "static", c, "get", ["get"], None, None, None) for k, c in enumerate(["DB", "Auth", "Own", None])], inputs.SCHEMAS["call_facts"])
    classes = spark.createDataFrame([("r", "Auth"), ("q", "DB"), ("r", "Own")], "repo string, class string")
    rows = labels.resolve_facades(calls, classes)
    assert {(r.containing_symbol, r.callee_class) for r in rows.collect()} == {("S::0", labels.FACADES["DB"]), ("S::1", "Auth"), ("S::2", "Own"), ("S::3", None)}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_calls_that_fit_several_rules_get_every_label(spark):
    own = [("r", x, "class", x, "f", 1, 9, None, None, None, None, None) for x in ("Job", "Model", "Both")] + [("r", "Job::handle", "method", "handle", "f", 2, 3, "Job", "public", False, None, None)]
    symbols = spark.createDataFrame(own, inputs.SCHEMAS["symbols"])
    parents = spark.createDataFrame([("r", "Model", labels.MODEL), ("r", "Both", "Model")], "repo string, child string, parent string")
    interfaces = spark.createDataFrame([("r", "Job", labels.SHOULD_QUEUE), ("r", "Both", labels.SHOULD_QUEUE)], "repo string, class string, name string")
    facts = [("S::a", "static", "Both", "push", ["push", "get"], None, None, None), ("S::b", "static", "Event", "listen", ["listen"], "Job", None, None), ("S::c", "static", "Bus", "dispatch", ["dispatch"], "Job", None, "new"), ("S::d", "func", None, "dispatch", ["dispatch"], "Job", None, "new"), (None, "func", None, "auth", ["auth"], None, None, None), ("S::e", "static", "Route", "get", ["get"], "Job", None, None)]
    calls = spark.createDataFrame([("r", "f", *x) for x in facts], inputs.SCHEMAS["call_facts"])
    got = {(r.symbol, r.type) for r in labels.framework_labels(labels.Project(symbols, parents, interfaces, interfaces.limit(0), calls)).collect()}
    assert got == {
        ("S::a", "database_read"), ("S::a", "database_write"), ("S::a", "queue"), ("Both::push", "queue"), ("Both", "queue"), ("Job::handle", "queue"),
        ("S::b", "event"), ("Job::handle", "event"), ("S::c", "queue"), ("S::d", "queue"), ("Job", "api_entrypoint"),
    }


def test_flows_of_any_depth_equal_a_queue_search(spark):
    """Ties between paths and between parallel edges, facts along the path, two repositories that share names, depths past the last level."""
    rng = random.Random(4)
    rows = sorted({(repo, f"n{rng.randrange(25)}", f"n{rng.randrange(25)}", k) for repo in "rq" for k in ("method_call", "extends") for _ in range(30)})
    edges = spark.createDataFrame([(*r, [i], i) for i, r in enumerate(rows)], EDGE)
    origins = [(repo, f"n{i}") for repo in "rq" for i in range(25)] + [("r", "missing")]
    out = defaultdict(list)
    for i, (repo, s, t, k) in enumerate(rows):
        if s != t:
            out[repo, s].append((t, k, i))
    for limit in (1, 3, 9):
        want = Counter()
        for repo, o in origins:
            trees, queue, inner = {o: ()}, deque([o]), set()
            while queue:
                n = queue.popleft()
                for t, k, i in sorted(out[repo, n]) if len(trees[n]) < limit else ():
                    if t not in trees:
                        trees[t] = (*trees[n], (t, k, i))
                        inner.add(n)
                        queue.append(t)
            want.update((repo, o, p) for n, p in trees.items() if p and n not in inner)
        found = flows.paths(spark.createDataFrame(origins, "repo string, origin string"), edges, limit, ["occurrences"]).collect()
        assert Counter((r.repo, r.origin, tuple(zip(r.path, r.types, (f.occurrences for f in r.facts)))) for r in found) == want
    assert max(len(p) for _, _, p in want) > 4
    nothing = flows.paths(spark.createDataFrame(origins, "repo string, origin string"), edges, 0)
    assert nothing.columns == ["repo", "origin", "path", "types", "facts"] and nothing.count() == 0
    assert flows.paths(spark.createDataFrame(origins, "repo string, origin string"), edges.where("false")).count() == 0


def test_flows_that_no_edge_leaves_are_an_empty_table(spark):
    """All columns are read: origins without an outgoing edge, edges onto themselves alone, no edge at all, no depth."""
    edges = spark.createDataFrame([("r", "p", "s", "method_call", [1], 1), ("r", "s", "s", "method_call", [1], 1)], EDGE)
    changed_ids = spark.createDataFrame([("r", "c", "s")], "repo string, change_id string, symbol string")
    nodes = spark.createDataFrame([("r", "s", True)], "repo string, id string, known boolean")
    full = flows.affected_flows(changed_ids.withColumn("symbol", F.lit("p")), edges, nodes)
    assert [n.id for n in full.head().nodes] == ["s"]
    for some, depth in ((edges, 3), (edges.where("source = target"), 3), (edges.where("false"), 3), (edges, 0)):
        found = flows.affected_flows(changed_ids, some, nodes, depth)
        assert found.dtypes == full.dtypes and found.collect() == []
        assert flows.listed_flows(found).collect() == [] and flows.flow_classes(found).collect() == []
        assert flows.paths(changed_ids.select("repo", F.col("symbol").alias("origin")), some, depth, ["lines"]).collect() == []


def test_flows_shuffle_no_facts_from_level_to_level(spark):
    steps = flows.numbered_steps(spark.createDataFrame([("r", "a", "b", "extends", [1], 1)], EDGE), F.struct("lines"))
    zero = spark.createDataFrame([("r", "a", 0)], "repo string, origin string, rank long")
    (level,) = flows.tree_levels(zero, steps.select("repo", "node", "next", "edge"), 2)
    assert dict(level.dtypes) == {"o": "bigint", "repo": "string", "node": "string", "up": "bigint", "edge": "bigint", "rank": "bigint"}


def test_types_as_of_a_place_equal_a_plain_search(spark):
    """Scopes of one binding and of several arrays, bindings without a type, ties of place, places of bindings themselves, nulls."""
    rng = random.Random(6)
    held, deps.HELD = deps.HELD, 8
    try:
        bound = [("r", "f", s, rng.randrange(n), v, rng.choice(["A", "B", None])) for s, n in (("big", 300), ("small", 6), (None, 40)) for v in "xy" for _ in range(n // 2)]
        bound += [("r", "f", "same", 5, "x", f"T{i:02}") for i in range(30)] + [("r", "f", "big", None, "x", "N"), ("q", "f", "big", 1, "x", "Q"), ("r", "f", "big", 1, None, "N")]
        sites = [(repo, "f", s, k, v) for repo in "rq" for s in ("big", "small", "same", "none", None) for v in ("x", "y", "z", None) for k in (*range(0, 310, 3), 5, 6, None)]
        rows = deps.as_of_types(
            spark.createDataFrame(sites, "repo string, file string, scope_symbol string, seq int, receiver_name string"),
            spark.createDataFrame(bound, "repo string, file string, scope_symbol string, seq int, var string, type string"),
        )
        by_scope = defaultdict(list)
        for repo, f, s, k, v, t in bound:
            if k is not None and v is not None and t is not None:
                by_scope[repo, f, s, v].append((k, t))
        want = Counter((*site, max((b for b in by_scope[*site[:3], site[4]] if site[3] is not None and b[0] < site[3]), default=(0, None))[1]) for site in sites)
        assert Counter(map(tuple, rows.select("repo", "file", "scope_symbol", "seq", "receiver_name", "receiver_type").collect())) == want
    finally:
        deps.HELD = held


def test_sites_are_not_sorted_for_their_types(spark):
    sites = spark.createDataFrame([("r", "f", "m", 1, "x")], "repo string, file string, scope_symbol string, seq int, receiver_name string")
    bound = spark.createDataFrame([], "repo string, file string, scope_symbol string, seq int, var string, type string")
    plan = deps.as_of_types(sites, bound)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
