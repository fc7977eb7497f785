"""More registered queries: resolution, lookups, renames, tests, framework rules and reports over whole tables.

They read the star schema as ``shockline.queries`` does and register there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockline.functions.lineage import cut
from shockline.functions.names import node_name
from shockline.operators import affected_tests, churn, deps, diffs, flows, graph, impact, labels, reports, risk
from shockline.queries import EDGES, FLOWS, REACH, REPO, RISK, _context, _id, _joined, blast, changes, commits, edges, edges_near, links, query, symbols, table


def _no_text():
    return F.lit(None).cast("string")


@query(
    "b3_hunks",
    """SELECT 'p' || p_partkey AS change_id, 'new/p' || p_partkey || '.php' AS path, 'old/p' || p_partkey || '.php' AS old_path, 'renamed' AS change_type,
    (p_size + 2) || ',' || (p_size + 3) AS added_lines, (p_size + 2)::VARCHAR AS deleted_lines FROM part""",
)
def b3_hunks(spark, d):
    name = F.concat(_id("p", "p_partkey"), F.lit(".php"))
    at = (F.col("p_size") + 1).cast("string")
    head = F.concat(F.lit("diff --git a/old/"), name, F.lit(" b/new/"), name, F.lit("\nsimilarity index 90%\nrename from old/"), name, F.lit("\nrename to new/"), name)
    text = F.concat(head, F.lit("\n--- a/old/"), name, F.lit("\n+++ b/new/"), name, F.lit("\n@@ -"), at, F.lit(",2 +"), at, F.lit(",3 @@\n same\n-gone\n+one\n+two\n\\ No newline at end of file"))
    rows = diffs.changed_files(table(spark, d, "part").select(F.lit(REPO).alias("repo"), _id("p", "p_partkey").alias("change_id"), text.alias("diff_text")))
    return rows.select("change_id", "path", "old_path", "change_type", _joined("added_lines").alias("added_lines"), _joined("deleted_lines").alias("deleted_lines"))


@query(
    "d2_resolved_references",
    """WITH s AS (SELECT l_linenumber AS line, 'o' || l_orderkey AS cls, CASE WHEN l_orderkey % 3 <> 0 THEN 'c' || (l_orderkey % 10) END AS par, l_partkey % 6 AS k, l_partkey, l_suppkey, l_orderkey FROM lineitem),
    r AS (SELECT cls || '::m' AS source, cls || '::go' AS target, 'method_call' AS type, line FROM s WHERE k = 0
        UNION ALL SELECT cls || '::m', 'p' || l_partkey || '::go', 'method_call', line FROM s WHERE k = 1
        UNION ALL SELECT cls || '::m', 's' || s_suppkey || '::go', 'method_call', line FROM s JOIN supplier ON l_orderkey = s_suppkey AND l_partkey % 5 = s_suppkey % 5 WHERE k = 2
        UNION ALL SELECT cls || '::m', par || '::go', 'static_call', line FROM s WHERE k = 3 AND par IS NOT NULL
        UNION ALL SELECT cls || '::m', CASE WHEN o_orderkey % 2 = 0 THEN cls || '::__construct' ELSE cls END, 'constructor_call', line FROM s LEFT JOIN orders ON o_orderkey = l_orderkey WHERE k = 4
        UNION ALL SELECT cls || '::m', unnest(['s' || l_suppkey, cls]), 'parameter_type', line FROM s WHERE k = 5
        UNION ALL SELECT cls, unnest(['s' || l_suppkey, cls]), 'property_type', line FROM s WHERE k = 5)
    SELECT source, target, type, array_to_string(list_sort(list_distinct(list(line))), ',') AS lines, count(*) AS occurrences FROM r GROUP BY ALL""",
)
def d2_resolved_references(spark, d):
    k = F.col("l_partkey") % 6
    cls, seq = _id("o", "l_orderkey"), F.col("l_linenumber").cast("int")
    sites = table(spark, d, "lineitem").select(
        F.lit(REPO).alias("repo"), F.lit("f").alias("file"), seq.alias("seq"), seq.alias("line"), F.concat(cls, F.lit("::m")).alias("scope_symbol"), cls.alias("scope_class"),
        F.when(F.col("l_orderkey") % 3 != 0, F.concat(F.lit("c"), (F.col("l_orderkey") % 10).cast("string"))).alias("scope_parent"),
        F.when(k < 3, "method_call").when(k == 3, "static_call").when(k == 4, "new").otherwise("parameter").alias("kind"), F.when(k < 4, "go").alias("name"),
        F.when(k == 0, "this").when(k == 1, "new").when(k == 2, "prop").when(k == 5, "promoted").alias("receiver_kind"),
        F.when(k == 1, _id("p", "l_partkey")).when(k == 2, F.concat(F.lit("q"), (F.col("l_partkey") % 5).cast("string"))).when(k == 3, "parent").when(k == 4, "static").alias("receiver_name"),
        F.when(k == 5, F.array(_id("s", "l_suppkey"), F.lit("self"))).alias("type_names"),
    )
    bindings = spark.createDataFrame([], "repo string, file string, scope_symbol string, seq int, var string, type string")
    properties = table(spark, d, "supplier").select(F.lit(REPO).alias("repo"), _id("o", "s_suppkey").alias("class"), F.concat(F.lit("q"), (F.col("s_suppkey") % 5).cast("string")).alias("prop"), _id("s", "s_suppkey").alias("type"))
    constructors = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.lit(REPO).alias("repo"), F.lit("f").alias("file"), _id("o", "o_orderkey").alias("class"))
    rows = deps.aggregate(deps.resolve(sites, bindings, properties, constructors))
    return rows.select("source", "target", "type", _joined("lines").alias("lines"), F.col("occurrences").cast("long").alias("occurrences"))


@query(
    "d7_dependencies_of_changed_files",
    """SELECT 'f' || (l_suppkey % 100) AS file, 'o' || l_orderkey AS source, 's' || l_suppkey AS target, count(*) AS occurrences FROM lineitem
    WHERE l_suppkey % 100 IN (SELECT s_suppkey % 100 FROM supplier WHERE s_acctbal < 0) GROUP BY ALL""",
)
def d7_dependencies_of_changed_files(spark, d):
    file = lambda c: F.concat(F.lit("f"), (F.col(c) % 100).cast("string"))
    sites = table(spark, d, "lineitem").select(F.lit(REPO).alias("repo"), file("l_suppkey").alias("file"), _id("o", "l_orderkey").alias("source"), _id("s", "l_suppkey").alias("target"), F.lit("static_call").alias("type"), F.col("l_linenumber").alias("line"))
    files = table(spark, d, "supplier").where("s_acctbal < 0").select(F.lit(REPO).alias("repo"), file("s_suppkey").alias("path"))
    return deps.aggregate(deps.of_changed_files(sites, files)).select("file", "source", "target", F.col("occurrences").cast("long").alias("occurrences"))


@query(
    "d9_index_counts",
    """SELECT repo, sum(f)::BIGINT AS files, sum(s)::BIGINT AS symbols, sum(d)::BIGINT AS dependencies FROM (
    SELECT 'n' || c_nationkey AS repo, 1 AS f, 0 AS s, 0 AS d FROM customer UNION ALL SELECT 'n' || s_nationkey, 0, 1, 0 FROM supplier UNION ALL SELECT 'n' || n_nationkey, 0, 0, 1 FROM nation) GROUP BY repo""",
)
def d9_index_counts(spark, d):
    of = lambda t, c: table(spark, d, t).select(_id("n", c).alias("repo"))
    return deps.index_counts(of("customer", "c_nationkey"), of("supplier", "s_nationkey"), of("nation", "n_nationkey"))


@query("e3_dependent_edges", f"WITH {EDGES} SELECT e.source, e.target, e.type, e.lines, e.occurrences FROM e JOIN part ON e.target = 'p' || p_partkey")
def e3_dependent_edges(spark, d):
    rows = graph.dependent_edges(edges(spark, d), symbols(spark, d).select("repo", F.col("fqn").alias("id")))
    return rows.select("source", "target", "type", _joined("lines").alias("lines"), F.col("occurrences").cast("long").alias("occurrences"))


@query("e5_nodes_with_dependents", f"WITH {EDGES} SELECT id FROM (SELECT 'p' || p_partkey AS id FROM part UNION ALL SELECT 'c' || c_custkey FROM customer) WHERE id IN (SELECT target FROM e)")
def e5_nodes_with_dependents(spark, d):
    nodes = table(spark, d, "part").select(_id("p", "p_partkey").alias("id")).unionByName(table(spark, d, "customer").select(_id("c", "c_custkey").alias("id")))
    return graph.having_dependents(nodes.withColumn("repo", F.lit(REPO)), edges(spark, d)).select("id")


@query(
    "e5_edges_found",
    f"""WITH {EDGES} SELECT w.source, w.target, w.type FROM (SELECT 'c' || c_custkey AS source, 'n' || (c_nationkey + k) AS target, 'parameter_type' AS type FROM customer, (VALUES (0), (1)) v(k)) w
    JOIN e ON e.source = w.source AND e.target = w.target AND e.type = w.type""",
)
def e5_edges_found(spark, d):
    c = table(spark, d, "customer").select(F.lit(REPO).alias("repo"), _id("c", "c_custkey").alias("source"), F.explode(F.array(F.col("c_nationkey"), F.col("c_nationkey") + 1)).alias("n"), F.lit("parameter_type").alias("type"))
    return graph.having_edge(c.withColumn("target", _id("n", "n")).drop("n"), edges(spark, d)).select("source", "target", "type")


@query("e6_node_names", r"WITH i AS (SELECT page_id, replace(url, '/', '\') || CASE WHEN page_id % 2 = 0 THEN '::m' || page_id ELSE '' END AS id FROM pages) SELECT page_id, CASE WHEN contains(id, '::') THEN split_part(id, '::', -1) ELSE split_part(id, '\', -1) END AS name FROM i")
def e6_node_names(spark, d):
    id_ = F.concat(F.replace("url", F.lit("/"), F.lit("\\")), F.when(F.col("page_id") % 2 == 0, _id("::m", "page_id")).otherwise(""))
    return table(spark, d, "pages").select("page_id", id_.alias("id")).select("page_id", node_name(F.col("id")).alias("name"))


@query("f5_entries_at_depth", f"WITH RECURSIVE {REACH} SELECT change_id, impacted_symbol FROM en WHERE depth = 2")
def f5_entries_at_depth(spark, d):
    return impact.entries_at(blast(spark, d).entries(), 2).select("change_id", "impacted_symbol")


@query("g6_flow_classes", f"WITH {FLOWS} SELECT p_brand AS change_id, array_to_string(list_sort(list_distinct(list(node))), ',') AS names FROM t JOIN part ON origin = 'p' || p_partkey GROUP BY p_brand")
def g6_flow_classes(spark, d):
    ids = table(spark, d, "part").select(F.lit(REPO).alias("repo"), F.col("p_brand").alias("change_id"), _id("p", "p_partkey").alias("symbol"))
    e = cut(edges(spark, d))
    rows = flows.flow_classes(flows.affected_flows(ids, e, graph.build_nodes(symbols(spark, d), e)))
    return rows.select("change_id", F.array_join("names", ",").alias("names"))


@query(
    "h4_renames",
    """SELECT DISTINCT CASE WHEN l_partkey % 3 = 0 AND o_orderdate < DATE '1995-06-01' THEN CASE WHEN l_partkey % 6 = 0 THEN 'z' ELSE 'y' END ELSE 'p' END || l_partkey AS path, 'h' || l_orderkey AS commit_hash
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def h4_renames(spark, d):
    part = table(spark, d, "part")
    rename = lambda step, was, now, day: part.where(f"p_partkey % {step} = 0").select(F.lit(REPO).alias("repo"), _id(was, "p_partkey").alias("old_path"), _id(now, "p_partkey").alias("new_path"), F.lit(day).cast("timestamp").alias("ts"))
    renames = rename(3, "p", "y", "1995-06-01").unionByName(rename(6, "y", "z", "1996-06-01"))
    return churn.follow_renames(commits(spark, d), renames).select("path", "commit_hash")


@query(
    "k2_combined_labels",
    """WITH own AS (SELECT 'r' || n_regionkey AS repo, 'n' || s_nationkey AS symbol, CASE WHEN s_acctbal < 0 THEN 'queue' ELSE 'event' END AS type, 0 AS rank FROM supplier JOIN nation ON n_nationkey = s_nationkey
        UNION ALL SELECT 'r' || n_regionkey, 'n' || c_nationkey, CASE WHEN c_acctbal < 0 THEN 'queue' ELSE 'database_read' END, 1 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey % 2 = 0)
    SELECT repo, symbol, type, min(rank)::BIGINT AS provider_rank FROM own GROUP BY ALL""",
)
def k2_combined_labels(spark, d):
    nation = table(spark, d, "nation")
    of = lambda t, p, other: table(spark, d, t).join(nation, F.col(f"{p}_nationkey") == F.col("n_nationkey")).select(_id("r", "n_regionkey").alias("repo"), _id("n", "n_nationkey").alias("symbol"), F.when(F.col(f"{p}_acctbal") < 0, "queue").otherwise(other).alias("type"))
    told = table(spark, d, "region").select(_id("r", "r_regionkey").alias("repo"), F.when(F.col("r_regionkey") % 2 == 0, "Laravel").alias("framework"))
    rows = labels.combine(of("supplier", "s", "event"), labels.for_framework(of("customer", "c", "database_read"), told))
    return rows.select("repo", "symbol", "type", F.col("provider_rank").cast("long").alias("provider_rank"))


@query(
    "l1_test_catalog",
    """WITH k AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 10 < 7 AND p_partkey // 10 IN (SELECT p_partkey // 10 FROM part WHERE p_partkey % 10 = 0)), m AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS s FROM lineitem)
    SELECT 'p' || k AS id, 'class' AS kind FROM k UNION ALL SELECT 'p' || m.k || '::' || CASE WHEN s % 3 = 0 THEN 'test' ELSE 'm' END || s, 'method' FROM m JOIN k ON k.k = m.k WHERE s % 3 <> 2""",
)
def l1_test_catalog(spark, d):
    part, k = table(spark, d, "part"), F.col("p_partkey")
    classes = part.select(F.lit(REPO).alias("repo"), _id("p", "p_partkey").alias("fqn"), F.lit("class").alias("type"), _id("p", "p_partkey").alias("name"), F.lit("t.php").alias("file"), _no_text().alias("parent"), F.array().cast("array<string>").alias("attributes"))
    pairs, s = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct(), F.col("l_suppkey")
    name = F.concat(F.when(s % 3 == 0, "test").otherwise("m"), s.cast("string"))
    methods = pairs.select(F.lit(REPO).alias("repo"), F.concat_ws("::", _id("p", "l_partkey"), name).alias("fqn"), F.lit("method").alias("type"), name.alias("name"), F.lit("t.php").alias("file"), _id("p", "l_partkey").alias("parent"), F.when(s % 3 == 1, F.array(F.lit(affected_tests.ATTRIBUTE))).otherwise(F.array(F.lit("Test"))).alias("attributes"))
    above = F.when(k % 10 == 0, F.lit(affected_tests.BASE_CLASS)).when(k % 10 == 7, "Other").otherwise(F.concat(F.lit("p"), F.when(k % 10 < 5, k - k % 10).otherwise(k - 1).cast("string")))
    parents = part.select(F.lit(REPO).alias("repo"), _id("p", "p_partkey").alias("source"), above.alias("target"), F.lit("extends").alias("type"))
    return affected_tests.test_catalog(classes.unionByName(methods), parents).select("id", "kind")


TEST_ROWS = "ti AS (SELECT change_id, changed_symbol, impacted_symbol AS test_symbol, min(depth) AS depth FROM ev JOIN customer ON impacted_symbol = 'c' || c_custkey GROUP BY ALL), ut AS (SELECT change_id, test_symbol, min({'depth': depth, 'changed_symbol': changed_symbol}) AS b FROM ti GROUP BY ALL)"
TESTS = f"{REACH}, {TEST_ROWS}"


def _test_impact(spark, d) -> DataFrame:
    tests = table(spark, d, "customer").select(F.lit(REPO).alias("repo"), _id("c", "c_custkey").alias("id"), F.lit("method").alias("kind"), F.lit("t.php").alias("file"))
    return affected_tests.test_impact_of(changes(spark, d), links(spark, d), tests)


@query("l3_unique_tests", f"WITH RECURSIVE {TESTS} SELECT change_id, test_symbol, b.depth::BIGINT AS depth, b.changed_symbol AS changed_symbol FROM ut")
def l3_unique_tests(spark, d):
    return affected_tests.unique_tests(_test_impact(spark, d)).select("change_id", "test_symbol", F.col("depth").cast("long").alias("depth"), "changed_symbol")


@query("l4_test_counts", f"WITH RECURSIVE {TESTS} SELECT change_id, count(*) FILTER (b.depth <= 1) AS direct, count(*) FILTER (b.depth > 1) AS indirect FROM ut GROUP BY change_id")
def l4_test_counts(spark, d):
    return affected_tests.test_counts(_test_impact(spark, d)).select("change_id", "direct", "indirect")


def _listed(l: str, limit: int, more: str) -> str:
    return f"CASE WHEN len({l}) > {limit} THEN list_append({l}[:{limit}], '{more}' || (len({l}) - {limit}) || ' more') ELSE {l} END"


def _section(title: str, l: str) -> str:
    return f"chr(10) || '{title}' || chr(10) || repeat('─', 24) || chr(10) || array_to_string(coalesce({l}, ['None']), chr(10))"


def _counted(n: str, one: str) -> str:
    return f"{n} || CASE {n} WHEN 1 THEN ' {one}' ELSE ' {one}s' END"


@query(
    "l6_comment",
    f"""WITH RECURSIVE {RISK}, {TEST_ROWS},
    co AS (SELECT change_id, CASE severity WHEN 'high' THEN w WHEN 'warning' THEN (w * 75 + 50) // 100 ELSE (w * 50 + 50) // 100 END AS c FROM rf WHERE severity IS NOT NULL),
    sc AS (SELECT change_id, score, CASE WHEN score < 30 THEN 'Low' WHEN score < 60 THEN 'Medium' ELSE 'High' END AS level
        FROM (SELECT r.change_id, least(100, coalesce(sum(c), 0))::BIGINT AS score FROM (SELECT DISTINCT change_id FROM x) r LEFT JOIN co ON co.change_id = r.change_id GROUP BY ALL)),
    s1 AS (SELECT change_id, list(symbol ORDER BY symbol) AS l1 FROM x GROUP BY change_id),
    s2 AS (SELECT change_id, list('Depth ' || depth || ': ' || {_counted("n", "symbol")} ORDER BY depth) AS l2 FROM (SELECT change_id, depth, count(*) AS n FROM en GROUP BY ALL) GROUP BY change_id),
    s3 AS (SELECT DISTINCT 'r' || n_regionkey AS change_id, ['→ r' || n_regionkey] AS l3 FROM nation),
    s4 AS (SELECT change_id, list_filter([CASE WHEN d > 0 THEN '✓ ' || {_counted("d", "direct test")} END, CASE WHEN i > 0 THEN '⚠ ' || {_counted("i", "indirect test")} END], lambda y: y IS NOT NULL) AS l4
        FROM (SELECT change_id, count(*) FILTER (b.depth <= 1) AS d, count(*) FILTER (b.depth > 1) AS i FROM ut GROUP BY change_id)),
    s5 AS (SELECT change_id, list(file || chr(10) || {_counted("k", "commit")} ORDER BY k DESC, file) AS h FROM cm WHERE k >= 10 GROUP BY change_id),
    s6 AS (SELECT change_id, list(title ORDER BY rank) AS l6 FROM rf JOIN (VALUES ('high_fan_in', 1, 'High fan-in'), ('large_blast_radius', 2, 'Large blast radius'), ('deep_impact', 3, 'Deep dependency chain'),
        ('multiple_dependency_types', 4, 'Multiple dependency types'), ('multiple_changed_symbols', 5, 'Multiple changed symbols')) c(code, rank, title) ON c.code = rf.code WHERE severity IS NOT NULL GROUP BY change_id)
    SELECT change_id, array_to_string(['{reports.MARKER}', '{reports.TITLE}' || chr(10), 'Risk: ' || score || ' / ' || level,
        {_section("Changed symbols", _listed("l1", 8, "… and "))}, {_section("Blast radius", "l2")}, {_section("Affected flows", "l3")}, {_section("Test impact", "l4")},
        {_section("Historical churn", "[array_to_string(h[:5], chr(10) || chr(10)) || CASE WHEN len(h) > 5 THEN chr(10) || '… and ' || (len(h) - 5) || ' more' ELSE '' END]")}, {_section("⚠ Risk factors", "l6")},
        chr(10) || 'See full analysis in the workflow artifact.'], chr(10)) AS comment
    FROM sc LEFT JOIN s1 USING (change_id) LEFT JOIN s2 USING (change_id) LEFT JOIN s3 USING (change_id) LEFT JOIN s4 USING (change_id) LEFT JOIN s5 USING (change_id) LEFT JOIN s6 USING (change_id)""",
)
def l6_comment(spark, d):
    ids = changes(spark, d)
    e, c = edges_near(spark, d, ids), _context(spark, d)
    factors = cut(risk.risk_factors(c))
    typed = ids.withColumns({"type": F.lit("class"), "file": F.lit("f.php"), "start_line": F.lit(1)})
    found = flows.affected_flows(ids, e, graph.build_nodes(symbols(spark, d), e))
    return reports.comment(risk.risk_scores(ids, factors), typed, c.histogram, found, _test_impact(spark, d), c.churn, factors).select("change_id", "comment")


#: Parts are classes: every seventh a controller, the next one its subclass; every 11th is queued, every 13th an event.
#: Events are calls about a class of number ``c``; ``named`` ones also name its method.
PROJECT = """v AS (SELECT 'u' || user_id AS u, event_id % 8 AS k, event_id % 200 AS c, event_id % 3 = 0 AS named FROM events),
p AS (SELECT p_partkey AS k, p_partkey % 7 = 1 AND p_partkey - 1 IN (SELECT p_partkey FROM part) AS sub FROM part),
q AS (SELECT k FROM p WHERE k % 11 = 0 OR (sub AND (k - 1) % 11 = 0))"""


def project(spark, d) -> labels.Project:
    part, k, none = table(spark, d, "part"), F.col("p_partkey"), F.array().cast("array<string>")
    name = _id("p", "p_partkey")
    item = lambda rows, fqn, type_, short, parent, visibility: rows.select(F.lit(REPO).alias("repo"), fqn.alias("fqn"), F.lit(type_).alias("type"), short.alias("name"), F.lit("f.php").alias("file"), parent.alias("parent"), visibility.alias("visibility"), none.alias("attributes"))
    member = lambda step, short, visibility: item(part.where(k % step == 0), F.concat(name, F.lit("::" + short)), "method", F.lit(short), name, visibility)
    own = item(part, name, "class", name, _no_text(), _no_text()).unionByName(member(2, "handle", _no_text())).unionByName(member(3, "show", F.when(k % 4 == 0, "private").otherwise("public"))).unionByName(member(5, "__construct", F.lit("public")))
    above = F.when(k % 7 == 0, F.lit(labels.CONTROLLER)).when(k % 7 == 1, F.concat(F.lit("p"), (k - 1).cast("string")))
    parents = part.select(F.lit(REPO).alias("repo"), name.alias("child"), above.alias("parent")).where("parent is not null")
    holds = lambda step, what: part.where(k % step == 0).select(F.lit(REPO).alias("repo"), name.alias("class"), F.lit(what).alias("name"))
    call, class_ = F.col("event_id") % 8, F.concat(F.lit("p"), (F.col("event_id") % 200).cast("string"))
    by = lambda *values: F.element_at(F.array(*(v if not isinstance(v, str) else F.lit(v) for v in (_no_text() if v is None else v for v in values))), (call + 1).cast("int"))
    method = by("get", "dispatch", "dispatch", "dispatch", "event", "listen", "user", "post")
    calls = table(spark, d, "events").select(
        F.lit(REPO).alias("repo"), F.lit("f.php").alias("file"), _id("u", "user_id").alias("containing_symbol"), by("static", "static", "static", "func", "func", "static", "static", "instance").alias("kind"),
        by("Route", "Bus", class_, None, None, "Event", "Auth", labels.GUZZLE_CLIENT).alias("callee_class"), method.alias("name"), F.array(method).alias("chain"),
        by(class_, None, None, class_, None, class_, None, None).alias("arg_class"), F.when(call.isin(0, 5) & (F.col("event_id") % 3 == 0), "show").alias("arg_method"), F.when(call == 3, "new").alias("arg_kind"),
    )
    return labels.Project(own, parents, holds(11, labels.SHOULD_QUEUE), holds(13, labels.EVENT_DISPATCHABLE), calls)


@query(
    "m3_entrypoint_labels",
    f"""WITH {PROJECT}, o AS (SELECT k FROM p WHERE k % 7 = 0 OR sub) SELECT DISTINCT symbol, 'api_entrypoint' AS type FROM (
    SELECT 'p' || k || '::handle' AS symbol FROM o WHERE k % 2 = 0 UNION ALL SELECT 'p' || k || '::show' FROM o WHERE k % 3 = 0 AND k % 4 <> 0
    UNION ALL SELECT 'p' || c || CASE WHEN named THEN '::show' ELSE '' END FROM v WHERE k = 0)""",
)
def m3_entrypoint_labels(spark, d):
    return labels.framework_labels(project(spark, d), [labels.controllers]).select("symbol", "type")


@query(
    "m5_queue_labels",
    f"""WITH {PROJECT} SELECT DISTINCT symbol, 'queue' AS type FROM (
    SELECT 'p' || k || CASE WHEN k % 2 = 0 THEN '::handle' ELSE '' END AS symbol FROM q UNION ALL SELECT u FROM v WHERE k = 1
    UNION ALL SELECT u FROM v JOIN q ON c = q.k WHERE v.k IN (2, 3) UNION ALL SELECT 'p' || c || '::dispatch' FROM v JOIN q ON c = q.k WHERE v.k = 2
    UNION ALL SELECT 'p' || c || '::handle' FROM v JOIN q ON c = q.k WHERE v.k IN (2, 3) AND c % 2 = 0)""",
)
def m5_queue_labels(spark, d):
    return labels.framework_labels(project(spark, d), [labels.queues]).select("symbol", "type")


@query(
    "m6_event_labels",
    f"""WITH {PROJECT} SELECT DISTINCT symbol, 'event' AS type FROM (
    SELECT 'p' || k AS symbol FROM p WHERE k % 13 = 0 OR (sub AND (k - 1) % 13 = 0) UNION ALL SELECT u FROM v WHERE k IN (4, 5)
    UNION ALL SELECT 'p' || c || CASE WHEN named THEN '::show' WHEN p.k % 2 = 0 THEN '::handle' ELSE '' END FROM v LEFT JOIN p ON p.k = c WHERE v.k = 5)""",
)
def m6_event_labels(spark, d):
    return labels.framework_labels(project(spark, d), [labels.events]).select("symbol", "type")


@query("m7_client_labels", f"WITH {PROJECT} SELECT DISTINCT u AS symbol, CASE k WHEN 6 THEN 'authentication' ELSE 'external_integration' END AS type FROM v WHERE k IN (6, 7)")
def m7_client_labels(spark, d):
    return labels.framework_labels(project(spark, d), [labels.authentication, labels.integrations]).select("symbol", "type")


@query(
    "m9_facades",
    r"SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Illuminate\Support\Facades\DB' WHEN 1 THEN 'Illuminate\Support\Facades\Auth' WHEN 2 THEN 'Http' ELSE 'Other' END AS class FROM events",
)
def m9_facades(spark, d):
    names = F.array(*map(F.lit, ("DB", "Auth", "Http", "Other")))
    rows = table(spark, d, "events").select(F.lit(REPO).alias("repo"), "event_id", F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")).alias("callee_class"))
    own = table(spark, d, "region").select(F.lit(REPO).alias("repo"), F.when(F.col("r_regionkey") == 0, "Http").otherwise(_id("R", "r_regionkey")).alias("class"))
    return labels.resolve_facades(rows, own).select("event_id", F.col("callee_class").alias("class"))
