"""Queries on cyclic graphs, on malformed input, and on whole reports, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockline.functions.lineage import cut, shared_folder
from shockline.operators import affected_tests, changed, churn, deps, diffs, flows, graph, impact, labels, reports, risk
from shockline.plans import jobs
from shockline.queries import EDGES, ORACLE_SQL, REPO, RISK, _context, _id, _joined, edges, edges_near, links, query, symbols, table
from shockline.sources import inputs, sinks

# A cyclic graph of parts, in two repositories that share their ids: even and odd order keys.
CYCLIC = """n AS (SELECT count(*) AS n FROM part),
g AS (SELECT DISTINCT 'r' || (l_orderkey % 2) AS repo, 'p' || l_partkey AS source, 'p' || ((l_partkey * 7 + l_suppkey) % n.n) AS target, CASE l_returnflag WHEN 'A' THEN 'extends' WHEN 'N' THEN 'method_call' ELSE 'parameter_type' END AS type FROM lineitem, n),
o AS (SELECT 'r' || (p_partkey // 100 % 2) AS repo, 'p' || p_partkey AS origin FROM part WHERE p_partkey % 100 = 0)"""


def cyclic(spark, d) -> tuple[DataFrame, DataFrame]:
    n = table(spark, d, "part").count()
    items = table(spark, d, "lineitem")
    type_ = F.when(F.col("l_returnflag") == "A", "extends").when(F.col("l_returnflag") == "N", "method_call").otherwise("parameter_type")
    target = F.concat(F.lit("p"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % n).cast("string"))
    g = items.select(_repo("l_orderkey"), _id("p", "l_partkey").alias("source"), target.alias("target"), type_.alias("type")).distinct()
    repo = F.concat(F.lit("r"), F.expr("p_partkey div 100 % 2").cast("string")).alias("repo")
    origins = table(spark, d, "part").where("p_partkey % 100 = 0").select(repo, _id("p", "p_partkey").alias("origin"))
    return cut(g.withColumns({"lines": F.array(F.lit(1)), "occurrences": F.lit(1)})), origins


def _repo(key: str):
    return F.concat(F.lit("r"), (F.col(key) % 2).cast("string")).alias("repo")


@query(
    "f3_cyclic_reach",
    f"""WITH RECURSIVE {CYCLIC}, w(repo, origin, node, depth) AS (SELECT repo, origin, origin, 0 FROM o UNION SELECT w.repo, w.origin, g.source, w.depth + 1 FROM w JOIN g ON g.repo = w.repo AND g.target = w.node WHERE w.depth < 14),
    m AS (SELECT repo, origin, node, min(depth) AS depth FROM w GROUP BY ALL)
    SELECT s.repo, s.origin, s.node AS impacted, s.depth::BIGINT AS depth, g.target, g.type AS dependency_type FROM m s JOIN g ON g.repo = s.repo AND g.source = s.node
    JOIN m t ON t.repo = s.repo AND t.origin = s.origin AND t.node = g.target AND t.depth = s.depth - 1 WHERE s.depth > 0 AND g.source <> g.target""",
)
def f3_cyclic_reach(spark, d):
    g, origins = cyclic(spark, d)
    return impact.reach(origins, g).select("repo", "origin", "impacted", F.col("depth").cast("long").alias("depth"), "target", "dependency_type")


@query(
    "g1_cyclic_paths",
    f"""WITH {CYCLIC}, h AS (SELECT * FROM g WHERE source <> target),
    l1 AS (SELECT o.repo, origin, target AS node, min({{'p': [target], 't': [type]}}) AS b FROM o JOIN h ON h.repo = o.repo AND source = origin WHERE target <> origin GROUP BY ALL),
    l2 AS (SELECT l1.repo, origin, target AS node, min({{'p': list_append(b.p, target), 't': list_append(b.t, type)}}) AS b FROM l1 JOIN h ON h.repo = l1.repo AND source = node WHERE target <> origin
        AND NOT EXISTS (SELECT 1 FROM l1 y WHERE y.repo = l1.repo AND y.origin = l1.origin AND y.node = h.target) GROUP BY ALL),
    l3 AS (SELECT l2.repo, origin, target AS node, min({{'p': list_append(b.p, target), 't': list_append(b.t, type)}}) AS b FROM l2 JOIN h ON h.repo = l2.repo AND source = node WHERE target <> origin
        AND NOT EXISTS (SELECT 1 FROM l1 y WHERE y.repo = l2.repo AND y.origin = l2.origin AND y.node = h.target) AND NOT EXISTS (SELECT 1 FROM l2 y WHERE y.repo = l2.repo AND y.origin = l2.origin AND y.node = h.target) GROUP BY ALL),
    t AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)
    SELECT repo, origin, array_to_string(b.p, '>') AS path, array_to_string(b.t, '>') AS types FROM t WHERE NOT EXISTS (SELECT 1 FROM t y WHERE y.repo = t.repo AND y.origin = t.origin AND len(y.b.p) = len(t.b.p) + 1 AND y.b.p[len(y.b.p) - 1] = t.node)""",
)
def g1_cyclic_paths(spark, d):
    g, origins = cyclic(spark, d)
    return flows.paths(origins, g).select("repo", "origin", F.array_join("path", ">").alias("path"), F.array_join("types", ">").alias("types"))


#: Kinds of malformed records by order key: no hash, five parts, no name, no date, a line without tabs, one with words, a blank one, too large a count, a line break ahead.
BAD_LOGS = """r AS (SELECT l_orderkey AS k, l_partkey AS p, sum(l_quantity::BIGINT)::BIGINT AS a, sum(l_linenumber)::BIGINT AS dl FROM lineitem GROUP BY ALL)"""


@query(
    "h1_malformed_logs",
    f"""WITH {BAD_LOGS} SELECT 'p' || p AS path, k % 10 IN (0, 1, 2, 3, 4, 5, 6, 7) AS error, count(*) AS records, coalesce(sum(CASE k % 10 WHEN 8 THEN a WHEN 9 THEN a END), 0)::BIGINT AS lines_added FROM r GROUP BY ALL""",
)
def h1_malformed_logs(spark, d):
    k = F.col("l_orderkey") % 10
    head = lambda *parts: F.concat_ws("\x1f", *(F.lit(x) if isinstance(x, str) else x for x in parts))
    hash_, name, date = F.lpad(F.hex("l_orderkey"), 8, "0"), "Al", "2024-05-06T07:08:09+02:00"
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("a"))
    stat = F.concat_ws("\t", "a", F.lit("1"), F.lit("f"))
    good = F.concat(head(hash_, name, "", date), F.lit("\n\n"), stat, F.lit("\n"))
    text = (
        F.when(k == 0, F.concat(head("nothex!", name, "", date), F.lit("\n"), stat))
        .when(k == 1, F.concat(head(hash_, name, "", date, "x"), F.lit("\n"), stat))
        .when(k == 2, F.concat(head(hash_, "", "e", date), F.lit("\n"), stat))
        .when(k == 3, F.concat(head(hash_, name, "", "someday"), F.lit("\n"), stat))
        .when(k == 4, F.concat(head(hash_, name, "", date), F.lit("\nno tab here\n"), stat))
        .when(k == 5, F.concat(head(hash_, name, "", date), F.lit("\nx\ty\tz\n"), stat))
        .when(k == 6, F.lit(" "))
        .when(k == 7, F.concat(head(hash_, name, "", date), F.lit("\n99999999999999999999\t1\tf\n")))
        .when(k == 8, F.concat(F.lit("\r\n\n"), good))
        .otherwise(good)
    )
    logs = rows.groupBy("l_partkey").agg(F.array_join(F.collect_list(F.concat(F.lit("\x1e"), text)), "").alias("log_text"))
    found = churn.parse_log(logs.select(F.lit(REPO).alias("repo"), _id("p", "l_partkey").alias("path"), "log_text"))
    return found.groupBy("path", "error").agg(F.count("*").alias("records"), F.coalesce(F.sum(F.when(~F.col("error"), F.col("lines_added"))), F.lit(0)).cast("long").alias("lines_added"))


#: Configurations by the number of an event modulo 16, and the error each has.
CONFIGS = [
    ('{"semantic_annotations":"x"}', "semantic_annotations is no array"),
    ('{"semantic_annotations":{"symbol":"A"}}', "semantic_annotations is no array"),
    ('{"semantic_annotations":[5]}', "an annotation is no object"),
    ('{"framework":""}', "bad framework"),
    ('{"framework":5}', "bad framework"),
    ('{"ai":null}', None),
    ('{"other":1}', "no known section"),
    ("[]", "the root is no object"),
    ("{broken", "no JSON"),
    ('{"semantic_annotations":[{"symbol":" A","type":"queue"}]}', "bad symbol"),
    ('{"semantic_annotations":[{"symbol":"A","type":"nothing"}]}', "unknown type"),
    ('{"semantic_annotations":[{"type":"queue"}]}', "bad symbol"),
    ('{"semantic_annotations":[{"symbol":7,"type":"queue"}]}', "bad symbol"),
    ('{"framework":null,"semantic_annotations":[]}', "bad framework"),
    ('{"semantic_annotations":[{"symbol":"A","type":"queue"},{"symbol":"A","type":"queue"}],"framework":"laravel"}', None),
    ("", "no JSON"),
]


@query("a5_malformed_configuration", "SELECT 'e' || event_id AS repo, CASE event_id % 16 " + " ".join(f"WHEN {k} THEN '{e}'" for k, (_, e) in enumerate(CONFIGS) if e) + " END AS error FROM events WHERE event_id % 16 NOT IN (5, 14)")
def a5_malformed_configuration(spark, d):
    text = F.element_at(F.array(*(F.lit(t) for t, _ in CONFIGS)), (F.col("event_id") % 16 + 1).cast("int"))
    return inputs.configuration(table(spark, d, "events").select(_id("e", "event_id").alias("repo"), text.alias("json")))[2]


@query(
    "b4_paths",
    """SELECT 'p' || p_partkey AS change_id, CASE p_partkey % 4 WHEN 0 THEN 'f' || p_partkey || '.php f' || p_partkey || '.php' WHEN 1 THEN 'f' || p_partkey || '.php' WHEN 2 THEN 'é f' || p_partkey || '.php' ELSE 'new' || p_partkey END AS path,
    CASE p_partkey % 4 WHEN 1 THEN 'f' || p_partkey || '.php' WHEN 2 THEN 'é f' || p_partkey || '.php' WHEN 3 THEN 'old' || p_partkey END AS old_path, CASE p_partkey % 4 WHEN 3 THEN 'renamed' ELSE 'modified' END AS change_type FROM part""",
)
def b4_paths(spark, d):
    k = F.col("p_partkey") % 4
    name = F.concat(_id("f", "p_partkey"), F.lit(".php"))
    cat = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    quoted = lambda side: cat('"', side, "/\\303\\251 ", name, '"')
    text = (
        F.when(k == 0, cat("diff --git ", name, " ", name, "\nindex 1..2\n"))  # no prefixes
        .when(k == 1, cat("diff --git b/", name, " a/", name, "\n--- b/", name, "\n+++ a/", name, "\t2024\n"))  # reversed
        .when(k == 2, cat("diff --git ", quoted("a"), " ", quoted("b"), "\n--- ", quoted("a"), "\n+++ ", quoted("b"), "\n"))
        .otherwise(cat("diff --git a/x b/y\nrename from ", _id("old", "p_partkey"), "\nrename to ", _id("new", "p_partkey"), "\n--- a/x\n"))
    )
    rows = diffs.changed_files(table(spark, d, "part").select(F.lit(REPO).alias("repo"), _id("p", "p_partkey").alias("change_id"), text.alias("diff_text")))
    return rows.select("change_id", "path", "old_path", "change_type")


# Reports: every supplier is a change of its class.  Parts call it, orders call parts; every 50th part and every 7th
# order is a test; small parts read a database, even nations are events.  A change has a source file and a text file.
WORLD = (
    EDGES
    + """,
su AS (SELECT 's' || s_suppkey AS c, s_suppkey AS k, s_name AS name, s_nationkey AS nk, 'n' || s_nationkey AS n, 'r' || n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey),
ev AS (SELECT target AS c, source AS node, 1 AS depth, target, type, lines, occurrences FROM e WHERE type = 'method_call'
    UNION ALL SELECT a.target, b.source, 2, b.target, b.type, b.lines, b.occurrences FROM e a JOIN e b ON b.target = a.source AND b.type = 'static_call' WHERE a.type = 'method_call'),
en AS (SELECT c, node, min(depth) AS depth FROM ev GROUP BY ALL),
ti AS (SELECT c, node AS test, CASE WHEN node[1] = 'p' THEN 't/p.php' ELSE 't/o.php' END AS file, depth, CASE WHEN depth <= 1 THEN 'direct' ELSE 'indirect' END AS impact FROM en
    WHERE node[2:]::BIGINT % CASE WHEN node[1] = 'p' THEN 50 ELSE 7 END = 0),
lb AS (SELECT en.c, node AS symbol, 'database_read' AS type, 0 AS o FROM en JOIN part ON node = 'p' || p_partkey WHERE p_size < 5 UNION ALL SELECT c, n, 'event', 1 FROM su WHERE nk % 2 = 0),
it AS (SELECT 's' || l_suppkey AS c, count(*) AS k FROM lineitem GROUP BY ALL),
ch AS (SELECT su.c, 'src/' || su.c || '.php' AS file, coalesce(it.k, 0) AS k, 2 AS a FROM su LEFT JOIN it USING (c) UNION ALL SELECT c, 'doc/' || n || '.txt', k % 15, 1 FROM su),
fan AS (SELECT target AS c, count(DISTINCT source) AS n FROM e WHERE type = 'method_call' GROUP BY ALL),
bl AS (SELECT c, count(*) AS n, max(depth) AS d FROM en GROUP BY ALL),
hc AS (SELECT c, max(k) AS n, list({'file': file, 'commit_count': k} ORDER BY k DESC, file) AS l FROM ch WHERE k >= 10 GROUP BY ALL),
rf AS (SELECT * FROM (
    SELECT c, 1 AS rank, 'high_fan_in' AS code, 'High fan-in' AS title, 20 AS w, n AS value, CASE WHEN n >= 10 THEN 'high' WHEN n >= 5 THEN 'warning' END AS severity, c || ' has ' || n || ' direct dependents.' AS description, '{"symbol":"' || c || '","direct_dependents":' || n || '}' AS evidence FROM fan
    UNION ALL SELECT c, 2, 'large_blast_radius', 'Large blast radius', 20, n, CASE WHEN n >= 10 THEN 'high' WHEN n >= 5 THEN 'warning' END, n || ' symbols may be affected by this change.', '{"affected_symbols":' || n || '}' FROM bl
    UNION ALL SELECT c, 3, 'deep_impact', 'Deep dependency chain', 15, d, CASE WHEN d >= 4 THEN 'high' WHEN d >= 2 THEN 'warning' END, 'The change can reach impacted symbols up to ' || d || ' dependency levels away.', '{"max_depth":' || d || '}' FROM bl
    UNION ALL SELECT c, 6, 'historical_churn', 'Historical churn', 25, n, CASE WHEN n >= 50 THEN 'high' WHEN n >= 25 THEN 'warning' ELSE 'info' END,
        CASE len(l) WHEN 1 THEN split_part(l[1].file, '/', -1) || ' has changed ' || n || ' times in Git history.' ELSE 'Frequently changed files:' || chr(10) || array_to_string(list_transform(l, lambda x: '  ' || x.file || ' — ' || x.commit_count || ' commits'), chr(10)) END,
        '{"max_commit_count":' || n || ',"affected_files":' || to_json(l)::VARCHAR || '}' FROM hc) WHERE severity IS NOT NULL),
co AS (SELECT c, rank, code, title, severity, w, CASE severity WHEN 'high' THEN w WHEN 'warning' THEN (w * 75 + 50) // 100 ELSE (w * 50 + 50) // 100 END AS x FROM rf),
sc AS (SELECT *, CASE WHEN score < 30 THEN 'low' WHEN score < 60 THEN 'medium' ELSE 'high' END AS level FROM (SELECT su.*, least(100, coalesce(sum(x), 0))::BIGINT AS score FROM su LEFT JOIN co USING (c) GROUP BY ALL))"""
)


def world(spark, d) -> jobs.Analysis:
    """The analysis of all suppliers' changes, from the library's operators."""
    supplier, nation = table(spark, d, "supplier"), table(spark, d, "nation")
    change, k = _id("s", "s_suppkey"), F.col("s_suppkey")
    key = [F.lit(REPO).alias("repo"), change.alias("change_id")]
    source, text = F.concat(F.lit("src/"), change, F.lit(".php")), F.concat(F.lit("doc/"), _id("n", "s_nationkey"), F.lit(".txt"))
    line = F.array((k % 10 + 1).cast("int"))
    file = lambda no, path, kind, lines: supplier.select(*key, F.lit(no).alias("file_no"), path.alias("path"), F.lit(kind).alias("change_type"), lines.alias("added_lines"), F.array_remove(F.array(F.lit(0)), 0).alias("deleted_lines"))
    files = file(1, source, "modified", line).unionByName(file(2, text, "added", F.array_remove(F.array(F.lit(0)), 0)))
    null = lambda t: F.lit(None).cast(t)
    ids = supplier.select(*key, change.alias("symbol"), F.lit("class").alias("type"), F.col("s_name").alias("name"), source.alias("file"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), null("string").alias("parent"), null("string").alias("visibility"), F.lit(False).alias("is_static"), line.alias("changed_lines"))
    unmapped = supplier.where("s_suppkey % 3 = 0").select(*key, F.when(k % 2 == 0, "added").otherwise("deleted").alias("side"), source.alias("file"), F.array(F.lit(3), F.lit(4)).alias("lines"))
    test = lambda t, c, p, step: table(spark, d, t).where(f"{c} % {step} = 0").select(F.lit(REPO).alias("repo"), _id(p, c).alias("id"), F.lit("method").alias("kind"), F.lit(f"t/{p}.php").alias("file"))
    tests = test("part", "p_partkey", "p", 50).unionByName(test("orders", "o_orderkey", "o", 7))
    counts = table(spark, d, "lineitem").groupBy(_id("s", "l_suppkey").alias("change_id")).agg(F.count("*").alias("n"))
    history = supplier.select(*key, source.alias("file"), F.lit(2).alias("a")).join(counts, "change_id", "left").select("repo", "change_id", "file", F.coalesce("n", F.lit(0)).alias("commit_count"), "a")
    history = history.unionByName(supplier.select(*key, text.alias("file"), (k % 15).cast("long").alias("commit_count"), F.lit(1).alias("a")))
    history = history.select("repo", "change_id", "file", "commit_count", F.col("a").alias("lines_added"), F.lit(0).alias("lines_deleted"), F.lit(1).alias("contributors_count"), null("string").alias("last_changed_text"))
    marks = table(spark, d, "part").where("p_size < 5").select(F.lit(REPO).alias("repo"), _id("p", "p_partkey").alias("symbol"), F.lit("database_read").alias("type"))
    marks = marks.unionByName(nation.where("n_nationkey % 2 = 0").select(F.lit(REPO).alias("repo"), _id("n", "n_nationkey").alias("symbol"), F.lit("event").alias("type")))
    near = edges_near(spark, d, ids)
    return jobs.Analysis(files, ids, unmapped, links(spark, d), lambda: cut(edges(spark, d)), near, graph.build_nodes(symbols(spark, d), near), tests, history, marks, ids)


def _first(l: str, n: int = 20) -> str:
    return f"CASE WHEN len({l}) > {n} THEN list_append({l}[:{n}], 'and ' || (len({l}) - {n}) || ' more') ELSE {l} END"


def _sql_block(title: str, l: str, indent: str = "") -> str:
    between = f"chr(10) || '{indent}  '"
    return f"'{indent}{title}:' || {between} || CASE WHEN len({l}) > 0 THEN array_to_string({_first(l)}, {between}) ELSE 'none' END"


@query(
    "l5_summary",
    f"""WITH {WORLD}, t AS (SELECT c, count(*) FILTER (impact = 'direct') AS d, count(*) FILTER (impact = 'indirect') AS i FROM ti GROUP BY c)
    SELECT sc.c AS change_id, concat_ws(chr(10), '{reports.TITLE}', repeat('─', {len(reports.TITLE)}), 'Risk: ' || score || ' / 100 (' || upper(level[1]) || level[2:] || ')', 'Changed files: 2',
        'Blast radius: ' || coalesce(bl.n, 0) || CASE WHEN bl.n = 1 THEN ' symbol' ELSE ' symbols' END, 'Affected tests: ' || coalesce(t.d, 0) || ' direct, ' || coalesce(t.i, 0) || ' indirect') AS text
    FROM sc LEFT JOIN bl ON bl.c = sc.c LEFT JOIN t ON t.c = sc.c""",
)
def l5_summary(spark, d):
    a = world(spark, d)
    return reports.summary(a.scores, a.files, a.histogram, a.test_counts).select("change_id", "text")


@query(
    "l7_change_digest",
    f"""WITH {WORLD},
    f AS (SELECT c, list(code ORDER BY rank) AS l FROM rf GROUP BY c), dc AS (SELECT c, list('depth ' || depth || ': ' || n ORDER BY depth) AS l FROM (SELECT c, depth, count(*) AS n FROM en GROUP BY ALL) GROUP BY c),
    lx AS (SELECT c, list(CASE o WHEN 0 THEN 'blast radius: ' ELSE 'affected flows: ' END || type || ' ' || symbol ORDER BY o, type, symbol) AS l FROM lb GROUP BY c),
    t AS (SELECT c, ['direct: ' || count(*) FILTER (impact = 'direct'), 'indirect: ' || count(*) FILTER (impact = 'indirect')] AS l FROM ti GROUP BY c), h AS (SELECT c, list(file || ': ' || k || ' commits' ORDER BY file) AS l FROM ch GROUP BY c),
    j AS (SELECT sc.*, f.l AS f, CASE WHEN dc.l IS NOT NULL THEN list_prepend('symbols: ' || bl.n, dc.l) END AS b, lx.l AS lx, t.l AS t, h.l AS h FROM sc LEFT JOIN f USING (c) LEFT JOIN dc USING (c) LEFT JOIN bl USING (c) LEFT JOIN lx USING (c) LEFT JOIN t USING (c) LEFT JOIN h USING (c))
    SELECT c AS change_id, concat_ws(chr(10) || chr(10), 'Changed files:' || chr(10) || '  src/' || c || '.php' || chr(10) || '  doc/' || n || '.txt', 'Changed symbols:' || chr(10) || '  ' || c, 'Risk:' || chr(10) || '  ' || score || ' / ' || level,
        {_sql_block("Risk factors", "f")}, {_sql_block("Blast radius", "b")}, 'Affected flows:' || chr(10) || '  ' || n || chr(10) || '  ' || r, {_sql_block("Semantic impact", "lx")}, {_sql_block("Test impact", "t")}, {_sql_block("Historical churn", "h")}) AS digest FROM j""",
)
def l7_change_digest(spark, d):
    return jobs.digest(world(spark, d), "change").select("change_id", "digest")


@query(
    "l7_risk_digest",
    f"""WITH {WORLD},
    xs AS (SELECT c, array_to_string(list(code || chr(10) || '  title: ' || title || chr(10) || '  severity: ' || severity || chr(10) || '  max_weight: ' || w || chr(10) || '  contribution: ' || x ORDER BY rank), chr(10) || chr(10)) AS l FROM co GROUP BY c),
    f AS (SELECT c, array_to_string(list(code || chr(10) || '  title: ' || title || chr(10) || '  severity: ' || severity || chr(10) || '  description: ' || description || chr(10) || '  evidence:' || chr(10) || '    ' || evidence ORDER BY rank), chr(10) || chr(10)) AS l FROM rf GROUP BY c),
    dc AS (SELECT c, list('depth ' || depth || ': ' || n ORDER BY depth) AS l FROM (SELECT c, depth, count(*) AS n FROM en GROUP BY ALL) GROUP BY c),
    j AS (SELECT sc.*, xs.l AS xl, f.l AS f, CASE WHEN dc.l IS NOT NULL THEN list_prepend('symbols: ' || bl.n, dc.l) END AS b FROM sc LEFT JOIN xs USING (c) LEFT JOIN f USING (c) LEFT JOIN dc USING (c) LEFT JOIN bl USING (c))
    SELECT c AS change_id, concat_ws(chr(10) || chr(10), 'Risk score: ' || score, 'Risk level: ' || level, 'Contributions:' || chr(10) || coalesce(xl, '  none'), 'Risk factors:' || chr(10) || coalesce(f, '  none'),
        CASE WHEN b IS NOT NULL THEN 'Blast radius:' || chr(10) || '  ' || array_to_string(b, chr(10) || '  ') END) AS digest FROM j""",
)
def l7_risk_digest(spark, d):
    return jobs.digest(world(spark, d), "risk").select("change_id", "digest")


@query(
    "l7_test_digest",
    f"""WITH {WORLD},
    tt AS (SELECT *, test || ' type=method file=' || file || ' production_symbol=' || c || ' depth=' || depth || ' impact=' || impact AS line FROM ti),
    td AS (SELECT c, list(line ORDER BY depth, file, test) FILTER (impact = 'direct') AS d, list(line ORDER BY depth, file, test) FILTER (impact = 'indirect') AS i FROM tt GROUP BY c),
    o AS (SELECT c, node, min(depth) AS depth, min({{'d': depth, 't': type, 'g': target}}) AS m FROM ev GROUP BY ALL),
    b AS (SELECT c, list(node || ' depth=' || depth || ' origin=' || c || ' origin_depth=' || m.d || ' edge=' || m.t || ' ' || node || '->' || m.g ORDER BY depth, node) AS l FROM o GROUP BY c),
    f AS (SELECT c, list(code || ' severity=' || severity ORDER BY rank) AS l FROM rf GROUP BY c),
    lx AS (SELECT c, list(CASE o WHEN 0 THEN 'blast_radius ' ELSE 'affected_flows ' END || type || ' ' || symbol ORDER BY o, type, symbol) AS l FROM lb GROUP BY c), h AS (SELECT c, list(file || ' commits=' || k ORDER BY file) AS l FROM ch GROUP BY c),
    j AS (SELECT sc.*, td.d, td.i, CASE WHEN len(b.l) > 0 THEN list_prepend('symbols: ' || len(b.l), b.l[:20]) END AS b, list_concat(['score=' || score, 'level=' || level], coalesce(f.l, [])) AS f, lx.l AS lx, h.l AS h
        FROM sc LEFT JOIN td USING (c) LEFT JOIN b USING (c) LEFT JOIN f USING (c) LEFT JOIN lx USING (c) LEFT JOIN h USING (c))
    SELECT c AS change_id, concat_ws(chr(10) || chr(10), 'Changed symbols:' || chr(10) || '  ' || c || ' type=class file=src/' || c || '.php lines=' || (k % 10 + 1),
        CASE WHEN d IS NULL AND i IS NULL THEN 'Test impact:' || chr(10) || '  none' ELSE 'Test impact:' || chr(10) || {_sql_block("directly_impacted_tests", "d", "  ")} || chr(10) || {_sql_block("indirectly_impacted_tests", "i", "  ")} END,
        {_sql_block("Blast radius", "b")}, 'Affected flows:' || chr(10) || '  ' || c || ' type=contract_chain depth=2 nodes=' || n || ' -> ' || r, {_sql_block("Risk", "f")}, {_sql_block("Semantic impact", "lx")}, {_sql_block("Historical churn", "h")}) AS digest FROM j""",
)
def l7_test_digest(spark, d):
    return jobs.digest(world(spark, d), "tests").select("change_id", "digest")


def _listed(rows: str, item: str, order: str) -> str:
    return f"(SELECT c, '[' || string_agg({item}, ',' ORDER BY {order}) || ']' AS j FROM {rows} GROUP BY c)"


@query(
    "a6_json_report",
    f"""WITH {WORLD},
    og AS (SELECT c, node, min(depth) AS depth, string_agg('{{"changed_symbol":"' || c || '","depth":' || depth || ',"dependency_type":"' || type || '","lines":[' || lines || '],"occurrences":' || occurrences || '}}', ',' ORDER BY depth, type, target) AS l FROM ev GROUP BY c, node),
    j1 AS {_listed("ev", '''\'{"changed_symbol":"' || c || '","impacted_symbol":"' || node || '","dependency_type":"method_call","lines":[' || lines || '],"occurrences":' || occurrences || '}\'''', "node").replace("FROM ev", "FROM ev WHERE depth = 1")},
    j2 AS {_listed("og", '''\'{"impacted_symbol":"' || node || '","depth":' || depth || ',"origins":[' || l || ']}\'''', "depth, node")},
    j3 AS {_listed("ti", '''\'{"changed_symbol":"' || c || '","test_symbol":"' || test || '","test_file":"' || file || '","depth":' || depth || ',"impact":"' || impact || '"}\'''', "depth, file, test")},
    j4 AS {_listed("rf", '''\'{"code":"' || code || '","severity":"' || severity || '","title":"' || title || '","description":' || to_json(description)::VARCHAR || ',"value":' || value || ',"evidence":' || evidence || '}\'''', "rank")},
    j5 AS {_listed("co", '''\'{"code":"' || code || '","title":"' || title || '","severity":"' || severity || '","max_weight":' || w || ',"contribution":' || x || '}\'''', "rank")},
    j6 AS {_listed("lb", '''\'{"symbol":"' || symbol || '","type":"' || type || '"}\'''', "type, symbol").replace("FROM lb", "FROM lb WHERE o = 0")},
    j7 AS {_listed("ch", '''\'{"file":"' || file || '","commit_count":' || k || ',"lines_added":' || a || ',"lines_deleted":0,"contributors_count":1,"last_changed_at":null}\'''', "file")}
    SELECT sc.c AS change_id, '{{"status":"success","diff":{{"files":[{{"path":"src/' || sc.c || '.php","change_type":"modified","added_lines":[' || (k % 10 + 1) || '],"deleted_lines":[]}},{{"path":"doc/' || n || '.txt","change_type":"added","added_lines":[],"deleted_lines":[]}}]}},"changed_symbols":[{{"type":"class","name":"' || name
        || '","fully_qualified_name":"' || sc.c || '","file":"src/' || sc.c || '.php","start_line":1,"end_line":9,"parent":null,"visibility":null,"is_static":false,"changed_lines":[' || (k % 10 + 1) || ']}}],"direct_impact":' || coalesce(j1.j, '[]') || ',"blast_radius":' || coalesce(j2.j, '[]') || ',"test_impact":' || coalesce(j3.j, '[]')
        || ',"risk_factors":' || coalesce(j4.j, '[]') || ',"risk_score":{{"score":' || score || ',"level":"' || level || '","contributions":' || coalesce(j5.j, '[]') || '}},"affected_flows":[{{"changed_symbol":"' || sc.c || '","type":"contract_chain","depth":2,"nodes":[{{"id":"' || n || '","depth":1}},{{"id":"' || r || '","depth":2}}],"edges":[{{"source":"' || sc.c
        || '","target":"' || n || '","dependency_type":"implements","lines":[1],"occurrences":1}},{{"source":"' || n || '","target":"' || r || '","dependency_type":"extends","lines":[1],"occurrences":1}}]}}],"semantic_impact":{{"blast_radius":' || coalesce(j6.j, '[]') || ',"affected_flows":' || CASE WHEN nk % 2 = 0 THEN '[{{"symbol":"' || n || '","type":"event"}}]' ELSE '[]' END
        || '}},"churn":' || j7.j || ',"unmapped_lines":' || CASE WHEN k % 6 = 0 THEN '[{{"file":"src/' || sc.c || '.php","lines":[3,4]}}]' ELSE '[]' END || ',"unmapped_deleted_lines":' || CASE WHEN k % 6 = 3 THEN '[{{"file":"src/' || sc.c || '.php","lines":[3,4]}}]' ELSE '[]' END
        || ',"dependencies":[{{"source":"' || sc.c || '","target":"' || n || '","type":"implements","line":1,"lines":[1],"occurrences":1}}]}}' AS report
    FROM sc LEFT JOIN j1 USING (c) LEFT JOIN j2 USING (c) LEFT JOIN j3 USING (c) LEFT JOIN j4 USING (c) LEFT JOIN j5 USING (c) LEFT JOIN j6 USING (c) LEFT JOIN j7 USING (c)""",
)
def a6_json_report(spark, d):
    a = world(spark, d)
    return reports.json_report(a.scores, jobs.json_items(a, _implements(spark, d))).select("change_id", "report")


def _implements(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(F.lit(REPO).alias("repo"), F.concat(F.lit("src/"), _id("s", "s_suppkey"), F.lit(".php")).alias("file"), _id("s", "s_suppkey").alias("source"), _id("n", "s_nationkey").alias("target"), F.lit("implements").alias("type"), F.array(F.lit(1)).alias("lines"), F.lit(1).alias("occurrences"))


@query("a6_report_files", ORACLE_SQL["a6_json_report"])
def a6_report_files(spark, d):
    """The same reports streamed into a file each, and read back."""
    a = world(spark, d)
    base = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    sinks.write_report_files(reports.fragments(a.scores, jobs.json_items(a, _implements(spark, d))), base)
    return inputs.texts(spark, f"{base}/{REPO}", "report").select(F.url_decode(F.regexp_extract("file", r"([^/]+)\.json$", 1)).alias("change_id"), "report")


@query(
    "a6_graph_sections",
    f"""WITH {EDGES}, b AS (SELECT split_part(target, target[2:], 1) || '' AS repo, e.* FROM e WHERE type IN ('extends', 'implements')),
    j AS (SELECT source, target, type, '{{"source":"' || source || '","target":"' || target || '","type":"' || type || '","lines":[' || lines || '],"occurrences":' || occurrences || '}}' AS i FROM e WHERE type IN ('extends', 'implements')),
    k AS (SELECT target, '"' || target || '":[' || string_agg(i, ',' ORDER BY source, type) || ']' AS i FROM j GROUP BY target),
    ns AS (SELECT id FROM (SELECT source AS id FROM j UNION SELECT target FROM j))
    SELECT (SELECT '{{"nodes":[' || string_agg('{{"id":"' || id || '","type":null,"name":"' || id || '","fully_qualified_name":"' || id || '","file":null,"known":false}}', ',' ORDER BY id) || '],"edges":[' FROM ns) || (SELECT string_agg(i, ',' ORDER BY source, target, type) || ']}}' FROM j) AS graph,
        (SELECT '{{"dependents":{{' || string_agg(i, ',' ORDER BY target) || '}}}}' FROM k) AS reverse_graph, (SELECT '{{"php_files":' || count(*) || ',"symbols":0,"dependencies":' FROM region) || (SELECT count(*) || '}}' FROM j) AS project_index""",
)
def a6_graph_sections(spark, d):
    e = edges(spark, d).where("type in ('extends', 'implements')")
    none = spark.createDataFrame([], inputs.SCHEMAS["symbols"])
    paths = table(spark, d, "region").select(F.lit(REPO).alias("repo"), _id("r", "r_regionkey").alias("path"))
    return reports.graph_sections(graph.build_nodes(none, e), e, deps.index_counts(paths, none, e)).select("graph", "reverse_graph", "project_index")


# The whole job from texts: a diff per supplier's file, its log, and the parts' graph.
@query(
    "w1_scores_from_texts",
    """WITH p AS (SELECT p_partkey AS k FROM part), s AS (SELECT 's' || s_suppkey AS c, s_suppkey AS k FROM supplier),
    f AS (SELECT s.c, count(DISTINCT l_partkey) AS n FROM s LEFT JOIN lineitem ON l_suppkey = s.k GROUP BY ALL), h AS (SELECT 's' || l_suppkey AS c, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY ALL),
    v AS (SELECT f.c, f.n, coalesce(h.n, 0) AS h FROM f LEFT JOIN h USING (c)),
    w AS (SELECT c, n, 2 * CASE WHEN n >= 10 THEN 20 WHEN n >= 5 THEN 15 ELSE 0 END + CASE WHEN h >= 50 THEN 25 WHEN h >= 25 THEN 19 WHEN h >= 10 THEN 13 ELSE 0 END AS score FROM v)
    SELECT c AS change_id, n AS blast, score::BIGINT AS score, CASE WHEN score < 30 THEN 'low' WHEN score < 60 THEN 'medium' ELSE 'high' END AS level FROM w""",
)
def w1_scores_from_texts(spark, d):
    supplier, items = table(spark, d, "supplier"), table(spark, d, "lineitem")
    name, file = _id("s", "s_suppkey"), F.concat(F.lit("src/"), _id("s", "s_suppkey"), F.lit(".php"))
    text = F.concat(F.lit("diff --git a/"), file, F.lit(" b/"), file, F.lit("\n--- a/"), file, F.lit("\n+++ b/"), file, F.lit("\n@@ -4 +4,2 @@\n-a\n+b\n+c\n"))
    diff_texts = supplier.select(F.lit(REPO).alias("repo"), name.alias("change_id"), text.alias("diff_text"))
    null = F.lit(None).cast("string")
    own = supplier.select(F.lit(REPO).alias("repo"), name.alias("fqn"), F.lit("class").alias("type"), F.col("s_name").alias("name"), file.alias("file"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), null.alias("parent"), null.alias("visibility"), F.lit(False).alias("is_static"), F.array().cast("array<string>").alias("attributes"))
    sites = items.select(F.lit(REPO).alias("repo"), F.lit("p.php").alias("file"), F.col("l_linenumber").cast("int").alias("seq"), F.col("l_linenumber").cast("int").alias("line"), _id("p", "l_partkey").alias("scope_symbol"), null.alias("scope_class"), null.alias("scope_parent"), F.lit("new").alias("kind"), null.alias("name"), null.alias("receiver_kind"), _id("s", "l_suppkey").alias("receiver_name"), F.array().cast("array<string>").alias("type_names"))
    bindings, props = (spark.createDataFrame([], s) for s in (inputs.SCHEMAS["bindings"], "repo string, class string, prop string, type string"))
    _, e, _ = jobs.build_graph(sites, bindings, props, own)
    record = F.concat(F.lit("\x1e"), F.concat_ws("\x1f", F.lpad(F.hex("l_orderkey"), 8, "0"), F.lit("Al"), F.lit(""), F.lit("2024-01-01T00:00:00Z")), F.lit("\n\n1\t1\tf\n"))
    logs = items.select("l_suppkey", "l_orderkey").distinct().groupBy("l_suppkey").agg(F.array_join(F.collect_list(record), "").alias("log_text"))
    commits = churn.commit_files(logs.select(F.lit(REPO).alias("repo"), F.concat(F.lit("src/"), _id("s", "l_suppkey"), F.lit(".php")).alias("path"), "log_text"))
    marks = spark.createDataFrame([], "repo string, symbol string, type string")
    a = jobs.analyze(diff_texts, own, e, commits, marks)
    blast = a.entries.groupBy("change_id").agg(F.count("*").alias("blast"))
    return a.scores.select("change_id", F.col("score").cast("long").alias("score"), "level").join(blast, "change_id", "left").select("change_id", F.coalesce("blast", F.lit(0)).alias("blast"), "score", "level")


@query("c5_listed_changed", "SELECT row_number() OVER (ORDER BY 'f' || (p_partkey % 100) || '.php', (p_partkey // 100) * 10, 'p' || p_partkey) AS place, 'p' || p_partkey AS fqn FROM part")
def c5_listed_changed(spark, d):
    return _numbered(changed.listed_changed(symbols(spark, d).withColumn("change_id", F.lit("all"))), "fqn")


def _numbered(rows: DataFrame, column: str) -> DataFrame:
    """Places of ordered rows: partitions follow each other, and each is in order."""
    held = cut(rows.select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"), column))
    sizes = {r["p"]: r["n"] for r in held.groupBy("p").agg(F.count("*").alias("n")).collect()}
    before, at = {}, 0
    for p in sorted(sizes):
        before[p], at = at, at + sizes[p]
    starts = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else F.create_map(F.lit(0), F.lit(0))
    return held.select((starts[F.col("p")] + F.col("i").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long").alias("place"), column)


@query("e4_listed_nodes", f"WITH {EDGES} SELECT row_number() OVER (ORDER BY id) AS place, id FROM (SELECT source AS id FROM e UNION SELECT target FROM e)")
def e4_listed_nodes(spark, d):
    none = spark.createDataFrame([], inputs.SCHEMAS["symbols"])
    return _numbered(graph.listed_nodes(graph.build_nodes(none, edges(spark, d))), "id")


@query("d6_listed_dependencies", "SELECT row_number() OVER (ORDER BY s, t) AS place, s || '>' || t AS pair FROM (SELECT DISTINCT 'o' || l_orderkey AS s, 's' || l_suppkey AS t FROM lineitem)")
def d6_listed_dependencies(spark, d):
    of = lambda rest: deps.aggregate(table(spark, d, "lineitem").where(f"l_orderkey % 2 = {rest}").select(F.lit(REPO).alias("repo"), F.lit("f").alias("file"), _id("o", "l_orderkey").alias("source"), _id("s", "l_suppkey").alias("target"), F.lit("static_call").alias("type"), F.col("l_linenumber").alias("line")))
    return _numbered(deps.listed_dependencies(deps.merge(of(0), of(1))).withColumn("pair", F.concat_ws(">", "source", "target")), "pair")


@query("h5_listed_churn", "SELECT row_number() OVER (ORDER BY file) AS place, file FROM (SELECT 'p' || p_partkey AS file FROM part)")
def h5_listed_churn(spark, d):
    rows = table(spark, d, "part").select(F.lit(REPO).alias("repo"), F.lit("all").alias("change_id"), _id("p", "p_partkey").alias("file"))
    return _numbered(churn.listed_churn(rows), "file")


@query("g5_listed_flows", f"WITH {EDGES} SELECT row_number() OVER (ORDER BY s.source, n.target) AS place, s.source || '>' || s.target || '>' || n.target AS path FROM e s JOIN e n ON s.type = 'implements' AND n.type = 'extends' AND n.source = s.target")
def g5_listed_flows(spark, d):
    ids = table(spark, d, "supplier").select(F.lit(REPO).alias("repo"), F.lit("all").alias("change_id"), _id("s", "s_suppkey").alias("symbol"))
    e = cut(edges(spark, d))
    rows = flows.affected_flows(ids, e, graph.build_nodes(symbols(spark, d), e))
    path = F.concat_ws(">", "changed_symbol", F.transform("nodes", lambda n: n["id"]))
    return _numbered(flows.listed_flows(rows).withColumn("path", path), "path")


@query("i7_ordered_factors", f"WITH {WORLD} SELECT c AS change_id, string_agg(code || ':' || description, '|' ORDER BY rank) AS factors FROM rf GROUP BY c")
def i7_ordered_factors(spark, d):
    rows = risk.ordered_factors(world(spark, d).factors)
    each = F.struct("place", F.concat_ws(":", "code", "description").alias("text"))
    return rows.groupBy("change_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["text"]), "|").alias("factors"))


@query("a4_facts", "SELECT 'p' || p_partkey AS fqn, p_size::BIGINT AS end_line, NULL::VARCHAR AS visibility FROM part")
def a4_facts(spark, d):
    """Facts written by some parser, read back with the schema of their kind; columns it doesn't know are null."""
    out = f"{shared_folder(spark)}/facts-{uuid.uuid4().hex}"
    table(spark, d, "part").select(F.lit(REPO).alias("repo"), _id("p", "p_partkey").alias("fqn"), F.col("p_size").cast("int").alias("end_line"), F.lit(1).alias("further")).write.json(out)
    return inputs.facts(spark, "symbols", out, "json").select("fqn", F.col("end_line").cast("long").alias("end_line"), "visibility")


@query("a2_diff_texts", "SELECT 'b' || l_returnflag AS path, count(*) AS files FROM (SELECT DISTINCT l_returnflag, l_orderkey FROM lineitem) GROUP BY ALL")
def a2_diff_texts(spark, d):
    """Diffs in files, written line by line and read back by many tasks; each file is a diff."""
    base = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey").distinct()
    rows.select("l_returnflag", F.concat(F.lit("diff --git a/f b/"), _id("o", "l_orderkey")).alias("value")).write.partitionBy("l_returnflag").text(base)
    lines = inputs.text_lines(spark, base).select(F.lit(REPO).alias("repo"), F.col("file").alias("change_id"), "part", "pos", "line")
    flag = F.concat(F.lit("b"), F.url_decode(F.regexp_extract("change_id", "l_returnflag=([^/]+)", 1)))
    return diffs.files_of(diffs.numbered(lines)).groupBy(flag.alias("path")).agg(F.count("*").alias("files"))


@query("a3_log_texts", "SELECT l_returnflag AS flag, count(DISTINCT l_orderkey) AS commits, sum(l_quantity::BIGINT)::BIGINT AS lines_added FROM lineitem GROUP BY ALL")
def a3_log_texts(spark, d):
    """Commit logs in files, written record by record, and parsed record by record where they are read."""
    base = f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
    stat = F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit("\t0\tf"))
    head = F.concat(F.lit("\x1e"), F.concat_ws("\x1f", F.lpad(F.hex("l_orderkey"), 8, "0"), F.lit("Al"), F.lit("a@x"), F.lit("2024-01-01T00:00:00Z")), F.lit("\n\n"))
    records = table(spark, d, "lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.concat(F.first(head), F.array_join(F.collect_list(stat), "\n")).alias("value"))
    records.select("l_returnflag", "value").write.partitionBy("l_returnflag").text(base)
    read = inputs.log_records(spark, base).select(F.lit(REPO).alias("repo"), F.regexp_extract("file", "l_returnflag=([^/]+)", 1).alias("path"), "record")
    return churn.commit_files(read).groupBy(F.col("path").alias("flag")).agg(F.count("*").alias("commits"), F.sum("lines_added").alias("lines_added"))


@query("a7_text_sink", "SELECT 'n' || s_nationkey AS repo, 'score of ' || s_name AS line FROM supplier")
def a7_text_sink(spark, d):
    """Texts of changes written in a folder per repository, and read back."""
    base = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    rows = table(spark, d, "supplier").select(_id("n", "s_nationkey").alias("repo"), F.concat(F.lit("score of "), "s_name").alias("text"))
    inputs.write_texts(rows, "text", base)
    return spark.read.text(base).select("repo", F.col("value").alias("line"))


@query("c4_source_files_only", "SELECT 'p' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.php' ELSE '.PhP' END AS file, p_size::BIGINT AS line FROM part WHERE p_partkey % 3 <> 2")
def c4_source_files_only(spark, d):
    k = F.col("p_partkey") % 3
    path = F.concat(_id("p", "p_partkey"), F.when(k == 0, ".php").when(k == 1, ".PhP").otherwise(".php.txt"))
    files = table(spark, d, "part").select(F.lit(REPO).alias("repo"), F.lit("all").alias("change_id"), path.alias("path"), F.lit("modified").alias("change_type"), F.array(F.col("p_size").cast("int")).alias("added_lines"))
    return changed.exploded(files, "added").select("file", F.col("line").cast("long").alias("line"))


@query("g3_flow_facts", f"WITH {EDGES} SELECT o.source AS changed_symbol, o.target AS id, o.type AS dependency_type, o.lines, o.occurrences, o.target[1] = 'p' AS known FROM e o WHERE o.source[1] = 'o'")
def g3_flow_facts(spark, d):
    ids = table(spark, d, "orders").select(F.lit(REPO).alias("repo"), F.lit("all").alias("change_id"), _id("o", "o_orderkey").alias("symbol"))
    e = cut(edges(spark, d))
    rows = flows.affected_flows(ids, e, graph.build_nodes(symbols(spark, d), e), max_depth=1)
    rows = rows.select("changed_symbol", F.inline(F.arrays_zip("nodes", "edges")))
    return rows.select("changed_symbol", "nodes.id", F.col("edges.type").alias("dependency_type"), _joined("edges.lines").alias("lines"), F.col("edges.occurrences").cast("long").alias("occurrences"), "nodes.known")


@query(
    "i_factor_details",
    f"""WITH RECURSIVE {RISK},
    tl AS (SELECT x.change_id, x.symbol, list_sort(list_distinct(list(e.type))) AS ts FROM x JOIN e ON e.target = x.symbol AND e.source <> e.target GROUP BY ALL),
    q1 AS (SELECT change_id, symbol, n, CASE WHEN n >= 10 THEN 3 WHEN n >= 5 THEN 2 END AS s FROM fan WHERE n >= 5), q2 AS (SELECT *, len(ts) AS n, CASE WHEN len(ts) >= 3 THEN 2 ELSE 1 END AS s FROM tl WHERE len(ts) >= 2),
    p1 AS (SELECT change_id, list({{'symbol': symbol, 'n': n}} ORDER BY s DESC, n DESC, symbol)[1] AS p, list({{'symbol': symbol, 'direct_dependents': n}} ORDER BY symbol) AS l FROM q1 GROUP BY change_id),
    p2 AS (SELECT change_id, list({{'symbol': symbol, 'n': n, 'ts': ts}} ORDER BY s DESC, n DESC, symbol)[1] AS p, list({{'symbol': symbol, 'dependency_types': ts}} ORDER BY symbol) AS l FROM q2 GROUP BY change_id)
    SELECT change_id, 'high_fan_in' AS code, p.symbol || ' has ' || p.n || ' direct dependents.' AS description, '{{"symbol":"' || p.symbol || '","direct_dependents":' || p.n || CASE WHEN len(l) > 1 THEN ',"symbols":' || to_json(l)::VARCHAR ELSE '' END || '}}' AS evidence FROM p1
    UNION ALL SELECT change_id, 'multiple_dependency_types', p.symbol || ' has dependents through ' || p.n || ' different dependency types.', '{{"symbol":"' || p.symbol || '","dependency_types":' || to_json(p.ts)::VARCHAR || CASE WHEN len(l) > 1 THEN ',"symbols":' || to_json(l)::VARCHAR ELSE '' END || '}}' FROM p2
    UNION ALL SELECT change_id, code, value || ' symbols may be affected by this change.', '{{"affected_symbols":' || value || '}}' FROM rf WHERE code = 'large_blast_radius' AND severity IS NOT NULL
    UNION ALL SELECT change_id, code, 'The change can reach impacted symbols up to ' || value || ' dependency levels away.', '{{"max_depth":' || value || '}}' FROM rf WHERE code = 'deep_impact' AND severity IS NOT NULL
    UNION ALL SELECT change_id, code, value || ' symbols were changed in this analysis.', '{{"changed_symbols":' || value || '}}' FROM rf WHERE code = 'multiple_changed_symbols' AND severity IS NOT NULL""",
)
def i_factor_details(spark, d):
    c = _context(spark, d)
    rows = risk.risk_factors(risk.Context(c.changed, c.edges, c.entries, None, c.histogram))
    return rows.select("change_id", "code", "description", F.to_json("evidence").alias("evidence"))


@query(
    "j2_score_errors",
    "WITH f AS (SELECT l_orderkey AS k, CASE l_linenumber % 3 WHEN 0 THEN 'deep_impact' WHEN 1 THEN 'high_fan_in' ELSE 'made_up' END AS code FROM lineitem) SELECT 'o' || k AS change_id, code, 'unknown code' AS error FROM f WHERE code = 'made_up' UNION ALL SELECT 'o' || k, code, 'code found twice' FROM f GROUP BY k, code HAVING count(*) > 1",
)
def j2_score_errors(spark, d):
    k = F.col("l_linenumber") % 3
    rows = table(spark, d, "lineitem").select(F.lit(REPO).alias("repo"), _id("o", "l_orderkey").alias("change_id"), F.when(k == 0, "deep_impact").when(k == 1, "high_fan_in").otherwise("made_up").alias("code"))
    return risk.score_errors(rows).select("change_id", "code", "error")


@query(
    "m2_model_labels",
    """WITH k AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 7 = 0 OR (p_partkey % 7 = 1 AND p_partkey - 1 IN (SELECT p_partkey FROM part)))
    SELECT DISTINCT 'u' || user_id AS symbol, CASE event_id % 3 WHEN 0 THEN 'database_read' ELSE 'database_write' END AS type FROM events LEFT JOIN k ON k.k = event_id % 100 WHERE event_id % 3 < 2 AND (k.k IS NOT NULL OR event_id % 100 = 99)""",
)
def m2_model_labels(spark, d):
    """Every seventh part is a model and the next one its subclass; a call on one of them, or on a query builder, reads or writes."""
    part, k = table(spark, d, "part"), F.col("p_partkey")
    text, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    own = part.select(F.lit(REPO).alias("repo"), _id("p", "p_partkey").alias("fqn"), F.lit("class").alias("type"), _id("p", "p_partkey").alias("name"), F.lit("f.php").alias("file"), text.alias("parent"), text.alias("visibility"), none.alias("attributes"))
    above = F.when(k % 7 == 0, F.lit(labels.MODEL)).when(k % 7 == 1, F.concat(F.lit("p"), (k - 1).cast("string")))
    parents = part.select(F.lit(REPO).alias("repo"), _id("p", "p_partkey").alias("child"), above.alias("parent")).where("parent is not null")
    n = F.col("event_id") % 100
    method = F.when(F.col("event_id") % 3 == 0, "first").when(F.col("event_id") % 3 == 1, "update").otherwise("where")
    calls = table(spark, d, "events").select(F.lit(REPO).alias("repo"), F.lit("f.php").alias("file"), _id("u", "user_id").alias("containing_symbol"), F.lit("static").alias("kind"), F.when(n == 99, F.lit(labels.BUILDERS[0])).otherwise(F.concat(F.lit("p"), n.cast("string"))).alias("callee_class"), method.alias("name"), F.array(method).alias("chain"), text.alias("arg_class"), text.alias("arg_method"), text.alias("arg_kind"))
    empty = spark.createDataFrame([], "repo string, class string, name string")
    return labels.framework_labels(labels.Project(own, parents, empty, empty, calls), [labels.database_reads, labels.database_writes]).select("symbol", "type")
