"""Lookups, state, incremental ingest, graphs and reports.

Customers are courses, orders their sheets, order lines the tasks, unless stated otherwise.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import graph as G, lookup as J
from ..plans import report as R
from ..session import staging_dir
from ..sources import store as S
from ..streaming import ingest as I
from . import REGISTRY, table

q = REGISTRY.query


@q("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def q_latest(spark, sf_dir):
    """The latest order per customer."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return J.latest_by(o, ["o_custkey"], F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey")


REFS = r"""
r AS (SELECT source AS course, doc_id, unnest(generate_series(1, len(x))) AS k, unnest(x) AS ref FROM (SELECT source, doc_id, regexp_extract_all(text, '\d+') AS x FROM documents)),
ex AS (SELECT course, number, arg_min(doc_id, doc_id) AS ex_doc FROM (SELECT source AS course, CAST(n_chars % 100 AS VARCHAR) AS number, doc_id FROM documents) GROUP BY ALL),
j AS (SELECT r.*, ex_doc FROM r LEFT JOIN ex ON r.course = ex.course AND r.ref = ex.number)
"""


def _refs(spark, sf_dir):
    """Documents are tasks; the numbers in their text refer to exercises, which are the
    documents of the same source by the last two digits of their length."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("course"), F.col("doc_id").alias("sheet_id"), F.lit(1).alias("pos"), F.lit(1).alias("number"), "text",
        F.regexp_extract_all("text", F.lit(r"(\d+)"), F.lit(1)).alias("script_references"))
    exercises = table(spark, sf_dir, "documents").select(
        F.col("source").alias("course"), F.col("doc_id").alias("pos"), (F.col("n_chars") % 100).cast("string").alias("number"),
        F.col("lang").alias("title"), "text", F.col("doc_id").cast("int").alias("page"))
    return docs, exercises, J.resolve_refs(docs, exercises)


@q(f"""WITH {REFS} SELECT doc_id AS sheet_id, coalesce(string_agg(CAST(ex_doc AS VARCHAR), ',' ORDER BY k) FILTER (WHERE ex_doc IS NOT NULL), '') AS found,
 coalesce(string_agg(ref, ',' ORDER BY k) FILTER (WHERE ex_doc IS NULL), '') AS missing FROM j GROUP BY doc_id""")
def q_resolve_refs(spark, sf_dir):
    """Found exercises and missing numbers in the order of the references."""
    _, _, resolved = _refs(spark, sf_dir)
    pages = F.transform("found", lambda e: e["page"].cast("string"))
    return resolved.select("sheet_id", F.array_join(pages, ",").alias("found"), F.array_join("missing", ",").alias("missing"))


@q(f"""WITH {REFS}, g AS (SELECT doc_id, count(ex_doc) AS n, string_agg(d.text, chr(10) ORDER BY k) FILTER (WHERE ex_doc IS NOT NULL) AS texts,
   string_agg('(' || ref || ') ' || d.lang, '' ORDER BY k) FILTER (WHERE ex_doc IS NOT NULL) AS titles FROM j LEFT JOIN (SELECT doc_id AS dd, text, lang FROM documents) d ON dd = ex_doc GROUP BY doc_id)
SELECT doc_id AS sheet_id, length(text) + coalesce(length(texts) + 1, 0) AS query_chars, CASE WHEN n = 1 THEN titles END AS title FROM documents LEFT JOIN g USING (doc_id)
""")
def q_task_query(spark, sf_dir):
    """What a task asks with its exercises, and the title of a single one."""
    docs, _, resolved = _refs(spark, sf_dir)
    full = J.with_found(docs, resolved)
    return full.select("sheet_id", F.length(J.task_query()).cast("bigint").alias("query_chars"),
                       F.when(F.size("found") == 1, J.task_title()).alias("title"))


@q(f"WITH {REFS} SELECT doc_id AS sheet_id, string_agg(ref, ',' ORDER BY k) AS missing FROM j WHERE ex_doc IS NULL GROUP BY doc_id")
def q_unresolved_refs(spark, sf_dir):
    """References without an exercise."""
    docs, _, resolved = _refs(spark, sf_dir)
    return J.unresolved_refs(docs, resolved).select("sheet_id", F.array_join("missing", ",").alias("missing"))


SHEETS = """
sheets AS (SELECT o_custkey AS course, o_orderkey AS sheet_id, CASE WHEN o_orderpriority <> '5-LOW' THEN month(o_orderdate) END AS n FROM orders),
tasks AS (SELECT o_custkey AS course, l_orderkey AS sheet_id, l_linenumber AS number, l_partkey AS pos, l_returnflag AS label, CAST(l_partkey AS VARCHAR) AS text FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
last AS (SELECT course, arg_max(sheet_id, (coalesce(n, 0), sheet_id)) AS sheet_id FROM sheets GROUP BY course)
"""


def _sheets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    sheets = o.select(F.col("o_custkey").alias("course"), F.col("o_orderkey").alias("sheet_id"),
                      F.when(F.col("o_orderpriority") != "5-LOW", F.month("o_orderdate")).alias("sheet_number"))
    li = table(spark, sf_dir, "lineitem")
    tasks = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("course"), F.col("l_orderkey").alias("sheet_id"), F.col("l_linenumber").alias("number"),
        F.col("l_partkey").alias("pos"), F.col("l_returnflag").alias("label"), F.col("l_partkey").cast("string").alias("text"))
    return sheets, tasks


@q(f"""WITH {SHEETS}, st AS (SELECT c_custkey AS course, c_custkey * 10 AS sheet, CAST(c_nationkey AS INTEGER) % 8 AS task, CASE WHEN c_acctbal > 5000 THEN 'A' ELSE 'N' END AS part FROM customer),
a AS (SELECT st.*, coalesce(s.sheet_id, l.sheet_id) AS sheet_id FROM st LEFT JOIN sheets s ON s.course = st.course AND s.sheet_id = st.sheet LEFT JOIN last l ON l.course = st.course),
b AS (SELECT a.course, a.sheet_id, a.part, CASE WHEN EXISTS (SELECT 1 FROM tasks t WHERE t.sheet_id = a.sheet_id AND t.number = a.task) THEN a.task
   ELSE (SELECT arg_min(number, (pos, number)) FROM tasks t WHERE t.sheet_id = a.sheet_id) END AS task FROM a)
SELECT course, sheet_id, task, CASE WHEN EXISTS (SELECT 1 FROM tasks t WHERE t.sheet_id = b.sheet_id AND t.number = b.task AND t.label = b.part) THEN part ELSE '' END AS part FROM b""")
def q_resolve_state(spark, sf_dir):
    """The remembered sheet, task and part of every course, repaired."""
    sheets, tasks = _sheets(spark, sf_dir)
    state = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("course"), (F.col("c_custkey") * 10).alias("sheet"), (F.col("c_nationkey") % 8).alias("task"),
        F.when(F.col("c_acctbal") > 5000, "A").otherwise("N").alias("part"))
    rows = tasks.groupBy("sheet_id", "number").agg(
        F.min(F.struct("pos", "number")).alias("pos"), F.collect_set("label").alias("labels"))
    return J.resolve_state(state, sheets, rows)


@q(f"""WITH {SHEETS}, cur AS (SELECT course, max(n) AS now FROM sheets GROUP BY course HAVING max(n) IS NOT NULL),
w AS (SELECT DISTINCT course, sheet_id || '#' || number AS ref FROM tasks WHERE label = 'R')
SELECT t.course, t.sheet_id || '#' || number AS ref, 'Sheet ' || n || ', task ' || number AS label, text FROM tasks t JOIN sheets s USING (course, sheet_id) JOIN cur USING (course)
WHERE n < now AND t.sheet_id || '#' || number IN (SELECT ref FROM w)""")
def q_earlier_tasks(spark, sf_dir):
    """Remembered tasks of sheets before the current one."""
    sheets, tasks = _sheets(spark, sf_dir)
    current = sheets.groupBy("course").agg(F.max("sheet_number").alias("number")).filter("number is not null")
    wanted = tasks.filter("label = 'R'").select("course", J.task_ref(F.col("sheet_id"), F.col("number")).alias("ref"))
    return J.earlier_tasks(sheets, tasks, current, wanted).select("course", "ref", "label", "text")


@q(f"""WITH {SHEETS}, cur AS (SELECT course, max(n) AS now FROM sheets GROUP BY course HAVING max(n) IS NOT NULL),
c AS (SELECT t.course, 'Sheet ' || n || ', task ' || number AS label, t.sheet_id || '#' || number AS ref, t.sheet_id, pos FROM tasks t JOIN sheets s USING (course, sheet_id) JOIN cur USING (course) WHERE n < now)
SELECT course, label, arg_min(ref, (sheet_id, pos)) AS ref FROM c GROUP BY course, label""")
def q_earlier_candidates(spark, sf_dir):
    """All tasks of earlier sheets, one per label."""
    sheets, tasks = _sheets(spark, sf_dir)
    current = sheets.groupBy("course").agg(F.max("sheet_number").alias("number")).filter("number is not null")
    return J.earlier_candidates(sheets, tasks, current).select("course", "label", "ref")


@q("""
SELECT 'section:' || p_partkey AS target, CASE WHEN p_size > 25 THEN 'deck ' || p_brand ELSE 'notes ' || p_type END AS pdf, p_size AS page, p_name AS what FROM part
UNION ALL SELECT 'P' || p_partkey, CASE WHEN p_retailprice > 950 THEN 'own ' || p_brand ELSE 'notes ' || p_type END, p_size + 1, 'P' || p_partkey FROM part
UNION ALL SELECT 'gone ' || p_partkey, NULL, NULL, 'gone ' || p_partkey FROM part
""")
def q_source_of(spark, sf_dir):
    """Where a section or a statement stands."""
    p = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey").cast("string")).withColumn("course", F.col("p_type"))
    nodes = p.select("course", F.col("k").alias("key"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("title"), F.col("p_size").alias("page"),
                     F.when(F.col("p_size") > 25, F.concat(F.lit("deck "), "p_brand")).alias("pdf"))
    entries = p.select("course", F.concat(F.lit("P"), "k").alias("id"), F.col("p_partkey").alias("pos"), (F.col("p_size") + 1).alias("page"),
                       F.when(F.col("p_retailprice") > 950, F.concat(F.lit("own "), "p_brand")).alias("pdf"))
    notes = p.select("course").distinct().withColumn("pdf", F.concat(F.lit("notes "), "course"))
    targets = p.select("course", F.explode(F.array(F.concat(F.lit("section:"), "k"), F.concat(F.lit("P"), "k"), F.concat(F.lit("gone "), "k"))).alias("target"))
    return J.source_of(targets, nodes, entries, notes).select("target", "pdf", "page", "what")


@q("""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS first FROM documents)
SELECT doc_id, CAST(CASE WHEN first IS NOT NULL THEN 1 END AS INTEGER) AS page FROM l
""")
def q_page_of_task(spark, sf_dir):
    """Every document is found on its first page, its text being split over two."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sheet_id"), F.lit(1).alias("number"), "text")
    half = F.greatest(F.ceil(F.length("text") / 2).cast("int"), F.lit(200))
    pages = docs.select("sheet_id", F.posexplode(F.array(
        F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text")))).alias("p", "text")).select(
        "sheet_id", (F.col("p") + 1).alias("page"), "text")
    return J.page_of_task(pages, docs).select(F.col("sheet_id").alias("doc_id"), "page")


@q(r"""
WITH l AS (SELECT doc_id AS sheet_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS page, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT sheet_id, page AS number, trim(line) AS first FROM l WHERE page % 4 = 3 AND regexp_matches(line, '^[!-~ ]*$') AND trim(line) <> ''),
n AS (SELECT sheet_id, number, left(first, 60) AS n0, array_to_string(string_split(regexp_replace(first, ' +', ' ', 'g'), ' ')[1:3], ' ') AS n1 FROM t)
SELECT n.sheet_id, number, coalesce(min(page) FILTER (WHERE contains(line, n0)), min(page) FILTER (WHERE contains(line, n1))) AS page
FROM n JOIN l USING (sheet_id) GROUP BY ALL""")
def q_page_of_line(spark, sf_dir):
    """Every fourth line is a task; the lines of its document are the pages it is looked for on."""
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sheet_id"), F.posexplode(F.split("text", "\n")).alias("p", "text")).select(
        "sheet_id", (F.col("p") + 1).alias("page"), "text")
    plain = r"^[!-~ ]*$"
    tasks = pages.filter(F.col("text").rlike(plain) & (F.trim("text") != "") & (F.col("page") % 4 == 3)).select("sheet_id", F.col("page").alias("number"), "text")
    return J.page_of_task(pages, tasks).select("sheet_id", "number", "page")


@q("""WITH nb AS (SELECT o_custkey AS course, o_orderkey AS path, o_orderkey % 5 AS number, o_orderdate AS mtime FROM orders),
b AS (SELECT course, number, arg_max(path, (mtime, path)) AS path FROM nb GROUP BY ALL)
SELECT c_custkey AS course, k AS sheet_id, path FROM customer CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k) LEFT JOIN b ON course = c_custkey AND number = k""")
def q_notebook_for(spark, sf_dir):
    """The newest order of a customer that bears a sheet's number as its notebook."""
    notebooks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("course"), F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"),
                                                      F.concat(F.lit("7 notes "), (F.col("o_orderkey") % 5).cast("string")).alias("stem"))
    sheets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("course"), F.explode(F.array(*[F.lit(k) for k in range(6)])).alias("sheet_id"))
    return J.notebook_for(sheets.withColumn("sheet_number", F.col("sheet_id")), notebooks)


@q("""
SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, CASE WHEN s.o_orderkey IS NULL THEN 'delete' WHEN t.o_orderkey IS NULL OR t.m < s.o_orderdate OR t.f < 6 THEN 'read' ELSE 'skip' END AS action
FROM (SELECT * FROM orders WHERE o_orderstatus <> 'P') s FULL JOIN
  (SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate END AS m, CASE WHEN o_orderpriority = '1-URGENT' THEN 5 ELSE 6 END AS f
   FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01') t USING (o_orderkey)
""")
def q_incremental(spark, sf_dir):
    """S3: orders as sources against an older slice of themselves."""
    o = table(spark, sf_dir, "orders")
    sources = o.filter("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_orderdate").alias("mtime"))
    older = F.when(F.col("o_totalprice") > 250000, F.col("o_orderdate") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("o_orderdate"))
    stored = o.filter("o_orderdate < timestamp_ntz '1999-01-01'").select(
        "o_orderkey", older.alias("mtime"), F.when(F.col("o_orderpriority") == "1-URGENT", 5).otherwise(6).alias("format"))
    return S.plan_ingest(sources, stored, ["o_orderkey"], S.FORMATS["knowledge"])


@q("SELECT o_custkey, bool_or(o_totalprice > 400000) AS changed FROM orders GROUP BY o_custkey")
def q_set_changed(spark, sf_dir):
    """Customers any of whose orders was touched since."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"), "o_totalprice")
    stamps = o.withColumn("mtime", F.when(F.col("o_totalprice") > 400000, F.col("mtime") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("mtime")))
    return S.set_changed(o, stamps, ["o_custkey"])


@q("""
SELECT conv_id AS sheet_id, bool_and(role <> 'system') AS valid FROM conversations GROUP BY conv_id
""")
def q_valid_plans(spark, sf_dir):
    """A plan made before system turns existed is valid where there are none."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sheet_id"), F.col("turn").alias("pos"), F.col("turn").alias("number"), "text", "role")
    then = J.fingerprint(turns.filter("role <> 'system'")).withColumn("format", F.lit(2))
    now = J.fingerprint(turns)
    ok = J.valid_plans(then, now, S.FORMATS["plan"]).select("sheet_id", F.lit(True).alias("ok"))
    return now.join(ok, "sheet_id", "left").select("sheet_id", F.coalesce("ok", F.lit(False)).alias("valid"))


@q("""
WITH u AS (SELECT l_suppkey, l_orderkey, l_partkey AS tokens, CASE WHEN l_discount > 0 THEN CAST(l_quantity AS DOUBLE) END AS cost FROM lineitem),
p AS (SELECT l_suppkey, l_orderkey, count(*) AS n, sum(tokens) AS t, sum(coalesce(cost, tokens * 0.5)) AS c, sum(CASE WHEN cost IS NULL THEN tokens * 0.5 ELSE 0 END) AS e, bool_or(cost IS NULL) AS g FROM u GROUP BY ALL)
SELECT l_suppkey, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(t) AS BIGINT) AS input_tokens, CAST(sum(c) AS DOUBLE) AS cost, CAST(sum(e) AS DOUBLE) AS estimated,
  CAST(arg_max(c, l_orderkey) AS DOUBLE) AS last_cost, arg_max(g, l_orderkey) AS last_estimated FROM p GROUP BY l_suppkey
""")
def q_usage(spark, sf_dir):
    """Order lines as requests of a supplier; without a discount the cost is estimated."""
    u = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_orderkey", F.col("l_partkey").alias("input_tokens"), F.when(F.col("l_discount") > 0, F.col("l_quantity")).alias("cost"))
    return J.usage_totals(u, ["l_suppkey"], 0.5, "l_orderkey")


@q(f"""WITH {SHEETS} SELECT c_custkey AS course, c_name AS name, count(sheet_id) AS sheets, count(sheet_id) > 0 AS has_notes FROM customer LEFT JOIN sheets ON course = c_custkey GROUP BY ALL""")
def q_course_listing(spark, sf_dir):
    """Courses with their sheets."""
    sheets, tasks = _sheets(spark, sf_dir)
    courses = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("course"), F.col("c_name").alias("name"))
    return J.course_listing(courses, sheets, sheets)


@q(f"""WITH {SHEETS}, t AS (SELECT sheet_id, count(*) AS tasks, bool_or(label = 'R') AS planned FROM tasks GROUP BY ALL)
SELECT s.course, s.sheet_id, coalesce(tasks, 0) AS tasks, last.sheet_id IS NOT NULL AS newest, coalesce(planned, false) AS planned
FROM sheets s LEFT JOIN t USING (sheet_id) LEFT JOIN last ON last.course = s.course AND last.sheet_id = s.sheet_id""")
def q_sheet_listing(spark, sf_dir):
    """Sheets with their tasks, the newest marked."""
    sheets, tasks = _sheets(spark, sf_dir)
    return J.sheet_listing(sheets, tasks, tasks.filter("label = 'R'")).select("course", "sheet_id", "tasks", "newest", "planned")


@q("""
WITH t AS (SELECT l_orderkey AS sheet_id, l_linenumber AS task, max(CAST(l_tax * 100 AS INTEGER)) * 0.5 AS effort FROM lineitem GROUP BY ALL),
k AS (SELECT l_orderkey AS sheet_id, l_linenumber AS task, count(*) FILTER (WHERE l_returnflag = 'A') AS proofs, count(*) FILTER (WHERE l_returnflag = 'R') AS earlier,
  count(*) FILTER (WHERE l_linestatus = 'O') AS statements FROM lineitem GROUP BY ALL)
SELECT sheet_id, task, CAST(1 + 3 * least(effort, 3) AS DOUBLE) AS effort, ['routine', 'short', 'medium', 'hard'][CAST(round_even(least(effort, 3), 0) AS INTEGER) + 1] AS word, statements, proofs, earlier FROM t JOIN k USING (sheet_id, task)
""")
def q_plan_summary(spark, sf_dir):
    """Effort and contents of every planned task."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sheet_id"), F.col("l_linenumber").alias("task"), "l_tax", "l_returnflag", "l_linestatus", F.col("l_partkey").alias("id"))
    plan = li.groupBy("sheet_id", "task").agg((F.max(F.round(F.col("l_tax") * 100).cast("int")) * 0.5).alias("effort"))
    kind = F.when(F.col("l_returnflag") == "A", "proof").when(F.col("l_returnflag") == "R", "earlier").otherwise("statement")
    return J.plan_summary(plan, li.withColumn("kind", kind), li.filter("l_linestatus = 'O'"))


@q("""
WITH r AS (SELECT p_partkey, p_type AS course, p_brand AS category, 'f' || p_partkey AS path, p_name AS name FROM part),
f AS (SELECT course, category, path, name, p_partkey FROM r WHERE CAST(p_partkey AS INTEGER) % 2 = 0),
m AS (SELECT course, category, arg_max(path, (p_partkey // 10, path)) AS newest FROM f GROUP BY ALL),
n AS (SELECT course, category, name, min(path) AS named FROM f GROUP BY ALL)
SELECT p_partkey, CASE WHEN CAST(p_partkey AS INTEGER) % 2 = 0 THEN path ELSE coalesce(named, newest) END AS found FROM r LEFT JOIN n USING (course, category, name) LEFT JOIN m USING (course, category)
""")
def q_locate_files(spark, sf_dir):
    """Every other part still has its file; the rest are found by name, else the newest."""
    r = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_type").alias("course"), F.col("p_brand").alias("category"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"),
        F.col("p_name").alias("name"), F.floor(F.col("p_partkey") / 10).alias("mtime"))
    f = r.filter("p_partkey % 2 = 0").drop("p_partkey")
    return J.locate_files(r.drop("mtime"), f, f).select("p_partkey", "found")


@q("""SELECT o_orderkey, coalesce(o_orderstatus <> 'P' AND o_totalprice > 200000, false) AS stale FROM orders""")
def q_stale(spark, sf_dir):
    """Results whose file changed since."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"), "o_totalprice", "o_orderstatus")
    later = F.when(F.col("o_totalprice") > 200000, F.col("mtime") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("mtime"))
    return J.stale(o, o.filter("o_orderstatus <> 'P'").select("path", later.alias("mtime"))).select("o_orderkey", "stale")


@q("""SELECT o_orderkey, o_orderstatus = 'F' AS active FROM orders""")
def q_active_past(spark, sf_dir):
    """Rows of the active semester and of the others."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("semester"))
    return J.active(o, "F").select("o_orderkey", F.lit(True).alias("active")).union(J.past(o, "F").select("o_orderkey", F.lit(False)))


# Graphs: nations are tasks; an edge leads from the supplier's to the customer's nation.
EDGES = """
e AS (SELECT s_nationkey AS a, c_nationkey AS b, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
"""


def _edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@q(f"""WITH RECURSIVE {EDGES}, f AS (SELECT a, arg_max(b, (n, b)) AS b FROM e WHERE a <> b GROUP BY a),
r AS (SELECT DISTINCT a AS source, a AS node FROM e UNION SELECT r.source, f.b FROM r JOIN f ON f.a = r.node)
SELECT a, b, EXISTS (SELECT 1 FROM r WHERE source = e.b AND node = e.a) AS reached FROM e""")
def q_reach(spark, sf_dir):
    """For every edge whether its end reaches its beginning along the busiest edges out of each nation."""
    e = _edges(spark, sf_dir).withColumn("k", F.lit(1))
    busiest = e.filter("a <> b").groupBy("k", "a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    asked = e.select("k", F.col("b").alias("source"), F.col("a").alias("target"))
    return G.reaches(busiest, asked, ["k"]).select(F.col("target").alias("a"), F.col("source").alias("b"), "reached")


# Pairs are kept one after the other; ``c`` holds all (x, y) with a way from x to y, as x * 100 + y.
@q(f"""WITH RECURSIVE {EDGES},
o AS (SELECT n_regionkey AS region, a, b, n, row_number() OVER (PARTITION BY n_regionkey ORDER BY n DESC, a * 100 + b) AS i FROM e JOIN nation ON n_nationkey = a WHERE a <> b),
r AS (SELECT region, 0::BIGINT AS i, []::BIGINT[] AS c, 0 AS a, 0 AS b, 0::BIGINT AS n, false AS kept FROM (SELECT DISTINCT region FROM o)
 UNION ALL SELECT region, i, CASE WHEN kept THEN list_distinct(list_concat(c, flatten(list_transform(list_concat([a], list_transform(list_filter(c, lambda x: x % 100 = a), lambda x: x // 100)),
     lambda x: list_transform(list_concat([b], list_transform(list_filter(c, lambda y: y // 100 = b), lambda y: y % 100)), lambda y: x * 100 + y))))) ELSE c END, a, b, n, kept
   FROM (SELECT r.region, o.i, r.c, o.a, o.b, o.n, NOT list_contains(r.c, o.b * 100 + o.a) AS kept FROM r JOIN o ON o.region = r.region AND o.i = r.i + 1))
SELECT region, a, b, CAST(n AS DOUBLE) AS p FROM r WHERE kept""")
def q_acyclic(spark, sf_dir):
    """G1: per region the edges out of its nations, most frequent first, without cycles."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("region"))
    e = _edges(spark, sf_dir).join(nation, "a").filter("a <> b").select(
        "region", "a", "b", F.col("n").cast("double").alias("p"), (F.col("a") * 100 + F.col("b")).alias("ord"))
    return G.acyclic_edges(e, ["region"], 1.0).select("region", "a", "b", "p")


@q(f"""WITH {EDGES}, f AS (SELECT DISTINCT a, b FROM e)
SELECT b AS task, b || ' builds on ' || string_agg(CAST(a AS VARCHAR), ', ' ORDER BY a) AS text FROM f GROUP BY b""")
def q_after(spark, sf_dir):
    """What each nation builds on."""
    e = _edges(spark, sf_dir).withColumn("k", F.lit(1))
    return G.after(e, ["k"]).select("task", "text")


@q("""SELECT l_orderkey, string_agg(DISTINCT pair, ', ' ORDER BY pair) AS text FROM (
  SELECT l_orderkey, lpad(CAST(l_linenumber AS VARCHAR), 2, ' ') || ' → ' || lpad(CAST(l_suppkey % 10 AS VARCHAR), 2, ' ') AS pair FROM lineitem) GROUP BY l_orderkey""")
def q_dependency_text(spark, sf_dir):
    """The edges of every order as one line."""
    two = lambda c: F.lpad(c.cast("string"), 2, " ")
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", two(F.col("l_linenumber")).alias("a"), two(F.col("l_suppkey") % 10).alias("b"))
    return G.dependency_text(e, ["l_orderkey"])


@q("""SELECT o_orderkey AS l_orderkey, coalesce(text, 'no dependencies') AS text FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT pair, ', ' ORDER BY pair) AS text FROM (
  SELECT l_orderkey, lpad(CAST(l_linenumber AS VARCHAR), 2, ' ') || ' → ' || lpad(CAST(l_suppkey % 10 AS VARCHAR), 2, ' ') AS pair FROM lineitem WHERE l_quantity > 40) GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def q_dependencies_or_none(spark, sf_dir):
    """The large lines of every order as edges, and the orders that have none."""
    two = lambda c: F.lpad(c.cast("string"), 2, " ")
    e = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select("l_orderkey", two(F.col("l_linenumber")).alias("a"), two(F.col("l_suppkey") % 10).alias("b"))
    return G.dependency_text(e, ["l_orderkey"], sheets=table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")))


@q("SELECT o_custkey, count(*) AS tasks, count(*) * (count(*) - 1) AS pairs FROM orders GROUP BY o_custkey")
def q_question_load(spark, sf_dir):
    """How many ordered pairs a sheet asks about, without forming them."""
    return G.question_load(table(spark, sf_dir, "orders"), ["o_custkey"])


@q("""
WITH s AS (SELECT source, labels.doc_id IS NOT NULL AND quality = 1 AS placed, coalesce(quality, -1) AS section, lang, text, n_chars FROM documents LEFT JOIN labels USING (doc_id)),
g AS (SELECT source, count(*) AS entries, count(*) FILTER (WHERE lang <> 'es') AS statements, count(*) FILTER (WHERE section >= 0) AS pl, count(*) FILTER (WHERE n_chars > 1000) AS proofs,
   count(*) FILTER (WHERE lang <> 'es' AND regexp_matches(text, '(?m)^(?:Beweis|Proof)(?:\\s+(?:von|of)\\s+\\w+\\s+[\\d.]+)?\\s*[.:]')) AS leaks FROM s GROUP BY source),
b AS (SELECT source, count(*) AS used, max(n) AS biggest FROM (SELECT source, section, count(*) FILTER (WHERE lang <> 'es') AS n FROM s WHERE section >= 0 GROUP BY ALL) WHERE n > 0 GROUP BY source)
SELECT source, entries, statements, 2 AS sections, coalesce(used, 0) AS used, 100 * pl // greatest(1, entries) AS placed_pct, proofs, coalesce(biggest, 0) AS biggest, leaks FROM g LEFT JOIN b USING (source)
""".replace("2 AS sections", "CAST(2 AS BIGINT) AS sections"))
def q_health(spark, sf_dir):
    """Per source the labelled documents as placed entries."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    kinds = F.when(F.col("lang") == "en", "Definition").when(F.col("lang") == "de", "Satz").when(F.col("lang") == "fr", "Lemma").otherwise("Bemerkung")
    entries = d.select("source", kinds.alias("type"), F.col("quality").cast("string").alias("section"), "text",
                       F.when(F.col("n_chars") > 1000, "proof").alias("proof"))
    nodes = d.select("source").distinct().select("source", F.explode(F.array(F.lit(0), F.lit(1))).alias("key"))
    return R.health_report(entries, nodes, ["source"])


@q("""SELECT source, CASE lang WHEN 'en' THEN 'Definition' WHEN 'de' THEN 'Satz' ELSE 'Lemma' END AS type, count(*) AS n FROM documents WHERE lang <> 'es' GROUP BY ALL""")
def q_type_histogram(spark, sf_dir):
    """Statements by type."""
    kinds = F.when(F.col("lang") == "en", "Definition").when(F.col("lang") == "de", "Satz").when(F.col("lang") == "fr", "Lemma").otherwise("Bemerkung")
    return R.type_histogram(table(spark, sf_dir, "documents").select("source", kinds.alias("type")), ["source"])


@q("""
WITH t AS (SELECT o_orderstatus, o_orderkey, o_orderpriority[1] AS chapter, o_totalprice AS seconds FROM orders),
e AS (SELECT o_orderstatus, o_orderkey, seconds, count(l_orderkey) AS n, count(*) FILTER (WHERE CAST(l_linenumber AS VARCHAR) = chapter) AS mine FROM t LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_orderstatus, round(avg(n), 6) AS avg_picks, round(100 * avg(CASE WHEN n > 0 THEN mine / n ELSE 0 END), 6) AS own_pct, count(*) FILTER (WHERE n = 0) AS empty, max(seconds) AS max_seconds,
  list_sort(list(seconds))[len(list(seconds)) // 2 + 1] AS median_seconds FROM e GROUP BY o_orderstatus
""")
def q_pick_report(spark, sf_dir):
    """Lines as picks of an order, its priority as chapter, its price as time."""
    tasks = table(spark, sf_dir, "orders").select(
        "o_orderstatus", F.col("o_orderkey").alias("task_ref"), F.substring("o_orderpriority", 1, 1).alias("section"), F.col("o_totalprice").alias("seconds"))
    picks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_ref"), F.concat(F.col("l_linenumber").cast("string"), F.lit(".1")).alias("section"))
    r = R.pick_report(picks, tasks, ["o_orderstatus"])
    return r.select("o_orderstatus", F.round("avg_picks", 6).alias("avg_picks"), F.round("own_pct", 6).alias("own_pct"), "empty", "max_seconds", "median_seconds")


@q("""
SELECT p_type AS course, p_partkey, p_type || ': ' || p_name || ' ' || p_partkey AS id, CASE WHEN p_size > 40 THEN 'Z' || (p_size % 3 + 1) ELSE 'Z' || (p_size % 3 + 1) || '.' || p_size END AS section, p_size AS page FROM part
""")
def q_merge_sources(spark, sf_dir):
    """Parts as entries of three other scripts per course."""
    p = table(spark, sf_dir, "part")
    doc = F.concat_ws("/", "p_type", (F.col("p_size") % 3).cast("string"))
    entries = p.select(doc.alias("doc_id"), F.col("p_partkey").alias("pos"), F.lit(None).cast("string").alias("id"), F.col("p_name").alias("type"),
                       F.col("p_partkey").cast("string").alias("number"), F.col("p_brand").alias("name"), F.col("p_size").alias("page"), F.col("p_name").alias("text"),
                       F.lit(None).cast("string").alias("proof"), F.when(F.col("p_size") <= 40, F.col("p_size").cast("string")).alias("section"))
    sources = p.select(F.col("p_type").alias("course"), (F.col("p_size") % 3 + 1).alias("i"), doc.alias("doc_id"), F.col("p_type").alias("name"), F.lit("x.pdf").alias("pdf")).distinct()
    nodes = entries.filter("section is not null").select("doc_id", F.col("section").alias("key"), F.lit(1).alias("level"), F.col("section").alias("title"), "page").distinct()
    merged, _ = S.merge_sources(entries, nodes, sources)
    return merged.select("course", F.col("pos").alias("p_partkey"), "id", "section", "page")


@q("""
SELECT 'n' || n_nationkey AS id, CAST(NULL AS VARCHAR) AS pdf, 0 AS ord FROM nation UNION ALL SELECT 's' || s_suppkey, 'deck', 1 FROM supplier UNION ALL SELECT 'c' || c_custkey, 'extra', 2 FROM customer
""")
def q_load_entries(spark, sf_dir):
    """Script, slides and other scripts as one table."""
    key = lambda t, c, prefix: table(spark, sf_dir, t).select(F.concat(F.lit(prefix), F.col(c).cast("string")).alias("id"))
    return S.load_entries(key("nation", "n_nationkey", "n"), key("supplier", "s_suppkey", "s").withColumn("pdf", F.lit("deck")),
                          key("customer", "c_custkey", "c").withColumn("pdf", F.lit("extra")))


@q("""SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1""")
def q_stream_ingest(spark, sf_dir):
    """The events arrive as files of a stream; the latest row per user is read back."""
    root = os.path.join(staging_dir(spark), f"stream-{uuid.uuid4().hex}")
    events = table(spark, sf_dir, "events")
    incoming = events.select("user_id", "event_id", "event_type", "value", F.col("ts").alias("mtime"), F.lit(1).alias("format"))
    incoming.repartition(6, "event_id").write.parquet(f"{root}/in")
    run = I.stream_ingest(spark, incoming.schema, f"{root}/in", f"{root}/out", f"{root}/state", max_files=2)
    run.awaitTermination()
    return I.read_latest(spark, f"{root}/out", ["user_id"]).select("user_id", "event_id", "event_type", "value")


@q("""WITH v AS (SELECT user_id, event_id, value, ts, CASE WHEN event_id % 7 > 0 THEN event_id % 3 END AS format, event_type = 'purchase' AS gone FROM events),
d AS (SELECT user_id, max(ts) AS gone_at FROM v WHERE gone GROUP BY user_id)
SELECT user_id, event_id, value FROM v LEFT JOIN d USING (user_id) WHERE NOT gone AND (gone_at IS NULL OR ts > gone_at)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY coalesce(format, -1) DESC, ts DESC) = 1""")
def q_stream_deletions(spark, sf_dir):
    """Purchases delete their user, whatever the formats of the rows; layers are merged on the way."""
    root = os.path.join(staging_dir(spark), f"stream-{uuid.uuid4().hex}")
    e = table(spark, sf_dir, "events")
    fmt = F.when(F.col("event_id") % 7 > 0, (F.col("event_id") % 3).cast("int"))
    incoming = e.select("user_id", "event_id", "value", F.col("ts").alias("mtime"), fmt.alias("format"), (F.col("event_type") == "purchase").alias("gone"))
    incoming.repartition(7, "event_id").write.parquet(f"{root}/in")
    I.stream_ingest(spark, incoming.schema, f"{root}/in", f"{root}/out", f"{root}/state", max_files=1, keys=["user_id"], compact_after=3).awaitTermination()
    return I.read_latest(spark, f"{root}/out", ["user_id"]).select("user_id", "event_id", "value")


@q("""SELECT s.course, 'statement' AS kind, id AS item FROM (SELECT o_custkey AS course, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS sheet FROM orders GROUP BY o_custkey) s
JOIN (SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS id FROM lineitem) l ON l_orderkey = sheet WHERE l_linenumber = 1""")
def q_selection_lookup(spark, sf_dir):
    """The selection kept for the task every course stands on."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    state = J.latest_by(o, ["o_custkey"], F.struct("o_orderdate", "o_orderkey")).select(
        F.col("o_custkey").alias("course"), F.col("o_orderkey").alias("sheet_id"), F.lit(1).alias("task"))
    planned = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet_id"), F.col("l_linenumber").alias("task"), F.lit("statement").alias("kind"),
                                                      F.col("l_partkey").cast("string").alias("item")).distinct()
    return J.selection_for_task(state, planned)


@q("""
WITH s AS (SELECT o_custkey AS course, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS sheet_id FROM orders GROUP BY o_custkey),
p AS (SELECT DISTINCT l_orderkey AS sheet_id, l_linenumber AS task, 'statement' AS kind, CAST(l_partkey AS VARCHAR) AS item FROM lineitem),
h AS (SELECT DISTINCT s.course, s.sheet_id FROM s JOIN p USING (sheet_id) WHERE task = 1)
SELECT p.* FROM p LEFT JOIN (SELECT DISTINCT sheet_id AS gone FROM h) g ON task = 1 AND sheet_id = gone WHERE gone IS NULL UNION ALL SELECT sheet_id, 1, 'section', CAST(course AS VARCHAR) FROM h
""")
def q_remember_selection(spark, sf_dir):
    """The edited selection of the current task replaces the planned one."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    state = J.latest_by(o, ["o_custkey"], F.struct("o_orderdate", "o_orderkey")).select(
        F.col("o_custkey").alias("course"), F.col("o_orderkey").alias("sheet_id"), F.lit(1).alias("task"))
    planned = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet_id"), F.col("l_linenumber").alias("task"), F.lit("statement").alias("kind"),
                                                      F.col("l_partkey").cast("string").alias("item")).distinct()
    edited = state.select("course", F.lit("section").alias("kind"), F.col("course").cast("string").alias("item"))
    return J.remember_selection(planned, state, edited)
