"""Task sheets, exercises, fonts, slide headings, stored tables, rule files and the stream by batch rules."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import predicates as P, text as X
from ..operators import exercises as E, headers as H, lookup as J, slides as L, tasks as T
from ..session import staging_dir
from ..sources import files as S, store as W
from ..streaming.ingest import read_latest, stream_ingest
from . import REGISTRY, table

q = REGISTRY.query


@q(r"""
WITH d AS (SELECT doc_id, doc_id % 3 = 1 AS footed, doc_id % 2 = 0 AS numbered,
  CASE WHEN doc_id % 3 = 1 THEN text || chr(10) || '  end' ELSE text END || CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '' END AS kept FROM documents)
SELECT doc_id, kept AS text FROM d
""")
def q_page_marks(spark, sf_dir):
    """Documents as pages with a footer in some and their own number under others; both go."""
    footed = F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("\n Seite  3 von 12 \n  end"))).otherwise(F.col("text"))
    page = F.when(F.col("doc_id") % 2 == 0, F.concat(footed, F.lit("\n "), F.col("doc_id").cast("string"), F.lit(" \n"))).otherwise(footed)
    rows = table(spark, sf_dir, "documents").select("doc_id", page.alias("text"))
    return rows.select("doc_id", X.strip_footer(X.drop_page_number(F.col("text"), F.col("doc_id"))).alias("text"))


@q(r"""
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'CMR10' WHEN 1 THEN 'CMBX10' WHEN 2 THEN 'SFTI1000-Italic' WHEN 3 THEN 'CMCSC10' END AS font,
  p_size % 5 IN (1, 2, 3) OR (p_size & 18) <> 0 AS styled FROM part
""")
def q_styled(spark, sf_dir):
    """Fonts by name or by the bold and italic bits."""
    kind = F.col("p_size") % 5
    font = F.when(kind == 0, "CMR10").when(kind == 1, "CMBX10").when(kind == 2, "SFTI1000-Italic").when(kind == 3, "CMCSC10")
    return table(spark, sf_dir, "part").select("p_partkey", font.alias("font"), P.is_styled(font, F.col("p_size")).alias("styled"))


@q(r"""
WITH d AS (SELECT doc_id, n_chars, regexp_extract(text, '^[^\n]*') AS head FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars % 40 AS INTEGER) ELSE CAST(doc_id % 100 AS INTEGER) END AS sheet_number,
  CASE WHEN doc_id % 2 = 0 THEN (doc_id % 28 + 1) || '. Mai' END AS discussion_date FROM d
""")
def q_sheet_records(spark, sf_dir):
    """Number and date of discussion of sheets that begin with them."""
    number = F.when(F.col("doc_id") % 3 == 0, F.concat((F.col("n_chars") % 40).cast("string"), F.lit(". Übungsblatt\n"))).otherwise("")
    date = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("(Besprechung am:  "), (F.col("doc_id") % 28 + 1).cast("string"), F.lit(". Mai )\n"))).otherwise("")
    sheets = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("sheet_id"), F.concat(F.lit("sheet"), (F.col("doc_id") % 100).cast("string")).alias("stem"),
        F.concat(number, date, "text").alias("text"))
    return T.sheet_records(sheets).withColumnRenamed("sheet_id", "doc_id")


@q(r"""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN (doc_id % 9) || '.' || (n_chars % 30) ELSE '' END AS refs,
  CASE doc_id % 4 WHEN 0 THEN 'Exercise ' || (doc_id % 9) || '.' || (n_chars % 30) || '.' ELSE source || ' says' END AS text FROM documents
""")
def q_lone_refs(spark, sf_dir):
    """Bodies whose first line is only a reference end at the next run-in heading."""
    lone = F.concat(F.lit("Exercise "), (F.col("doc_id") % 9).cast("string"), F.lit("."), (F.col("n_chars") % 30).cast("string"), F.lit("."))
    body = F.when(F.col("doc_id") % 4 == 0, F.concat(lone, F.lit("\nHint. "), "text")).otherwise(F.concat("source", F.lit(" says")))
    return table(spark, sf_dir, "documents").select("doc_id", X.lone_ref(body).alias("r")).select(
        "doc_id", F.array_join("r.refs", ",").alias("refs"), "r.text")


@q(r"""
WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS u, text FROM conversations),
l AS (SELECT conv_id, turn, list_filter(u, lambda x, i: true) AS u, list_sort(u) AS s FROM t WHERE len(u) > 0)
SELECT conv_id AS doc_id, turn AS page, array_to_string(CASE WHEN len(s) > 1 AND turn % 2 = 1 THEN list_concat([s[-1]], s[1:-2]) ELSE s END, chr(10)) AS text FROM l
""")
def q_heading_first(spark, sf_dir):
    """Lines of a turn as a slide; where the last one stands above the others, it is the heading and goes first."""
    lines = F.array_sort(F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.btrim(x) != "")))
    slides = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), lines.alias("lines")).filter(
        F.size("lines") > 0)
    last = F.element_at("lines", -1)
    top = F.when(F.col("page") % 2 == 1, F.lit(1.0)).otherwise(F.lit(90.0))
    tops = F.map_from_entries(F.transform("lines", lambda x, i: F.struct(x, F.when(x == last, top).otherwise(10.0 + i))))
    heads = slides.select("doc_id", "page", last.alias("head"), tops.alias("tops"))
    return L.heading_first(slides, heads).select("doc_id", "page", F.array_join("lines", "\n").alias("text"))


EXERCISE_TITLE = E.TITLE.replace(r"\A", "^").replace("'", "''")


@q(rf"""
WITH b AS (SELECT doc_id, trim(regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g'), chr(10) || ' ') AS body FROM documents),
c AS (SELECT doc_id, body, regexp_extract(body, '{EXERCISE_TITLE}', 1) AS title FROM b)
SELECT doc_id, '1' AS number, nullif(regexp_replace(trim(title), '\s+', ' ', 'g'), '') AS title, CASE WHEN title <> '' THEN trim(substr(body, length(title) + 2), chr(10) || ' ') ELSE body END AS text, doc_id % 5 + 1 AS page FROM c
UNION ALL SELECT doc_id, '2', NULL, 'Show it.', doc_id % 5 + 1 FROM c
""")
def q_exercises(spark, sf_dir):
    """Two exercises in the exercise section of every document, under a running head and over a page
    number; a definition after the first one ends it, a number out of order opens nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 5 + 1).alias("page"))
    page = F.concat(F.lit("12\nExercises\n\nAufgabe\n 1. "), "text", F.lit("\n7.4 Definition. A set.\nAufgabe 2. Show it.\n\nxiv\n"))
    pages = docs.select("doc_id", "page", page.alias("text"))
    nodes = docs.select("doc_id", F.lit(0).alias("seq"), F.lit("1").alias("key"), F.lit("Exercises").alias("title"), F.lit(1).alias("level"), "page")
    return E.extract_exercises(pages, nodes).select("doc_id", "number", "title", "text", F.col("page").cast("bigint").alias("page"))


@q(r"""
WITH ex AS (SELECT p_brand AS course, CAST(p_size AS VARCHAR) AS number, arg_min(p_type, p_partkey) AS title, min(p_partkey) AS page FROM part GROUP BY ALL),
n AS (SELECT ex.course, ex.number, ex.title, ex.page, p_name AS text FROM ex JOIN part ON p_partkey = ex.page)
SELECT p.p_partkey AS sheet_id, '(' || n.number || ') ' || n.title AS title, p.p_name || chr(10) || chr(10) || '(' || n.number || ') ' || n.text AS text,
  CASE WHEN p.p_partkey % 3 > 0 THEN round(1 + 9 * (p.p_partkey % 4) / 3, 1) END AS effort, n.page AS page, 0 AS parts FROM part p
JOIN n ON n.course = p.p_brand AND n.number = CAST(p.p_size AS VARCHAR)
""")
def q_task_listing(spark, sf_dir):
    """Parts as tasks that point at the first part of their brand and size."""
    part = table(spark, sf_dir, "part")
    tasks = part.select(F.col("p_brand").alias("course"), F.col("p_partkey").alias("sheet_id"), F.lit(1).alias("pos"), F.lit(1).alias("number"),
                        F.col("p_name").alias("text"), F.array(F.col("p_size").cast("string")).alias("script_references"))
    exercises = part.select(F.col("p_brand").alias("course"), F.col("p_partkey").alias("pos"), F.col("p_size").cast("string").alias("number"),
                            F.col("p_type").alias("title"), F.col("p_name").alias("text"), F.col("p_partkey").cast("int").alias("page"))
    efforts = part.filter("p_partkey % 3 > 0").select(F.col("p_partkey").alias("sheet_id"), F.lit(1).alias("number"), (F.col("p_partkey") % 4).cast("double").alias("effort"))
    after = part.select(F.col("p_partkey").alias("sheet_id"), F.lit(1).alias("task"), F.array(F.lit(0)).alias("after"))
    got = J.task_listing(tasks, J.resolve_refs(tasks, exercises), efforts, after)
    return got.select("sheet_id", "title", "text", "effort", F.col("page").cast("bigint").alias("page"), F.size("parts").alias("parts"))


@q("SELECT DISTINCT source, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def q_scan_files(spark, sf_dir):
    """The documents are laid out as a tree of files by source and language; the files are found by pattern, without their contents."""
    root = os.path.join(staging_dir(spark), f"tree-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents").filter("source is not null and lang is not null")
    docs.select("doc_id", "source", "lang").write.partitionBy("source", "lang").parquet(root)
    files = S.scan_files(spark, root, ["PART-*.Parquet"]).filter("length > 0")
    at = lambda part: F.regexp_extract("path", rf"/{part}=([^/]+)/", 1).alias(part)
    return files.select(at("source"), at("lang")).distinct()


@q("SELECT source AS course, doc_id, lang, CASE WHEN source = 'src3' THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents")
def q_store(spark, sf_dir):
    """Documents stored by source, one source replaced, all read back."""
    root = os.path.join(staging_dir(spark), f"store-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("course"), "doc_id", "lang", "n_chars")
    W.write_store(docs, root, "documents")
    W.write_store(docs.filter("course = 'src3'").withColumn("n_chars", F.col("n_chars") + 1), root, "documents")
    return W.read_store(spark, root, "documents").select(*docs.columns)


@q("""
SELECT r_name AS semester, n_name AS folder, CASE WHEN n_nationkey % 2 = 0 THEN 'The ' || n_name ELSE n_name END AS course, c AS category,
  CASE c WHEN 'skript' THEN n_name || '*.pdf' ELSE '*-' || n_nationkey || '.pdf' END AS pattern
FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT unnest(['skript', 'blaetter']) AS c) WHERE n_nationkey % 7 <> 3
""")
def q_rules_from_json(spark, sf_dir):
    """A rule file with the nations as courses of their region; courses with an unknown field are left out."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    spec = F.concat(
        F.lit('{"_note":"x","skript":'), quoted(F.concat("n_name", F.lit("*.pdf"))), F.lit(',"blaetter":['),
        quoted(F.concat(F.lit("*-"), F.col("n_nationkey").cast("string"), F.lit(".pdf"))), F.lit("]"),
        F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(',"name":'), quoted(F.concat(F.lit("The "), "n_name")))).otherwise(""),
        F.when(F.col("n_nationkey") % 7 == 3, ',"other":"y"').otherwise(""), F.lit("}"))
    folders = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat(quoted(F.col("n_name")), F.lit(":"), spec))), ",").alias("f"))
    config = folders.agg(F.concat(F.lit('{"semesters":{"_c":{},'), F.array_join(F.array_sort(F.collect_list(
        F.concat(quoted(F.col("r_name")), F.lit(":{"), F.col("f"), F.lit("}")))), ","), F.lit("}}")).alias("value"))
    rules, _, _ = S.rules_from_json(config)
    return rules.select("semester", "folder", "course", "category", "pattern")


# Three deliveries: all suppliers; a third of them newer, a fifth in a newer format; a fourth gone.
@q("""
SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS mtime, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 20 WHEN s_suppkey % 5 = 0 THEN 30 ELSE 10 END AS BIGINT) AS value
FROM supplier WHERE s_suppkey % 4 <> 1
""")
def q_stream_policy(spark, sf_dir):
    """The rules of a batch ingest on a stream: newer files and formats are taken, what is gone is deleted."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")

    def delivery(mtime: int, fmt: int, value: int, gone: bool = False):
        return s.select("s_suppkey", F.lit(mtime).cast("bigint").alias("mtime"), F.lit(fmt).alias("format"), F.lit(value).cast("bigint").alias("value"), F.lit(gone).alias("gone"))

    root = os.path.join(staging_dir(spark), f"stream-{uuid.uuid4().hex}")
    steps = [delivery(1, 1, 10), delivery(2, 1, 20).filter("s_suppkey % 3 = 0").union(delivery(1, 2, 30).filter("s_suppkey % 5 = 0 and s_suppkey % 3 > 0")).union(
        delivery(0, 1, 99).filter("s_suppkey % 3 = 1")), delivery(3, 2, 0, True).filter("s_suppkey % 4 = 1")]
    for i, step in enumerate(steps):
        step.write.parquet(f"{root}/in/{i}")
        stream_ingest(spark, step.schema, f"{root}/in/*", f"{root}/out", f"{root}/state").awaitTermination()
    return read_latest(spark, f"{root}/out", ["s_suppkey"]).select("s_suppkey", "mtime", "value")


@q(r"""
WITH c AS (SELECT doc_id, source, text FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id AS id, 'chosen' AS part FROM c WHERE strpos(lower(doc_id || ' ' || source || ' ' || text), 'license') > 0
UNION ALL SELECT item_id, 'earlier' FROM benchmark WHERE strpos(lower(item_id || '  ' || text), 'license') > 0 OR item_id % 2 = 0
""")
def q_search_chosen(spark, sf_dir):
    """Search among what is chosen, and in the earlier tasks beside it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), "text")
    earlier = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("id"), F.lit(None).cast("string").alias("name"),
        F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("License: "), "text")).otherwise(F.col("text")).alias("text"))
    return P.search(docs, F.lit(" LICENSE "), docs.filter("id % 3 = 0").select("id"), earlier).select("id", "part")


@q(r"""
WITH c AS (SELECT doc_id, source, text FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id AS id, 'chosen' AS part FROM c WHERE strpos(lower(doc_id || ' ' || source || ' ' || text), 'the') > 0
UNION ALL SELECT item_id, 'earlier' FROM benchmark WHERE item_id % 2 = 1 AND strpos(lower(item_id || '  ' || text), 'the') > 0
""")
def q_search_chosen_earlier(spark, sf_dir):
    """Search among what is chosen, of the earlier tasks as well."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), "text")
    earlier = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit(None).cast("string").alias("name"), "text")
    return P.search(docs, F.lit("The"), docs.filter("id % 3 = 0").select("id"), earlier, earlier.filter("id % 2 = 1").select("id")).select("id", "part")


@q(r"""
WITH h AS (SELECT doc_id, unnest([
  {'n': 0, 'kind': 'numbered', 'type': 'Satz', 'number': '1.' || (doc_id % 50), 'name': 'A' || chr(10) || 'Lemma 2.1 b', 'ref': NULL},
  {'n': 4, 'kind': 'numbered', 'type': 'Proposition', 'number': '3.4', 'name': NULL, 'ref': NULL},
  {'n': 5, 'kind': 'proof', 'type': 'Beweis', 'number': NULL, 'name': NULL, 'ref': 'Satz 1.2'},
  {'n': 6, 'kind': 'numbered', 'type': 'Exercise', 'number': '3.5', 'name': NULL, 'ref': NULL},
  {'n': 6, 'kind': 'boundary', 'type': NULL, 'number': NULL, 'name': NULL, 'ref': NULL},
  {'n': 7, 'kind': 'boundary', 'type': NULL, 'number': NULL, 'name': NULL, 'ref': NULL}]) AS h FROM documents)
SELECT doc_id, h.n AS line_no, h.kind, h.type, h.number, h.name, h.ref FROM h
""")
def q_header_families(spark, sf_dir):
    """Headers of all five forms above the text of every document, one wrapped around a blank line and holding another."""
    top = F.concat(F.lit("Satz\n\n1."), (F.col("doc_id") % 50).cast("string"), F.lit(
        " (A\nLemma 2.1 b). body\n3.4 Proposition. p\nBeweis von Satz 1.2. c\n3.5 Exercise. d\nLiteratur\n"))
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), F.concat(top, "text").alias("text"))
    return H.header_candidates(pages).select("doc_id", "line_no", "kind", "type", "number", "name", "ref")
