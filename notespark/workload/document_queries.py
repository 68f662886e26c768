"""Assembled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import choose as C, lookup as J
from ..plans import assemble as A
from . import REGISTRY, table
from .choose_queries import ENTRIES, entries, selection

q = REGISTRY.query


@q("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY ALL""")
def q_document_assembly(spark, sf_dir):
    """B1: one text per conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(": ", "role", "text").alias("text"))
    return A.assemble(turns, ["conv_id"], ["turn"])


HEAD_SQL = A.HEAD.replace("{what}", A.WHOLE_TASK).replace("'", "''")
RULES_SQL = " || ".join("chr(10) || '- " + r.replace("'", "''") + "'" for r in A.RULES)
TAIL_SQL = " || ".join("chr(10) || '- " + r.replace("'", "''") + "'" for r in A.TAIL)


def _rule(text: str) -> str:
    return "chr(10) || '- " + text.replace("'", "''") + "'"


DOCS = f"""
base AS (SELECT *, row_number() OVER (PARTITION BY course ORDER BY CAST(split_part(section, '.', 1) AS INTEGER), page, pos) AS place,
   course = 'PROMO' AS every, course = 'PROMO' OR page BETWEEN 10 AND 11 AS proof_on FROM ch),
secs AS (SELECT course, item FROM sel WHERE kind = 'section'),
mk AS (SELECT base.*, EXISTS (SELECT 1 FROM secs WHERE secs.course = base.course AND (section = item OR starts_with(section, item || '.'))) AS inside FROM base),
nm AS (SELECT secs.course, string_agg(item || ' Brand ' || item, ', ' ORDER BY CAST(item AS INTEGER)) AS named FROM secs
   WHERE EXISTS (SELECT 1 FROM base WHERE base.course = secs.course AND (section = item OR starts_with(section, item || '.'))) GROUP BY secs.course),
fa AS (SELECT course, coalesce(string_agg(id, ', ' ORDER BY place) FILTER (WHERE NOT inside), '') AS singles,
   coalesce(string_agg(id, ', ' ORDER BY place) FILTER (WHERE proof IS NOT NULL AND proof_on AND NOT every), '') AS proofs,
   bool_or(type = 'Slide') AS any_slide, bool_and(type = 'Slide') AS all_slides, bool_or(type = 'Algorithmus') AS algorithms, bool_or(every) AS every,
   bool_or(type = 'Definition') AS definitions, bool_or(type NOT IN ('Definition', 'Slide')) AS results FROM mk GROUP BY course),
hd AS (SELECT course, '# From the lecture ' || CASE WHEN all_slides THEN 'slides' WHEN any_slide THEN 'notes and slides' ELSE 'notes' END || ': ' ||
   concat_ws('; ', 'section ' || named, nullif(singles, '')) || chr(10) || '(' ||
   CASE WHEN all_slides AND named IS NOT NULL THEN 'every slide of these sections' WHEN all_slides THEN 'the slides chosen for this task'
        WHEN named IS NOT NULL THEN 'every definition and theorem of these sections' ELSE 'the definitions and theorems chosen for this task' END ||
   CASE WHEN named IS NOT NULL AND singles <> '' THEN ', plus the single statements named' ELSE '' END || CASE WHEN algorithms THEN ', algorithms included' ELSE '' END ||
   CASE WHEN proofs <> '' THEN ', proofs only for ' || proofs WHEN every OR all_slides THEN '' ELSE ', proofs omitted' END || ')' AS head, definitions, results FROM fa LEFT JOIN nm USING (course)),
en AS (SELECT course, string_agg(chr(10) || id || CASE WHEN name IS NULL THEN '' ELSE ' (' || name || ')' END || ':' || chr(10) || text || CASE WHEN proof_on AND proof IS NOT NULL THEN chr(10) || 'Proof: ' || proof ELSE '' END, chr(10) ORDER BY place) AS body FROM mk GROUP BY course)
"""


@q(f"""WITH {ENTRIES}, {DOCS}
SELECT course AS task_ref, '{HEAD_SQL}' || {RULES_SQL} || CASE WHEN definitions THEN {_rule(A.DEFINITIONS_RULE)} ELSE '' END
  || CASE WHEN results THEN {_rule(A.RESULTS_RULE.replace('{what}', 'theorems and earlier exercises'))} ELSE {_rule(A.RESULTS_RULE.replace('{what}', 'earlier exercises'))} END || {TAIL_SQL}
  || chr(10) || chr(10) || '# Course: ' || course || chr(10) || 'Sheet 3, due: 1.1.' || chr(10) || chr(10) || '# Task 7: Title' || chr(10) || 'Do it.' || chr(10)
  || chr(10) || '{A.EARLIER_HEAD}' || chr(10) || '{A.EARLIER_NOTE}' || chr(10) || chr(10) || '## Sheet 1, task 1' || chr(10) || 'Earlier ' || course || chr(10)
  || CASE WHEN head IS NULL THEN '' ELSE chr(10) || head || chr(10) || body || chr(10) END AS text
FROM (SELECT DISTINCT course FROM entries) LEFT JOIN hd USING (course) LEFT JOIN en USING (course)""")
def q_build_documents(spark, sf_dir):
    """B1, B2: one document per course, with its selection of statements as context."""
    e = entries(spark, sf_dir)
    s = selection(e)
    order = C.script_order()
    keyed = C.proof_wanted(C.chosen(e, s), s, ["course"]).select(
        "*", *[c.alias(f"o{i}") for i, c in enumerate(order)])
    context = J.merged_order(keyed, ["course"], ["o0", "o1", "o2"]).select(
        F.col("course").alias("task_ref"), "place", "id", "type", "section", "name", "text", "proof",
        F.lit(None).cast("string").alias("source"), F.col("proof").isNotNull().alias("has_proof"), "proof_on", (F.col("course") == "PROMO").alias("all_proofs"))
    sections = s.filter("kind = 'section'").select(
        F.col("course").alias("task_ref"), "item", F.concat(F.lit("Brand "), "item").alias("title"), F.lit(None).cast("string").alias("root_title"))
    tasks = e.select("course").distinct().select(
        F.col("course").alias("task_ref"), F.col("course").alias("course_name"), F.lit(3).alias("sheet_number"), F.lit("1.1.").alias("discussion_date"),
        F.lit(7).alias("number"), F.lit("Title").alias("title"), F.lit("Do it.").alias("text"), F.array().cast(J.FOUND).alias("found"),
        F.array().cast("array<struct<label:string,text:string>>").alias("parts"), F.lit(None).cast("string").alias("asked"),
        F.lit("").alias("attempt"), F.lit(True).alias("include_task"), F.lit(True).alias("include_context"))
    earlier = tasks.select("task_ref", F.lit(1).alias("place"), F.lit("Sheet 1, task 1").alias("label"), F.concat(F.lit("Earlier "), "task_ref").alias("text"))
    return A.build_documents(tasks, context, sections, earlier)
