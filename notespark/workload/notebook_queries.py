"""Fragments, stretches and attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import match as M
from . import REGISTRY, table

q = REGISTRY.query

# A conversation is a sheet: its user turns are the tasks, the lines of all its turns are the
# fragments pasted into a notebook.
FOLD = """list_aggregate(list_filter(string_split(regexp_replace(translate(lower({0}), 'äöüß', 'aous'), '[^a-z]+', ' ', 'g'), ' '), lambda w: length(w) > 1), 'string_agg', ' ')"""
GRAMS = "CASE WHEN length({0}) >= 3 THEN list_distinct(list_transform(generate_series(1, length({0}) - 2), lambda i: substr({0}, i, 3))) ELSE [] END"
MATCHES = rf"""
fr AS (SELECT conv_id AS scope, turn * 1000 + k AS frag_id, line AS text FROM (
   SELECT conv_id, turn, unnest(generate_series(1, len(x))) AS k, unnest(x) AS line FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS x FROM conversations))),
f0 AS (SELECT *, {FOLD.format('text')} AS q FROM fr),
f AS (SELECT *, {GRAMS.format('q')} AS fg FROM f0 WHERE NOT regexp_matches(trim(text), '^\W{{0,3}}(Satz|Definition|Lemma|Korollar|Proposition|Bemerkung|Beispiel|Algorithmus|Theorem|Corollary|Proof|Beweis|Remark)\b')),
c0 AS (SELECT conv_id AS scope, turn AS cand_ord, turn + 1 AS task, {FOLD.format('text')} AS q FROM conversations WHERE role = 'user'),
c AS (SELECT *, {GRAMS.format('q')} AS cg FROM c0),
p AS (SELECT f.scope, frag_id, cand_ord, task, len(list_intersect(fg, cg)) AS k, len(fg) AS n, len(cg) AS m FROM f JOIN c USING (scope) WHERE len(fg) >= 15 AND len(cg) > 0),
s AS (SELECT *, (k / n) * (0.5 + 0.5 * (k / m)) AS score FROM p),
m AS (SELECT scope, frag_id, arg_min(task, (-score, cand_ord)) AS task, max(score) AS score FROM s WHERE score >= 0.35 GROUP BY ALL)
"""


def _matches(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    lines = turns.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    fragments = lines.select(F.col("conv_id").alias("scope"), (F.col("turn") * 1000 + F.col("k") + 1).alias("frag_id"), "text")
    cands = turns.filter("role = 'user'").select(
        F.col("conv_id").alias("scope"), F.col("turn").alias("cand_ord"), (F.col("turn") + 1).alias("task"), F.lit("").alias("part"),
        F.lit(None).cast("string").alias("number"), "text")
    return fragments, M.classify_fragments(fragments, cands)


@q(f"WITH {MATCHES} SELECT scope, frag_id, task, round(score, 9) AS score FROM m")
def q_fuzzy_classify(spark, sf_dir):
    """Which task of its conversation every line quotes."""
    _, found = _matches(spark, sf_dir)
    return found.select("scope", "frag_id", "task", F.round("score", 9).alias("score"))


@q(rf"""WITH fr AS (SELECT conv_id AS scope, turn * 1000 + k AS frag_id, CASE k % 3 WHEN 0 THEN '(' || (turn % 4 + 1) || '.1) ' || line WHEN 1 THEN 'Aufgabe ' || (turn % 3 + 1) || ' ' || line ELSE line END AS text FROM (
   SELECT conv_id, turn, unnest(generate_series(1, len(x))) AS k, unnest(x) AS line FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS x FROM conversations))),
f0 AS (SELECT *, {FOLD.format('text')} AS q, nullif(regexp_extract(left(trim(text), 120), '\((\d+(?:\.\d+)+)\)', 1), '') AS f_number,
         TRY_CAST(nullif(regexp_extract(trim(text), '^\W{{0,3}}Aufgabe\s+(\d+)\b', 1), '') AS BIGINT) AS f_task FROM fr),
f AS (SELECT *, {GRAMS.format('q')} AS fg FROM f0 WHERE NOT regexp_matches(trim(text), '^\W{{0,3}}(Satz|Definition|Lemma|Korollar|Proposition|Bemerkung|Beispiel|Algorithmus|Theorem|Corollary|Proof|Beweis|Remark)\b')),
c0 AS (SELECT conv_id AS scope, turn AS cand_ord, turn + 1 AS task, (turn % 4 + 1) || '.1' AS number, CASE WHEN turn % 3 = 0 THEN 'a' ELSE '' END AS part, {FOLD.format('text')} AS q FROM conversations WHERE role = 'user'),
c AS (SELECT *, {GRAMS.format('q')} AS cg FROM c0),
p AS (SELECT f.scope, frag_id, cand_ord, task, part, f_number, f_task, number, len(list_intersect(fg, cg)) AS k, len(fg) AS n, len(cg) AS m FROM f JOIN c USING (scope) WHERE len(fg) >= 15 AND len(cg) > 0),
s AS (SELECT *, (k / n) * (0.5::DOUBLE + 0.5::DOUBLE * (k / m)) + CASE WHEN f_number = number THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN f_task = task THEN 0.3::DOUBLE ELSE 0 END
        - CASE WHEN (f_number IS NOT NULL OR f_task IS NOT NULL) AND part <> '' THEN 0.05::DOUBLE ELSE 0 END AS score FROM p)
SELECT scope, frag_id, arg_min({{'t': task, 'p': part}}, (-score, cand_ord)).t AS task, arg_min({{'t': task, 'p': part}}, (-score, cand_ord)).p AS part, round(max(score), 9) AS score
FROM s WHERE score >= 0.35 GROUP BY ALL""")
def q_fuzzy_markers(spark, sf_dir):
    """The same with markers: an exercise's number or the name of a task in front of a line, and candidates that are parts."""
    turns = table(spark, sf_dir, "conversations")
    text = lambda c: c.cast("string")
    lines = turns.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("k", "line")).withColumn("k", F.col("k") + 1)
    marked = F.when(F.col("k") % 3 == 0, F.concat(F.lit("("), text(F.col("turn") % 4 + 1), F.lit(".1) "), "line")).when(
        F.col("k") % 3 == 1, F.concat(F.lit("Aufgabe "), text(F.col("turn") % 3 + 1), F.lit(" "), "line")).otherwise(F.col("line"))
    fragments = lines.select(F.col("conv_id").alias("scope"), (F.col("turn") * 1000 + F.col("k")).alias("frag_id"), marked.alias("text"))
    cands = turns.filter("role = 'user'").select(
        F.col("conv_id").alias("scope"), F.col("turn").alias("cand_ord"), (F.col("turn") + 1).alias("task"), F.when(F.col("turn") % 3 == 0, "a").otherwise("").alias("part"),
        F.concat(text(F.col("turn") % 4 + 1), F.lit(".1")).alias("number"), "text")
    return M.classify_fragments(fragments, cands).select("scope", "frag_id", "task", "part", F.round("score", 9).alias("score"))


@q(f"""WITH {MATCHES} SELECT fr.scope, fr.frag_id, task, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 80) AS text FROM fr LEFT JOIN m USING (scope, frag_id)""")
def q_match_audit(spark, sf_dir):
    """Every line with what it was taken for."""
    fragments, found = _matches(spark, sf_dir)
    return M.match_audit(fragments, found).select("scope", "frag_id", "task", "text")


# A user is a notebook and a day a page of height 86,400,000,000 (its microseconds). Signups and
# purchases are pasted statements, views are strokes, clicks are lines read.
DAY = 86_400_000_000
NOTEBOOK = f"""
ev AS (SELECT user_id AS nb, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS page, event_id, event_type,
         CAST(epoch_us(ts) - epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS DOUBLE) AS y, CAST(CASE WHEN event_type = 'signup' THEN 1 ELSE 2 END AS BIGINT) AS task FROM events),
mk AS (SELECT *, task IS DISTINCT FROM lag(task) OVER (PARTITION BY nb ORDER BY page, y, task) AS opens FROM ev WHERE event_type IN ('signup', 'purchase')),
rn AS (SELECT *, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY nb ORDER BY page, y, task) AS BIGINT) AS stretch FROM mk)
"""
SLICES = f"""{NOTEBOOK},
sp AS (SELECT nb, stretch, task, min((page, y)) AS first, max((page, y + 1)) AS last FROM rn GROUP BY ALL),
pg AS (SELECT DISTINCT nb, unnest(generate_series(0, (SELECT max(page) FROM ev e WHERE e.nb = ev.nb))) AS page FROM ev),
en AS (SELECT nb, max(page) AS page FROM pg GROUP BY nb),
bo AS (SELECT sp.nb, stretch, task, last[1] AS p0, last[2] AS y0, coalesce(lead(first[1]) OVER w, en.page) AS p1, coalesce(lead(first[2]) OVER w, {DAY}.0) AS y1
       FROM sp JOIN en USING (nb) WINDOW w AS (PARTITION BY sp.nb ORDER BY stretch)),
sl AS (SELECT bo.nb, stretch, task, pg.page, CASE WHEN pg.page = p0 THEN y0 ELSE 0.0 END AS top, CASE WHEN pg.page = p1 THEN y1 ELSE {DAY}.0 END AS bottom FROM bo JOIN pg ON pg.nb = bo.nb AND pg.page BETWEEN p0 AND p1),
cl AS (SELECT sl.nb, stretch, sl.task, sl.page, greatest(top, min(y) - 6) AS top, least(bottom, max(y + 5) + 6) AS bottom FROM sl JOIN ev ON ev.nb = sl.nb AND ev.page = sl.page AND event_type = 'view' AND y < bottom AND y + 5 > top GROUP BY sl.nb, stretch, sl.task, sl.page, top, bottom),
ln AS (SELECT nb, page, event_id, y FROM ev WHERE event_type = 'click'),
li AS (SELECT ln.nb, ln.page, event_id, y, min(stretch) AS stretch FROM ln JOIN cl ON cl.nb = ln.nb AND cl.page = ln.page AND top <= y + 1 AND y + 1 < bottom GROUP BY ALL)
"""


def _notebook(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ev = e.select(F.col("user_id").alias("nb"), F.datediff(day, F.lit("2024-01-01").cast("date")).alias("page"), "event_id", "event_type",
                  (us - F.unix_micros(day.cast("timestamp"))).cast("double").alias("y"))
    marks = ev.filter(F.col("event_type").isin("signup", "purchase")).select(
        "nb", "page", F.col("y").alias("top"), (F.col("y") + 1).alias("bottom"),
        F.when(F.col("event_type") == "signup", 1).otherwise(2).cast("bigint").alias("task"), F.lit("").alias("part"))
    pages = ev.groupBy("nb").agg(F.max("page").alias("n")).select("nb", F.explode(F.sequence(F.lit(0), "n")).alias("page"), F.lit(float(DAY)).alias("height"))
    strokes = ev.filter("event_type = 'view'").select("nb", "page", F.col("y").alias("top"), (F.col("y") + 5).alias("bottom"))
    lines = ev.filter("event_type = 'click'").select(
        "nb", "page", F.col("event_id").alias("seq"), F.col("y").alias("top"), (F.col("y") + 2).alias("bottom"), F.lit("text").alias("kind"),
        F.concat(F.lit("line "), F.col("event_id").cast("string")).alias("text"))
    return marks, pages, strokes, lines


@q(f"WITH {NOTEBOOK} SELECT nb, page, y AS top, task, stretch AS run FROM rn")
def q_merge_marks(spark, sf_dir):
    """Marks of one task in a row are one run."""
    marks, *_ = _notebook(spark, sf_dir)
    return M.merge_marks(marks, ["nb"], ["page", "top", "bottom", "task", "part"], ["task", "part"]).select("nb", "page", "top", "task", "run")


@q(f"WITH {SLICES} SELECT nb, stretch, task, page, top, bottom FROM cl")
def q_stretches(spark, sf_dir):
    """What was written below each statement, page by page."""
    marks, pages, strokes, _ = _notebook(spark, sf_dir)
    return M.stretches(marks, pages, strokes).select("nb", "stretch", "task", F.col("page").cast("bigint").alias("page"), "top", "bottom")


@q(f"WITH {SLICES} SELECT nb, event_id AS seq, stretch FROM li")
def q_lines_in_stretch(spark, sf_dir):
    """The stretch every line lies in."""
    marks, pages, strokes, lines = _notebook(spark, sf_dir)
    return M.lines_to_stretches(lines, M.stretches(marks, pages, strokes)).select("nb", "seq", "stretch")


@q(f"""WITH {SLICES}, x AS (SELECT DISTINCT nb, stretch, task FROM cl), n AS (SELECT nb, task, count(*) > 1 AS several FROM x GROUP BY ALL),
b AS (SELECT li.nb, x.task, li.stretch, string_agg('line ' || event_id, chr(10) ORDER BY page, event_id) AS t FROM li JOIN x USING (nb, stretch) GROUP BY ALL)
SELECT nb, task, string_agg(CASE WHEN several THEN 'Task ' || task || ':' || chr(10) || t ELSE t END, chr(10) || chr(10) ORDER BY stretch) AS text FROM b JOIN n USING (nb, task) GROUP BY ALL""")
def q_compose_stretches(spark, sf_dir):
    """The lines of every task as one text."""
    marks, pages, strokes, lines = _notebook(spark, sf_dir)
    return M.compose_stretches(lines, M.stretches(marks, pages, strokes)).select("nb", "task", "text")


@q("""WITH s AS (SELECT user_id AS nb, event_id AS stretch, event_id % 3 AS task, CASE WHEN event_id % 4 > 0 THEN substr('abc', CAST(event_id % 4 AS INTEGER), 1) ELSE '' END AS part FROM events),
a AS (SELECT DISTINCT user_id AS nb, task, CASE WHEN (user_id + task) % 4 > 0 THEN substr('abc', CAST((user_id + task) % 4 AS INTEGER), 1) END AS asked FROM events CROSS JOIN (SELECT unnest([0, 1]) AS task))
SELECT nb, stretch, s.task, part FROM s JOIN a USING (nb, task) WHERE asked IS NULL OR part = '' OR part <= asked""")
def q_up_to_part(spark, sf_dir):
    """What was written for the part that is asked and the parts before it."""
    letter = lambda c: F.when(c % 4 > 0, F.substring(F.lit("abc"), (c % 4).cast("int"), F.lit(1)))
    e = table(spark, sf_dir, "events")
    slices = e.select(F.col("user_id").alias("nb"), F.col("event_id").alias("stretch"), (F.col("event_id") % 3).alias("task"),
                      F.coalesce(letter(F.col("event_id")), F.lit("")).alias("part"))
    asked = e.select(F.col("user_id").alias("nb")).distinct().select("nb", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("task"))
    asked = asked.withColumn("asked_part", letter(F.col("nb") + F.col("task")))
    return M.up_to_part(slices, asked).select("nb", "stretch", "task", "part")


@q(f"""WITH {SLICES}, t AS (SELECT DISTINCT user_id AS nb, unnest([1, 2, 3]) AS task FROM events UNION ALL SELECT -1, 1),
x AS (SELECT DISTINCT nb, stretch, task FROM cl), l AS (SELECT li.nb, x.task, count(*) AS lines FROM li JOIN x USING (nb, stretch) GROUP BY ALL),
pages AS (SELECT nb, task, string_agg(DISTINCT CAST(page + 1 AS VARCHAR), ',' ORDER BY CAST(page + 1 AS VARCHAR)) AS pages FROM cl GROUP BY ALL)
SELECT CAST(t.nb AS BIGINT) AS nb, CAST(t.task AS BIGINT) AS task, CASE WHEN t.nb = -1 THEN 'no-notebook' WHEN l.nb IS NULL THEN 'nothing' ELSE 'ok' END AS status, coalesce(pages, '') AS pages, coalesce(lines, 0) AS lines
FROM t LEFT JOIN l USING (nb, task) LEFT JOIN pages USING (nb, task)""")
def q_attempt_status(spark, sf_dir):
    """What reading the attempt of every task came to."""
    marks, pages, strokes, lines = _notebook(spark, sf_dir)
    slices = M.stretches(marks, pages, strokes)
    tasks = pages.select("nb").distinct().select("nb", F.explode(F.array(*[F.lit(i).cast("bigint") for i in (1, 2, 3)])).alias("task"))
    tasks = tasks.union(tasks.limit(1).select(F.lit(-1).cast("bigint"), F.lit(1).cast("bigint")))
    got = M.attempt_status(tasks, pages, slices, M.compose_stretches(lines, slices))
    shown = F.array_join(F.array_sort(F.col("pages").cast("array<string>")), ",")
    return got.select("nb", "task", "status", shown.alias("pages"), "lines")
