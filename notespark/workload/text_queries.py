"""Text clean-up, extraction and classification over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P, text as X
from ..operators import headers as H, tasks as T
from . import REGISTRY, table

q = REGISTRY.query

# Fragments of SQL shared by the queries below.
STEM = r"regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', ''), '^.*/', '')"
TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


def url_stem():
    return F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", ""), "^.*/", "")


@q(r"""
SELECT doc_id, CAST(unnest(generate_series(1, len(l))) - 1 AS INTEGER) AS pos, unnest(l) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
""")
def q_lines(spark, sf_dir):
    """The line table: one row per line, no shuffle."""
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    return H.line_table(pages).select("doc_id", F.col("line_no").alias("pos"), "line")


@q("SELECT doc_id, text FROM documents")
def q_normalize_roundtrip(spark, sf_dir):
    """Texts are damaged the way old fonts damage them and come back as they were."""
    text = F.replace(F.col("text"), F.lit("fi"), F.lit("ﬁ"))
    text = F.regexp_replace(text, r"ß(?<=\p{L}ß)", "ÿ")
    text = F.regexp_replace(text, r"ü(?<=\p{L}ü)", "¨u")
    text = F.regexp_replace(text, r"ff(?<=\p{L}ff)(?=\p{L})", "\x1b")
    text = F.replace(text, F.lit(". "), F.lit(".\x01 "))
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize(text).alias("text"))


@q(r"""
SELECT conv_id, turn, list_aggregate(list_transform(
    regexp_split_to_array(trim(text, ' ' || chr(10)), '\n\s*\n'),
    lambda b: coalesce(list_reduce(
        list_filter(list_transform(string_split(b, chr(10)), lambda s: trim(s)), lambda s: s <> ''),
        lambda a, s: CASE
            WHEN regexp_matches(s, '^(\(?[a-z]\)|\(?[ivx]+\)|\d+[.)]|[•\-–])\s') THEN a || chr(10) || s
            WHEN right(a, 1) = '-' AND regexp_matches(s, '^\p{Ll}') THEN left(a, -1) || s
            ELSE a || ' ' || s END, ''), '')), 'string_agg', chr(10) || chr(10)) AS text
FROM conversations
""".replace("lambda a, s: CASE", "lambda a, s: CASE WHEN a = '' THEN s"))
def q_readable(spark, sf_dir):
    """Paragraphs of every turn."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.readable(F.col("text")).alias("text"))


@q(r"""
WITH f AS (
  SELECT doc_id, list_aggregate(list_filter(string_split(
      regexp_replace(translate(lower(text), 'äöüß', 'aous'), '[^a-z]+', ' ', 'g'), ' '),
      lambda w: length(w) > 1), 'string_agg', ' ') AS t FROM documents)
SELECT doc_id, CAST(coalesce(length(t), 0) AS INTEGER) AS folded_chars,
       CAST(CASE WHEN coalesce(length(t), 0) < 3 THEN 0
            ELSE len(list_distinct(list_transform(generate_series(1, length(t) - 2), lambda i: substr(t, i, 3)))) END AS INTEGER) AS n_grams
FROM f
""")
def q_trigrams(spark, sf_dir):
    """Folded length and distinct trigrams of every document."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(X.fold(F.col("text"))).alias("folded_chars"), F.size(X.trigrams(F.col("text"))).alias("n_grams"))


@q(rf"""
WITH t AS (SELECT page_id, url, {TITLE} AS title FROM pages)
SELECT page_id,
       coalesce(nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'course') AS slug,
       trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS squashed,
       regexp_replace(lower(regexp_replace(trim(title), '^\d+(\.\d+)*\.?\s+', '')), '[^\p{{L}}\p{{N}}]+', '', 'g') AS plain,
       trim(regexp_replace(trim(regexp_replace(title, '\s+', ' ', 'g')), '^\d+(\.\d+)*\.?\s+', '')) AS clean,
       left(trim(regexp_replace(html, '\s+', ' ', 'g')), 300) AS preview
FROM t JOIN pages USING (page_id)
""")
def q_titles(spark, sf_dir):
    """Page titles in their four reduced forms, and a preview."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").withColumn("title", title).select(
        "page_id", X.slug(F.col("title")).alias("slug"), X.squash(F.col("title")).alias("squashed"),
        X.plain_title(F.col("title")).alias("plain"), X.clean_title(F.col("title")).alias("clean"),
        X.preview(F.col("html"), 300).alias("preview"))


@q(rf"""
WITH s AS (SELECT page_id, {STEM} AS stem, url FROM pages)
SELECT page_id,
       TRY_CAST(nullif(regexp_extract(regexp_replace(stem, '\.[^.]+$', ''), '(\d+)\D*$', 1), '') AS INTEGER) AS last_number,
       coalesce(
         TRY_CAST(nullif(regexp_extract(regexp_replace(stem, '\.[^.]+$', ''), '(?i)(?:lectures?|vorlesung|kapitel|chapter|chap|week|woche|unit|einheit|teil|part|foliensatz|folien|slides?|deck|session)[\s._#-]*(\d+)', 1), '') AS INTEGER),
         TRY_CAST(nullif(regexp_extract(regexp_replace(stem, '\.[^.]+$', ''), '^(\d+)', 1), '') AS INTEGER),
         TRY_CAST(nullif(regexp_extract(regexp_replace(stem, '\.[^.]+$', ''), '(\d+)\D*$', 1), '') AS INTEGER)) AS deck,
       coalesce(nullif(array_to_string(regexp_extract_all(url, '\d+'), ','), ''), '0') AS natural_key,
       nullif(regexp_extract(stem, '^(.+?)(?: ?\(\d+\)|-\d+)(\.[^.]+)?$', 1) || regexp_extract(stem, '^(.+?)(?: ?\(\d+\)|-\d+)(\.[^.]+)?$', 2), '') AS base
FROM s
""")
def q_file_names(spark, sf_dir):
    """Numbers in the names of all pages."""
    name = url_stem()
    stem = X.file_stem(name)
    return table(spark, sf_dir, "pages").select(
        "page_id", X.last_number(stem).alias("last_number"), X.deck_number(stem).alias("deck"),
        F.array_join(X.natural_key(F.col("url")).cast("array<string>"), ",").alias("natural_key"),
        X.base_name(name).alias("base"))


@q(rf"""
WITH s AS (
  SELECT page_id, regexp_replace({STEM}, '(.)\.[^.]+$', '\1') AS stem, url,
         len(string_split(html, '<p>')) AS n, regexp_extract(html, '<h1>([^<]*)', 1) AS first_page FROM pages),
c AS (
  SELECT *, list_filter(regexp_split_to_array(stem, '[-_\s]+'), lambda t: t <> '' AND NOT regexp_matches(t, '^\d+$')
              AND lower(t) NOT IN ('blatt','ps','vo','übung','uebung','aufgabenblatt','skript','skriptum','lecture','worksheet','notes','exercise')) AS tokens,
         regexp_matches(lower(stem), 'blatt|übung|uebung|aufgabenblatt|exercise|worksheet|hausaufgabe') OR regexp_matches(stem, '^\d{{1,3}}[-_]') AS sheet_name,
         regexp_matches(stem, '^[A-Za-z]\d{{1,3}}$') AS lettered,
         regexp_matches(lower(stem), 'skript|vorlesung|lecture|script|notes') OR regexp_matches(stem, '(?i)^VO\d*[-_]') AS script_name,
         nullif(trim(first_page), '') AS first_line FROM s),
v AS (
  SELECT *, CASE WHEN sheet_name OR lettered THEN 'sheet' WHEN script_name THEN 'script'
                 WHEN n >= 15 THEN 'script' WHEN n <= 3 THEN 'sheet' ELSE 'unknown' END AS doc_type,
         CASE WHEN sheet_name THEN 0.7 WHEN lettered THEN 0.6 WHEN script_name THEN 0.7 WHEN n >= 15 THEN 0.6 WHEN n <= 3 THEN 0.4 ELSE 0.2 END AS conf,
         array_to_string(tokens, ' ') AS named FROM c)
SELECT page_id, doc_type,
       CASE WHEN named <> '' THEN named WHEN doc_type <> 'unknown' AND length(first_line) <= 60 AND right(first_line, 1) <> '.' THEN first_line END AS course_guess,
       CAST(CASE WHEN named = '' AND doc_type <> 'unknown' AND length(first_line) <= 60 AND right(first_line, 1) <> '.' THEN least(conf, 0.35) ELSE conf END AS DOUBLE) AS confidence
FROM v
""")
def q_classify_name(spark, sf_dir):
    """Kind and course of every page, the heading being its first page."""
    c = P.classify(X.file_stem(url_stem()), F.regexp_extract("html", "<h1>([^<]*)", 1), F.size(F.split("html", "<p>")))
    return table(spark, sf_dir, "pages").withColumn("c", c).select("page_id", "c.doc_type", "c.course_guess", "c.confidence")


TITLE_SQL = r"""
WITH b AS (SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS t FROM conversations),
m AS (SELECT *, regexp_replace(t, '\b(vs|bzw|d\.h|z\.B|i\.e|e\.g|ca|vgl)\.', '\1' || chr(1), 'g') AS u FROM b),
h AS (SELECT *, regexp_matches(u, '[.:]\s') AS found,
        regexp_extract(u, '(?s)^(.*?)[.:]\s', 1) AS head,
        split_part(t, chr(10), 1) AS first,
        ltrim(substr(t, length(split_part(t, chr(10), 1)) + 2), ' ' || chr(10)) AS rest FROM m),
c AS (SELECT *, substr(t, length(head) + 1, 1) = ':' AS colon,
        regexp_replace(replace(head, chr(1), '.'), '-\n([a-zäöüß])', '\1', 'g') AS joined FROM h),
k AS (
  SELECT conv_id, turn, 1 AS n, joined AS raw, colon FROM c WHERE found AND length(head) <= 140 AND
     (position(chr(10) IN joined) = 0 OR (colon AND NOT regexp_matches(trim(regexp_extract(joined, '[^\n]*$')), '^\(?(?:[a-h]|i{1,3}v?|vi{0,3})[).]')))
  UNION ALL
  SELECT conv_id, turn, 2, first, false FROM c WHERE rest <> '' AND (regexp_matches(rest, '^\p{Lu}') OR regexp_matches(rest, '^\(?(?:[a-h]|i{1,3}v?|vi{0,3})[).]'))
     AND NOT regexp_matches(rtrim(first), '[,-]$')),
w AS (
  SELECT *, trim(regexp_replace(regexp_replace(raw, '-\n([a-zäöüß])', '\1', 'g'), '\s+', ' ', 'g')) AS flat FROM k),
x AS (SELECT *, CASE WHEN flat LIKE '(%)' THEN trim(flat[2:-2]) ELSE flat END AS title FROM w),
y AS (SELECT *, list_transform(string_split(title, ' '), lambda s: lower(trim(s, ',;()'))) AS words FROM x),
z AS (
  SELECT conv_id, turn, n, title FROM y WHERE title <> '' AND length(title) <= 70 AND len(words) <= 8 AND regexp_matches(title, '^\p{L}')
    AND NOT regexp_matches(title || ' ', '^\s*\(?([a-h]|i{1,3}v?|vi{0,3})\)\s')
    AND NOT list_contains(string_split('@STARTERS', ' '), words[1])
    AND length(title) - length(translate(title, '=∈∉⊂⊆⊃⊇→←↦≤≥<>|{}[]∀∃^_∗·∑∫∞⩾⩽≠≈×', '')) <= CASE WHEN colon THEN 1 ELSE 0 END
    AND (colon OR NOT list_has_any(words, string_split('@WORDS', ' '))))
SELECT conv_id, turn, title FROM (SELECT * FROM conversations) LEFT JOIN (
  SELECT conv_id, turn, arg_min(title, n) AS title FROM z GROUP BY ALL) USING (conv_id, turn)
""".replace("@STARTERS", " ".join(P.STARTER_WORDS)).replace("@WORDS", " ".join(P.SENTENCE_WORDS))


@q(TITLE_SQL)
def q_guess_title(spark, sf_dir):
    """The heading every turn opens with, if it reads like one."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.guess_title(F.col("text")).alias("title"))


@q(r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
p AS (SELECT doc_id, l, unnest(generate_series(1, least(len(l) - 1, 8))) AS k FROM l WHERE len(l) >= 3)
SELECT doc_id, chr(CAST(96 + k AS INTEGER)) AS label,
       trim(CASE WHEN k < 8 THEN l[k + 1] ELSE array_to_string(l[9:], chr(10)) END, ' ' || chr(10)) AS text,
       trim(l[1], ' ') AS preamble
FROM p
""")
def q_subparts(spark, sf_dir):
    """Lines 2 to 9 of every document get part labels, and are found by them."""
    lines = F.split("text", "\n")
    labelled = F.transform(lines, lambda line, i: F.when(
        i.between(1, 8), F.concat(F.char(i + 96), F.lit(") "), line)).otherwise(line))
    body = F.array_join(labelled, "\n")
    docs = table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    return docs.select("doc_id", F.explode(X.subparts(F.col("body"))).alias("p"), X.preamble(F.col("body")).alias("preamble")).select(
        "doc_id", "p.label", "p.text", "preamble")


@q(r"""
SELECT conv_id AS sheet_id, turn + 1 AS number, trim(text, ' ' || chr(10)) AS text FROM conversations
""")
def q_find_tasks(spark, sf_dir):
    """a conversation written as a sheet, a task per turn, is cut into its turns.
    Every third number stands alone on its line and is found as a gap."""
    turns = table(spark, sf_dir, "conversations")
    n = F.col("turn") + 1
    # The last task is numbered on its own line, as a lone last number needs a part after it.
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    lone = (F.col("turn") % 3 == 2) & (F.col("turn") < F.col("last"))
    numbered = turns.join(last, "conv_id").withColumn("text", F.concat(
        F.lit("("), n.cast("string"), F.lit(")"), F.when(lone, "\n").otherwise(" "), F.col("text")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    sheets = numbered.groupBy(F.col("conv_id").alias("sheet_id")).agg(F.array_join(parts, "\n").alias("text"))
    return T.find_tasks(sheets).select("sheet_id", "number", "text")


@q(r"""
SELECT doc_id, array_to_string(regexp_extract_all(text, '\d+'), ',') AS refs FROM documents
""")
def q_script_refs(spark, sf_dir):
    """Numbers in the texts, written as references, are all found in order."""
    as_refs = F.regexp_replace("text", r"(?<!\d)(\d+)(?!\d)", "Aufgabe ($1) vom Skriptum")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(X.script_refs(as_refs), ",").alias("refs"))


@q(r"""
SELECT doc_id, source FROM documents
WHERE strpos(lower(CAST(doc_id AS VARCHAR) || ' ' || source || ' ' || text), 'license') > 0
""")
def q_search(spark, sf_dir):
    """Substring search over id, name and text of all documents."""
    hit = P.matches(F.col("doc_id").cast("string"), F.col("source"), F.col("text"), F.lit(" LICENSE "))
    return table(spark, sf_dir, "documents").filter(hit).select("doc_id", "source")
