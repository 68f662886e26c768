"""Headers, blocks, outlines and placement over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains as C, headers as H, outline as O, slides as L, tasks as T
from ..plans.knowledge import extract_entries
from ..scan import row_number, scan
from ..session import staged
from . import REGISTRY, table

q = REGISTRY.query

# documents as files of one page; a one-word line that ends in a full stop opens a block.
ONE_WORD = r"^\S+\.$"
BLOCKS_SQL = r"""
l AS (SELECT doc_id, CAST(unnest(generate_series(1, len(x))) AS INTEGER) AS n, unnest(x) AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
b AS (SELECT *, CAST(sum(CASE WHEN regexp_matches(line, '^\S+\.$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS block FROM l)
"""


def one_page(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")


@q(rf"""
WITH {BLOCKS_SQL}
SELECT doc_id, block, arg_min(line, n) AS header,
       coalesce(trim(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT regexp_matches(line, '^\S+\.$')), ' ' || chr(10)), '') AS text
FROM b WHERE block > 0 GROUP BY ALL
""")
def q_segment_blocks(spark, sf_dir):
    """Every document cut at its headers."""
    pages = one_page(spark, sf_dir)
    first = F.element_at(F.split("rest", "\n", 2), 1)
    found = H.header_lines(pages, ONE_WORD).select(
        "doc_id", "page", "line_no", F.lit(0).alias("ord"), F.lit("numbered").alias("kind"),
        F.lit(None).cast("string").alias("ref"), first.alias("header"), F.length(first).alias("match_len"))
    heads = H.number_blocks(staged(found, "heads"))
    return heads.join(H.cut_blocks(pages, heads), ["doc_id", "block"]).select("doc_id", "block", "header", "text")


VERIFY_SQL = """
c AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day,
             row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS k FROM events WHERE event_type = 'click'),
s AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY ALL),
v AS (SELECT event_id, c.user_id, coalesce(k <= n, false) AS accepted FROM c LEFT JOIN s ON c.user_id = s.user_id AND c.day = s.day)
"""


def _verified(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type")
    word = F.lit("x").alias("word")
    clicks = events.filter("event_type = 'click'").select("event_id", "user_id", "day", word)
    views = events.filter("event_type = 'view'").select("user_id", "day", word)
    return H.verify_headers(clicks, views, ["user_id", "day"], "word", ["event_id"])


@q(f"WITH {VERIFY_SQL} SELECT event_id, user_id, accepted FROM v")
def q_verify_headers(spark, sf_dir):
    """The k-th click of a user's day is accepted if the day has at least k views."""
    return _verified(spark, sf_dir).select("event_id", "user_id", "accepted")


@q(f"WITH {VERIFY_SQL} SELECT user_id, count(*) FILTER (WHERE NOT accepted) AS rejected FROM v GROUP BY user_id")
def q_rejected(spark, sf_dir):
    """Rejected candidates per user."""
    return H.rejected(_verified(spark, sf_dir), ["user_id"])


@q(r"""
WITH l AS (SELECT source, doc_id AS page, CAST(unnest(generate_series(1, len(x))) AS INTEGER) - 1 AS n, unnest(x) AS line
           FROM (SELECT source, doc_id, string_split(text, chr(10)) AS x FROM documents)),
k AS (SELECT *, n % 3 = 2 AS proof FROM l),
-- styled words per page: one per two-thirds of the statement lines, all proofs
r AS (SELECT *, CASE WHEN proof THEN true ELSE
        row_number() OVER (PARTITION BY source, page, proof ORDER BY n) <=
        count(*) OVER (PARTITION BY source, page, proof) - count(*) OVER (PARTITION BY source, page, proof) // 3 END AS ok FROM k),
g AS (SELECT *, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY page, n) AS BIGINT) AS block FROM r),
t AS (SELECT source, block, bool_or(ok AND proof) AS proof, min(page) AS page, min(CASE WHEN ok THEN n END) AS n,
        trim(string_agg(CASE WHEN ok THEN line ELSE 'Satz ' || (page + 1) || '.' || (n + 1) || '. ' || line END, chr(10) ORDER BY page, n), ' ' || chr(10)) AS text
      FROM g WHERE block > 0 GROUP BY source, block),
a AS (SELECT *, max(CASE WHEN NOT proof THEN block END) OVER (PARTITION BY source ORDER BY block) AS target FROM t),
p AS (SELECT source, target AS block, arg_max(text, a.block) AS proof_text FROM a WHERE proof GROUP BY source, target)
SELECT t.source AS doc_id, t.block AS pos, (t.page + 1) || '.' || (t.n + 1) AS number, t.text, p.proof_text AS proof
FROM t LEFT JOIN p USING (source, block) WHERE NOT t.proof
""")
def q_extract_entries(spark, sf_dir):
    """All documents of a source are the pages of one script. Each line gets a
    header, every third a proof header; a page has fewer styled words than statements, so
    its last statements are rejected and stay in the block before."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("script"), F.col("doc_id").alias("page"), F.split("text", "\n").alias("lines"))
    headed = F.transform("lines", lambda x, i: F.when(i % 3 == 2, F.concat(F.lit("Beweis. "), x)).otherwise(
        F.concat(F.lit("Satz "), (F.col("page") + 1).cast("string"), F.lit("."), (i + 1).cast("string"), F.lit(". "), x)))
    pages = docs.select(F.col("script").alias("doc_id"), "page", F.array_join(headed, "\n").alias("text"))
    n = F.size("lines")
    proofs = F.floor(n / 3).cast("int")
    statements = n - proofs
    words = F.concat(F.array_repeat(F.lit("Satz"), statements - F.floor(statements / 3).cast("int")), F.array_repeat(F.lit("Beweis"), proofs))
    styled = docs.select(F.col("script").alias("doc_id"), "page", F.posexplode(words).alias("seq", "word"))
    # Styled words are a table of their own; derived from the texts, they would take these along into joins.
    entries, _ = extract_entries(staged(pages, "pages"), staged(styled, "styled"))
    return entries.select("doc_id", "pos", "number", "text", "proof")


@q("""
WITH a AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations),
p AS (SELECT conv_id, target AS turn, arg_max(text, a.turn) AS proof FROM a WHERE role = 'assistant' AND target IS NOT NULL GROUP BY ALL)
SELECT c.conv_id, c.turn AS block, c.text, p.proof FROM conversations c LEFT JOIN p USING (conv_id, turn) WHERE role = 'user'
""")
def q_attach_followup(spark, sf_dir):
    """An assistant turn belongs to the last user turn before it; the last one wins."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.lit(1).alias("page"), F.col("turn").alias("line_no"), F.lit(0).alias("ord"),
        F.when(F.col("role") == "user", "numbered").when(F.col("role") == "assistant", "proof").otherwise("boundary").alias("kind"),
        F.lit(None).cast("string").alias("ref"), "text")
    linked = H.number_blocks(turns)
    return H.attach_followups(linked, ["doc_id"]).select(F.col("doc_id").alias("conv_id"), F.col("line_no").alias("block"), "text", "proof")


@q("""
WITH c AS (SELECT *, count(*) OVER (PARTITION BY p_type, p_name, p_brand) AS n,
             row_number() OVER (PARTITION BY p_type, p_name, p_brand, p_size ORDER BY p_partkey) AS k FROM part)
SELECT p_partkey AS pos, CASE WHEN n > 1 THEN p_name || ' ' || p_brand || ' (p. ' || p_size || ')' || CASE WHEN k > 1 THEN ' #' || k ELSE '' END END AS id FROM c
""")
def q_set_ids(spark, sf_dir):
    """A10: parts of one kind with the same name and brand are told apart by size and #k."""
    parts = table(spark, sf_dir, "part").select(
        F.col("p_type").alias("doc_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("type"),
        F.col("p_brand").alias("number"), F.col("p_size").alias("page"))
    return H.set_ids(parts, ["doc_id"]).select("pos", "id")


@q("""
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN CAST(event_id AS VARCHAR) END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
FROM events
""")
def q_asof_section(spark, sf_dir):
    """Every event belongs to the last signup of its user at or before it."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), "event_type",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("page"), F.lit(None).cast("string").alias("number"))
    nodes = e.filter("event_type = 'signup'").select("doc_id", F.col("pos").alias("seq"), F.col("pos").cast("string").alias("key"), "page")
    return O.assign_sections(e.drop("event_type"), nodes).select(F.col("pos").alias("event_id"), "section")


# Five scripts, one per region, with nations as sections. Three sections begin on each page.
# Customers are entries numbered in their nation; those in debt stand one page later.
SHARED_SQL = """
n AS (SELECT n_regionkey, n_nationkey, row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS seq,
        (n_regionkey + 1) || '.' || (n_nationkey + 1) AS key FROM nation),
nodes AS (SELECT *, seq // 3 + 1 AS page FROM n),
e AS (SELECT n_regionkey AS doc, c_custkey AS pos, key AS prefix, key || '.' || c_custkey AS number,
        page + CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS page FROM customer JOIN nodes ON c_nationkey = n_nationkey)
"""


def _shared(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(
        F.lit(1).alias("all"), "n_nationkey", "n_regionkey",
        F.concat_ws(".", (F.col("n_regionkey") + 1).cast("string"), (F.col("n_nationkey") + 1).cast("string")).alias("key"))
    seq = scan(nation, ["all"], ["n_regionkey", "n_nationkey"], seq=row_number()).withColumn(
        "page", (F.floor(F.col("seq") / 3) + 1).cast("int"))
    customers = table(spark, sf_dir, "customer").join(seq, F.col("c_nationkey") == F.col("n_nationkey"))
    entries = customers.select(
        F.col("n_regionkey").alias("doc_id"), F.col("c_custkey").alias("pos"),
        F.concat_ws(".", "key", F.col("c_custkey").cast("string")).alias("number"),
        (F.col("page") + F.when(F.col("c_acctbal") < 0, 1).otherwise(0)).alias("page"))
    nodes = seq.select(
        F.col("n_regionkey").alias("doc_id"), "seq", "key", F.split("key", r"\.").cast("array<int>").alias("key_path"),
        F.lit(2).alias("level"), F.lit("t").alias("title"), "page")
    return entries, nodes


@q(f"""
WITH {SHARED_SQL},
l AS (SELECT e.*, (SELECT arg_max(key, seq) FROM nodes WHERE n_regionkey = doc AND nodes.page <= e.page) AS last,
             (SELECT arg_max(key, seq) FROM nodes WHERE n_regionkey = doc AND nodes.page < e.page) AS before,
             (SELECT page FROM nodes WHERE key = e.prefix) AS own FROM e),
t AS (SELECT doc, count(*) FILTER (WHERE prefix = last) >= 0.8 * count(*) AS trusted FROM l WHERE last IS NOT NULL GROUP BY doc)
SELECT l.doc AS doc_id, pos, CASE WHEN trusted AND (own = page OR before = prefix) AND prefix <> last THEN prefix ELSE last END AS section
FROM l JOIN t USING (doc)
""")
def q_shared_page(spark, sf_dir):
    """Placement by page, corrected where the numbering can be trusted (it cannot
    here: most sections share their page)."""
    entries, nodes = _shared(spark, sf_dir)
    return O.assign_sections(entries, nodes).select("doc_id", "pos", "section")


@q(f"""
WITH {SHARED_SQL.replace('seq // 3 + 1', 'seq + (seq - 1) // 6 * -1')},
l AS (SELECT e.*, (SELECT arg_max(key, seq) FROM nodes WHERE n_regionkey = doc AND nodes.page <= e.page) AS last,
             (SELECT arg_max(key, seq) FROM nodes WHERE n_regionkey = doc AND nodes.page < e.page) AS before,
             (SELECT page FROM nodes WHERE key = e.prefix) AS own FROM e),
t AS (SELECT doc, count(*) FILTER (WHERE prefix = last) >= 0.8 * count(*) AS trusted FROM l WHERE last IS NOT NULL GROUP BY doc)
SELECT l.doc AS doc_id, pos, trusted, CASE WHEN trusted AND (own = page OR before = prefix) AND prefix <> last THEN prefix ELSE last END AS section
FROM l JOIN t USING (doc)
""")
def q_shared_page_trusted(spark, sf_dir):
    """J10 where most sections begin on a page of their own, so numbers decide the rest."""
    entries, nodes = _shared(spark, sf_dir)
    seq = F.col("seq") - F.floor((F.col("seq") - 1) / 6)
    own = nodes.withColumn("page", seq.cast("int"))
    keys = own.select("doc_id", F.concat_ws(".", "key").alias("__k"), F.col("page").alias("__page"))
    late = F.col("page") - F.col("__old")
    old = nodes.select("doc_id", F.col("key").alias("__k"), F.col("page").alias("__old"))
    moved = entries.withColumn("__k", F.regexp_replace("number", r"\.[^.]*$", "")).join(old, ["doc_id", "__k"]).join(
        keys, ["doc_id", "__k"]).select("doc_id", "pos", "number", (F.col("__page") + late).alias("page"))
    placed = O.assign_sections(moved, own)
    agree = placed.withColumn("__p", F.regexp_replace("number", r"\.[^.]*$", ""))
    plain = O.assign_sections(moved.withColumn("number", F.lit(None).cast("string")), own).select(
        "doc_id", "pos", F.col("section").alias("__last"))
    trusted = agree.join(plain, ["doc_id", "pos"]).filter("__last is not null").groupBy("doc_id").agg(
        (F.count_if(F.col("__p") == F.col("__last")) >= 0.8 * F.count(F.lit(1))).alias("trusted"))
    return placed.join(trusted, "doc_id").select("doc_id", "pos", "trusted", "section")


@q("""
WITH s AS (SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
r AS (SELECT n_regionkey, row_number() OVER (ORDER BY n_regionkey) AS k FROM (SELECT DISTINCT n_regionkey FROM nation)),
n AS (SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation),
p AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM s)
SELECT 'Region ' || n_regionkey AS title, CAST(k AS VARCHAR) AS key, 1 AS level FROM r
UNION ALL SELECT 'Nation ' || n_nationkey, r.k || '.' || n.k, 2 FROM n JOIN r USING (n_regionkey)
UNION ALL SELECT 'Supplier ' || s_suppkey, r.k || '.' || n.k || '.' || p.k, 3 FROM p JOIN n ON s_nationkey = n_nationkey JOIN r USING (n_regionkey)
""")
def q_outline_keys(spark, sf_dir):
    """regions, nations and suppliers in reading order."""
    nation = table(spark, sf_dir, "nation")
    zero = F.lit(-1).cast("bigint")
    rows = (
        nation.select("n_regionkey").distinct().select(
            F.struct("n_regionkey", F.lit(-1).alias("n"), zero.alias("s")).alias("at"), F.lit(1).alias("level"),
            F.concat(F.lit("Region "), F.col("n_regionkey").cast("string")).alias("title"))
        .union(nation.select(F.struct("n_regionkey", F.col("n_nationkey"), zero), F.lit(2),
                             F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string"))))
        .union(table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.struct("n_regionkey", "n_nationkey", F.col("s_suppkey")), F.lit(3),
            F.concat(F.lit("1.2 Supplier  "), F.col("s_suppkey").cast("string"))))
    )
    raw = rows.select(F.lit("all").alias("doc_id"), F.col("at").alias("seq"), "level", "title")
    return O.outline_keys(raw).select("title", "key", "level")


NUMBERS = """
p AS (SELECT p_type AS doc, p_partkey AS pos, regexp_extract(p_brand, '(\\d+)', 1) AS b, p_size AS s,
        regexp_extract(p_brand, '(\\d+)', 1) || '.' || p_size || CASE WHEN p_type IN ('PROMO', 'SMALL') OR p_size < 10 THEN '.' || p_partkey ELSE '' END AS number,
        p_type IN ('PROMO', 'SMALL') AS deep FROM part)
"""


def _numbered(spark, sf_dir):
    size = F.col("p_size").cast("string")
    deep = F.col("p_type").isin("PROMO", "SMALL") | (F.col("p_size") < 10)
    return table(spark, sf_dir, "part").select(
        F.col("p_type").alias("doc_id"), F.col("p_partkey").alias("pos"), F.col("p_size").alias("page"),
        F.concat_ws(".", F.regexp_extract("p_brand", r"(\d+)", 1), size, F.when(deep, F.col("p_partkey").cast("string"))).alias("number"))


@q(f"""
WITH {NUMBERS}, k AS (SELECT doc, b AS key FROM p UNION SELECT doc, b || '.' || s FROM p WHERE deep)
SELECT doc AS doc_id, key, CAST(len(string_split(key, '.')) AS INTEGER) AS level,
       row_number() OVER (PARTITION BY doc ORDER BY CAST(string_split(key, '.')[1] AS INTEGER), len(string_split(key, '.')), CAST(string_split(key, '.')[-1] AS INTEGER)) AS seq
FROM k
""")
def q_tree_from_numbers(spark, sf_dir):
    """The tree that most numbers of a script imply."""
    return O.tree_from_numbers(_numbered(spark, sf_dir)).select("doc_id", "key", "level", "seq")


@q(f"""
WITH {NUMBERS}
SELECT doc AS doc_id, pos, CASE WHEN doc = 'LARGE' THEN '9' WHEN deep THEN b || '.' || s ELSE b END AS section FROM p
WHERE NOT (doc = 'LARGE' AND s < 5) UNION ALL SELECT doc, pos, NULL FROM p WHERE doc = 'LARGE' AND s < 5
""")
def q_choose_tree(spark, sf_dir):
    """Only the script LARGE has an outline, and it places most entries; the others are
    placed by their numbers."""
    entries = _numbered(spark, sf_dir)
    nodes = table(spark, sf_dir, "part").filter("p_type = 'LARGE'").select(
        F.col("p_type").alias("doc_id"), F.lit(1).cast("bigint").alias("seq"), F.lit("9").alias("key"),
        F.array(F.lit(9)).alias("key_path"), F.lit(1).alias("level"), F.lit("All").alias("title"), F.lit(5).alias("page")).distinct()
    placed, _ = O.choose_tree(entries, nodes)
    return placed.select("doc_id", "pos", "section")


@q("""
SELECT a.event_id AS seq, coalesce((SELECT arg_min(b.page, b.seq) FROM (SELECT user_id, event_id AS seq, CAST(floor(value) AS INTEGER) AS page FROM events) b
         WHERE b.user_id = a.user_id AND b.seq > a.event_id AND b.page > CAST(floor(a.value) AS INTEGER)) - 1, 10000) AS end_page
FROM events a
""")
def q_section_extent(spark, sf_dir):
    """Events as headings on page floor(value): where the next later page begins."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.floor("value").cast("int").alias("page"))
    counts = e.select("doc_id").distinct().withColumn("n_pages", F.lit(10000))
    return O.section_extent(e, counts).select("seq", "end_page")


@q("""
WITH n AS (SELECT n_regionkey AS doc, 1 AS level, CAST(sum(c_custkey) AS BIGINT) AS size FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey
  UNION ALL SELECT n_regionkey, 2, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000
  UNION ALL SELECT n_regionkey, 3, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0),
d AS (SELECT doc, max(level) AS deepest FROM n GROUP BY doc),
c AS (SELECT doc, deepest, unnest(generate_series(2, deepest)) AS cand FROM d),
j AS (SELECT c.doc, cand, (SELECT count(*) FROM n WHERE n.doc = c.doc AND level <= cand) <= 10
        OR (SELECT list_sort(list(size))[len(list(size)) // 2 + 1] FROM n WHERE n.doc = c.doc AND level <= cand - 1) > 15000 AS go FROM c)
SELECT d.doc, CAST(coalesce(min(CASE WHEN NOT go THEN cand END) - 1, any_value(deepest)) AS INTEGER) AS depth FROM d JOIN j ON d.doc = j.doc GROUP BY d.doc
""")
def q_display_depth(spark, sf_dir):
    """How deep the tree of each region is shown."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    doc = F.col("n_regionkey").alias("doc")
    nodes = (
        c.groupBy(doc, "n_nationkey").agg(F.sum("c_custkey").alias("size")).select("doc", F.lit(1).alias("level"), "size")
        .union(c.filter("c_acctbal > 9000").select(doc, F.lit(2), "c_custkey"))
        .union(c.filter("c_acctbal < 0").select(doc, F.lit(3), "c_custkey"))
    )
    return O.display_depth(nodes, ["doc"])


@q("""
SELECT conv_id, turn, 'S' || (conv_id + 1) || CASE WHEN n > 0 THEN '.' || n ELSE '' END AS section
FROM (SELECT *, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
""")
def q_slide_section(spark, sf_dir):
    """Turns are slides, user turns open the parts of a deck."""
    t = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "role",
        F.concat(F.lit("S"), (F.col("conv_id") + 1).cast("string")).alias("deck_key"))
    parts = t.filter("role = 'user'").select("doc_id", F.col("page").alias("seq"), "page")
    return O.slide_sections(t.drop("role"), parts).select(F.col("doc_id").alias("conv_id"), F.col("page").alias("turn"), "section")


@q("""
WITH l AS (SELECT DISTINCT source, doc_id, line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
d AS (SELECT source, count(*) AS n FROM (SELECT DISTINCT source, doc_id FROM l) GROUP BY source)
SELECT l.source, line, count(*) AS pages FROM l JOIN d USING (source) WHERE n >= 5 GROUP BY l.source, line, n HAVING count(*) >= 0.04 * n
""")
def q_furniture(spark, sf_dir):
    """Lines on at least 4 % of the documents of a source."""
    lines = table(spark, sf_dir, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return L.furniture(lines, ["source"], page="doc_id", share=0.04)


@q(r"""
WITH s AS (SELECT source, doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS x FROM documents),
n AS (SELECT source AS doc_id, doc_id * 2 AS page, array_to_string(x, chr(10)) AS text FROM s WHERE len(x) > 0)
SELECT * FROM n
""")
def q_clean_slides(spark, sf_dir):
    """Documents of a source as slides under a header and over two footers, with
    an outline slide after some; the slides come back clean, the outlines go."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    outline = docs.select(F.col("source").alias("doc_id")).distinct().withColumn(
        "title", F.explode(F.array(F.lit("1. First part"), F.lit("2. Second part"))))
    slide = F.struct((F.col("doc_id") * 2).alias("page"), F.col("text"))
    outline_slide = F.struct((F.col("doc_id") * 2 + 1).alias("page"), F.lit("Outline\nFirst part\n2. Second  part").alias("text"))
    docs = docs.select("source", "doc_id", F.explode(F.when(F.col("doc_id") % 7 == 3, F.array(slide, outline_slide)).otherwise(F.array(slide))).alias("s"))
    docs = docs.select("source", F.col("s.page").alias("doc_id"), F.col("s.text").alias("text"))
    body = F.col("text")
    framed = F.concat_ws("\n", F.concat(F.lit("Deck "), "source"), body, F.lit("First  part"), F.col("source"),
                         F.concat(F.col("doc_id").cast("string"), F.lit(" / 9999")))
    pages = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), framed.alias("text"))
    return L.clean_slides(pages, outline).select("doc_id", "page", F.array_join("lines", "\n").alias("text"))


@q("""
WITH s AS (SELECT conv_id, turn, unnest(generate_series(1, len(x))) AS i, x FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS x FROM conversations)),
t AS (SELECT conv_id, turn * 1000 + i AS page, turn, array_to_string(x[1:i], chr(10)) AS text FROM s),
n AS (SELECT *, lead(page) OVER w AS np, lead(turn) OVER w AS nt, lead(text) OVER w AS nx FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY page))
SELECT conv_id, CAST(page AS BIGINT) AS page, text FROM n WHERE NOT coalesce(np = page + 1 AND nt = turn AND starts_with(nx, text), false)
""")
def q_drop_overlay(spark, sf_dir):
    """Each turn shown line by line, one slide per step; the complete slide stays."""
    lines = F.split("text", "\n")
    steps = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.explode(F.transform(lines, lambda x, i: F.struct(
            (F.col("turn") * 1000 + i + 1).alias("page"), F.array_join(F.slice(lines, F.lit(1), i + 1), "\n").alias("text")))).alias("s"))
    slides = steps.select("conv_id", "s.page", F.col("turn").cast("string").alias("name"), "s.text")
    return L.drop_overlay(slides, ["conv_id"]).select("conv_id", "page", "text")


@q("""
WITH r AS (SELECT p_brand AS course, p_name || ' ' || p_partkey AS name, CASE WHEN p_size > 45 THEN NULL ELSE p_size END AS n FROM part),
i AS (SELECT *, row_number() OVER (PARTITION BY course ORDER BY n IS NULL, n, name) AS i FROM r)
SELECT course, name, CAST(i + coalesce(max(n - i) OVER (PARTITION BY course ORDER BY i), 0) AS INTEGER) AS number FROM i
""")
def q_number_decks(spark, sf_dir):
    """F8: parts of a brand as decks numbered by size; missing and repeated numbers move up."""
    decks = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("course"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"),
        F.when(F.col("p_size") <= 45, F.col("p_size")).alias("number"))
    return L.number_decks(decks).select("course", "name", "number")


@q("""
WITH RECURSIVE l AS (
  SELECT l_orderkey AS k, l_linenumber AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) AS i FROM lineitem),
f AS (
  SELECT k, 0::BIGINT AS i, 0 AS prev, false AS keep FROM (SELECT DISTINCT k FROM l)
  UNION ALL
  SELECT l.k, l.i, CASE WHEN l.v - f.prev BETWEEN 1 AND 3 THEN l.v ELSE f.prev END, l.v - f.prev BETWEEN 1 AND 3
  FROM f JOIN l ON l.k = f.k AND l.i = f.i + 1)
SELECT k AS l_orderkey, i AS pos, prev AS last FROM f WHERE keep
""")
def q_monotone(spark, sf_dir):
    """line numbers of an order by ship date, accepted while they go up by 1 to 3."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("last"), "l_shipdate", "l_partkey", "l_suppkey")
    pos = scan(lines, ["l_orderkey"], ["l_shipdate", "l_partkey", "l_suppkey", "last"], pos=row_number())
    return C.monotone(pos.select("l_orderkey", "pos", "last"), ["l_orderkey"])


@q("""
SELECT conv_id AS doc_id, turn AS page, sum(CASE WHEN role IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS part, role AS number
FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev,
        count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
QUALIFY count(*) FILTER (WHERE role IS DISTINCT FROM prev) OVER (PARTITION BY conv_id) >= 2
UNION ALL
SELECT conv_id, turn, 1, NULL FROM (SELECT *, min(role) OVER (PARTITION BY conv_id) = max(role) OVER (PARTITION BY conv_id) AS same FROM conversations) WHERE same
""")
def q_split_documents(spark, sf_dir):
    """A turn opens a part when its role differs from the turn before."""
    pages = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.lit("course").alias("first_line"), F.col("role").alias("number"))
    return T.split_documents(pages)
