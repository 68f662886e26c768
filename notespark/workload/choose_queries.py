"""Selections, roll-ups and budgets.

Parts are the statements: a part's type is its course, brand and size give its section
("17.11"), the first word of its name its kind, the second its title.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import budget as B, chains as C, choose as S, lookup as J, outline as O
from ..scan import key_sizes
from . import REGISTRY, table

q = REGISTRY.query

TYPES = {"red": "Definition", "blue": "Satz", "small": "Lemma", "large": "Theorem", "old": "Bemerkung",
         "new": "Slide", "hot": "Algorithmus", "cold": "Beispiel"}

ENTRIES = """
entries AS (
  SELECT p_type AS course, p_partkey AS pos, 'P' || p_partkey AS id,
    CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'Definition' WHEN 'blue' THEN 'Satz' WHEN 'small' THEN 'Lemma' WHEN 'large' THEN 'Theorem'
      WHEN 'old' THEN 'Bemerkung' WHEN 'new' THEN 'Slide' WHEN 'hot' THEN 'Algorithmus' ELSE 'Beispiel' END AS type,
    regexp_extract(p_brand, '(\\d+)', 1) || '.' || p_size AS section, p_size AS page,
    CASE WHEN split_part(p_name, ' ', 2) <> 'bolt' THEN split_part(p_name, ' ', 2) END AS name,
    p_name || ' ' || p_brand AS text,
    CASE split_part(p_name, ' ', 2) WHEN 'gear' THEN 'Siehe Aufgabe 3.' WHEN 'ring' THEN NULL ELSE 'By ' || p_brand || ' and ' || p_type END AS proof,
    split_part(p_name, ' ', 2) AS noun FROM part),
st AS (SELECT *, length(id || CASE WHEN name IS NULL THEN '' ELSE ' (' || name || ')' END || ':' || chr(10) || text) + 1 AS size,
         CASE WHEN proof IS NULL THEN 0 ELSE length(chr(10) || 'Proof: ' || proof) END AS proof_size,
         noun = 'gear' AS referral
       FROM entries WHERE type NOT IN ('Bemerkung', 'Beispiel')),
plain AS (SELECT * FROM st WHERE type <> 'Algorithmus'),
sel AS (
  SELECT DISTINCT course, 'section' AS kind, split_part(section, '.', 1) AS item FROM entries WHERE page = 50
  UNION ALL SELECT course, 'statement', id FROM entries WHERE page BETWEEN 10 AND 12
  UNION ALL SELECT course, 'proof', id FROM entries WHERE page BETWEEN 10 AND 11
  UNION ALL SELECT DISTINCT course, 'proofs', '' FROM entries WHERE course = 'PROMO'
  UNION ALL SELECT DISTINCT course, 'earlier', split_part(section, '.', 1) FROM entries WHERE page = 7),
ch AS (SELECT st.* FROM st WHERE
    (type <> 'Algorithmus' AND EXISTS (SELECT 1 FROM sel WHERE sel.course = st.course AND kind = 'section' AND (st.section = item OR starts_with(st.section, item || '.'))))
    OR EXISTS (SELECT 1 FROM sel WHERE sel.course = st.course AND kind = 'statement' AND item = st.id)),
picked AS (SELECT course, id FROM entries WHERE page >= 20 OR section LIKE '3.%' OR (section LIKE '7.%' AND course = 'LARGE')),
up AS (SELECT *, split_part(section, '.', 1) AS node FROM plain UNION ALL SELECT *, section AS node FROM plain)
"""


def entries(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    kinds = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    noun = words[1]
    return part.select(
        F.col("p_type").alias("course"), F.col("p_partkey").alias("pos"),
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), kinds[words[0]].alias("type"),
        F.concat_ws(".", F.regexp_extract("p_brand", r"(\d+)", 1), F.col("p_size").cast("string")).alias("section"),
        F.col("p_size").alias("page"), F.when(noun != "bolt", noun).alias("name"), F.concat_ws(" ", "p_name", "p_brand").alias("text"),
        F.when(noun == "gear", "Siehe Aufgabe 3.").when(noun != "ring", F.concat(
            F.lit("By "), F.col("p_brand"), F.lit(" and "), F.col("p_type"))).alias("proof"))


def selection(e):
    line = lambda cond, kind, item: e.filter(cond).select("course", F.lit(kind).alias("kind"), item.alias("item"))
    return (
        line("page = 50", "section", K.root(F.col("section"))).distinct()
        .union(line("page between 10 and 12", "statement", F.col("id")))
        .union(line("page between 10 and 11", "proof", F.col("id")))
        .union(line("course = 'PROMO'", "proofs", F.lit("")).distinct())
        .union(line("page = 7", "earlier", K.root(F.col("section"))).distinct())
    )


def picked(e):
    return e.filter("page >= 20 or section like '3.%' or (section like '7.%' and course = 'LARGE')").select("course", "id")


@q(f"""WITH {ENTRIES} SELECT course, section, id, row_number() OVER (PARTITION BY course, section ORDER BY pos) AS member FROM plain""")
def q_section_members(spark, sf_dir):
    """Statements by section."""
    return S.section_members(S.statements(entries(spark, sf_dir)), ["course"]).select("course", "section", "id", "member")


@q(f"""WITH {ENTRIES} SELECT course, id FROM entries WHERE EXISTS (
  SELECT 1 FROM sel WHERE sel.course = entries.course AND kind = 'section' AND (entries.section = item OR starts_with(entries.section, item || '.')))""")
def q_cover(spark, sf_dir):
    """Entries at or beneath a chosen section."""
    e = entries(spark, sf_dir)
    return S.entries_in(e, selection(e).filter("kind = 'section'"), ["course"]).select("course", "id")


@q(f"""WITH {ENTRIES} SELECT course, node, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM up GROUP BY ALL""")
def q_rollup_tree(spark, sf_dir):
    """A4, M3: statements and their size beneath every node."""
    sized = S.with_sizes(S.statements(entries(spark, sf_dir)))
    return S.rollup_tree(sized, ["course"]).select("course", "node", "n", "size")


@q(f"""WITH {ENTRIES}, m AS (SELECT up.*, picked.id IS NOT NULL AS chosen FROM up LEFT JOIN picked USING (course, id))
SELECT course, node, CASE WHEN n_on = 0 THEN 'none' WHEN n_on = n THEN 'all' ELSE 'some' END AS state, n_on || '/' || n AS count, size
FROM (SELECT course, node, count(*) AS n, count(*) FILTER (WHERE chosen) AS n_on, CAST(sum(size) AS BIGINT) AS size FROM m GROUP BY ALL)""")
def q_tri_state(spark, sf_dir):
    """A5: none, some or all of a node chosen."""
    e = entries(spark, sf_dir)
    return S.tri_state(S.with_sizes(S.statements(e)), picked(e), ["course"]).select("course", "node", "state", "count", "size")


@q(f"""WITH {ENTRIES}, m AS (SELECT up.*, picked.id IS NOT NULL AS chosen FROM up LEFT JOIN picked USING (course, id)),
f AS (SELECT course, node FROM m GROUP BY ALL HAVING bool_and(chosen)),
o AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.course = f.course AND starts_with(f.node, g.node || '.')))
SELECT course, 'section' AS kind, node AS item FROM o UNION ALL
SELECT st.course, 'statement', id FROM st JOIN picked USING (course, id) WHERE type = 'Algorithmus' OR NOT EXISTS (
  SELECT 1 FROM o WHERE o.course = st.course AND (st.section = o.node OR starts_with(st.section, o.node || '.')))""")
def q_compress(spark, sf_dir):
    """The fewest sections and single statements that select exactly the picked ids."""
    e = entries(spark, sf_dir)
    return S.compress(e, picked(e)).select("course", "kind", "item")


@q(f"""WITH {ENTRIES} SELECT course, id, row_number() OVER (PARTITION BY course ORDER BY CAST(split_part(section, '.', 1) AS INTEGER), page, pos) AS place FROM ch""")
def q_chosen(spark, sf_dir):
    """Chosen sections and single statements in script order."""
    e = entries(spark, sf_dir)
    got = S.chosen(e, selection(e))
    order = S.script_order()
    keyed = got.select("course", "id", *[c.alias(f"o{i}") for i, c in enumerate(order)])
    return J.merged_order(keyed, ["course"], ["o0", "o1", "o2"]).select("course", "id", "place")


@q(f"""WITH {ENTRIES}, m AS (SELECT ch.*, course = 'PROMO' OR page BETWEEN 10 AND 11 AS proof_on FROM ch),
e AS (SELECT course, count(*) AS earlier FROM sel WHERE kind = 'earlier' GROUP BY course),
s AS (SELECT course, count(*) AS statements, count(*) FILTER (WHERE proof_on AND proof_size > 0 AND NOT referral) AS proofs,
  count(*) FILTER (WHERE proof_size > 0 AND NOT referral) AS with_proof,
  CAST(sum(size + CASE WHEN proof_on THEN proof_size ELSE 0 END) AS BIGINT) AS size FROM m GROUP BY course)
SELECT course, coalesce(statements, 0) AS statements, coalesce(proofs, 0) AS proofs, coalesce(with_proof, 0) AS with_proof,
  coalesce(earlier, 0) AS earlier, coalesce(size, 0) AS size FROM s FULL JOIN e USING (course)""")
def q_totals(spark, sf_dir):
    """What a selection amounts to."""
    e = entries(spark, sf_dir)
    s = selection(e)
    return S.totals(S.with_sizes(S.chosen(e, s)), s, ["course"])


@q(f"""WITH {ENTRIES}, k AS (SELECT *, CASE WHEN type = 'Definition' THEN 'definition' WHEN type = 'Slide' THEN 'other' ELSE 'result' END AS kind FROM ch)
SELECT course, bool_or(kind = 'definition') AS definitions, bool_or(kind = 'result') AS results,
  CASE WHEN bool_or(type = 'Slide') AND bool_or(type <> 'Slide') THEN 'lecture notes and slides' WHEN bool_or(type = 'Slide') THEN 'lecture slides' ELSE 'lecture notes' END AS source_name
FROM k GROUP BY course""")
def q_context_flags(spark, sf_dir):
    """What kinds of statements a context holds."""
    e = entries(spark, sf_dir)
    return S.context_flags(S.chosen(e, selection(e)), ["course"]).select("course", "definitions", "results", "source_name")


@q("""
WITH s AS (SELECT l_orderkey, l_partkey AS id, CASE WHEN l_returnflag = 'A' THEN 'proof' ELSE 'statement' END AS kind, l_discount * 10 AS p FROM lineitem),
b AS (SELECT l_orderkey, id, max(p) FILTER (WHERE kind = 'statement') AS sp, max(p) FILTER (WHERE kind = 'proof') AS pp FROM s GROUP BY ALL)
SELECT l_orderkey, id, sp IS NOT NULL AND (sp >= 0.5 OR coalesce(pp >= 0.7, false)) AS statement, coalesce(pp >= 0.7, false) AS proof FROM b
WHERE (sp IS NOT NULL AND sp >= 0.5) OR coalesce(pp >= 0.7, false)
""")
def q_pick(spark, sf_dir):
    """Lines of an order as scores of statements and proofs, at two thresholds."""
    s = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_partkey").alias("id"), F.when(F.col("l_returnflag") == "A", "proof").otherwise("statement").alias("kind"),
        (F.col("l_discount") * 10).alias("p"))
    return S.pick(s, ["l_orderkey"], 0.5, 0.7)


BUDGET = """
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_shipdate) AS ord FROM lineitem),
i AS (SELECT l_orderkey AS k, ord, l_discount AS p, CAST(l_quantity AS BIGINT) AS cost, 10 AS base FROM o),
t AS (SELECT *, base + sum(cost) OVER (PARTITION BY k) - (sum(cost) OVER (PARTITION BY k ORDER BY p, ord) - cost) <= 100 AS kept FROM i)
"""


def _proofs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    numbered = J.merged_order(li, ["l_orderkey"], ["l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"])
    proofs = numbered.select("l_orderkey", F.col("place").alias("ord"), F.col("l_discount").alias("p"), F.col("l_quantity").cast("bigint").alias("cost"))
    return proofs, li.select("l_orderkey").distinct().withColumn("base", F.lit(10)), key_sizes(li, ["l_orderkey"])


@q(f"WITH {BUDGET} SELECT k AS l_orderkey, ord, cost, kept FROM t")
def q_trim_budget(spark, sf_dir):
    """Lines of an order go by ascending discount until 100 units fit."""
    proofs, base, sizes = _proofs(spark, sf_dir)
    return S.trim(proofs, base, ["l_orderkey"], 100, sizes).select("l_orderkey", "ord", "cost", "kept")


@q(f"""WITH RECURSIVE {BUDGET},
r AS (SELECT k, 100 - any_value(base) - coalesce(sum(cost) FILTER (WHERE kept), 0) AS room FROM t GROUP BY k),
d AS (SELECT k, ord, cost, row_number() OVER (PARTITION BY k ORDER BY p DESC, ord) AS n FROM t WHERE NOT kept),
f AS (SELECT k, 0::BIGINT AS n, room::BIGINT AS room, NULL::BIGINT AS ord, false AS back FROM r
  UNION ALL SELECT d.k, d.n, CASE WHEN d.cost <= f.room THEN f.room - d.cost ELSE f.room END::BIGINT, d.ord, d.cost <= f.room FROM f JOIN d ON d.k = f.k AND d.n = f.n + 1)
SELECT t.k AS l_orderkey, t.ord, t.cost, t.kept OR coalesce(f.back, false) AS kept FROM t LEFT JOIN f ON f.k = t.k AND f.ord = t.ord
""")
def q_trim_refill(spark, sf_dir):
    """And dropped lines return, the most discounted first, where they still fit."""
    proofs, base, sizes = _proofs(spark, sf_dir)
    return S.refill(S.trim(proofs, base, ["l_orderkey"], 100, sizes), ["l_orderkey"], 100, sizes).select("l_orderkey", "ord", "cost", "kept")


@q("""
WITH RECURSIVE d AS (SELECT source, doc_id, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
f AS (SELECT source, doc_id, i, size AS used, 0::BIGINT AS batch FROM d WHERE i = 1
  UNION ALL SELECT d.source, d.doc_id, d.i, CASE WHEN f.used + d.size > 12000 THEN d.size ELSE f.used + d.size END, f.batch + CASE WHEN f.used + d.size > 12000 THEN 1 ELSE 0 END
  FROM f JOIN d ON d.source = f.source AND d.i = f.i + 1)
SELECT source, doc_id, batch FROM f
""")
def q_pack_batches(spark, sf_dir):
    """documents of a source in batches of 12,000 characters."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("n_chars").alias("size"))
    return C.pack_batches(docs, ["source"], 12_000, order="doc_id").select("source", "doc_id", "batch")


@q("""
WITH i AS (SELECT o_custkey, l_orderkey AS task, l_returnflag AS ctx, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey, l_suppkey, l_linenumber, l_shipdate) AS pos,
      CAST(l_quantity AS BIGINT) AS size FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT *, sum(size) OVER (PARTITION BY task, ctx ORDER BY pos) AS ctx_size FROM i),
w AS (SELECT *, sum(size) OVER (PARTITION BY task) - (sum(size) OVER (PARTITION BY task ORDER BY ctx_size DESC, ctx, pos DESC) - size) AS task_size FROM c),
g AS (SELECT *, sum(size) OVER (PARTITION BY o_custkey) - (sum(size) OVER (PARTITION BY o_custkey ORDER BY task_size DESC, task, ctx_size DESC, ctx, pos DESC) - size) AS left_size FROM w)
SELECT task, ctx, pos, size FROM g WHERE left_size <= 600
""")
def q_shrink_to_fit(spark, sf_dir):
    """orders of a customer give up lines, always from the largest group of the largest
    order, until 600 units are left."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    numbered = J.merged_order(li, ["l_orderkey", "l_returnflag"], ["l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"])
    items = numbered.select("o_custkey", F.col("l_orderkey").alias("task"), F.col("l_returnflag").alias("ctx"),
                            F.col("place").alias("pos"), F.col("l_quantity").cast("bigint").alias("size"))
    return B.shrink_to_fit(items, ["o_custkey"], 600).select("task", "ctx", "pos", "size")


@q(f"""WITH {ENTRIES}, w AS (SELECT course, id FROM plain WHERE section LIKE '3.%' OR (section LIKE '5.%' AND course <> 'LARGE')),
a AS (SELECT w.course, bool_and(p.id IS NOT NULL) AS all_on FROM w LEFT JOIN picked p USING (course, id) GROUP BY w.course)
SELECT course, id FROM picked WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.course = picked.course AND w.id = picked.id)
UNION ALL SELECT w.course, w.id FROM w JOIN a USING (course) WHERE NOT all_on""")
def q_toggle(spark, sf_dir):
    """Two nodes toggled in every course; in LARGE all was chosen, so all goes."""
    e = entries(spark, sf_dir)
    ids = S.statements(e).filter("section like '3.%' or (section like '5.%' and course <> 'LARGE')")
    return S.toggle(picked(e), ids, ["course"])


@q(f"""WITH {ENTRIES}, t AS (SELECT course, arg_min(id, pos) AS t FROM st WHERE page = 11 AND proof_size > 0 AND NOT referral GROUP BY course),
s AS (SELECT course, t, course = 'PROMO' AS every, course = 'PROMO' OR EXISTS (SELECT 1 FROM sel WHERE sel.course = t.course AND kind = 'proof' AND item = t) AS is_on FROM t)
SELECT DISTINCT course, kind, item FROM (
  SELECT sel.* FROM sel LEFT JOIN s USING (course) WHERE t IS NULL OR NOT is_on OR NOT ((kind = 'proof' AND item = t) OR (kind = 'proofs' AND every))
  UNION ALL SELECT course, 'proof', t FROM s WHERE NOT is_on UNION ALL SELECT course, 'statement', t FROM s WHERE NOT is_on
  UNION ALL SELECT sel.course, 'proof', item FROM sel JOIN s USING (course) JOIN st ON st.course = sel.course AND st.id = sel.item
    WHERE kind = 'statement' AND every AND item <> t AND proof_size > 0 AND NOT referral)""")
def q_toggle_proof(spark, sf_dir):
    """One proof per course is switched off, in PROMO out of "all proofs"."""
    e = entries(spark, sf_dir)
    sized = S.with_sizes(S.statements(e, True)).filter("proof_size > 0 and not referral")
    target = J.first_by(sized.filter("page = 11").select("course", "id", "pos"), ["course"], F.col("pos"))
    return S.toggle_proof(selection(e), target, sized)


OFF = """
off AS (SELECT course, kind, item FROM sel WHERE (kind = 'section' AND CAST(item AS INTEGER) <= 8) OR (kind = 'statement' AND CAST(substr(item, 2) AS INTEGER) % 3 = 0) OR kind = 'proofs')
"""


def _off(s):
    number = F.substring("item", 2, 20).try_cast("int")
    return s.filter(((F.col("kind") == "section") & (F.col("item").try_cast("int") <= 8))
                    | ((F.col("kind") == "statement") & (number % 3 == 0)) | (F.col("kind") == "proofs"))


@q(f"""WITH {ENTRIES}, {OFF} SELECT * FROM sel WHERE NOT EXISTS (SELECT 1 FROM off WHERE off.course = sel.course AND off.kind = sel.kind AND off.item = sel.item)
  AND NOT (kind = 'proof' AND EXISTS (SELECT 1 FROM off WHERE off.course = sel.course AND off.kind = 'statement' AND off.item = sel.item))""")
def q_off_list(spark, sf_dir):
    """U4: unticked lines leave the selection, a statement with its proof."""
    s = selection(entries(spark, sf_dir))
    return S.apply_off(s, _off(s))


@q(f"""WITH {ENTRIES}, {OFF},
new AS (SELECT course, 'statement' AS kind, id AS item FROM entries WHERE page BETWEEN 11 AND 14),
still AS (SELECT * FROM off WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.course = off.course AND new.kind = off.kind AND new.item = off.item))
SELECT course, kind, item, EXISTS (SELECT 1 FROM still WHERE still.course = m.course AND still.kind = m.kind AND still.item = m.item) AS off FROM (
  SELECT * FROM new UNION SELECT * FROM still
  UNION SELECT still.course, 'proof', still.item FROM still JOIN sel ON sel.course = still.course AND sel.kind = 'proof' AND sel.item = still.item WHERE still.kind = 'statement') m""")
def q_merge_edit(spark, sf_dir):
    """U4: an edit replaces the selection; unticked lines it does not name stay unticked."""
    e = entries(spark, sf_dir)
    s = selection(e)
    new = e.filter("page between 11 and 14").select("course", F.lit("statement").alias("kind"), F.col("id").alias("item"))
    merged, off = S.merge_edit(s, new, _off(s), new.select("course", F.col("item").alias("id")))
    return merged.join(off.withColumn("off", F.lit(True)), ["course", "kind", "item"], "left").withColumn("off", F.coalesce("off", F.lit(False)))


@q("""
WITH a AS (SELECT user_id, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) AS value FROM events WHERE event_type IN ('signup', 'view') GROUP BY user_id),
b AS (SELECT user_id, arg_max(event_type, event_id) AS kind, arg_max(CASE WHEN event_type = 'purchase' THEN value END, event_id) AS value FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(b.kind, a.kind) AS kind, coalesce(b.value, a.value) AS value FROM a FULL JOIN b ON a.user_id = b.user_id
""")
def q_upsert_state(spark, sf_dir):
    """Per user the remembered state, overwritten by the last values that are not NULL."""
    e = table(spark, sf_dir, "events")
    at = F.col("event_id")
    stored = e.filter(F.col("event_type").isin("signup", "view")).groupBy("user_id").agg(F.max_by("event_type", at).alias("kind"), F.max_by("value", at).alias("value"))
    buy = F.when(F.col("event_type") == "purchase", F.col("value"))
    updates = e.filter(F.col("event_type").isin("purchase", "error")).groupBy("user_id").agg(
        F.max_by("event_type", at).alias("kind"), F.max_by(buy, F.when(buy.isNotNull(), at)).alias("value"))
    return S.merge_state(stored, updates, ["user_id"])


@q(f"""WITH {ENTRIES}, new AS (SELECT * FROM sel WHERE NOT (course = 'SMALL' AND item = '7') AND NOT (course = 'PROMO' AND kind = 'proofs'))
SELECT course, count(*) <> (SELECT count(*) FROM new WHERE new.course = sel.course) AS changed FROM sel GROUP BY course""")
def q_selection_changed(spark, sf_dir):
    """Which courses an edit changed."""
    s = selection(entries(spark, sf_dir))
    new = s.filter("not (course = 'SMALL' and item = '7') and not (course = 'PROMO' and kind = 'proofs')")
    return S.selection_changed(s, new, ["course"])


@q(f"""WITH {ENTRIES}, {OFF}, lab AS (SELECT course, id, section, name, text, type, coalesce(name, text) AS a,
   CASE WHEN type = 'Slide' THEN coalesce(name, text) || ': ' || text ELSE coalesce(name, text) END AS about FROM st),
l AS (SELECT *, id || '  ' || CASE WHEN length(about) > 48 THEN left(about, 47) || '…' ELSE about END AS label FROM lab),
items AS (
  SELECT course, kind, item, 'Section ' || item || ' Brand ' || item AS text FROM sel WHERE kind = 'section'
  UNION ALL SELECT s.course, kind, item, coalesce(label, item) || CASE WHEN EXISTS (SELECT 1 FROM sel p WHERE p.course = s.course AND p.kind = 'proof' AND p.item = s.item) THEN '  + proof' ELSE '' END
    FROM sel s LEFT JOIN l ON l.course = s.course AND l.id = s.item WHERE kind = 'statement'
  UNION ALL SELECT course, kind, item, '+ all their proofs' FROM sel WHERE kind = 'proofs'
  UNION ALL SELECT course, kind, item, 'Earlier: ' || item FROM sel WHERE kind = 'earlier')
SELECT items.*, EXISTS (SELECT 1 FROM off WHERE off.course = items.course AND off.kind = items.kind AND off.item = items.item) AS off FROM items""")
def q_selection_items(spark, sf_dir):
    """The selection as lines of text."""
    e = entries(spark, sf_dir)
    s = selection(e)
    nodes = e.select("course", K.root(F.col("section")).alias("key")).distinct().withColumn("title", F.concat(F.lit("Brand "), F.col("key")))
    return S.selection_items(s, e, nodes, _off(s)).select("course", "kind", "item", "text", "off")


@q(f"""WITH {ENTRIES}, items AS (
  SELECT sel.course, kind, item, CASE kind WHEN 'section' THEN 0 WHEN 'statement' THEN 1 WHEN 'proofs' THEN 2 ELSE 3 END AS part,
    CASE WHEN kind = 'section' THEN [CAST(item AS INT)] WHEN kind = 'statement' AND st.id IS NULL THEN [2147483647] WHEN kind = 'statement'
      THEN list_transform(string_split(section, '.'), lambda x: CAST(x AS INT)) ELSE [0] END AS place, coalesce(page, 0) AS page, coalesce(pos, 0) AS pos
  FROM sel LEFT JOIN st ON st.course = sel.course AND st.id = item AND kind = 'statement' WHERE kind <> 'proof')
SELECT course, kind, item, row_number() OVER (PARTITION BY course ORDER BY part, place, page, pos, item) AS ord FROM items""")
def q_selection_order(spark, sf_dir):
    """The place of every line of the selection."""
    e = entries(spark, sf_dir)
    s = selection(e)
    nodes = e.select("course", K.root(F.col("section")).alias("key")).distinct().withColumn("title", F.lit(""))
    return S.selection_items(s, e, nodes, _off(s)).select("course", "kind", "item", "ord")


@q(f"""WITH {ENTRIES}, nodes AS (SELECT course, unnest([split_part(section, '.', 1), section]) AS key FROM entries)
SELECT DISTINCT course, key FROM nodes WHERE EXISTS (SELECT 1 FROM plain WHERE plain.course = nodes.course AND (section = key OR starts_with(section, key || '.')))""")
def q_live_nodes(spark, sf_dir):
    """Nodes with a statement at or beneath them."""
    e = entries(spark, sf_dir)
    nodes = e.select("course", F.explode(K.ancestors(F.col("section"))).alias("key")).distinct()
    return O.live_nodes(nodes, S.statements(e), ["course"])


@q(f"""WITH {ENTRIES} SELECT course, id, CASE WHEN name IS NULL THEN '' ELSE '(' || name || ') ' END || text AS statement, proof IS NOT NULL AND NOT referral AS has_proof FROM plain""")
def q_judgement_items(spark, sf_dir):
    """Every statement as it is asked about, and whether its proof is."""
    return J.judgement_items(S.statements(entries(spark, sf_dir)), ["course"]).select("course", "id", "statement", "has_proof")


@q(f"""WITH {ENTRIES} SELECT course, id, section LIKE '1%' AS slides, section LIKE '2%' AS extra FROM entries WHERE NOT (section LIKE '1%' AND course = 'PROMO') AND NOT (section LIKE '2%' AND course = 'SMALL')""")
def q_switched_off(spark, sf_dir):
    """P5: sections of slides and other scripts that a course switched off are left out."""
    e = entries(spark, sf_dir).withColumn("key", F.when(F.col("section").startswith("1"), F.concat(F.lit("S"), "section")).when(
        F.col("section").startswith("2"), F.concat(F.lit("Z"), "section")).otherwise(F.col("section")))
    off = K.switched_off(F.col("key"), F.col("course") != "PROMO", F.col("course") != "SMALL")
    return e.filter(~off).select("course", "id", K.is_slides(F.col("key")).alias("slides"), K.is_extra(F.col("key")).alias("extra"))


@q(f"""WITH {ENTRIES} SELECT course, id, CASE WHEN section LIKE '1%' THEN 'Root S · ' || 'T' || page WHEN section LIKE '2%' THEN 'Root Z · ' || page || ' T' || page
  ELSE section || ' T' || page END AS label FROM entries""")
def q_section_label(spark, sf_dir):
    """Sections of notes, slides and other scripts by name."""
    key = F.when(F.col("section").startswith("1"), F.concat(F.lit("S"), "section")).when(
        F.col("section").startswith("2"), F.concat(F.lit("Z"), "section")).otherwise(F.col("section"))
    e = entries(spark, sf_dir).withColumn("key", key)
    title = F.concat(F.lit("T"), F.col("page").cast("string"))
    root = F.concat(F.lit("Root "), F.substring("key", 1, 1))
    return e.select("course", "id", K.section_label(F.col("key"), title, root).alias("label"))
