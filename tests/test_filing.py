import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from notespark.operators import filing as G
from notespark.sources import files as S, store as T


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


RULES = "course string, course_ord int, category string, cat_ord int, pattern string, pat_ord int"


def test_filing_plan(spark):
    rules = spark.createDataFrame([("Opt", 0, "skript", 0, "VO*_Optimierung.pdf", 0), ("Opt", 0, "blaetter", 2, "*-Blatt.pdf", 0)], RULES)
    names = [("VO4_Optimierung.pdf", 5), ("01-Blatt.pdf", 1), ("01-Blatt-1.pdf", 2), ("cat.png", 3)]
    files = spark.createDataFrame([("d/" + n, n, m, 10, n) for n, m in names], "path string, name string, mtime int, length int, digest string")
    filed = spark.createDataFrame([("Opt", "skript", "lib/VO3_Optimierung.pdf", "VO3_Optimierung.pdf", 10, "old")],
                                  "course string, category string, path string, name string, length int, digest string")
    plan = G.filing_plan(files, filed, G.match_rules(files, rules))
    assert rows(plan, "name", "status", "target", "replaces") == [
        ("01-Blatt-1.pdf", "new", "Opt/blaetter/01-Blatt.pdf", []),
        ("01-Blatt.pdf", "superseded", "Opt/blaetter/01-Blatt.pdf", []),
        ("VO4_Optimierung.pdf", "replace", "Opt/skript/VO4_Optimierung.pdf", ["lib/VO3_Optimierung.pdf"])]
    many = rules.union(spark.createDataFrame([("x", 1, "folien", 1, f"none{i}", i) for i in range(900)], RULES))
    assert rows(G.match_rules(files, many), "name", "pattern") == rows(G.match_rules(files, rules), "name", "pattern")
    twice = rules.union(spark.createDataFrame([("Opt", 7, "folien", 1, "cat.*", 0), ("Opt", 8, "folien", 1, "c[a]t*", 0), ("Any", 9, "folien", 1, "*", 0)], RULES))
    assert rows(G.match_rules(files, twice).filter("name = 'cat.png'"), "course", "course_ord") == [("Any", 9), ("Opt", 7), ("Opt", 8)]
    assert rows(G.filing_summary(plan, files), "status", "n", "moving") == [
        ("ignored", 1, False), ("new", 1, True), ("replace", 1, True), ("superseded", 1, False)]


def test_plan_of_files_that_share_a_path(spark):
    """two downloads of one path are two files with one hit each, not one file with two hits."""
    rules = spark.createDataFrame([("Opt", 0, "skript", 0, "*.pdf", 0)], RULES)
    files = spark.createDataFrame([(1, "d/a.pdf", "a.pdf", 5, 10, "x"), (2, "d/a.pdf", "a.pdf", 3, 11, "y")],
                                  "page_id int, path string, name string, mtime int, length int, digest string")
    filed = spark.createDataFrame([("Opt", "skript", "lib/a.pdf", "a.pdf", 10, "x")],
                                  "course string, category string, path string, name string, length int, digest string")
    plan = G.filing_plan(files, filed, G.match_rules(files, rules))
    assert rows(plan, "path", "status", "replaces") == [("d/a.pdf", "duplicate", ["lib/a.pdf"]), ("d/a.pdf", "replace", ["lib/a.pdf"])]
    assert rows(G.filing_summary(plan, files), "status", "n") == [("duplicate", 1), ("ignored", 0), ("replace", 1)]


FILE, FILED = "path string, name string, mtime int, length int, digest string", "course string, category string, path string, name string, length int, digest string"


@pytest.mark.parametrize("share", [4_000_000, 3])
def test_what_is_replaced_like_brute_force(spark, monkeypatch, share):
    """Lists of random plans: paths of several files and patterns, targets at the place of a filed file of another name."""
    monkeypatch.setattr(G, "LISTED_PATHS", share)
    rng, changed = random.Random(5), 0
    patterns = [("Opt", "skript", "a*.pdf"), ("Opt", "skript", "*1*"), ("Opt", "blaetter", "b*"), ("Alg", "skript", "c*"), ("Alg", "skript", "*2*")]
    rules = spark.createDataFrame([(c, int(c == "Alg"), k, i, p, i) for i, (c, k, p) in enumerate(patterns)], RULES)
    names = [f"{a}{i}{end}.pdf" for a in "abc" for i in range(20) for end in ("", "", "-1")]
    files = spark.createDataFrame([(rng.choice([f"d{rng.randrange(12)}", f"e{i}", None]), rng.choice(names), rng.randrange(9), rng.randrange(200), "x") for i in range(80)], FILE)
    stored = []
    for i in range(40):
        course, kind, _ = rng.choice(patterns)
        name = rng.choice(names)
        other = rng.choice([n for n in names if n[0] == name[0] and n != name])
        stored.append((course, kind, rng.choice([f"lib/{i}, {name}", f"{course}/{kind}/{other}"]), name, rng.randrange(200), "x"))
    filed = spark.createDataFrame([x for i, x in enumerate(stored) if x[2] not in {y[2] for y in stored[:i]}], FILED)
    hits = G.match_rules(files, rules)
    judged = G._judged(files, filed, hits).collect()
    held = filed.collect()
    lists = {r["path"]: set() for r in judged if r["path"]}
    for r in judged:
        if r["path"] and r["status"] == "replace":
            lists[r["path"]].add(r["target"])
        if r["path"] and r["category"] == "skript" and r["status"] in ("new", "replace"):
            fit = [f["path"] for f in held if (f["course"], f["category"]) == (r["course"], r["category"]) and fnmatch.fnmatchcase(f["name"], r["pattern"])]
            changed += r["status"] == "new" and r["target"] in fit
            lists[r["path"]] |= {f for f in fit if f != r["target"]}
    want = sorted(((r["path"] or "", r["name"], r["target"], "replace" if r["status"] == "new" and lists.get(r["path"]) else r["status"],
                    sorted(lists.get(r["path"], ()))) for r in judged))
    plan = G.filing_plan(files, filed, hits)
    assert changed and rows(plan.withColumn("path", F.coalesce("path", F.lit(""))), "path", "name", "target", "status", "replaces") == want
    joined = G.filing_plan(files, filed, hits, joined="|").withColumn("path", F.coalesce("path", F.lit("")))
    assert rows(joined, "path", "name", "target", "status", "replaces") == [(*w[:4], "|".join(w[4])) for w in want]
    assert rows(G.filing_status(files, filed, hits), "name", "target", "status") == rows(plan, "name", "target", "status")


@pytest.mark.parametrize("what", ["plan", "summary"])
def test_pairs_of_new_and_filed_scripts_do_not_travel(spark, what):
    """1,500 new scripts replace 1,500 filed ones each; what is shuffled does not grow with the product."""
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        every = [files.apply(i) for i in range(files.size())]
        return {f.getName(): f.length() for f in every if f.getName().startswith("shuffle_")}

    rules = spark.createDataFrame([("Opt", 0, "skript", 0, "*.pdf", 0)], RULES)
    named = spark.range(1500).withColumn("name", F.concat(F.lit("a"), "id", F.lit(".pdf")))
    files = named.select(F.concat(F.lit("d/"), "name").alias("path"), "name", F.lit(1).alias("mtime"), F.lit(1).alias("length"), "name")
    files = files.toDF(*"path name mtime length digest".split())
    filed = named.select(F.lit("Opt").alias("course"), F.lit("skript").alias("category"), F.concat(F.lit("lib/"), "name").alias("path"),
                         F.concat(F.lit("b"), "name").alias("name"), F.lit(1).alias("length"), F.lit("").alias("digest"))
    before, hits = shuffled(), G.match_rules(files, rules)
    if what == "plan":
        plan = G.filing_plan(files, filed, hits)
        assert plan.select(F.sum(F.size("replaces"))).first()[0] == 1500 * 1500
    else:
        plan = G.filing_status(files, filed, hits) if hasattr(G, "filing_status") else G.filing_plan(files, filed, hits)
        assert rows(G.filing_summary(plan, files), "status", "n") == [("ignored", 0), ("replace", 1500)]
    assert sum(size for name, size in shuffled().items() if name not in before) < 1_000_000


def test_content_of_files_that_share_a_path(spark):
    """a hit counts once for every first page of its path that is accepted."""
    hits = spark.createDataFrame([(1, "a", "Fr"), (2, "a", "Fr"), (3, "b", "En"), (4, "b", "En"), (5, "c", "En")], "page_id int, path string, course string")
    pages = spark.createDataFrame([("a", "Le  mot"), ("a", "rien"), ("b", "x"), ("b", "y")], "path string, text string")
    asks = spark.createDataFrame([("Fr", "le mot"), ("Fr", "mot")], "course string, text string")
    assert rows(G.content_matches(hits, pages, asks), "page_id") == [(1,), (2,), (3,), (3,), (4,), (4,), (5,)]


def test_globs_like_the_standard_library(spark):
    patterns = ["a[?].pdf", "a[*]", "[]]b", "[!]]b", "a[]]b", "a[b", "[z-a]x", "[!z-a]x", "[a-c-]?", "[^a]b", "[&&a]", "[\\\\]a", "*.*", "**", "?", "",
                "[[]a", "a-[!0-9]*", "x{1}", "(a|b)+$^.", "[ä-ü]*"]
    names = ["a?.pdf", "ax.pdf", "a..pdf", "a*", "ab", "]b", "xb", "a]b", "a[b", "zx", "x", "ax", "b-", "--", "^b", "&", "a", "\\a", "[a", "a-b1", "a-1",
             "x{1}", "(a|b)+$^.", "öl", "", "A]B"]
    cases = [(p, n, fnmatch.fnmatchcase(n.lower(), p.lower())) for p in patterns for n in names]
    df = spark.createDataFrame(cases, "p string, n string, want boolean")
    assert df.filter(F.regexp_like(F.lower("n"), G.glob_to_regex(F.col("p"))) != F.col("want")).collect() == []
    files = spark.createDataFrame([(n,) for n in names], "name string")
    rules = spark.createDataFrame([(p, i, "folien", 1, p, 0) for i, p in enumerate(patterns)], RULES)
    got = {(r["pattern"], r["name"]) for r in G.match_rules(files, rules).collect()}
    assert got >= {(p, n) for p, n, want in cases if want}


def test_globs(spark):
    cases = [("A[1].pdf", "a1.pdf", True), ("a[!1].pdf", "a1.pdf", False), ("a[!1].pdf", "a2.pdf", True), ("a?.pdf", "ab.pdf", True),
             ("a+b*.pdf", "a+b(1).pdf", True), ("a[b.pdf", "a[b.pdf", True), ("*.pdf", "x.pdfs", False)]
    df = spark.createDataFrame(cases, "p string, n string, want boolean")
    assert df.filter(F.regexp_like("n", G.glob_to_regex(F.col("p"))) != F.col("want")).count() == 0


def test_courses_against_loop(spark):
    rnd = random.Random(8)
    words = ["algebra", "algebra 1", "analysis", "lin algebra", "ana", "stoch", "stoch 2 b", "bra", "x1", "x"]
    guesses = [(f"f{i:02}", i, rnd.choice(words)) for i in range(30)]
    known = {"algebra-intro": "Algebra Intro"}
    got = rows(G.resolve_courses(spark.createDataFrame(guesses, "path string, ord int, guess string"),
                                 spark.createDataFrame(list(known.items()), "slug string, course_name string")), "path", "slug")
    seen, want = set(known), []
    for path, _, guess in guesses:
        slug = guess.replace(" ", "-")
        related = sorted((len(k), k) for k in seen if k in slug or slug in k)
        slug = slug if slug in seen or not related else related[0][1]
        seen.add(slug)
        want.append((path, slug))
    assert got == want


def test_a_chain_of_slugs_takes_few_rounds(spark, monkeypatch):
    """200 guesses, each of which is settled by the one before it alone."""
    parts = ["".join("abcdefghijklmnopqrst"[(7 * i + d * d + i // 20 * (d + 1)) % 20] for d in range(6)) + f"{i:03}" for i in range(101)]
    guesses, i = [], 0
    for i in range(100):
        guesses += [parts[i], parts[i] + "-" + parts[i + 1]]
    rows_ = [(f"f{k:03}", k, g) for k, g in enumerate(guesses)]
    rounds = []
    follow = G._follow
    monkeypatch.setattr(G, "_follow", lambda pointers: rounds.append(1) or follow(pointers))
    got = rows(G.resolve_courses(spark.createDataFrame(rows_, "path string, ord int, guess string"),
                                 spark.createDataFrame([], "slug string, course_name string")), "path", "slug")
    seen, want = set(), []
    for path, _, slug in rows_:
        related = sorted((len(k), k) for k in seen if k in slug or slug in k)
        slug = slug if slug in seen or not related else related[0][1]
        seen.add(slug)
        want.append((path, slug))
    assert got == want and len(rounds) <= 10


def test_rules_from_json(spark):
    text = """{"active": "m1", "semesters": {"_note": {}, "m1": {
      "Opt": {"name": "Optimierung", "skript": "VO*.pdf", "blaetter": ["a*", "b*"], "_x": "y", "inhalt": ["Foo"]},
      "Bad": {"skripte": "z"}, "_old": {}}, "b5": {"Ana": {"folien": ["c*"]}}}}"""
    rules, content, rejects = S.rules_from_json(spark.createDataFrame([(text,)], "value string"))
    assert rows(rules, "semester", "course", "category", "pattern", "pat_ord") == [
        ("b5", "Ana", "folien", "c*", 0), ("m1", "Optimierung", "blaetter", "a*", 0), ("m1", "Optimierung", "blaetter", "b*", 1),
        ("m1", "Optimierung", "skript", "VO*.pdf", 0)]
    assert rows(content, "course", "text") == [("Optimierung", "Foo")]
    assert rows(rejects, "folder", "unknown") == [("Bad", ["skripte"])]


def test_files_and_store(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name in ("A1.PDF", "b.txt", "sub/a2.pdf"):
        (tmp_path / "in" / name).write_text(name)
    assert rows(S.scan_files(spark, str(tmp_path / "in"), ["a*.pdf"]), "name", "length") == [("A1.PDF", 6), ("a2.pdf", 10)]
    assert rows(S.scan_files(spark, str(tmp_path / "in"), ["a*.pdf"], recursive=False), "name") == [("A1.PDF",)]
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "course string, v int")
    T.write_store(df, str(tmp_path / "store"), "t")
    T.write_store(df.filter("course = 'y'").withColumn("v", F.lit(9)), str(tmp_path / "store"), "t")
    assert rows(T.read_store(spark, str(tmp_path / "store"), "t"), "course", "v") == [("x", 1), ("x", 2), ("y", 9)]
    assert rows(T.read_store(spark, str(tmp_path / "store"), "t", "x"), "v") == [(1,), (2,)]


def test_ingest_policies(spark):
    src = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "k string, mtime int")
    old = spark.createDataFrame([("a", 4, 6), ("b", 9, 5), ("d", 1, 6)], "k string, mtime int, format int")
    assert rows(T.plan_ingest(src, old, ["k"], 6), "k", "action") == [("a", "read"), ("b", "read"), ("c", "read"), ("d", "delete")]
    assert rows(T.plan_ingest(src, old, ["k"], 5, by_mtime=False, remove_gone=False), "k", "action") == [
        ("a", "skip"), ("b", "skip"), ("c", "read"), ("d", "skip")]
