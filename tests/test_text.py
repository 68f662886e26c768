import datetime

import pytest
from pyspark.sql import functions as F

from notespark.functions import keys, predicates as P, text as X


@pytest.fixture(scope="module")
def one(spark):
    frame = spark.range(1)

    def run(*cols):
        row = frame.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
        return row[0] if len(cols) == 1 else tuple(row)

    return run


@pytest.mark.parametrize("raw,want", [
    ("o\x1ben", "offen"), ("Gauÿ", "Gauß"), ("L¨osung", "Lösung"), ("F ̈ur", "Für"),
    ("x", "x"), ("ﬁnd", "find"), ("a\x00b", "ab"), ("o\x1b\x1c ", "off "), ("o\x1b\x1cx", "offfix"),
    ("\x1b\n", "\n"), ("¨w", "ẅ"), ("a\tb\nc", "a\tb\nc"), (None, None),
])
def test_normalize(one, raw, want):
    assert one(X.normalize(F.lit(raw).cast("string"))) == want


def test_fix_diaeresis_alone(one):
    assert one(X.fix_diaeresis(F.lit("F ̈ur L¨osung"))) == "Für Lösung"


def test_page_number_and_footer(one):
    assert one(X.drop_page_number(F.lit("a\nb\n 2 \n"), F.lit(2))) == "a\nb\n"
    assert one(X.drop_page_number(F.lit("a\nb\n3\n"), F.lit(2))) == "a\nb\n3\n"
    assert one(X.strip_footer(F.lit("x\n Seite 1 von 2 \ny"))) == "x\ny"


def test_titles_and_slugs(one):
    assert one(X.slug(F.lit("  Höhere Mathe 2! "))) == "h-here-mathe-2"
    assert one(X.slug(F.lit("???"))) == "course"
    assert one(X.slug(F.lit("???"), "x")) == "x"
    assert one(X.clean_title(F.lit("2.3  Bipartite\n graphs"))) == "Bipartite graphs"
    assert one(X.plain_title(F.lit("1. Course – of – Values"))) == "courseofvalues"
    assert one(X.join_title(F.lit("Un-\nteraufgaben  x"))) == "Unteraufgaben x"
    assert one(X.squash(F.lit("  A\n b "))) == "a b"


def test_readable(one):
    text = "Sei f eine Ab-\nbildung\nund g.\na) Zeige\nb) Finde\n\n\nZweiter\nAbsatz"
    assert one(X.readable(F.lit(text))) == (
        "Sei f eine Abbildung und g.\na) Zeige\nb) Finde\n\nZweiter Absatz")


def test_trigrams(one):
    assert set(one(X.trigrams(F.lit("Lösung ab")))) == {"los", "osu", "sun", "ung", "ng ", "g a", " ab"}
    assert one(X.trigrams(F.lit("ab"))) == []


@pytest.mark.parametrize("name,want", [
    ("Folien-1.pdf", "Folien.pdf"), ("a (2).pdf", "a.pdf"), ("a(2).pdf", "a.pdf"),
    ("a.pdf", None), ("Blatt_1.pdf", None), ("x-3", "x"),
])
def test_base_name(one, name, want):
    assert one(X.base_name(F.lit(name))) == want


@pytest.mark.parametrize("stem,want", [
    ("01x1", 1), ("03-opt", 3), ("lecture12", 12), ("MachineLearning-Theory-Lec06_FreeEnergies_v2", 6),
    ("Evolution3", 3), ("TheoryLec06b7", 6), ("Evo3x9", 9), ("intro", None), ("Kapitel 4 v2", 4),
])
def test_deck_number(one, stem, want):
    assert one(X.deck_number(F.lit(stem))) == want


def test_sheet_number(one):
    assert one(X.sheet_number(F.lit("PS\n3. Übungsblatt"), F.lit("x7"))) == 3
    assert one(X.sheet_number(F.lit("BLATT 12"), F.lit("x7"))) == 12
    assert one(X.sheet_number(F.lit("nothing"), F.lit("a1-b07"))) == 7
    assert one(X.sheet_number(F.lit("y" * 400 + " Blatt 2"), F.lit("q"))) is None


def test_references(one):
    refs = one(X.script_refs(F.lit("Lösen Sie Aufgabe (1.1) vom Skriptum und Übungsaufgabe 2.3 im Skrip-\ntum")))
    assert refs == ["1.1", "2.3"]
    got = one(X.lone_ref(F.lit("Exercise 11.1\n\nScripts. Presentation of programming")))
    assert (got["refs"], got["text"]) == (["11.1"], "Exercise 11.1")
    got = one(X.lone_ref(F.lit("Exercise 2.4 shows that\nmore")))
    assert got["refs"] == []
    assert one(X.discussion_date(F.lit("Besprechung am: 26. 5. 2026 (HS)"))) == "26. 5. 2026 (HS"


def test_subparts(one):
    got = one(X.subparts(F.lit("Sei G.\na) Zeige A\n(b) Zeige B\n iv) Ende")))
    assert [(p["label"], p["text"]) for p in got] == [("a", "Zeige A"), ("b", "Zeige B"), ("iv", "Ende")]
    assert one(X.subparts(F.lit("only a) x"))) == []
    assert one(X.preamble(F.lit("Sei G.\na) Zeige A\n(b) Zeige B"))) == "Sei G."


@pytest.mark.parametrize("body,want", [
    ("Produkttopologie: Es sei X ein Raum.", "Produkttopologie"),
    ("Konvexe Funktionen.\nSei f konvex.", "Konvexe Funktionen"),
    ("Sei G eine Gruppe. Zeige", None),
    ("Erwartungstreue\nSeien X und Y", "Erwartungstreue"),
    ("Maximum-Likelihood-Estimator (MLE) vs. Bayes: Let", "Maximum-Likelihood-Estimator (MLE) vs. Bayes"),
    ("Radiale Lösungen der Wellengleichung in d = 3: Es", "Radiale Lösungen der Wellengleichung in d = 3"),
    ("Formel x = y.\nSei", None),
    ("(Hermite-Interpolation). Es sei", "Hermite-Interpolation"),
    ("Kompakte Intervalle sind kompakt: Zeige", "Kompakte Intervalle sind kompakt"),
    ("", None),
])
def test_guess_title(one, body, want):
    assert one(P.guess_title(F.lit(body))) == want


@pytest.mark.parametrize("score,ten,word", [
    (0.0, 1.0, "routine"), (0.5, 2.5, "routine"), (1.49, 5.5, "short"), (2.5, 8.5, "medium"),
    (3.0, 10.0, "hard"), (9.0, 10.0, "hard"), (-1.0, 1.0, "routine"),
])
def test_effort(one, score, ten, word):
    assert one(X.effort_ten(F.lit(score)), X.effort_word(F.lit(score))) == (ten, word)


def test_keys(spark, one):
    rows = spark.createDataFrame([(k,) for k in ["10", "2", "2.10", "2.9", "S1", "Z1"]], "k string")
    got = [r.k for r in rows.orderBy(keys.sort_key(F.col("k"))).collect()]
    assert got == ["2", "2.9", "2.10", "10", "S1", "Z1"]
    assert one(keys.covers(F.lit("3"), F.lit("3.1.2")), keys.covers(F.lit("3"), F.lit("30"))) == (True, False)
    assert one(keys.ancestors(F.lit("3.1.2"))) == ["3", "3.1", "3.1.2"]
    assert one(keys.num_prefix(F.lit("2.2.6")), keys.num_prefix(F.lit("2")), keys.last_part(F.lit("2.16"))) == ("2.2", None, 16)


def test_section_label(one):
    n = F.lit(None).cast("string")
    lab = keys.section_label
    assert one(lab(F.lit("3.1"), F.lit("Konvex"), n)) == "3.1 Konvex"
    assert one(lab(F.lit("S1.3"), F.lit("Rec"), F.lit("Lecture 1"))) == "Lecture 1 · Rec"
    assert one(lab(F.lit("Z1.2.3"), F.lit("Bed"), F.lit("Stoch"))) == "Stoch · 2.3 Bed"
    assert one(lab(F.lit("Z1"), n, n)) == "Z1"


def test_predicates(one):
    assert one(P.is_referral(F.lit("Siehe Aufgabe (3.4).")), P.is_referral(F.lit("Übungen")),
               P.is_referral(F.lit("Sei x"))) == (True, True, False)
    assert one(P.is_styled(F.lit("CMBX10"), F.lit(4)), P.is_styled(F.lit("CMCSC10"), F.lit(4)),
               P.is_styled(F.lit("CMR10"), F.lit(4)), P.is_styled(F.lit("CMR10"), F.lit(18))) == (True, True, False, True)
    assert one(P.styled_type_word(F.lit("Definition7.4.4")), P.styled_type_word(F.lit("Definitionen"))) == ("Definition", None)
    assert one(P.kind_of(F.lit("Slide"), F.lit("Lemma (x)")), P.kind_of(F.lit("Satz"), F.lit(None).cast("string"))) == ("result", "result")


@pytest.mark.parametrize("stem,page,n,want", [
    ("07-Blatt-PS-Opt", "", 2, ("sheet", "Opt", 0.7)),
    ("A03", "", 2, ("sheet", "A03", 0.6)),
    ("VO3_Optimierung", "", 200, ("script", "VO3 Optimierung", 0.7)),
    ("foo", "Aufgaben zur Algebra 1 \nx", 1, ("sheet", "Algebra 1", 0.95)),
    ("foo", "Skriptum zur Vorlesung\n Algebra\n", 1, ("script", "Algebra", 0.95)),
    ("foo", "Aufgabe 1 Aufgabe 2 Besprechung", 9, ("sheet", "foo", 0.5)),
    ("123", "Kurz\nmehr", 40, ("script", "Kurz", 0.35)),
    ("foo", "", 7, ("unknown", "foo", 0.2)),
])
def test_classify(one, stem, page, n, want):
    got = one(P.classify(F.lit(stem), F.lit(page), F.lit(n)))
    assert (got["doc_type"], got["course_guess"], got["confidence"]) == want


def test_a_normalised_text_is_worked_out_once(spark):
    """what a text is made of stands once in the plan, not once per look at it."""
    df = spark.createDataFrame([("a ﬁ", 1), (None, 2), ("¨uber", 3)], "t string, i int")
    out = df.select("i", X.normalize(F.replace(F.col("t"), F.lit("#"), F.lit("+"))).alias("t"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("replace(t") == 1
    assert sorted((r["i"], r["t"]) for r in out.collect()) == [(1, "a fi"), (2, None), (3, "über")]


def test_trigram_numbers_differ(spark):
    """Trigrams travel as numbers, which stand for one trigram each."""
    letters = "abcdefghijklmnopqrstuvwxyz "
    grams = spark.createDataFrame([(a + b + c,) for a in letters for b in letters for c in letters], "g string")
    assert grams.select(F.countDistinct(F.hash("g").bitwiseAND(0x7FFFFFFF))).first()[0] == 27 ** 3
    codes = grams.sparkSession.createDataFrame([("abcabc",)], "t string").select(X.trigram_codes(F.col("t")).alias("c")).first()["c"]
    assert len(set(codes)) == len(codes) == 3 and min(codes) >= 0
