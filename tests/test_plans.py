from pyspark.sql import functions as F

from notespark.operators import lookup as J, tasks as T
from notespark.plans.knowledge import extract_knowledge


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_knowledge_of_two_scripts(spark):
    pages = spark.createDataFrame([("a", 1, "Satz 1.1.1. eins"), ("a", 2, "Satz 1.2.1. zwei\nBeweis. klar"), ("b", 1, "Lemma 3.1.4. drei")],
                                  "doc_id string, page int, text string")
    styled = spark.createDataFrame([("a", 1, 0, "Satz"), ("a", 2, 0, "Satz"), ("a", 2, 1, "Beweis"), ("b", 1, 0, "Lemma")],
                                   "doc_id string, page int, seq int, word string")
    outline = spark.createDataFrame([("a", 1, 1, "1 Kapitel", 1), ("a", 2, 2, "Anfang", 1), ("a", 3, 2, "Ende", 2)],
                                    "doc_id string, seq int, level int, title string, page int")
    entries, nodes = extract_knowledge(pages, styled, outline)
    assert rows(entries, "doc_id", "number", "section", "text", "proof") == [
        ("a", "1.1.1", "1.1", "eins", None), ("a", "1.2.1", "1.2", "zwei", "klar"), ("b", "3.1.4", "3.1", "drei", None)]
    assert rows(nodes, "doc_id", "key", "title") == [
        ("a", "1", "Kapitel"), ("a", "1.1", "Anfang"), ("a", "1.2", "Ende"), ("b", "3", ""), ("b", "3.1", "")]


def test_sheet_records(spark):
    sheets = spark.createDataFrame([("s", "x7", "3. Übungsblatt\nBesprechung am 5. 6.\n Seite 1 von 2\n"), ("t", "x7", "ohne")],
                                   "sheet_id string, stem string, text string")
    assert rows(T.sheet_records(sheets), "sheet_id", "sheet_number", F.coalesce("discussion_date", F.lit("-"))) == [
        ("s", 3, "5. 6."), ("t", 7, "-")]


def test_task_listing(spark):
    tasks = spark.createDataFrame(
        [("c", "s", 0, 1, "Lösen Sie Aufgabe\n(1.1) vom Skriptum", ["1.1"]), ("c", "s", 1, 2, "Konvexe Mengen: Sei C.", ["9.9"])],
        "course string, sheet_id string, pos int, number int, text string, script_references array<string>")
    exercises = spark.createDataFrame([("c", 0, "1.1", "Mengen", "Zeige:\na) eins\nb) zwei", 7), ("c", 1, "1.1", "zweite", "x", 8)],
                                      "course string, pos int, number string, title string, text string, page int")
    efforts = spark.createDataFrame([("s", 1, 1.5)], "sheet_id string, number int, effort double")
    after = spark.createDataFrame([("s", 1, [2])], "sheet_id string, task int, after array<int>")
    got = {r.number: r for r in J.task_listing(tasks, J.resolve_refs(tasks, exercises), efforts, after).collect()}
    one, two = got[1], got[2]
    assert (one.title, one.page, one.effort, one.effort_word, one.after, one.missing) == ("(1.1) Mengen", 7, 5.5, "medium", [2], [])
    assert one.text == "Lösen Sie Aufgabe (1.1) vom Skriptum\n\n(1.1) Zeige:\na) eins\nb) zwei"
    assert one.preamble == "Zeige:" and [(p.label, p.text) for p in one.parts] == [("a", "eins"), ("b", "zwei")]
    assert (two.title, two.page, two.effort, two.effort_word, two.after, two.missing) == ("Konvexe Mengen", None, None, "", None, ["9.9"])


def test_a_document_is_one_text(spark):
    from notespark.plans.assemble import assemble

    rows = spark.createDataFrame([("k", i, f"line {i}") for i in range(2500)], "k string, pos int, text string")
    got = assemble(rows, ["k"], ["pos"]).collect()
    assert [r["text"] for r in got] == ["\n".join(f"line {i}" for i in range(2500))]


def test_judgements_come_in_script_order(spark):
    from notespark.operators.lookup import judgement_items

    rows = [("c", "x", "9", 1, 0, "late", "", None), ("c", "x", "1", 1, 1, "early", "", None)]
    df = spark.createDataFrame(rows, "course string, id string, section string, page int, pos int, text string, name string, proof string")
    assert [r["statement"] for r in judgement_items(df, ["course"]).collect()] == ["early"]


def test_exercise_starts_over_blank_lines(spark):
    from notespark.operators.exercises import extract_exercises

    pages = spark.createDataFrame([("d", 1, "Exercises\nAufgabe\n\n\n1. First\ntext\nAufgabe 2 Second")], "doc_id string, page int, text string")
    nodes = spark.createDataFrame([("d", 0, "1", "Exercises", 1, 1)], "doc_id string, seq int, key string, title string, level int, page int")
    got = sorted((r["number"], r["text"]) for r in extract_exercises(pages, nodes).collect())
    assert got == [("1", "First\ntext"), ("2", "Second")]


def test_a_long_deck_is_no_hot_key(spark):
    """slides meet what repeats in their deck by deck and block of pages, not by deck alone."""
    from notespark.operators import slides as L

    pages = spark.createDataFrame([("d", p, f"Head\nbody {p}\nFoot") for p in (0, 5, 255, 256, 700, 701)] + [("d", None, "Head\nlast\nFoot")],
                                  "doc_id string, page int, text string")
    outline = spark.createDataFrame([("d", "1. Foot")], "doc_id string, title string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        clean = L.clean_slides(pages, outline)
        assert "hashpartitioning(doc_id" in (plan := clean._jdf.queryExecution().executedPlan().toString())
        assert any("__block" in line and "hashpartitioning" in line for line in plan.splitlines())
        assert sorted(r["lines"][0] for r in clean.collect()) == sorted([f"body {p}" for p in (0, 5, 255, 256, 700, 701)] + ["last"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
