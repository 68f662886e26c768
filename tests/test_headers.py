import pytest
from pyspark.sql import functions as F

from notespark.operators import headers as H
from notespark import scan as S
from notespark.plans.knowledge import extract_entries


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(params=["windows", "runs"])
def both_ways(spark, request):
    """Every test below runs with plain windows and with split keys."""
    spark.conf.set(S.GROUP_ROWS_SETTING, "2000000" if request.param == "windows" else "2")
    yield
    spark.conf.unset(S.GROUP_ROWS_SETTING)


PAGES = "doc_id string, page int, text string"
STYLED = "doc_id string, page int, seq int, word string"


def styled_of(spark, spec):
    return spark.createDataFrame(
        [(d, p, i, w) for (d, p), ws in spec.items() for i, w in enumerate(ws)], STYLED)


def test_blocks_with_rejected_header(spark, both_ways):
    text = "\n".join(["Definition 1.1.1 (Halbraum).", "A set H.", "Satz 1.1.2. Sei H konvex.",
                      "Beweis. Klar.", "Satz 1.1.2 zeigt dies."])
    pages = spark.createDataFrame([("d", 1, text)], PAGES)
    styled = styled_of(spark, {("d", 1): ["Definition", "Satz", "Beweis"]})
    entries, rejected = extract_entries(pages, styled)
    assert rows(entries, "type", "number", "name", "text", "proof") == [
        ("Definition", "1.1.1", "Halbraum", "A set H.", None),
        ("Satz", "1.1.2", None, "Sei H konvex.", "Klar.\nSatz 1.1.2 zeigt dies."),
    ]
    assert rows(rejected, "doc_id", "rejected") == [("d", 1)]


def test_blocks_over_pages_boundaries_and_named_proofs(spark, both_ways):
    pages = spark.createDataFrame([
        ("d", 1, "intro\nLemma 1.1\nfirst\n"), ("d", 2, "still first\nProof. one\n"),
        ("d", 3, "more\nReferences\nbook\n"), ("d", 4, "book 2\nBeweis von Satz 9.9. dropped\n"),
        ("d", 5, "1.2.5 Proposition. SO(3)\nProof.\nlast\nSketch of proof. wins\n1.1.5 Problem. x"),
        ("e", 1, "Definition\n2.3 (A\nB). wrapped"),
    ], PAGES)
    styled = styled_of(spark, {("d", 1): ["Lemma"], ("d", 2): ["Proof"],
                               ("d", 5): ["Proposition", "Proof", "Sketch"], ("e", 1): ["Definition"]})
    entries, rejected = extract_entries(pages, styled)
    assert rows(entries, "doc_id", "type", "number", "page", "text", "proof") == [
        ("d", "Lemma", "1.1", 1, "first\n\nstill first", "one\n\nmore"),
        ("d", "Proposition", "1.2.5", 5, "SO(3)", "wins"),
        ("e", "Definition", "2.3", 1, "wrapped", None),
    ]
    assert rows(entries.filter("doc_id = 'e'"), "name") == [("A\nB",)]
    assert rows(rejected, "doc_id", "rejected") == [("d", 0), ("e", 0)]


def test_combined_type_takes_an_adjacent_pair(spark):
    text = "Bemerkung/Beispiel 1.1\na\nBemerkung 1.2\nb\nBeispiel 1.3\nc\nBemerkung 1.4\nd"
    pages = spark.createDataFrame([("d", 1, text)], PAGES)
    styled = styled_of(spark, {("d", 1): ["Bemerkung", "Bemerkung", "Beispiel", "Beispiel"]})
    entries, rejected = extract_entries(pages, styled)
    assert rows(entries, "type", "number") == [
        ("Beispiel", "1.3"), ("Bemerkung", "1.2"), ("Bemerkung/Beispiel", "1.1")]
    assert rows(rejected, "rejected") == [(1,)]


def test_ids(spark, both_ways):
    entries = spark.createDataFrame(
        [("c", 1, "Definition", "1.16", 45), ("c", 2, "Definition", "1.16", 90),
         ("c", 3, "Definition", "1.16", 90), ("c", 4, "Satz", "1.1", 2)],
        "doc_id string, pos int, type string, number string, page int")
    got = H.set_ids(entries, ["doc_id"])
    assert sorted(rows(got, "pos", F.coalesce(F.col("id"), F.lit("-")))) == [
        (1, "Definition 1.16 (p. 45)"), (2, "Definition 1.16 (p. 90)"),
        (3, "Definition 1.16 (p. 90) #2"), (4, "-")]
    assert rows(got.filter("pos = 4"), H.entry_id()) == [("Satz 1.1",)]


def test_scan_ways_agree(spark):
    import random
    rnd = random.Random(3)
    data = [(rnd.choice("aaab"), i, rnd.choice([None, rnd.randint(0, 9)])) for i in range(200)]
    df = spark.createDataFrame(data, "k string, t int, v int")
    outs = dict(s=S.running_sum(F.col("v")), x=S.running_sum(F.col("v"), inclusive=False), n=S.row_number(),
                l=S.last_value(F.col("v")), le=S.last_value(F.col("v"), inclusive=False),
                f=S.next_value(F.col("v")), p=S.previous(F.col("v")), q=S.following(F.col("v")),
                m=S.running_min(F.col("v")))
    plain = rows(S.scan(df, ["k"], ["t"], **outs), F.to_json(F.struct("*")))
    spark.conf.set(S.GROUP_ROWS_SETTING, "20")
    try:
        assert S.key_sizes(df, ["k"])[0] > 20
        assert rows(S.scan(df, ["k"], ["t"], **outs), F.to_json(F.struct("*"))) == plain
    finally:
        spark.conf.unset(S.GROUP_ROWS_SETTING)
    med = dict(rows(S.upper_median(df.filter("v is not null"), ["k"], "v"), "k", "median"))
    for k in "ab":
        vs = sorted(v for kk, _, v in data if kk == k and v is not None)
        assert med[k] == vs[len(vs) // 2]


def test_headers_of_any_extent(spark):
    texts = {"far": "Satz" + " " * 2100 + "1.1. text", "down": "Satz" + "\n" * 400 + "1.2 (" + "x\n" * 40 + ") go",
             "long": "word " * 3000 + "\nLemma 2.1. A"}
    pages = spark.createDataFrame([(d, 1, t) for d, t in texts.items()], PAGES)
    got = {(r["doc_id"], r["number"]): r for r in H.header_candidates(pages).collect()}
    assert set(got) == {("far", "1.1"), ("down", "1.2"), ("long", "2.1")}
    assert got["down", "1.2"]["match_len"] == len(texts["down"]) - len("go")


def test_headers_inside_a_header(spark):
    """A second match of the same form cannot begin inside the first one, but after it again."""
    text = "Satz 1.1 (see\nSatz 1.2 (b\nSatz 1.3 and more)\nSatz 1.4. Text\nBeweis (of\nBeweis.)\nBeweis."
    pages = spark.createDataFrame([("d", 1, text)], PAGES)
    got = sorted((r["line_no"], r["kind"]) for r in H.header_candidates(pages).collect())
    import re
    want = []
    for kind, pattern in (("numbered", H.NUMBERED), ("proof", H.PROOF)):
        plain = pattern.replace("(?U)", "(?m)").replace(r"\A", "^")
        want += [(text.count("\n", 0, m.start()), kind) for m in re.finditer(plain, text)]
    assert got == sorted(want)


def test_texts_are_matched_once(spark, tmp_path):
    """What reads the candidates reads a narrow table: neither the page texts nor, where no match
    runs over several lines, a shuffle."""
    where = str(tmp_path / "pages")
    spark.createDataFrame([("d", p, "Satz 1.1. A\nBeweis. B\n" + "more " * 100) for p in range(20)], PAGES).write.parquet(where)
    cands = H.header_candidates(spark.read.parquet(where))
    assert cands.count() == 40
    assert not [f for f in cands.inputFiles() if where in f]


def test_cut_lines_read_as_whole_ones(spark):
    """What is cut from a long line or a few of them never decides a header."""
    import random
    rnd = random.Random(5)
    parts = ["Satz", " 1.1", "1.1.2 Lemma. ", " (", ")", "Beweis", ".", " " * 260, "7" * 260, "Index", "\u2003" * 90, "\n", "a" * 79, "b" * 151, "\u4e2d" * 160,
             " von Lemma 2.3", "References ", "1.2 Exercises", "x y. "]
    starts = ["Satz 1.1", "Lemma 2.3 (", "Beweis", "Index", "References", "1.1.2 Lemma", "1.2 Exercises"]
    texts = [rnd.choice(starts) + "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for _ in range(400)]
    pages = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], PAGES)
    got = rows(H.header_candidates(pages), "page", "line_no", "ord", F.coalesce("name", F.lit("-")), "match_len")
    cut, H.LINE_START = H.LINE_START, 1_000_000
    try:
        assert rows(H.header_candidates(pages), "page", "line_no", "ord", F.coalesce("name", F.lit("-")), "match_len") == got
    finally:
        H.LINE_START = cut
    assert len(got) > 100
    line = "w" * 300 + "."
    assert rows(H.header_lines(spark.createDataFrame([("d", 1, line + "\nx")], PAGES), r"^\S+\.$"), F.split("rest", "\n")[0]) == [(line,)]


def test_text_and_proof_move_once(spark, tmp_path):
    """The last follow-up over pages goes with its statement, without a further look at the texts."""
    where = str(tmp_path / "pages")
    spark.createDataFrame([("d", 1, "Satz 1.1. A\nBeweis. lost\nBeweis. B"), ("d", 2, "b\nIndex\nx"), ("d", 3, "y\nBeweis. C\n"), ("d", 4, "c\nLemma 1.2")],
                          PAGES).write.parquet(where)
    styled = styled_of(spark, {("d", 1): ["Satz", "Beweis", "Beweis"], ("d", 3): ["Beweis"], ("d", 4): ["Lemma"]})
    entries, _ = extract_entries(spark.read.parquet(where), styled)
    assert rows(entries, "number", "text", "proof") == [("1.1", "A", "C\n\nc"), ("1.2", "", None)]
    assert entries._jdf.queryExecution().optimizedPlan().toString().count("split(text") == 1
