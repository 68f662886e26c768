"""Predicates and classifications (Column -> Column)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .text import SUBPART, collapse, join_title, non_empty, rstrip, strip

# --- Fixed values: must equal the documents' conventions for right results ------------
STATEMENT_TYPES = [
    "Definition", "Satz", "Lemma", "Korollar", "Proposition", "Theorem", "Corollary", "Slide",
]
ALGORITHM_TYPES = ["Algorithmus", "Algorithm"]
BOLD_BIT, ITALIC_BIT = 16, 2
SMALL_CAPS_FONT = r"CSC|SmallCaps|Smallcaps|-SC|SC10"
STYLED_TYPE_WORD = (
    r"(?U)^(Definition|Satz|Lemma|Korollar|Proposition|Bemerkung|Beispiel|Algorithmus|Beweis"
    r"|Konstruktion|Theorem|Corollary|Remark|Example|Algorithm|Proof|Exercise|Notation|Claim"
    r"|Construction|Sketch)(?=[\s\d.:]|$)"
)
REFERRAL = r"(?U)^(?:Übung|Übungen|Übungsaufgabe|Aufgabe\s*\d|Siehe|siehe|Exercise|See)\b"
REFERRAL_CHARS = 120
RESULT_SLIDE_TITLES = ["theorem", "lemma", "corollary", "proposition", "satz", "korollar"]
TITLE_END = (
    r"(?<!\bvs)(?<!\bbzw)(?<!\bd\.h)(?<!\bz\.B)(?<!\bi\.e)(?<!\be\.g)(?<!\bca)(?<!\bvgl)"
    r"[.:](?=\s)"
)
NEXT_PART = r"^\(?(?:[a-h]|i{1,3}v?|vi{0,3})[).]"
MATH_CHARS = "=∈∉⊂⊆⊃⊇→←↦≤≥<>|{}[]∀∃^_∗·∑∫∞⩾⩽≠≈×"
MAX_TITLE_CHARS, MAX_TITLE_WORDS = 70, 8
STARTER_WORDS = """
    sei seien es zeigen zeige beweisen beweise bestimmen bestimme berechnen berechne
    gegeben betrachte betrachten wir man für finden finde geben gib lösen löse
    skizzieren skizziere verwenden verwende implementieren implementiere programmieren
    programmiere nehmen überprüfen untersuchen untersuche diagonalisieren interpolieren
    setzen variieren stellen lese lies lesen definieren definiere begründen ermitteln
    vervollständigen versuchen importieren wie was welche ein eine einen der die das
    den dem auf im in an ist sind
    let show prove suppose consider determine find compute calculate we the a an for
    given if write describe use using recall
""".split()
SENTENCE_WORDS = """
    sei seien ist sind gilt gelte hat haben wird werden sie wir man kann können soll
    sollen is are be let we
""".split()
SHEET_NAME_HINTS = ["blatt", "übung", "uebung", "aufgabenblatt", "exercise", "worksheet", "hausaufgabe"]
SCRIPT_NAME_HINTS = ["skript", "skriptum", "vorlesung", "lecture", "script", "notes"]
NAME_NOISE = [
    "blatt", "ps", "vo", "übung", "uebung", "aufgabenblatt", "skript", "skriptum", "lecture",
    "worksheet", "notes", "exercise",
]
SHEET_PHRASE = r"(?U)Aufgaben\s+zur\s+([^\n]+)"
SCRIPT_PHRASE = r"(?U)Skriptum\s+zur\s+Vorlesung\s*\n\s*([^\n]+)"
SCRIPT_PAGES, SHEET_PAGES = 15, 3
REASONS = {
    "sheet_name": "filename matches assignment-sheet pattern",
    "lettered": "filename looks like a lettered sheet id (e.g. A03)",
    "script_name": "filename matches lecture-script pattern",
    "none": "no filename pattern matched",
    "sheet_phrase": "first page contains 'Aufgaben zur <course>'",
    "script_phrase": "first page contains 'Skriptum zur Vorlesung\\n<course>'",
    "weak": "content has multiple 'Aufgabe N' + a discussion date, but no clear course phrase",
    "many_pages": "no filename/content match, but {n} pages strongly suggests a script",
    "few_pages": "no filename/content match, but only {n} page(s) suggests a sheet",
    "first_line": "; course guessed from first line of text (low confidence)",
}
# ---------------------------------------------------------------------------------------


def is_statement(type_: Column, algorithms: Column | bool = False) -> Column:
    switch = F.lit(algorithms) if isinstance(algorithms, bool) else algorithms
    return type_.isin(STATEMENT_TYPES) | (switch & type_.isin(ALGORITHM_TYPES))


def is_algorithm(type_: Column) -> Column:
    return type_.isin(ALGORITHM_TYPES)


def is_styled(font: Column, flags: Column) -> Column:
    font = F.coalesce(font, F.lit(""))
    bold = (flags.bitwiseAND(BOLD_BIT) != 0) | font.rlike(r"Bold|-BX|BX10\z")
    italic = (flags.bitwiseAND(ITALIC_BIT) != 0) | font.rlike(r"Italic|-TI|TI10\z")
    return bold | italic | font.rlike(SMALL_CAPS_FONT)


def styled_type_word(text: Column) -> Column:
    return non_empty(F.regexp_extract(strip(text), STYLED_TYPE_WORD, 1))


def is_referral(proof: Column) -> Column:
    text = collapse(proof)
    return (F.length(text) < REFERRAL_CHARS) & text.rlike(REFERRAL)


def has_proof(proof: Column) -> Column:
    """A proof that is there and is more than a pointer elsewhere."""
    return F.coalesce((proof != "") & ~is_referral(proof), F.lit(False))


def kind_of(type_: Column, name: Column) -> Column:
    title = F.lower(F.coalesce(name, F.lit("")))
    result = reduce(lambda a, b: a | b, [title.startswith(w) for w in RESULT_SLIDE_TITLES])
    slide = F.when(title.startswith("definition"), "definition").when(result, "result").otherwise("other")
    return F.when(type_ == "Slide", slide).when(type_ == "Definition", "definition").otherwise("result")


def matches(id_: Column, name: Column, text: Column, needle: Column) -> Column:
    """Case-insensitive substring search over id, name and text."""
    empty = F.lit("")
    hay = F.concat_ws(" ", id_, F.coalesce(name, empty), F.coalesce(text, empty))
    return F.contains(F.lower(hay), F.lower(F.trim(needle)))


def search(entries: DataFrame, needle: Column, chosen: DataFrame | None = None, earlier: DataFrame | None = None,
           chosen_earlier: DataFrame | None = None) -> DataFrame:
    """(entry columns, part) of the ``entries`` (id, name, text) that match. With ``chosen`` (id) only
    those count; ``earlier`` are tasks of earlier sheets, searched as well, with ``chosen_earlier`` (id) only those chosen."""
    own = entries if chosen is None else entries.join(chosen.distinct(), "id", "left_semi")
    found = own.withColumn("part", F.lit("all" if chosen is None else "chosen"))
    if earlier is not None and chosen_earlier is not None:
        earlier = earlier.join(chosen_earlier.select("id").distinct(), "id", "left_semi").select(*earlier.columns)
    if earlier is not None:
        found = found.unionByName(earlier.withColumn("part", F.lit("earlier")))
    return found.filter(matches(F.col("id").cast("string"), F.col("name"), F.col("text"), needle))


def heading(text: Column, before_colon: Column) -> Column:
    """``text`` as a title if it reads like one, else NULL."""
    def judged(title: Column) -> Column:
        words = F.transform(
            F.split(title, " "), lambda w: F.lower(F.btrim(w, F.lit(",;()")))
        )
        math = F.length(title) - F.length(F.translate(title, MATH_CHARS, ""))
        quota = F.when(before_colon, 1).otherwise(0)
        ok = (
            (title != "")
            & (F.length(title) <= MAX_TITLE_CHARS)
            & (F.size(words) <= MAX_TITLE_WORDS)
            & title.rlike(r"^\p{L}")
            & ~F.concat(title, F.lit(" ")).rlike(r"\A" + SUBPART.replace("^", "", 1).replace("(?Umd)", "(?U)"))
            & ~F.element_at(words, 1).isin(STARTER_WORDS)
            & (math <= quota)
            & (before_colon | ~F.exists(words, lambda w: w.isin(SENTENCE_WORDS)))
        )
        return F.when(ok, title)

    joined = join_title(text)
    bare = F.when(
        joined.startswith("(") & joined.endswith(")"), strip(F.regexp_replace(joined, r"^\(|\)$", ""))
    ).otherwise(joined)
    return F.element_at(F.transform(F.array(bare), judged), 1)


def guess_title(body: Column) -> Column:
    """The heading a task opens with, or NULL."""
    def from_body(text: Column) -> Column:
        head = F.element_at(F.split(text, r"(?U)" + TITLE_END, 2), 1)
        found = text.rlike(r"(?U)" + TITLE_END) & (F.length(head) <= 2 * MAX_TITLE_CHARS)
        colon = F.substring(text, F.length(head) + 1, F.lit(1)) == ":"
        unwrapped = F.regexp_replace(head, r"-\n(?=[a-zäöüß])", "")
        last_line = strip(F.element_at(F.split(unwrapped, "\n"), -1))
        usable = found & (~unwrapped.contains("\n") | (colon & ~last_line.rlike(NEXT_PART)))
        first = F.element_at(F.split(text, "\n", 2), 1)
        rest = F.regexp_replace(
            F.coalesce(F.get(F.split(text, "\n", 2), F.lit(1)), F.lit("")), r"(?U)^\s+", ""
        )
        own_line = (
            (rest != "")
            & (rest.rlike(r"^\p{Lu}") | rest.rlike(NEXT_PART))
            & ~rstrip(first).rlike(r"[,-]$")
        )
        return F.coalesce(
            F.when(usable, heading(unwrapped, colon)), F.when(own_line, heading(first, F.lit(False)))
        )

    return F.element_at(F.transform(F.array(strip(body)), from_body), 1)


def course_from_name(stem: Column) -> Column:
    """Words of a file stem that may name a course."""
    kept = F.filter(
        F.split(stem, r"(?U)[-_\s]+"),
        lambda t: (t != "") & ~F.lower(t).isin(NAME_NOISE) & ~t.rlike(r"(?U)^\d+$"),
    )
    return F.when(F.size(kept) > 0, F.array_join(kept, " "))


def _contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def classify(stem: Column, first_page: Column, n_pages: Column) -> Column:
    """Struct (doc_type, course_guess, confidence, reason) from file name and first page."""
    page = F.coalesce(first_page, F.lit(""))
    low = F.lower(stem)
    sheet_name = _contains_any(low, SHEET_NAME_HINTS) | stem.rlike(r"^\d{1,3}[-_]")
    lettered = stem.rlike(r"^[A-Za-z]\d{1,3}$")
    script_name = _contains_any(low, SCRIPT_NAME_HINTS) | stem.rlike(r"(?i)^VO\d*[-_]")
    sheet_course = F.regexp_extract(page, SHEET_PHRASE, 1)
    script_course = F.regexp_extract(page, SCRIPT_PHRASE, 1)
    weak = (F.size(F.split(page, "Aufgabe ")) > 2) & page.contains("Besprechung")

    def verdict(doc_type, confidence, reason):
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(doc_type).alias("doc_type"),
                        F.lit(confidence).alias("confidence"), reason.alias("reason"))

    def counted(key):
        before, after = REASONS[key].split("{n}")
        return F.concat(F.lit(before), n_pages.cast("string"), F.lit(after))

    v = (
        F.when(sheet_course != "", verdict("sheet", 0.95, REASONS["sheet_phrase"]))
        .when(script_course != "", verdict("script", 0.95, REASONS["script_phrase"]))
        .when(sheet_name, verdict("sheet", 0.7, REASONS["sheet_name"]))
        .when(lettered, verdict("sheet", 0.6, REASONS["lettered"]))
        .when(script_name, verdict("script", 0.7, REASONS["script_name"]))
        .when(weak, verdict("sheet", 0.5, REASONS["weak"]))
        .when(n_pages >= SCRIPT_PAGES, verdict("script", 0.6, counted("many_pages")))
        .when(n_pages <= SHEET_PAGES, verdict("sheet", 0.4, counted("few_pages")))
        .otherwise(verdict("unknown", 0.2, REASONS["none"]))
    )
    named = (
        F.when(sheet_course != "", strip(sheet_course))
        .when(script_course != "", strip(script_course))
        .otherwise(course_from_name(stem))
    )
    first_line = F.element_at(
        F.concat(F.filter(F.transform(F.split(page, "\n"), strip), lambda x: x != ""),
                 F.array(F.lit(""))), 1)
    fallback = (
        named.isNull() & (v["doc_type"] != "unknown")
        & (first_line != "") & (F.length(first_line) <= 60) & ~first_line.endswith(".")
    )
    return F.struct(
        v["doc_type"].alias("doc_type"),
        F.when(fallback, first_line).otherwise(named).alias("course_guess"),
        F.when(fallback, F.least(v["confidence"], F.lit(0.35))).otherwise(v["confidence"]).alias("confidence"),
        F.when(fallback, F.concat(v["reason"], F.lit(REASONS["first_line"]))).otherwise(v["reason"]).alias("reason"),
    )
