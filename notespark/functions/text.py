"""Text clean-up, extraction and cost expressions (Column -> Column)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# --- Fixed values: must equal the documents' conventions for right results ------------
LIGATURES = [("\x1b", "ff"), ("\x1c", "fi"), ("\x1d", "fl"), ("\x1e", "ffi"), ("\x1f", "ffl")]
LETTER = r"[\p{L}\p{Nl}\p{No}]"
WORD_CHAR = r"[\p{L}\p{N}_]"
PRIVATE_OR_CONTROL = r"[\x{E000}-\x{F8FF}\x00-\x08\x0b-\x1f\x7f]"
PAGE_FOOTER = r"(?Umd)^\s*Seite\s+\d+\s+von\s+\d+\s*$\n?"
LEADING_NUMBER = r"(?U)^\d+(?:\.\d+)*\.?\s+"
LIST_ITEM = r"(?U)^(\(?[a-z]\)|\(?[ivx]+\)|\d+[.)]|[•\-–])\s"
COPY_SUFFIX = r"^(.+?)(?: ?\(\d+\)|-\d+)(\.[^.]+)?$"
HEADER_CHARS = 400
SHEET_NUMBER = r"(?iuU)(?:Blatt|Problem Set|Sheet)\s+(\d+)|(\d+)\.\s*Übungsblatt"
DECK_WORDS_LONG = (
    "lectures?|vorlesung|kapitel|chapter|chap|week|woche|unit|einheit|teil|part"
    "|folien|foliensatz|slides?|deck|session"
)
DECK_WORDS_SHORT = "lec|vl|vo|kap|ch"
DISCUSSION_DATE = r"(?U)Besprechung(?:stermin)?(?:\s+am)?:?\s*([^\n)]+)"
SCRIPT_REFERENCE = (
    r"(?U)(?:Programmier|Übungs)?[Aa]ufgabe\s*\(?(\d+(?:\.\d+)?)\)?\s*"
    r"(?:vom|aus\s+dem|im)\s*Skrip(?:-\s*)?t(?:um)?"
)
LONE_REFERENCE = r"(?U)^(?:Exercise|Problem|Aufgabe|Übung)\s+(\d+\.\d+)\.?$"
RUN_IN_HEADING = r"(?Umd)^[A-Z][a-z]+\.\s"
SUBPART = r"(?Umd)^\s*\(?([a-h]|i{1,3}v?|vi{0,3})\)\s"
EFFORT_WORDS = ["routine", "short", "medium", "hard"]
# ---------------------------------------------------------------------------------------

_DAMAGED = r"[\x00-\x08\x0b-\x1f\x7fÿ\x{A8}\x{308}\x{E000}-\x{F8FF}]"
_MARK = "﷐"  # a noncharacter, never part of a text


def strip(c: Column) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+\z", "")


def collapse(c: Column) -> Column:
    """Whitespace runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def non_empty(c: Column) -> Column:
    return F.when(c != "", c)


def fix_ligatures(c: Column) -> Column:
    """OT1 ligature bytes next to a letter. Neighbours are judged on the original text, so
    the hits are marked in one pass and spelled out afterwards."""
    out = F.regexp_replace(
        c, rf"([\x1b-\x1f])(?:(?<={LETTER}[\x1b-\x1f])|(?={LETTER}))", _MARK + "$1"
    )
    for byte, letters in LIGATURES:
        out = F.replace(out, F.lit(_MARK + byte), F.lit(letters))
    return out


def fix_eszett(c: Column) -> Column:
    return F.regexp_replace(c, rf"ÿ(?:(?<={LETTER}ÿ)|(?={LETTER}))", "ß")


def strip_undisplayable(c: Column) -> Column:
    return F.regexp_replace(c, PRIVATE_OR_CONTROL, "")


def _move_diaeresis(c: Column) -> Column:
    """A diaeresis drawn before its letter goes behind it, where composition finds it."""
    c = F.regexp_replace(c, rf" ([\x{{0308}}\x{{00A8}}])(?={WORD_CHAR})", "$1")
    return F.regexp_replace(c, rf"[\x{{0308}}\x{{00A8}}]({WORD_CHAR})", "$1̈")


def fix_diaeresis(c: Column) -> Column:
    out = _move_diaeresis(c)
    for plain, umlaut in zip("aouAOUeiyEIY", "äöüÄÖÜëïÿËÏŸ"):
        out = F.replace(out, F.lit(plain + "̈"), F.lit(umlaut))
    return out


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(c: Column) -> Column:
    """NFKC. All texts go to Python, which knows at a glance what it cannot change: an expression that looks first
    would have the text worked out once more on either side of the call."""
    return _nfkc(c)


def _once(c: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` on a value that is worked out once, however often ``step`` names it."""
    return F.get(F.transform(F.array(c), step), F.lit(0))


def normalize(c: Column) -> Column:
    """All of the above. A text without any of the characters in question skips the repairs."""
    def repaired(t: Column) -> Column:
        return F.when(t.rlike(_DAMAGED), _move_diaeresis(strip_undisplayable(fix_eszett(fix_ligatures(t))))).otherwise(t)

    return nfkc(_once(c, repaired))


def drop_page_number(text: Column, page: Column) -> Column:
    body = rstrip(text)
    lines = F.split(body, "\n")
    is_number = strip(F.element_at(lines, -1)) == page.cast("string")
    shorter = F.concat(F.array_join(F.slice(lines, F.lit(1), F.size(lines) - 1), "\n"), F.lit("\n"))
    return F.when(is_number, shorter).otherwise(text)


def strip_footer(c: Column) -> Column:
    return F.regexp_replace(c, PAGE_FOOTER, "")


def slug(c: Column, default: str = "course") -> Column:
    core = F.btrim(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(non_empty(core), F.lit(default))


def squash(c: Column) -> Column:
    return collapse(F.lower(c))


def plain_title(c: Column) -> Column:
    return F.regexp_replace(
        F.lower(F.regexp_replace(strip(c), LEADING_NUMBER, "")), r"[^\p{L}\p{N}]+", ""
    )


def clean_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(collapse(c), LEADING_NUMBER, ""))


def join_title(c: Column) -> Column:
    return collapse(F.regexp_replace(c, r"-\n(?=[a-zäöüß])", ""))


def _join_line(text: Column, line: Column) -> Column:
    hyphen = text.endswith("-") & line.rlike(r"^\p{IsLowercase}")
    return (
        F.when(text == "", line)
        .when(line.rlike(LIST_ITEM), F.concat_ws("\n", text, line))
        .when(hyphen, F.concat(F.substring(text, F.lit(1), F.length(text) - 1), line))
        .otherwise(F.concat_ws(" ", text, line))
    )


def readable(c: Column) -> Column:
    """Lines joined to paragraphs again; list items keep their line, hyphens at a wrap go."""
    def paragraph(block: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, "\n"), strip), lambda x: x != "")
        return F.aggregate(lines, F.lit(""), _join_line)

    blocks = F.split(strip(c), r"(?U)\n\s*\n")
    return F.array_join(F.transform(blocks, paragraph), "\n\n")


def fold(c: Column) -> Column:
    """Lower case, umlauts to base letters, other characters to spaces, no 1-letter words."""
    letters = F.regexp_replace(F.translate(F.lower(c), "äöüß", "aous"), "[^a-z]+", " ")
    return F.array_join(F.filter(F.split(letters, " "), lambda w: F.length(w) > 1), " ")


def trigrams(c: Column) -> Column:
    """Distinct 3-character pieces of the folded text; none for fewer than 3 characters.

    One pass of a lookahead: cutting pieces by position would walk the text for each of them.
    """
    return F.array_distinct(F.regexp_extract_all(fold(c), F.lit("(?=(...))"), F.lit(1)))


def trigram_codes(c: Column) -> Column:
    """The trigrams as numbers of 31 bits. No two of the 19,683 that can be have the same number (test)."""
    return F.transform(trigrams(c), lambda g: F.hash(g).bitwiseAND(0x7FFFFFFF))


def base_name(c: Column) -> Column:
    """``x-1.pdf`` and ``x (1).pdf`` -> ``x.pdf``; NULL without such a suffix."""
    return non_empty(
        F.concat(F.regexp_extract(c, COPY_SUFFIX, 1), F.regexp_extract(c, COPY_SUFFIX, 2))
    )


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def preview(c: Column, n: int) -> Column:
    return F.substring(collapse(c), 1, n)


# --- Extraction ------------------------------------------------------------------------

def _int(c: Column) -> Column:
    return c.try_cast("int")


def header_number(text: Column) -> Column:
    head = F.substring(text, 1, HEADER_CHARS)
    return F.coalesce(
        _int(F.regexp_extract(head, SHEET_NUMBER, 1)), _int(F.regexp_extract(head, SHEET_NUMBER, 2))
    )


def last_number(stem: Column) -> Column:
    return _int(F.regexp_extract(stem, r"(\d+)(?!.*\d)", 1))


def sheet_number(text: Column, stem: Column) -> Column:
    """Number in the first 400 characters, else the last digits of the file stem."""
    return F.coalesce(header_number(text), last_number(stem))


def deck_number(stem: Column) -> Column:
    """Digits after a marker word, else leading digits, else the last ones. A short marker
    does not count inside a word unless it is written as ``...yLec06``."""
    not_glued = r"(?:(?<!\p{L})|(?<=\p{Ll})(?=\p{Lu}))"
    marker = (
        rf"(?:(?i:{DECK_WORDS_LONG})|{not_glued}(?i:{DECK_WORDS_SHORT}))[\s._#-]*(\d+)"
    )
    return F.coalesce(
        _int(F.regexp_extract(stem, marker, 1)),
        _int(F.regexp_extract(stem, r"^(\d+)", 1)),
        last_number(stem),
    )


def discussion_date(c: Column) -> Column:
    return non_empty(strip(F.regexp_extract(c, DISCUSSION_DATE, 1)))


def script_refs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(SCRIPT_REFERENCE), F.lit(1))


def lone_ref(body: Column) -> Column:
    """(refs, text): all references in the body; without any, a first line that is only a
    reference counts and the text ends at the next run-in heading."""
    refs = script_refs(body)
    alone = non_empty(
        F.regexp_extract(strip(F.element_at(F.split(body, "\n", 2), 1)), LONE_REFERENCE, 1)
    )
    use = (F.size(refs) == 0) & alone.isNotNull()
    cut = strip(F.element_at(F.split(body, RUN_IN_HEADING, 2), 1))
    return F.struct(
        F.when(use, F.array(alone)).otherwise(refs).alias("refs"),
        F.when(use & body.rlike(RUN_IN_HEADING), cut).otherwise(body).alias("text"),
    )


def subparts(body: Column) -> Column:
    """``[{label, text}]`` when there are at least two part labels, else empty."""
    labels = F.regexp_extract_all(body, F.lit(SUBPART), F.lit(1))
    texts = F.split(body, SUBPART)
    parts = F.transform(
        labels,
        lambda label, i: F.struct(
            label.alias("label"), strip(F.element_at(texts, i + 2)).alias("text")
        ),
    )
    none = F.array().cast("array<struct<label:string,text:string>>")
    return F.when(F.size(labels) >= 2, parts).otherwise(none)


def preamble(body: Column) -> Column:
    """The text before the first part; empty without parts."""
    has_parts = F.size(F.regexp_extract_all(body, F.lit(SUBPART), F.lit(1))) >= 2
    return F.when(has_parts, strip(F.element_at(F.split(body, SUBPART), 1))).otherwise("")


def natural_key(stem: Column) -> Column:
    numbers = F.transform(
        F.regexp_extract_all(stem, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("bigint")
    )
    return F.when(F.size(numbers) > 0, numbers).otherwise(F.array(F.lit(0).cast("bigint")))


def statement_label(id_: Column, name: Column, text: Column, type_: Column, width: int = 48) -> Column:
    words = collapse(text)
    about = F.coalesce(non_empty(name), words)
    about = F.when(
        (type_ == "Slide") & (F.coalesce(text, F.lit("")) != ""), F.concat(about, F.lit(": "), words)
    ).otherwise(about)
    short = F.when(
        F.length(about) > width, F.concat(F.substring(about, 1, width - 1), F.lit("…"))
    ).otherwise(about)
    return F.concat(id_, F.lit("  "), short)


# --- Cost and effort -------------------------------------------------------------------

def effort_ten(score: Column) -> Column:
    """0..3 -> 1..10 with one decimal, rounded half to even; NULL without a score."""
    clamped = F.least(F.lit(3.0), F.greatest(F.lit(0.0), score))
    return F.when(score.isNotNull(), F.bround(1 + 9 * clamped / 3, 1))


def effort_word(score: Column) -> Column:
    level = F.least(F.lit(3.0), F.greatest(F.lit(0.0), F.bround(score, 0))).cast("int")
    return F.when(score.isNotNull(), F.element_at(F.array(*[F.lit(w) for w in EFFORT_WORDS]), level + 1))


def entry_header(id_: Column, name: Column) -> Column:
    return F.concat(id_, F.when(F.coalesce(name, F.lit("")) != "",
                                F.concat(F.lit(" ("), name, F.lit(")"))).otherwise(""))


def entry_text(id_: Column, name: Column, text: Column) -> Column:
    return F.concat(entry_header(id_, name), F.lit(":\n"), text)


def proof_text(proof: Column) -> Column:
    return F.when(F.coalesce(proof, F.lit("")) != "",
                  F.concat(F.lit("\nProof: "), proof)).otherwise("")


def entry_size(id_: Column, name: Column, text: Column) -> Column:
    return F.length(entry_text(id_, name, text)) + 1


def proof_size(proof: Column) -> Column:
    return F.length(proof_text(proof))
