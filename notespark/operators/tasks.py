"""Task sheets: where tasks begin, what they refer to, and several sheets in one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import predicates as P, text as X
from ..scan import key_sizes, last_value, row_number, running_sum, scan

# --- Fixed values: how sheets number their tasks, in order of preference ---------------
NUMBER_STYLES = [
    (r"(?U)\A(?:Aufgabe|Exercise|Problem)\s+(\d+)\s*[:.]?[ \t]*", None),
    (r"(?U)\A\((\d+)\)[ \t]*(?=\S)", r"(?Umd)\A\((\d+)\)[ \t]*$"),
    (r"(?U)\A(\d+)\.(?:[ \t]+(?=\S)|(?=[\p{L}\p{Nl}\p{No}]))", r"(?Umd)\A(\d+)\.[ \t]*$"),
    (r"(?U)\A(\d+)\)[ \t]*(?=\S)", r"(?Umd)\A(\d+)\)[ \t]*$"),
]
MAX_TASK_GAP = 2
# ---------------------------------------------------------------------------------------
#: A number, its colon and the part label after it stand on so many further lines at most, blank ones not counted.
HEAD_LINES = 4
_MAYBE_TASK = r"^(?:Aufgabe|Exercise|Problem|\(?\d)"
_HEAD = "struct<line_no:int,style:int,lone:boolean,num:bigint,match_len:int,part_next:boolean>"


def task_candidates(text: Column) -> Column:
    """Per text the array of line starts that may number a task."""
    def of_sheet(sheet: Column) -> Column:
        lines, filled = sheet["lines"], sheet["filled"]
        where = F.filter(F.transform(lines, lambda line, i: F.when(line.rlike(_MAYBE_TASK), i)), lambda i: i.isNotNull())

        def readings(i: Column) -> Column:
            def of(rest: Column) -> Column:
                found = []
                for style, (plain, alone) in enumerate(NUMBER_STYLES):
                    for lone, pattern in ((False, plain), (True, alone)):
                        if pattern is None:
                            continue
                        size = F.length(F.regexp_extract(rest, pattern, 0))
                        after = F.regexp_replace(F.substring(rest, size + 1, F.length(rest)), r"(?U)\A\s+", "")
                        found.append(F.when(rest.rlike(pattern), F.struct(
                            i.alias("line_no"), F.lit(style).alias("style"), F.lit(lone).alias("lone"),
                            F.regexp_extract(rest, pattern, 1).try_cast("bigint").alias("num"),
                            size.alias("match_len"), after.rlike(P.NEXT_PART).alias("part_next"))))
                return F.filter(F.array(*found), lambda x: x.isNotNull() & x["num"].isNotNull())

            stop = F.coalesce(F.get(filled, (F.array_position(filled, i) + HEAD_LINES).cast("int")), F.size(lines))
            rest = F.array_join(F.slice(lines, i + 1, stop - i), "\n")
            return F.element_at(F.transform(F.array(rest), of), 1)

        return F.flatten(F.transform(where, readings))

    lines = F.split(text, "\n")
    filled = F.filter(F.transform(lines, lambda line, i: F.when(line.rlike(r"(?U)\S"), i)), lambda i: i.isNotNull())
    sheets = F.array(F.struct(lines.alias("lines"), filled.alias("filled")))  # split once, not per candidate
    return F.element_at(F.transform(sheets, of_sheet), 1).cast(f"array<{_HEAD}>")


def _step(earlier: Column, later: Column) -> Column:
    return (later["num"] - earlier["num"]).between(1, MAX_TASK_GAP)


def _runs(matches: Column, style: int) -> Column:
    """The best run of one style as (length, fresh, -style, -first line).

    Built from the last line upwards: a line's run is one longer than that of the first later
    line it can step to. ``fresh`` is false if the first number shows again inside the run.
    """
    def prepend(later: Column, m: Column) -> Column:
        to = F.get(F.filter(later, lambda x: _step(m, x)), F.lit(0))
        return F.concat(F.array(F.struct(
            m["line_no"].alias("line_no"), m["num"].alias("num"),
            (F.coalesce(to["length"], F.lit(0)) + 1).alias("length"),
            F.coalesce(to["stop"], m["line_no"]).alias("stop"))), later)

    none = F.array().cast("array<struct<line_no:int,num:bigint,length:int,stop:int>>")

    def judged(r: Column) -> Column:
        again = F.exists(matches, lambda x: (x["num"] == r["num"]) & (x["line_no"] > r["line_no"])
                         & (x["line_no"] < r["stop"]))
        return F.struct(r["length"].alias("length"), (~again).alias("fresh"), F.lit(-style).alias("style"),
                        (-r["line_no"]).alias("first"))

    return F.array_max(F.transform(F.aggregate(F.reverse(matches), none, prepend), judged))


def task_heads(cands: DataFrame) -> DataFrame:
    """Add ``heads`` to rows with the array ``cands``: the numbering run of the sheet and the
    lone numbers that fill its gaps, by line."""
    def plain(style: int) -> Column:
        return F.filter("cands", lambda c: (c["style"] == style) & ~c["lone"])

    best = cands.withColumn(
        "best", F.array_max(F.array(*[_runs(plain(s), s) for s in range(len(NUMBER_STYLES))])))
    none = F.array().cast(f"array<{_HEAD}>")

    def extend(run: Column, m: Column) -> Column:
        fits = (F.size(run) == 0) | F.coalesce(_step(F.element_at(run, -1), m), F.lit(False))
        return F.when(fits, F.concat(run, F.array(m))).otherwise(run)

    style = -F.col("best.style")
    run = F.aggregate(
        F.filter("cands", lambda c: (c["style"] == style) & ~c["lone"] & (c["line_no"] >= -F.col("best.first"))),
        none, extend)
    chosen = best.withColumn("run", F.when(F.col("best").isNotNull(), run).otherwise(none))
    # Run members and lone numbers in one order, the next missing number carried along.
    events = F.array_sort(F.concat("run", F.filter("cands", lambda c: (c["style"] == style) & c["lone"])))

    def place(state: Column, e: Column) -> Column:
        ahead = F.get(F.filter("run", lambda m: m["line_no"] > e["line_no"]), F.lit(0))["num"]
        fills = (e["num"] == state["want"]) & F.when(ahead.isNull(), e["part_next"]).otherwise(e["num"] < ahead)
        return F.when(~e["lone"] | fills, F.struct(
            (e["num"] + 1).alias("want"), F.concat(state["heads"], F.array(e)).alias("heads"))).otherwise(state)

    start = F.struct(F.least(F.lit(1).cast("bigint"), F.get("run", F.lit(0))["num"]).alias("want"), none.alias("heads"))
    heads = F.aggregate(events, start, place, lambda s: s["heads"])
    return chosen.withColumn("heads", F.when(F.size("run") > 0, heads).otherwise(none)).drop("best", "run")


def find_tasks(sheets: DataFrame) -> DataFrame:
    """(sheet_id, pos, number, text): the tasks of every sheet.

    ``sheets`` has one text per sheet, so all of it stays inside the row.
    """
    lines = F.split("text", "\n")

    def body(h, i):
        stop = F.coalesce(F.get("heads", i + 1)["line_no"], F.size(lines))
        raw = F.array_join(F.slice(lines, h["line_no"] + 1, stop - h["line_no"]), "\n")
        return F.struct(h["num"].alias("number"),
                        X.strip(F.substring(raw, h["match_len"] + 1, F.length(raw))).alias("text"))

    runs = task_heads(sheets.withColumn("cands", task_candidates(F.col("text"))))
    return runs.select("sheet_id", F.posexplode(F.transform("heads", body)).alias("pos", "t")).select(
        "sheet_id", "pos", "t.number", "t.text")


def extract_tasks(sheets: DataFrame) -> DataFrame:
    """Tasks with title, parts and references; ``sheets`` are normalized texts."""
    tasks = find_tasks(sheets.select("sheet_id", X.strip_footer(F.col("text")).alias("text")))
    tasks = tasks.withColumn("r", X.lone_ref(F.col("text"))).select(
        "sheet_id", "pos", "number", F.col("r.text").alias("text"), F.col("r.refs").alias("script_references"))
    return tasks.select(
        "sheet_id", "pos", "number", P.guess_title(F.col("text")).alias("title"), "text",
        X.subparts(F.col("text")).alias("subparts"), "script_references")


def sheet_records(sheets: DataFrame) -> DataFrame:
    """(sheet_id, sheet_number, discussion_date) from (sheet_id, stem, text)."""
    text = X.strip_footer(F.col("text"))
    return sheets.select("sheet_id", X.sheet_number(text, F.col("stem")).alias("sheet_number"),
                         X.discussion_date(text).alias("discussion_date"))


def sheet_texts(pages: DataFrame) -> DataFrame:
    """(sheet_id, text): the pages of a sheet joined, each without its own page number."""
    clean = pages.select("sheet_id", "page",
                         X.drop_page_number(X.normalize(F.col("text")), F.col("page")).alias("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])
    return clean.groupBy("sheet_id").agg(F.array_join(parts, "\n").alias("text"))


def split_documents(pages: DataFrame) -> DataFrame:
    """(doc_id, page, part, number): which part of a file a page belongs to.

    A page opens a part if it starts like page 1 and its number differs from that of the part
    before it. Parts without a number are left out. With fewer than two numbered parts the
    file stays whole (part 1). ``pages`` has (doc_id, page, first_line, number).
    """
    keys = ["doc_id"]
    sizes = key_sizes(pages, keys)
    opening = pages.groupBy("doc_id").agg(F.min_by("first_line", "page").alias("__course"),
                                          F.min("page").alias("__p1"))
    like_first = F.coalesce(F.col("first_line") == F.col("__course"), F.lit(False)) | (F.col("page") == F.col("__p1"))
    marked = pages.join(opening, "doc_id").withColumn("__like", like_first)
    # A part's number is that of its opening page, and only pages like the first can open one,
    # so "differs from the part before" is "differs from the page like the first before".
    seen = scan(marked, keys, ["page"], sizes,
                __prev=last_value(F.when(F.col("__like"), F.struct("number")), inclusive=False))
    opens = F.col("__like") & (F.col("__prev").isNull() | ~F.col("number").eqNullSafe(F.col("__prev.number")))
    parted = scan(seen.withColumn("__opens", opens), keys, ["page"], sizes,
                  __part=running_sum(F.col("__opens").cast("bigint")),
                  __number=last_value(F.when(F.col("__opens"), F.struct("number"))))
    flat = parted.select("doc_id", "page", "__part", F.col("__number.number").alias("__number"))
    heads = flat.select("doc_id", "__part", "__number").distinct()
    several = heads.filter("__number is not null").groupBy("doc_id").agg((F.count(F.lit(1)) >= 2).alias("__several"))
    ranks = scan(heads.filter("__number is not null"), keys, ["__part"], part=row_number())
    split = flat.join(several.filter("__several").select("doc_id"), "doc_id", "left_semi").join(
        ranks.select("doc_id", "__part", "part"), ["doc_id", "__part"]).select(
        "doc_id", "page", "part", F.col("__number").alias("number"))
    whole = flat.join(several.filter("__several").select("doc_id"), "doc_id", "left_anti").select(
        "doc_id", "page", F.lit(1).cast("bigint").alias("part"), F.lit(None).cast(pages.schema["number"].dataType).alias("number"))
    return split.unionByName(whole)
