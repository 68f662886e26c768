"""File trees and the filing rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators.filing import CATEGORIES, SCRIPT, glob_to_regex
from ..scan import row_number, scan

# --- Fixed values: keys of the rule file ------------------------------------------------
COURSE_KEYS = ["name", "unterordner", "inhalt", "zusatzskript", *CATEGORIES]
# ---------------------------------------------------------------------------------------


def scan_files(spark: SparkSession, root: str, globs: list[str] | None = None, recursive: bool = True,
               content: bool = False) -> DataFrame:
    """(path, name, mtime, length[, content]) of the files below ``root`` whose name fits one
    of the patterns, upper and lower case alike. Contents are read only when asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    cols = ["path", X.file_name(F.col("path")).alias("name"), F.col("modificationTime").alias("mtime"), "length"]
    files = files.select(*cols, *(["content"] if content else []))
    if globs:
        low = F.lower("name")
        hit = F.lit(False)
        for g in globs:
            hit = hit | F.regexp_like(low, glob_to_regex(F.lit(g)))
        files = files.filter(hit)
    return files


def _as_list(c: Column) -> Column:
    """A field that holds one string or a JSON list of strings, as an array."""
    none = F.array().cast("array<string>")
    return F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")).when(
        F.coalesce(c, F.lit("")) == "", none).otherwise(F.array(c))


def rules_from_json(config: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rules, content rules, rejects) from rows with a JSON text ``value``.

    rules: (semester, course, course_ord, category, cat_ord, pattern, pat_ord); a single
    pattern may stand for a list, keys starting with ``_`` are comments. Courses with unknown
    fields are returned as rejects, with those fields, and have no rules.
    """
    nested = "map<string,map<string,map<string,string>>>"
    semesters = config.select(F.from_json(F.get_json_object("value", "$.semesters"), nested).alias("s"))
    courses = (
        semesters.select(F.posexplode("s").alias("i", "semester", "folders")).filter(~F.col("semester").startswith("_"))
        .select("i", "semester", F.posexplode("folders").alias("j", "folder", "spec")).filter(~F.col("folder").startswith("_"))
    )
    unknown = F.filter(F.map_keys("spec"), lambda k: ~k.startswith("_") & ~k.isin(COURSE_KEYS))
    judged = courses.withColumn("unknown", F.array_sort(unknown)).withColumn(
        "course", F.coalesce(F.col("spec")["name"], F.col("folder")))
    good = judged.filter(F.size("unknown") == 0)
    ordered = scan(good.withColumn("__all", F.lit(0)), ["__all"], ["i", "j"], course_ord=row_number())
    cats = F.array(*[F.struct(F.lit(k).alias("category"), F.lit(n).alias("cat_ord"),
                              _as_list(F.col("spec")[k]).alias("patterns")) for n, k in enumerate(CATEGORIES)])
    rules = ordered.select("semester", "folder", "course", F.col("course_ord").cast("int").alias("course_ord"), F.explode(cats).alias("c")).select(
        "semester", "folder", "course", "course_ord", "c.category", "c.cat_ord", F.posexplode("c.patterns").alias("pat_ord", "pattern"))
    content = ordered.select("semester", "course", F.explode(_as_list(F.col("spec")["inhalt"])).alias("text"))
    rejects = judged.filter(F.size("unknown") > 0).select("semester", "folder", "unknown")
    return rules, content, rejects


def natural_order(files: DataFrame) -> DataFrame:
    """Files by the numbers in their names, then by time: Blatt 10 after Blatt 9."""
    return files.withColumn("natural_key", X.natural_key(X.file_stem(F.col("name"))))


def file_catalog(matched: DataFrame, active_semester: str, past_scripts: bool = True, others: DataFrame | None = None) -> DataFrame:
    """Scripts and decks of the active courses, the last sheet of each, and the scripts of past
    courses if wanted. ``matched``: (semester, course, category, path, name, mtime).

    ``others`` (semester, path, name, mtime) are scripts that no rule gives to a course, such as
    books: each is listed once by path, with no course, unless it is a course's own script, also
    one that is not listed. Of rows of one path the first by semester (newest), name and time counts.
    """
    keyed = natural_order(matched)
    now = F.col("semester") == active_semester
    keep = keyed.filter((now & (F.col("category") != "blaetter")) | (~now & (F.col("category") == SCRIPT) & F.lit(past_scripts)))
    slot = ["semester", "course"]
    rest = [c for c in keyed.columns if c not in slot]
    last = keyed.filter(now & (F.col("category") == "blaetter")).groupBy(*slot).agg(
        F.max_by(F.struct(*rest), F.struct("natural_key", "mtime", "path")).alias("r")).select(*slot, *[F.col(f"r.{c}").alias(c) for c in rest])
    catalog = keep.select(*keyed.columns).unionByName(last.select(*keyed.columns))
    if others is None:
        return catalog
    own = matched.filter(F.col("category") == SCRIPT).select("path").distinct()
    fields = [c for c in others.columns if c != "path"]
    once = others.join(own, "path", "left_anti").groupBy("path").agg(
        F.max_by(F.struct(*fields), F.struct(F.coalesce("semester", F.lit("")), "name", "mtime")).alias("r")).select("path", *[F.col(f"r.{c}").alias(c) for c in fields])
    return catalog.unionByName(natural_order(once.withColumn("category", F.lit(SCRIPT))), allowMissingColumns=True)


def script_catalog(found: DataFrame, active_semester: str) -> DataFrame:
    """(name, semester, path, active, place): every script once, by its first name, active
    semester first, then the newest. ``found``: (ord, name, semester, path)."""
    once = found.groupBy("path").agg(F.min_by(F.struct("name", "semester", "ord"), "ord").alias("r")).select("path", "r.*")
    keyed = once.withColumn("active", F.col("semester") == active_semester)
    return keyed.orderBy(F.desc("active"), F.desc("semester"), "ord")


def distinct_names(scripts: DataFrame) -> DataFrame:
    """Add ``shown``: with several scripts in a course, the course and what tells the stem
    apart. The common prefix of all stems is that of the smallest and the largest one."""
    spans = scripts.groupBy("course").agg(F.min("stem").alias("lo"), F.max("stem").alias("hi"), F.count(F.lit(1)).alias("n"))
    same = F.filter(F.sequence(F.lit(0), F.least(F.length("lo"), F.length("hi"))),
                    lambda k: F.substring(F.col("lo"), F.lit(1), k) == F.substring(F.col("hi"), F.lit(1), k))
    prefix = spans.select("course", F.when(F.col("n") > 1, F.array_max(same)).otherwise(0).alias("__n"))
    rest = F.btrim(F.substring(F.col("stem"), F.col("__n") + 1, F.length("stem")), F.lit("-_ "))
    return scripts.join(prefix, "course").withColumn("__rest", rest).withColumn(
        "shown", F.when(F.col("__rest") != "", F.concat(F.col("course"), F.lit(" ("), F.col("__rest"), F.lit(")"))).otherwise(F.col("course"))
    ).drop("__n", "__rest")


def deck_list(decks: DataFrame, titles: DataFrame) -> DataFrame:
    """(course, path, title, newest): decks with their stored title, else the file stem.
    ``decks``: (course, path, mtime); ``titles``: (path, title)."""
    top = decks.groupBy("course").agg(F.max_by("path", F.struct("mtime", "path")).alias("__top"))
    return decks.join(titles, "path", "left").join(top, "course").select(
        "course", "path", F.coalesce("title", X.file_stem(F.col("path"))).alias("title"),
        (F.col("path") == F.col("__top")).alias("newest"))
