"""URL filter: fixed rules first, then a tree of path templates per host. Columns and SQL functions throughout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged
from .lines import ascii_lower


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", True),
    Rule("example.org", "/es/", False),
    Rule("example.org", "/en/1", False),
    Rule("com", "/fr/", True),
    Rule("com", "/de/", False),
)
#: A segment value stays literal if this share of its host's pages at that depth has it, and more than one does.
LITERAL_SHARE = 0.05
#: Squared deviations from its siblings' block rate up to which a branch counts as similar.
SIMILAR = 4.0
#: Pages that the next wider rate counts for, and the smoothed block rate from which a template is rejected.
PRIOR_PAGES, REJECT = 5.0, 0.7


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """(name, allow) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<name: string, allow: boolean>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.allow).alias("allow"))).otherwise(found)
    return found


#: Segments without their obvious variables: long hexadecimal names and digits.
SHAPE = """transform(filter(split(path, '/'), s -> s != ''), s ->
    case when s rlike '^[0-9a-f]{8,}$' and s rlike '[0-9]' and s rlike '[a-f]' then '<x>'
         else regexp_replace(s, '[0-9]+', '<n>') end)"""


def _templates(paths: DataFrame) -> DataFrame:
    """``paths`` with ``template``: rare segment values of a host become wildcards.

    ``paths`` has one row per host and shape, so nothing here grows with the pages of a shape.
    """
    tokens = paths.select("host", "shape", "pages", F.posexplode(F.split("shape", "/")).alias("depth", "token"))
    seen = tokens.groupBy("host", "depth", "token").agg(F.sum("pages").alias("n"))
    at_depth = seen.groupBy("host", "depth").agg(F.sum("n").alias("total"))
    rare = seen.join(at_depth, ["host", "depth"]).select(
        "host", "depth", "token", ((F.col("n") < 2) | (F.col("n") < LITERAL_SHARE * F.col("total"))).alias("rare"))
    general = tokens.join(rare, ["host", "depth", "token"]).groupBy("host", "shape").agg(
        F.expr("""array_join(transform(array_sort(collect_list(struct(depth,
            case when rare and token not like '%<_>%' then '*' else token end as token))), x -> x.token), '/')""").alias("template"))
    return paths.join(general, ["host", "shape"])


def _merged(templates: DataFrame) -> DataFrame:
    """``templates`` with ``merged``: the first literal segment becomes a wildcard where siblings are alike.

    Branches are siblings if they start after the same wildcards on one host, and alike if their
    most frequent rest is the same and their block rates do not differ beyond chance from the
    rate of them all. Branches without labels have nothing to differ by.
    """
    parts = templates.withColumn("parts", F.split("template", "/")).withColumn("at", F.expr(
        "coalesce(nullif(array_position(transform(parts, t -> contains(t, '*') or contains(t, '<')), false), 0), size(parts) + 1)"))
    parts = parts.withColumns({
        "lead": F.expr("array_join(slice(parts, 1, cast(at as int) - 1), '/')"), "literal": F.expr("coalesce(get(parts, cast(at as int) - 1), '')"),
        "rest": F.expr("array_join(slice(parts, cast(at as int) + 1, size(parts)), '/')")})
    parts = parts.select("host", "shape", "labelled", "blocked", "template", "lead", "literal", "rest", "pages")
    by_rest = parts.filter("literal != ''").groupBy("host", "lead", "literal", "rest").agg(
        F.sum("pages").alias("pages"), F.sum("labelled").alias("n"), F.sum("blocked").alias("k"))
    branches = by_rest.groupBy("host", "lead", "literal").agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.max(F.struct("pages", "rest")).getField("rest").alias("main"))
    pools = branches.groupBy("host", "lead", "main").agg(F.sum("n").alias("n_all"), F.sum("k").alias("k_all"))
    # (k - n r)^2 <= SIMILAR n r (1 - r), with r = k_all / n_all
    judged = branches.join(pools, ["host", "lead", "main"]).withColumn("alike", F.expr(
        f"n = 0 or k_all = 0 or pow(k * double(n_all) - n * double(k_all), 2) <= double({SIMILAR}) * n * k_all * (n_all - k_all)"))
    groups = judged.filter("alike").groupBy("host", "lead", "main").agg(F.count(F.lit(1)).alias("alikes"))
    merging = judged.join(groups, ["host", "lead", "main"], "left").select(
        "host", "lead", "literal", F.expr("alike and alikes > 1").alias("merge"))
    return parts.join(merging, ["host", "lead", "literal"], "left").select(
        "host", "shape", "labelled", "blocked",
        F.expr("case when merge then concat_ws('/', nullif(lead, ''), '*', nullif(rest, '')) else template end").alias("merged"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, template, block_rate) per row of ``pages``.

    The host is what follows the first :// up to /, ? or #, in lower case; the path goes on up to
    ? or #. A null url or one without :// has neither, and fits no rule. The longest rule that
    fits decides. Pages that rules decide are the labels for the others: paths are generalised
    per host, branches that behave alike are merged, and a template is rejected if the share of
    blocked pages among its labelled ones is REJECT or more, smoothed towards its host's share
    and that towards all pages'. Ids play no part, so nulls and repeats in them do no harm; a
    repeated page counts each time. No pages, no rows. Other columns are not read.

    Pages are counted per host and shape first; the tree works on those counts, and the pages
    meet their verdicts in one join whose small side is staged, so that adaptive execution can
    split a host of a third of all pages.
    """
    read = pages.select(F.col(id_col).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    read = read.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", F.expr(f"array_join({SHAPE}, '/')"))
    counts = staged(read.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("pages"), F.count("rule").alias("labelled"),
        F.count(F.expr("case when not rule.allow then 1 end")).alias("blocked")), "shapes")
    merged = staged(_merged(_templates(counts)), "templates")
    overall = counts.agg(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    everywhere = (overall[1] + 1) / (overall[0] + 2)
    hosts = merged.groupBy("host").agg(
        ((F.sum("blocked") + PRIOR_PAGES * everywhere) / (F.sum("labelled") + PRIOR_PAGES)).alias("host_rate"))
    rates = merged.groupBy("host", "merged").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("k")).join(hosts, "host").select(
        "host", "merged", ((F.col("k") + PRIOR_PAGES * F.col("host_rate")) / (F.col("n") + PRIOR_PAGES)).alias("block_rate"))
    verdicts = staged(merged.join(rates, ["host", "merged"]).select("host", "shape", "merged", "block_rate"), "verdicts")
    allow = F.coalesce("rule.allow", F.col("block_rate") < REJECT)
    return read.join(verdicts, ["host", "shape"]).select(
        "id", "host", "path", F.col("rule.name").alias("rule"), F.when(allow, "allow").otherwise("block").alias("verdict"),
        F.col("merged").alias("template"), "block_rate")
