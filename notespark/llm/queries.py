"""One query per operator over the driver's tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, embeddings, exact, forest, html, licences, lines, merkle, packing, quality, simhash, urls, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))


LINES_SQL = """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
frequent as (
  select k, max(doc_id) as keeper from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
judged as (
  select doc_id, pos, line, f.k is not null and doc_id <> f.keeper as dropped from keyed left join frequent f using (k))
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from judged group by doc_id
"""


@query(LINES_SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, those dropped as common, and what is left as a digest."""
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learned from the labelled ones that are not held out."""
    found = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


URLS_SQL = """
with parsed as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from parsed),
read as (
  select page_id, host, path,
    case when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
         when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
         when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
         when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
         when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end as rule,
    array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s:
      case when regexp_matches(s, '^[0-9a-f]{8,}$') and regexp_matches(s, '[0-9]') and regexp_matches(s, '[a-f]') then '<x>'
           else regexp_replace(s, '[0-9]+', '<n>', 'g') end), '/') as shape
  from p),
counts as (
  select host, shape, count(*) as pages, count(rule) as labelled,
         count(*) filter (where rule in ('example.org/en/1', 'example.org/es/', 'com/de/')) as blocked
  from read group by host, shape),
tokens as (
  select host, shape, pages, unnest(string_split(shape, '/')) as token,
         generate_subscripts(string_split(shape, '/'), 1) as depth from counts),
seen as (select host, depth, token, sum(pages) as n from tokens group by all),
rare as (
  select host, depth, token, n < 2 or n < 0.05::double * sum(n) over (partition by host, depth) as rare from seen),
templates as (
  select host, shape, string_agg(case when rare and not regexp_matches(token, '<.>') then '*' else token end, '/' order by depth) as template
  from tokens join rare using (host, depth, token) group by host, shape),
led as (
  select c.*, template, string_split(template, '/') as t,
         coalesce(list_position(list_transform(string_split(template, '/'), lambda x: contains(x, '*') or contains(x, '<')), false),
                  len(string_split(template, '/')) + 1) as first
  from counts c join templates using (host, shape)),
parts as (
  select *, array_to_string(t[1:first - 1], '/') as lead, coalesce(t[first], '') as literal, array_to_string(t[first + 1:], '/') as rest from led),
by_rest as (
  select host, lead, literal, rest, sum(pages) as pages, sum(labelled) as n, sum(blocked) as k
  from parts where literal <> '' group by all),
branches as (
  select host, lead, literal, sum(n) as n, sum(k) as k, max({'pages': pages, 'rest': rest}).rest as main
  from by_rest group by all),
judged as (
  select *, n = 0 or k_all = 0 or pow(k * n_all::double - n * k_all::double, 2) <= 4::double * n * k_all * (n_all - k_all) as alike
  from (select *, sum(n) over w as n_all, sum(k) over w as k_all from branches window w as (partition by host, lead, main))),
merging as (
  select host, lead, literal, alike and count(*) filter (where alike) over (partition by host, lead, main) > 1 as merge from judged),
merged as (
  select p.host, shape, labelled, blocked, case when merge then concat_ws('/', nullif(p.lead, ''), '*', nullif(rest, '')) else template end as merged
  from parts p left join merging m on p.host = m.host and p.lead = m.lead and p.literal = m.literal),
everywhere as (select (coalesce(sum(blocked), 0) + 1) / (coalesce(sum(labelled), 0) + 2)::double as g from counts),
hosts as (
  select host, (sum(blocked) + 5 * any_value(g)) / (sum(labelled) + 5)::double as host_rate from merged, everywhere group by host),
rates as (
  select host, merged, (sum(blocked) + 5 * any_value(host_rate)) / (sum(labelled) + 5)::double as block_rate
  from merged join hosts using (host) group by host, merged)
select page_id, host, path, rule,
       case when coalesce(rule in ('org/', 'com/fr/'), block_rate < 0.7) then 'allow' else 'block' end as verdict,
       merged as template, block_rate
from read join merged using (host, shape) join rates using (host, merged)
"""


@query(URLS_SQL)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict, by rule or by its path template."""
    return urls.judge_urls(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


@query()
def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence phrases and labels."""
    return licences.scan_licences(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in sequences of at most 2048 tokens."""
    found = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumnRenamed("id", "doc_id")


EXACT_SQL = """
with d as (
  select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as norm
  from documents),
g as (
  select doc_id, norm, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size
  from d window w as (partition by norm order by length(t) desc, doc_id))
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from g
"""


@query(EXACT_SQL)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts and the row that stays for it."""
    found = exact.exact_duplicates(table(spark, sf_dir, "documents"), carry={"text_sha256": F.sha2("norm", 256)})
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@query()
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count and digests of its ids and of what they decode to."""
    found = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return found.withColumnRenamed("id", "doc_id")


@query()
def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component; the smallest id of a component is kept."""
    found = embeddings.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


@query()
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    found = html.main_texts(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on the 16 leading components."""
    found = whitening.whitened_components(table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id").withColumn("deviation", F.col("deviation").cast("bigint"))


@query()
def op12_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every fiftieth one, searched among all."""
    found = forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@query()
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest, and whether it verifies, some of them tampered with."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf(*map(F.col, LEAF_FIELDS[:-1]), lowered))
    found = merkle.prove(table(spark, sf_dir, "documents"), LEAF_FIELDS, changed=tampered)
    return found.withColumnRenamed("id", "doc_id")
