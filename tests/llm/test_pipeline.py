"""The corpus pipeline: every stage on what its predecessor kept, against brute force."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_similar import groups, shingle_set
from test_tokens import check_packing

import corpus_pipeline
from notespark.llm import quality

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def exact_by_hand(rows):
    best = {}
    for d, t, *_ in rows:
        norm = "".join((t or "").split(" ")).translate({ord(c): None for c in "\t\n\x0b\x0c\r"})
        best[norm] = min(best.get(norm, (1, None)), (-len(t or ""), d))
    return sorted(d for _, d in best.values())


def near_by_hand(rows):
    rows = sorted(rows, key=lambda r: r[0])
    _, root = groups([shingle_set(r[1]) for r in rows])
    return [r[0] for i, r in enumerate(rows) if root[i] == i]


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = quality.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    functions = [f for _, f in corpus_pipeline.STAGES]
    good = functions[0](spark, docs, SF).cache()
    assert good.columns == COLUMNS and ids(good) == sorted(r["id"] for r in scores if r["predicted"] == 1)
    unique = functions[1](spark, good, SF).cache()
    assert unique.columns == COLUMNS and ids(unique) == exact_by_hand(good.collect())
    apart = functions[2](spark, unique, SF).cache()
    assert apart.columns == COLUMNS and ids(apart) == near_by_hand(unique.collect())
    placed = functions[3](spark, apart, SF).withColumnRenamed("doc_id", "id").collect()
    check_packing(spark, [(r["doc_id"], r["text"]) for r in apart.collect()], placed)
    ran = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in ran) == Counter((r["id"], r["piece"], r["ids_crc32"]) for r in placed)


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = corpus_pipeline.quality_filter(spark, docs, "/root/testdata/sf0.01").select("doc_id").withColumn("kept", F.lit(True))
    rows = labels.join(kept, "doc_id", "left").collect()
    good, bad = ([r["kept"] is True for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[1:]])
def test_odd_rows(spark, stage):
    rows = [(1, "a b c", "en", None, 5), (1, "a b c", "en", None, 5), (2, None, None, "s", None), (3, "", "en", "s", 0), (None, "no id", "en", "s", 5),
            (4, "x " * 60_000, "en", "s", 120_000), (5, "a bc", "en", "s", 4), (None, "a b c", "en", "s", 5), (6, "once", "en", "s", 4), (6, "a b c", "en", "s", 5)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "key", "component", "t", "__twin_of")})
    got = stage(spark, docs, SF).collect()
    kept = Counter(r["doc_id"] for r in got if r["doc_id"] != 4)
    if stage is corpus_pipeline.exact_dedup:
        assert kept == Counter([1, 2, None, 6])  # of the id given twice only the text that others have goes
        assert [r["text"] for r in got if r["doc_id"] == 6] == ["once"]
    elif stage is corpus_pipeline.near_dedup:
        assert kept == Counter([1, 1, 2, None, 5, 6])
        assert [r["text"] for r in got if r["doc_id"] in (None, 6)] in (["no id", "once"], ["once", "no id"])
    else:
        assert kept == Counter([1, 1, 2, 3, None, None, 5, 6, 6])
    assert stage(spark, spark.createDataFrame([], SCHEMA), SF).collect() == []


def test_rejected_rows_go_by_id_and_text(spark, tmp_path):
    """The classifier's decision meets the row that it was made for: ids that are null or given twice."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    scores = {r["key"]: r["predicted"] for r in quality.quality_scores(docs, labels, carry={"key": F.xxhash64(F.coalesce("text", F.lit("")))}).collect()}
    twice = docs.withColumn("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("doc_id") - F.col("doc_id") % 2).cast("bigint"))
    train = docs.unionByName(twice.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("doc_id") + 10**6)))
    got = corpus_pipeline.quality_filter(spark, train, str(tmp_path)).withColumn("key", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    want = train.withColumn("key", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    assert Counter((r["doc_id"], r["key"]) for r in got) == Counter((r["doc_id"], r["key"]) for r in want if scores[r["key"]] == 1)
