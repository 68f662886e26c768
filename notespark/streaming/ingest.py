"""New files as a stream: each batch is read in by the same rules as a batch ingest."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

#: Young layers that are merged into a base of one layer.
COMPACT_AFTER = 16


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """The numbers of the entries of ``folder`` that are called ``prefix<number>``."""
    fs, place = _files(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and n.removeprefix(prefix).isdigit())


def layers(spark: SparkSession, target: str) -> tuple[int | None, list[int]]:
    """(the last batch the valid base holds or None, the batches that lie in layers above it).

    The manifest is the folder ``_bases``: a base counts once a file there bears its number, so
    one that was not finished is not seen.
    """
    bases = _numbers(spark, os.path.join(target, "_bases"), "upto-")
    base = bases[-1] if bases else None
    return base, [n for n in _numbers(spark, target, "batch=") if base is None or n > base]


def _rows(spark: SparkSession, target: str) -> DataFrame:
    """All rows of the valid base and the layers above it, each with its batch."""
    base, young = layers(spark, target)
    parts = []
    if base is not None:
        parts.append(spark.read.parquet(os.path.join(target, f"_base-{base}")))
    if young or base is None:  # nothing at all is for the reader to complain about
        paths = [os.path.join(target, f"batch={n}") for n in young] or [target]
        parts.append(spark.read.option("basePath", target).parquet(*paths).withColumn("batch", F.col("batch").cast("bigint")))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows if "gone" in rows.columns else rows.withColumn("gone", F.lit(False))


def _standing(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that no deletion undoes, the last deletion per key). A deletion undoes what is older, whatever its format."""
    gone = rows.withColumn("gone", F.coalesce("gone", F.lit(False)))
    # A deletion without a time is later than all of its batch and before, but not than what comes after.
    last = gone.filter("gone").groupBy(*keys).agg(
        F.max(F.when(F.col("mtime").isNotNull(), F.struct("mtime", "batch"))).alias("__timed"), F.max(F.when(F.col("mtime").isNull(), F.col("batch"))).alias("__untimed"))
    same = reduce(lambda a, b: a & b, [F.col(f"__k_{k}").eqNullSafe(F.col(k)) for k in keys])
    met = gone.filter("not gone").join(last.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__timed", "__untimed"), same, "left")
    undone = (F.col("__timed") >= F.struct("mtime", "batch")) | (F.col("__untimed") >= F.col("batch"))
    return met.filter(~F.coalesce(undone, F.lit(False))).select(*rows.columns), last


def compact(spark: SparkSession, target: str, keys: list[str]) -> None:
    """Merge the base and all layers into a new base, and delete what the base before held.

    A base keeps, per key and format, the newest row that stands, and the last deletions: so
    what later batches bring is judged as if all layers were still there. The new base becomes
    valid with its file in the manifest; readers of the old one find its files until the next time.
    """
    base, young = layers(spark, target)
    if not young:
        return
    rows, upto = _rows(spark, target), young[-1]
    standing, last = _standing(rows, keys)
    rest = [c for c in rows.columns if c not in (*keys, "format")]
    newest = standing.groupBy(*keys, "format").agg(F.max_by(F.struct(*rest), F.struct("mtime", "batch")).alias("r")).select(
        *keys, "format", *[F.col(f"r.{c}").alias(c) for c in rest])
    timed = last.filter("__timed is not null").select(*keys, F.lit(True).alias("gone"), "__timed.mtime", "__timed.batch")
    untimed = last.filter("__untimed is not null").select(*keys, F.lit(True).alias("gone"), F.lit(None).cast(rows.schema["mtime"].dataType).alias("mtime"),
                                                          F.col("__untimed").alias("batch"))
    merged = newest.unionByName(timed.unionByName(untimed), allowMissingColumns=True)
    merged.write.mode("overwrite").parquet(os.path.join(target, f"_base-{upto}"))
    fs, mark = _files(spark, os.path.join(target, "_bases", f"upto-{upto}"))
    fs.create(mark, True).close()
    if base is not None:
        for name in [f"_base-{n}" for n in _numbers(spark, target, "_base-") if n < base] + [f"batch={n}" for n in _numbers(spark, target, "batch=") if n <= base]:
            fs, place = _files(spark, os.path.join(target, name))
            fs.delete(place, True)


def stream_ingest(spark: SparkSession, schema: T.StructType, source: str, target: str, checkpoint: str,
                  fmt: str = "parquet", max_files: int = 1000, keys: list[str] | None = None, compact_after: int = COMPACT_AFTER) -> StreamingQuery:
    """Take in all files not seen yet and stop. Rows carry ``mtime`` and ``format``, and ``gone``
    where sources may vanish: true for a key whose source is no longer there.

    The target is the state: every batch writes its own layer ``batch=<id>``. A batch that is
    repeated after a failure writes the same layer again, so nothing is doubled; one that a base
    holds already is passed over. With ``keys`` the layers are merged whenever ``compact_after``
    of them lie above the base, so twice as many lie there at most.
    """
    rows = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files).load(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        base, _ = layers(own, target)
        if base is not None and batch_id <= base:
            return
        batch.write.mode("overwrite").parquet(os.path.join(target, f"batch={batch_id}"))
        if keys and len(layers(own, target)[1]) >= compact_after:
            compact(own, target, keys)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The valid row per key over base and layers, as a batch ingest would have left it: the newest
    of the newest format. A deletion (``gone``) undoes every row that is older, by time and then
    by batch, whatever the formats; one without a time undoes what came up to its batch. A row
    without a time is older than those that have one, a null format older than any. Null keys are keys."""
    rows = _rows(spark, target)
    standing, _ = _standing(rows, keys)
    rest = [c for c in rows.columns if c not in keys]
    return standing.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("format", "mtime", "batch")).alias("r")).select(
        *keys, *[F.col(f"r.{c}").alias(c) for c in rest if c not in ("batch", "gone")])
