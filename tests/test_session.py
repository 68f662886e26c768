"""Staged tables."""

import time

from pyspark.sql import functions as F

from notespark.session import staged


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffles_of_a_staged_table_do_not_stay(spark):
    before = shuffled(spark)
    table = staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 20
    while shuffled(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled(spark) - before
    assert sorted(r["count"] for r in table.collect()) == [142] * 1 + [143] * 6
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
