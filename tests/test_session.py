import time

from pyspark.sql import functions as F

from chorus.session import stage


def _shuffle_files(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    return disk.getAllFiles().mkString(" ").count("shuffle_")


def test_staged_tables_release_their_shuffles(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, files = spark.conf.get(key, None), _shuffle_files(spark)
    kept = stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "released")
    for _ in range(50):
        if _shuffle_files(spark) <= files:
            break
        time.sleep(0.1)
    assert _shuffle_files(spark) <= files
    assert spark.conf.get(key, None) == before
    assert sorted(r["k"] for r in kept.collect()) == list(range(7))
