"""Tables that are written once leave no shuffle files behind, and no setting."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from sourceloom import scratch


def shuffle_files(spark):
    return set(Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*"))


def test_shuffle_files_go_when_a_table_is_written(spark):
    before, setting = shuffle_files(spark), spark.conf.get(scratch.RELEASE, None)
    rows = spark.range(0, 10_000, 1, 4).withColumn("k", F.col("id") % 7)
    counted = rows.groupBy("k").agg(F.count("*").alias("n"))
    held = scratch.cut_lineage(rows.hint("merge").join(counted, "k"))
    until = time.time() + 10  # files are removed beside the next query
    while not shuffle_files(spark) <= before and time.time() < until:
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert held.count() == 10_000 and held.agg(F.sum("n")).first()[0] == sum(n * n for n in [1429] * 4 + [1428] * 3)
    assert sorted(r.n for r in counted.collect()) == [1428] * 3 + [1429] * 4
    assert sorted(r.n for r in scratch.cut_lineage(counted).collect()) == [1428] * 3 + [1429] * 4
    assert spark.conf.get(scratch.RELEASE, None) == setting


def test_the_setting_of_the_session_comes_back(spark):
    spark.conf.set(scratch.RELEASE, "false")
    try:
        try:
            with scratch.shuffles_released(spark):
                assert spark.conf.get(scratch.RELEASE) == "true"
                raise KeyError
        except KeyError:
            pass
        assert spark.conf.get(scratch.RELEASE) == "false"
    finally:
        spark.conf.unset(scratch.RELEASE)
