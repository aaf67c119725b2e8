"""Scratch tables and joins that must not depend on one machine or one task."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from voltgrid.functions.durable import CLEANUP, ensure_checkpoint_dir, materialize
from voltgrid.functions.onerow import with_group_stats


def session(master, shared=None):
    made = []
    context = SimpleNamespace(getCheckpointDir=lambda: None, setCheckpointDir=made.append, master=master)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: shared)), made


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(session(master)[0])
    spark, made = session("yarn", "hdfs://store/checkpoints")
    ensure_checkpoint_dir(spark)
    assert made == ["hdfs://store/checkpoints"]
    spark, made = session("local[4]")
    ensure_checkpoint_dir(spark)
    assert len(made) == 1


def test_written_tables_restore_the_setting(spark):
    before = spark.conf.get(CLEANUP)
    assert materialize(spark.range(100).repartition(3).withColumn("x", F.col("id") * 2)).agg(F.sum("x")).first()[0] == 9900
    assert spark.conf.get(CLEANUP) == before


def test_a_hot_group_is_shared_by_many_tasks(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(-1)).alias("k"))
    keep = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for c, v in zip(keep, ("-1", "false", "16"), strict=True):
        spark.conf.set(c, v)
    try:
        out = with_group_stats(df, ["k"], F.count(F.lit(1)).alias("n"))
        hot = out.filter("k = -1").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert out.count() == 4000 and out.filter("k = -1 AND n <> 3600").count() == 0
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)
    assert len(hot) >= 8 and max(r["count"] for r in hot) < 1800
