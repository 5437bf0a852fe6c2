from collections import Counter

from pyspark.sql import functions as F
from runledger.functions.joins import hot_keys, join_many, spread_join


def many(spark):
    """Key 1 holds a third of the rows, no key a tenth, the rest is spread thin."""
    key = F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 10 == 1, None).otherwise(F.col("id"))
    return spark.range(3000).select(F.col("id").alias("row_id"), key.alias("key"))


def single(spark):
    return spark.range(0, 2000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))


def rows(df, *columns):
    return Counter(map(tuple, df.select(*columns).collect()))


def test_hot_keys_are_few_and_cut_small(spark):
    counts = many(spark).groupBy("key").agg(F.count("*").alias("rows"))
    hot = {row.key: row.pieces for row in hot_keys(counts, "key", 50).collect()}
    assert set(hot) == {1, None} and hot[1] == 17


def test_spread_joins_equal_plain_joins(spark):
    for how in ("inner", "left"):
        plain = many(spark).join(single(spark), "key", how)
        spread = spread_join(many(spark), single(spark), "key", "row_id", how=how, parts=50)
        assert sorted(spread.columns) == sorted(plain.columns)
        assert rows(spread, "key", "row_id", "value") == rows(plain, "key", "row_id", "value")


def test_a_hot_key_is_spread_over_tasks(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        joined = spread_join(many(spark), single(spark), "key", "row_id", parts=200)
        tasks = joined.where("key = 1").groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert len(tasks) > 4 and sum(row["count"] for row in tasks) == 1000


def test_join_many_keeps_rows_without_partners(spark):
    joined = join_many(single(spark), many(spark), "key", "row_id")
    plain = single(spark).join(many(spark), "key", "left")
    assert rows(joined, "key", "row_id", "value") == rows(plain, "key", "row_id", "value")


def test_joins_of_nothing(spark):
    none = many(spark).where("false")
    assert spread_join(none, single(spark), "key", "row_id").count() == 0
    assert join_many(single(spark), none, "key", "row_id").count() == 2000


def test_neither_side_of_a_spread_join_is_broadcast(spark):
    """Both sides look small enough here; only the list of hot keys may go to every task."""
    plan = join_many(single(spark), many(spark), "key", "row_id")._jdf.queryExecution().executedPlan().toString()
    broadcast = [line for line in plan.split("\n") if "BroadcastHashJoin" in line]
    assert len(broadcast) == 2 and all("LeftOuter" in line for line in broadcast)
    assert plan.count("SortMergeJoin") == 2
