"""Hot keys: results stay whole, and no group is held by one task."""

from pyspark.sql import functions as F

from loomlight.operators import ordering
from tests.conftest import rows


def skewed(spark, n=9000):
    """A third of all rows in one group."""
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    return spark.range(n).select(key.alias("key"), (F.col("id") * 7919 % n).alias("v"))


def test_positions_of_a_hot_group(spark):
    df = skewed(spark)
    placed = ordering.group_positions(df, ["key"], ["v"], ranges=16).toPandas()
    for _, group in placed.groupby("key"):
        ordered = group.sort_values("v")
        assert list(ordered["pos"]) == list(range(len(ordered)))
    split = ordering.range_split(df, ["key"], ["v"], ranges=16)
    hot = split.filter("key = 'hot'").groupBy(ordering.RANGE).count()
    assert hot.count() >= 4 and hot.agg(F.max("count")).first()[0] < 3000 / 2


def test_positions_with_null_keys_and_without_keys(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "key string, v int")
    assert sorted(rows(ordering.group_positions(df, ["key"], ["v"]), "v", "pos")) == [(1, 0), (2, 1), (3, 0)]
    assert sorted(rows(ordering.group_positions(df, [], ["v"]), "v", "pos")) == [(1, 0), (2, 1), (3, 2)]


def test_blocks_hold_everything_in_order(spark):
    blocks = ordering.ordered_blocks(skewed(spark), ["key"], ["v"], F.col("v"), "vs", 100, ranges=16)
    hot = blocks.filter("key = 'hot'").orderBy("block").collect()
    values = [v for b in hot for v in b.vs]
    assert len(values) == 3000 and values == sorted(values)
    assert all(len(b.vs) == 100 for b in hot)


def test_lookup_join_splits_hot_keys_and_loses_nothing(spark):
    df = skewed(spark)
    table = df.select("key").distinct().filter("key <> 'k7'").withColumn("t", F.upper("key"))
    for how in ("inner", "left", "left_anti"):
        plain = df.join(table, "key", how)
        split = ordering.lookup_join(df, table, ["key"], how)
        assert sorted(map(str, rows(split.select(*plain.columns)))) == sorted(map(str, rows(plain)))


def test_split_join_equals_a_plain_join(spark):
    df = skewed(spark, 900).withColumn("options", F.create_map(F.lit("x"), F.col("v")))
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), (None, 4)], "key string, t int")
    many = skewed(spark, 300).select("key", F.col("v").alias("t"))
    for table in (few, many):
        plain = df.drop("options").join(table, "key")
        for split in (ordering.split_join(df, table, ["key"]), ordering.split_join(table, df, ["key"])):
            assert sorted(rows(split, "key", "v", "t")) == sorted(rows(plain, "key", "v", "t"))


def test_rows_of_a_hot_scope_are_split_and_others_not_copied(spark):
    n = 8000
    scope = F.when(F.col("id") % 10 > 0, "").otherwise(F.concat(F.lit("s"), F.col("id")))
    asked = spark.range(n).select(F.col("id").alias("req_id"), scope.alias("scope"))
    parts = ordering.hot_parts(asked, ["scope"], "_parts").collect()
    assert [(r["scope"], r["_parts"]) for r in parts] == [("", 8)]
    members = spark.createDataFrame([("", "a"), ("", "b"), ("s10", "c")], "scope string, name string")
    met = ordering.split_join(asked, members, ["scope"], ["req_id"], ["name"])
    assert met.count() == 2 * n * 9 // 10 + 1
    sizes = asked.join(F.broadcast(ordering.hot_parts(asked, ["scope"], "_parts")), "scope", "left")
    placed = sizes.withColumn("_a", ordering._parted(asked, ["scope"], ["req_id"], F.coalesce("_parts", F.lit(1).cast("bigint"))))
    largest = placed.groupBy("scope", "_a").count().agg(F.max("count")).first()[0]
    assert largest < n * 0.9 / 8 * 1.2


def test_rows_with_null_keys_are_spread(spark):
    df = spark.range(4000).select(F.lit(None).cast("string").alias("key"), F.col("id").alias("v"))
    table = spark.createDataFrame([("a", 1)], "key string, t int")
    assert ordering.lookup_join(df, table, ["key"], "left").count() == 4000
    salted = df.withColumn("_a", ordering._parted(df, ["key"], ["v"], F.lit(1).cast("bigint")))
    assert salted.groupBy("_a").count().count() == 8
