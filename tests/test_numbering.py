from pyspark.sql import functions as F

from plans import plan_nodes
from hedgerow.functions.numbering import first_per, number_rows


def test_numbers_follow_the_order_over_all_ranges(spark):
    rows = spark.range(50_000).select(
        (F.col("id") * 7919 % 50_000).alias("k"), F.lit("x").alias("hot")
    )
    numbered = number_rows(rows, "hot", "k", column="n", start=1)
    assert numbered.filter(F.col("n") != F.col("k") + 1).count() == 0
    assert numbered.count() == 50_000
    assert number_rows(rows.limit(0), "k").count() == 0


def test_first_per_hot_key(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"),
        (F.col("id") * 31 % 20_011).alias("o"), F.col("id").alias("v"),
    )
    first = first_per(rows, ["key"], ["o"], ["o", "v"])
    expected = rows.groupBy("key").agg(F.min("o").alias("m"))
    assert first.join(expected, "key").filter("o <> m").count() == 0
    assert first.count() == expected.count()
    nodes = plan_nodes(first)
    assert "Window" not in nodes and nodes.count("Exchange") == 1
