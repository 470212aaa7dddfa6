"""Two-pass windows against Spark's own, with a key that holds a third of the rows."""
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import windows as W
from tests.conftest import rows


@pytest.fixture(scope="module", autouse=True)
def pieces(spark):
    """Small inputs stay in as many pieces as there are shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="module")
def df(spark):
    rng = random.Random(2)
    data = [("hot" if i % 3 == 0 else rng.choice([None, "a", "b", "c"]), rng.randrange(400), rng.choice([None, "x", "y", "z"]), None if i % 7 == 0 else rng.randrange(-50, 50), i) for i in range(3000)]
    return spark.createDataFrame(data + [("one", 1, "x", 5, 9999)], "k string, o int, s string, v long, id long").repartition(7).cache()


def test_numbers_sums_tiles_and_neighbours(df):
    order = [F.col("o").desc(), F.col("id")]
    w = Window.partitionBy("k").orderBy(*order)
    near = {"b1": ("v", -1), "b2": ("v", -2), "f1": ("id", 1), "f3": ("v", 3)}
    got = W.scan(df, ["k"], order, row_number="rn", sums={"run": "v"}, ntile=("tile", 4), near=near)
    want = df.select("*", F.row_number().over(w).cast("long").alias("rn"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
                     F.ntile(4).over(w).cast("long").alias("tile"), F.lag("v", 1).over(w).alias("b1"), F.lag("v", 2).over(w).alias("b2"),
                     F.lead("id", 1).over(w).alias("f1"), F.lead("v", 3).over(w).alias("f3"))
    cols = ["k", "id", "rn", "run", "tile", *near]
    assert rows(got, *cols) == rows(want, *cols)


def test_ranks(df):
    w = Window.partitionBy("k").orderBy("s")
    got = W.ranks(df, ["k"], ["s"], rank="rk", dense_rank="drk")
    want = df.select("*", F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("drk"))
    assert rows(got, "k", "id", "rk", "drk") == rows(want, "k", "id", "rk", "drk")


def test_short_pieces_and_empty_input(spark):
    small = spark.range(6).select(F.lit("k").alias("k"), F.col("id"))
    got = W.scan(small, ["k"], [F.col("id")], row_number="rn", near={"p": ("id", -3), "n": ("id", 2)})
    assert rows(got, "id", "rn", "p", "n") == [(i, i + 1, i - 3 if i >= 3 else None, i + 2 if i < 4 else None) for i in range(6)]
    assert W.scan(small.limit(0), ["k"], [F.col("id")], row_number="rn", sums={"s": "id"}).count() == 0


def test_a_hot_key_lies_in_many_pieces(df):
    sizes = df.filter("k = 'hot'").orderBy("k", "o", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 2


def test_only_hot_keys_go_in_pieces(df):
    """One shuffle for the other keys; the rows of hot ones are those of Spark's window too."""
    order, near = [F.col("o").desc(), F.col("id")], {"b1": ("v", -1), "f3": ("v", 3)}
    w = Window.partitionBy("k").orderBy(*order)
    want = df.select("*", F.row_number().over(w).cast("long").alias("rn"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
                     F.ntile(4).over(w).cast("long").alias("tile"), F.lag("v", 1).over(w).alias("b1"), F.lead("v", 3).over(w).alias("f3"))
    cols = ["k", "id", "rn", "run", "tile", *near]
    assert W.hot_keys(df, ["k"], 5000) is None
    hot = W.hot_keys(df, ["k"], 700)
    assert rows(hot) == [("hot",)]
    for h in (None, hot, W.hot_keys(df, ["k"], 0)):
        got = W.scan(df, ["k"], order, row_number="rn", sums={"run": "v"}, ntile=("tile", 4), near=near, hot=h)
        assert rows(got, *cols) == rows(want, *cols)
        r = Window.partitionBy("k").orderBy("s")
        ranked = W.ranks(df, ["k"], ["s"], rank="rk", dense_rank="drk", hot=h)
        assert rows(ranked, "id", "rk", "drk") == rows(df.select("id", F.rank().over(r).cast("long").alias("rk"), F.dense_rank().over(r).cast("long").alias("drk")))
    plan = W.scan(df, ["k"], order, row_number="rn", sums={"run": "v"}, near=near)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan and "Join" not in plan
