"""Small Spark helpers of the training-data operators."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is
    cut, and a lost executor costs nothing that was already written."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Have the driver collect garbage: Spark removes the shuffle files of
    finished jobs once nothing refers to them, and only then. The plan of the
    last job goes in a second round."""
    gc.collect()
    try:
        for _ in range(2):
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.2)
    except Exception:  # noqa: BLE001 - Spark Connect: the server cleans up by itself
        pass


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with its 0-based row number in ``order`` as column ``name``.

    The rows are range-sorted (a key with many rows is spread as far as
    ``order`` tells its rows apart), written with their place in the
    partition, and read back with the partitions' offsets, a table of one
    row per partition."""
    at, low = free_name(df, "_at"), (1 << 33) - 1
    sorted_ = written(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(at, 33)
    counts = sorted_.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = sorted_.join(F.broadcast(offsets), part == F.col("_p"))
    place = (F.col("_before") + F.col(at).bitwiseAND(F.lit(low))).cast("long")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], place.alias(name))


BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hand Arrow batches of about ``BATCH_BYTES`` to Python instead of
    10,000 rows of any length, unless the session has a limit of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(key, None) or "").rstrip("bB")
    if not now.isdigit() or int(now) >= 1 << 28:
        spark.conf.set(key, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer form of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components: (node, root) for every node of ``edges``, root
    the smallest node of its component.

    Alternating large-star and small-star rounds; every round is a grouped
    minimum and a join, written to the shared folder, until no edge changes.
    The joins are plain shuffles that AQE may split, so a hub does not land
    in one task. Null ends are ignored; an empty input gives no rows."""
    spark = edges.sparkSession
    e = (edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null and x <> y")
         .select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    e = written(e, "cc")
    last = None
    for _ in range(max_rounds):
        # Large star: each neighbour above a node links to the node's smallest neighbour (or itself).
        both = e.select(F.col("u").alias("n"), F.col("v").alias("w")).unionByName(
            e.select(F.col("v").alias("n"), F.col("u").alias("w")))
        low = both.groupBy("n").agg(F.least(F.min("w"), F.col("n")).alias("m"))
        large = (both.filter("w > n").join(low, "n").select(F.col("w").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        # Small star: each node and its smaller neighbours link to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        e = written(small, "cc")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def grown(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, root) of what ``roots`` joins and ``links`` (a, b):
    only the roots that the links meet are searched again."""
    if roots is None:
        return written(components(links), "roots")
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    base = roots.unionByName(ends.join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
    at = lambda end: base.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    met = links.join(at("a"), "a").join(at("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    new = components(met).select(F.col("node").alias("root"), F.col("root").alias("new"))
    return written(base.join(new, "root", "left").select("node", F.coalesce("new", "root").alias("root")), "roots")
