"""Stored frames, numbers for rows, and connected components with DataFrame joins."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share; it goes when the driver ends. Where the setting is
    missing, a folder of our own in local mode, as in tests; elsewhere that would lose data, and is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="mapweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    name = f"{base.rstrip('/')}/mapweave-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared folder and read from there. Parquet takes a small part of the disk that a
    checkpoint's serialised rows take, where values recur as they do in cells."""
    path = f"{shared_folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df` with its rows' numbers in an order, from 0 without gaps: rows are sorted by ranges, placed inside partitions, and the partitions'
    offsets (a number each) are added. No task sees all rows, and no number depends on how many partitions or columns there are."""
    df = checkpointed(df)  # finding the ranges would compute it a second time
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place_no", F.monotonically_increasing_id()))
    part, at = F.shiftright("place_no", 33), F.col("place_no").bitwiseAND((1 << 33) - 1)
    earlier = Window.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each partition
    before = placed.groupBy(part.alias("part_no")).agg(F.count("*").alias("rows_no")).select("part_no", F.coalesce(F.sum("rows_no").over(earlier), F.lit(0)).alias("offset_no"))
    return placed.join(F.broadcast(before), part == F.col("part_no")).withColumn(name, F.col("offset_no") + at).drop("place_no", "part_no", "offset_no")  # a row for each partition


def components(edges: DataFrame, vertices: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """(v, root): each vertex with the smallest one of its component. edges: a, b; vertices: v, whose lone ones are their own root.

    Large-star and small-star rounds: every step needs only the minimum of a vertex's neighbours, which is aggregated before the
    shuffle, and the edges at hubs become stars around the smallest vertex. Work a round is linear in the edges.
    """
    kind = dict(edges.dtypes)["a"]
    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    for _ in range(rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpointed(small.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError("the components didn't settle")
    roots = now.select(F.col("a").alias("v"), F.col("b").alias("root")).union(now.select(F.col("b").alias("v"), F.col("b").cast(kind).alias("root")).distinct())
    alone = edges.select(F.col("a").alias("v")).union(edges.select(F.col("b").alias("v"))) if vertices is None else vertices.select("v")
    return alone.distinct().join(roots, "v", "left").select("v", F.coalesce("root", "v").alias("root"))
