"""Graph steps shared by the clustering operators: components, first-come references on edges, global numbers."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.scratch import Scratch


def cut(df: DataFrame, split: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again; for work that is heavy for its bytes, a task reads no more than ``split`` of its files."""
    conf, key = df.sparkSession.conf, "spark.sql.files.maxPartitionBytes"
    before = conf.get(key)
    try:
        if split:
            conf.set(key, split)
        return Scratch(df.sparkSession).write(df)
    finally:
        if split:
            conf.set(key, before)


def written(df: DataFrame, *columns: str) -> DataFrame:
    """Columns of ``df``, which is cut unless it is what ``cut`` gave."""
    return df.select(*columns) if hasattr(df, "_scratch_path") else cut(df.select(*columns))


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, label): the least id reachable over edges (a, b); ids without an edge don't appear.

    Large-star and small-star rounds alternate; each is a minimum per node and a join, and no node's neighbours are
    gathered.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    now = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = scratch.write(small.where("u <> v").distinct())
        scratch.drop(now)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            return now.select(F.col("u").alias("id"), F.col("v").alias("label"))
        mark = state


def references(edges: DataFrame) -> DataFrame:
    """Ids among the ends of ``edges`` (later, earlier) that become references.

    An id is a reference iff no earlier neighbour is one. A round drops what the last round's references reach and
    names those that have lost all earlier neighbours; it reads and writes the edges that are still open only.
    """
    scratch = Scratch(edges.sparkSession)
    left = scratch.write(edges)
    ends = left.select(F.col("later").alias("id")).distinct()
    new = scratch.write(left.select(F.col("earlier").alias("id")).distinct().join(ends, "id", "left_anti"))
    found, read = [new], left
    while not new.isEmpty():
        members = left.join(new.withColumnRenamed("id", "earlier"), "earlier", "left_semi").select("later").distinct()
        gone = members.select(F.col("later").alias("earlier"), F.lit(True).alias("lost"))
        held = left.join(members, "later", "left_anti").join(gone, "earlier", "left").select("later", "earlier", F.coalesce("lost", F.lit(False)).alias("lost"))
        held = scratch.write(held)
        scratch.drop(read)
        read = held
        new = scratch.write(held.groupBy("later").agg(F.min("lost").alias("free")).where("free").select(F.col("later").alias("id")))
        found.append(new)
        left = held.where("NOT lost").select("later", "earlier")
    return reduce(DataFrame.unionByName, found)


def numbered(df: DataFrame, *order, first: int = 1, scratch: Scratch | None = None, tasks: int | None = None) -> DataFrame:
    """``df`` with ``row``, its place from ``first`` in the given order.

    Rows are dealt by range, to as many ``tasks`` as joins have unless it is given; only each partition's count goes to the driver, and comes back as that partition's
    offset. ``df`` is written once on the way, so that a second reading can't deal it otherwise.
    """
    spark = df.sparkSession
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    held = (scratch or Scratch(spark)).write(dealt)
    counts = {r[0]: r[1] for r in held.groupBy(F.shiftright("_at", 33).alias("p")).count().collect()}
    parts = sorted(counts)
    offsets = [first + x for x in accumulate((counts[p] for p in parts), initial=0)][:-1]
    table = spark.createDataFrame(pa.table({"_p": pa.array(parts, pa.int64()), "_offset": pa.array(offsets, pa.int64())}))
    out = held.withColumn("_p", F.shiftright("_at", 33)).join(F.broadcast(table), "_p")  # a row per partition
    return out.withColumn("row", F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_p", "_at", "_offset")
