"""Contiguous shards of near-equal bytes, by global prefix sums from per-partition totals.

Equal texts lie side by side in the global order. Where a border falls into a group of them that is small against a
shard, the group goes whole to the side of its middle byte; only a group too large for that is cut.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.scratch import Scratch

_HELD = "doc_id long, size long, text_crc32 long, digest long, part int, before long, at long"
#: A group of equal texts stays whole if it has no more than this share of a shard's bytes.
WHOLE_GROUP = 0.02


def _running(batches):
    """Sums and row counts from the start of the partition."""
    from pyspark import TaskContext

    part, total, n = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        sizes = b.column(1).to_numpy()
        ends = sizes.cumsum() + total
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), b.column(3), pa.array([part] * len(sizes), pa.int32()), pa.array(ends - sizes), pa.array(range(n, n + len(sizes)), pa.int64())],
            names=["doc_id", "size", "text_crc32", "digest", "part", "before", "at"],
        )
        n += len(sizes)
        total = int(ends[-1]) if len(sizes) else total


def shard_by_bytes(documents: DataFrame, n_shards: int = 16, scratch: Scratch | None = None) -> DataFrame:
    """Every document's shard and its slot there, cut from one global order at equal targets of bytes.

    A document's size is its UTF-8 bytes plus 1. The order is by text digest, then id, so equal texts lie side by
    side. A document goes where its middle byte falls, or with its whole group where the middle of that falls, so a
    shard misses its target by one document or WHOLE_GROUP of it at most. Null texts have size 1 and digest 0, null ids come first,
    repeated rows are placed one after the other, and an empty table gives no rows. Of each partition two totals
    go to the driver, and of each shard a count and the group at its border. Other columns aren't read. ``law`` is ``bytes``; ``grown_shard`` is null under it.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("digest"),
    ).withColumn("tie", F.monotonically_increasing_id())  # rows that are repeated can be parted
    order = ("text_crc32", "digest", "doc_id", "tie")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = narrow.repartitionByRange(n, *order).sortWithinPartitions(*order)
    held = scratch.write(ordered.select("doc_id", "size", "text_crc32", "digest").mapInArrow(_running, _HELD))

    totals = held.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    offsets, total, rows = [], 0, 0
    for r in sorted(totals):
        offsets.append((r["part"], total, rows))
        total, rows = total + r["bytes"], rows + r["n"]
    table = spark.createDataFrame(offsets, "part int, bytes_before long, rows_before long")
    total = max(total, 1)
    at = held.join(F.broadcast(table), "part").withColumn("start", F.col("bytes_before") + F.col("before"))  # a row per partition
    # the documents that hold a border's byte, one per border at most, name the groups that borders fall into
    border = F.greatest(F.lit(1), F.ceil(F.col("start") * n_shards / F.lit(total)))
    on_border = at.where((border < n_shards) & (border * total < (F.col("start") + F.col("size")) * n_shards)).select("text_crc32", "digest").distinct()
    groups = at.join(F.broadcast(on_border), ["text_crc32", "digest"]).groupBy("text_crc32", "digest").agg(F.min("start").alias("start"), F.sum("size").alias("bytes"))
    whole = [(r["text_crc32"], r["digest"], 2 * r["start"] + r["bytes"]) for r in groups.collect() if r["bytes"] <= WHOLE_GROUP * total / n_shards]
    whole = spark.createDataFrame(whole, "text_crc32 long, digest long, _middle long")
    middle = F.coalesce("_middle", F.col("start") * 2 + F.col("size"))
    placed = at.join(F.broadcast(whole), ["text_crc32", "digest"], "left").select(  # a row per border
        "doc_id",
        "size",
        "text_crc32",
        (F.col("rows_before") + F.col("at")).alias("row"),
        F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(2 * total))).cast("int").alias("shard"),
    )
    starts, start = [], 0
    for r in sorted(placed.groupBy("shard").count().collect()):
        starts.append((r["shard"], start))
        start += r["count"]
    first = spark.createDataFrame(starts, "shard int, first long")
    return placed.join(F.broadcast(first), "shard").select(  # a row per shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
