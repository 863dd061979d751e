"""Scan results as JSON snapshots: written whole, read with a fixed schema and checked rule by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "path string, size bigint, modified_ns bigint, changed_ns bigint, device bigint, inode bigint, streams array<struct<name:string,size:bigint>>, stream_hashes array<struct<name:string,sha256:string>>, selected boolean"
SCHEMA = f"group_id string, digest string, byte_verified boolean, files array<struct<{RECORD.replace(' ', ':').replace(',:', ',')}>>"
# How digests and stream names look.
DIGEST = r"^[0-9a-f]{64}$"
STREAM = r"^:[^:\\/\x00]+:\$DATA$"


def save(members: DataFrame, folder: str) -> None:
    """A line per group; the folder appears whole or not at all."""
    columns = [c.split()[0] for c in RECORD.split(", ")]
    have = [F.col(c) if c in members.columns else F.lit(None).cast(k).alias(c) for c, k in (x.split(" ", 1) for x in RECORD.split(", "))]
    groups = members.select("group_id", "digest", "byte_verified", F.struct(*[h.alias(c) for h, c in zip(have, columns, strict=True)]).alias("f"))
    groups.groupBy("group_id", "digest", "byte_verified").agg(F.array_sort(F.collect_list("f")).alias("files")).write.json(folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(folder)


def record_violations(f: Column) -> Column:
    """Names of the rules that a record breaks."""
    negative = lambda c: f[c].isNull() | (f[c] < 0)
    streams, hashes = F.coalesce(f["streams"], F.array()), F.coalesce(f["stream_hashes"], F.array())
    names = F.transform(streams, lambda s: s["name"])
    rules = {
        "path": f["path"].isNull() | ~f["path"].rlike(r"^/"),
        "size": negative("size"),
        "modified_ns": f["modified_ns"].isNull(),
        "inode": negative("inode"),
        "stream name": F.exists(streams, lambda s: ~s["name"].rlike(STREAM)),
        "stream size": F.exists(streams, lambda s: s["size"].isNull() | (s["size"] < 0)),
        "stream twice": F.size(F.array_distinct(names)) != F.size(names),
        "stream digest": F.exists(hashes, lambda s: ~s["sha256"].rlike(DIGEST)),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]))


def violations(groups: DataFrame) -> DataFrame:
    """(group_id, path, rule): every broken rule; a path in two groups breaks one as well."""
    flat = groups.select("group_id", "digest", F.explode("files").alias("f"))
    own = flat.select("group_id", F.col("f.path").alias("path"), F.explode(record_violations(F.col("f"))).alias("rule"))
    digest = groups.where(F.col("digest").isNotNull() & ~F.col("digest").rlike(DIGEST)).select("group_id", F.lit(None).cast("string").alias("path"), F.lit("digest").alias("rule"))
    few = groups.where(F.size("files") < 2).select("group_id", F.lit(None).cast("string").alias("path"), F.lit("members").alias("rule"))
    twice = flat.groupBy(F.col("f.path").alias("path")).agg(F.count("*").alias("n"), F.min("group_id").alias("group_id")).where("n > 1").select("group_id", "path", F.lit("path twice").alias("rule"))
    return own.unionByName(digest).unionByName(few).unionByName(twice)


def restore(groups: DataFrame, now: DataFrame, *, reference: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, issues): records that are unchanged now, in groups that keep two.

    ``reference`` names the column of ``groups`` that holds a group's reference; a group without it goes whole.
    """
    flat = groups.select("group_id", "digest", "byte_verified", "files").withColumn("f", F.explode("files")).drop("files").select("group_id", "digest", "byte_verified", "f.*")
    seen = now.select(F.col("path").alias("_path"), *[F.col(c).alias(f"_{c}") for c in ("size", "modified_ns", "inode")])
    same = F.col("_path").isNotNull()
    for c in ("size", "modified_ns", "inode"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}").cast("long"))
    told = flat.join(seen, F.col("path") == F.col("_path"), "left").withColumn("_same", same).select(*flat.columns, "_same")
    alive = told.groupBy("group_id").agg(F.count_if("_same").alias("_n")).where("_n > 1")
    if reference:
        there = told.where("_same").select("group_id", F.col("path").alias("_reference"))
        alive = alive.join(groups.select("group_id", F.col(reference).alias("_reference")).join(there, ["group_id", "_reference"], "left_semi"), "group_id")
    members = told.where("_same").join(alive.select("group_id"), "group_id", "left_semi").drop("_same")
    return members, told.where("NOT _same").select("path", F.lit("changed or gone since it was saved").alias("reason"))
