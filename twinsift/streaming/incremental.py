"""Results that grow with further files: retained keys and digests, deltas, and a stream of additions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.functions import paths
from twinsift.functions.fingerprints import file_digest
from twinsift.operators import folders
from twinsift.operators.exact import duplicate_groups, few, on_keys, sharing
from twinsift.operators.graph import cut
from twinsift.plans.matching import Matching, matching
from twinsift.scratch import file_system


def _plain(want: Matching) -> None:
    if want.tolerance("name") or want.tolerance("size"):
        raise ValueError("groups under a tolerance depend on all files; scan anew")


def keyed(files: DataFrame, want: Matching) -> DataFrame:
    """``files`` with their exact keys; without content, whose place a digest not yet known takes."""
    _plain(want)
    return files.withColumns(want.exact()).withColumn("digest", F.lit(None).cast("string")).drop("content")


def with_digests(rows: DataFrame, contents: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the digests that are missing where another row has the same keys; no other content is read."""
    needed = few(sharing(rows, keys).where("digest IS NULL").select("path"))
    told = contents.select("path", "content").join(needed, "path", "left_semi").select("path", file_digest(F.col("content")).alias("_new"))
    return rows.join(told, "path", "left").withColumn("digest", F.coalesce("digest", "_new")).select(*rows.columns)


def retained(files: DataFrame, want: Matching) -> DataFrame:
    """What a scan keeps of each file: its columns, its keys, and its digest where its keys aren't its alone."""
    rows = keyed(files, want)
    return with_digests(rows, files, list(want.exact())) if want.evidence else rows


def extend(state: DataFrame, new: DataFrame, want: Matching, contents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(state with the new files, members of the groups whose keys the new files touch).

    Old files under other keys are not looked at. ``contents`` (path, content) gives old files whose digest is asked
    for the first time; known digests are never read again.
    """
    keys = list(want.exact())
    added = cut(keyed(new, want))
    touched = on_keys(state, added.select(*keys).distinct(), keys, "left_semi")
    both = touched.unionByName(added)
    if want.evidence:
        source = new.select("path", "content")
        both = with_digests(both, source if contents is None else source.unionByName(contents.select("path", "content")), keys)
    both = cut(both)
    left = state.join(both.select("path"), "path", "left_anti")
    return left.unionByName(both), sharing(both.where("digest IS NOT NULL") if want.evidence else both, [*keys, "digest"])


def members_of(rows: DataFrame, want: Matching) -> DataFrame:
    """Groups among rows of a state: group_id, path, size, digest."""
    by = [*want.exact(), *(["digest"] if want.evidence else [])]
    known = rows.where("digest IS NOT NULL") if want.evidence else rows
    groups = known.groupBy(*by).agg(F.min("path").alias("group_id"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return on_keys(known, groups, by).select("group_id", "path", "size", "digest")


def grown(before: DataFrame, found: DataFrame, want: Matching) -> DataFrame:
    """The members ``before``, with those of the groups that a delta ``found`` in place of what it touched."""
    delta = members_of(found, want)
    return before.join(delta.select("path"), "path", "left_anti").unionByName(delta)


def incremental_groups(old: DataFrame, new: DataFrame, want: Matching) -> DataFrame:
    """Members of all groups after ``new`` joins ``old``: the earlier result, changed where new files touch it."""
    state = cut(retained(old, want))
    before = members_of(state, want)
    _, found = extend(state, new, want, old)
    return grown(before, found, want)


def full_groups(files: DataFrame, want: Matching) -> DataFrame:
    return duplicate_groups(files, want).select("group_id", "path", "size", "digest")


@dataclass(frozen=True)
class FolderState:
    """What a scan of folders keeps: path, size, digest of files; sums of folders; folders that hold something unreadable; groups."""

    files: DataFrame
    sums: DataFrame
    poisoned: DataFrame
    groups: DataFrame


def scan_folders(files: DataFrame, directories: DataFrame | None = None, issues: DataFrame | None = None) -> FolderState:
    """The state over files whose digests are known (path, size, digest)."""
    held = cut(files.select("path", "size", "digest"))
    sums = cut(folders.folder_sums(held.withColumnRenamed("digest", "content_id"), directories))
    bad = cut(_unreadable(files.sparkSession, issues))
    groups = cut(folders.equal_folders(cut(folders.signed(sums.join(bad, "path", "left_anti")))))
    return FolderState(held, sums, bad, groups)


def _unreadable(spark: SparkSession, issues: DataFrame | None) -> DataFrame:
    return spark.createDataFrame([], "path string") if issues is None else folders.poisoned(issues)


def extend_folders(state: FolderState, new: DataFrame, directories: DataFrame | None = None, issues: DataFrame | None = None, *, replace: bool = True) -> FolderState:
    """The state after ``new`` files (path, size, and content or digest), directories and issues join it.

    A file that comes under a path that is held takes its place; without ``replace`` it is counted beside it. What is added to sums is worked out from the new files, level by
    level; of the earlier state the folders above them are changed, and only folders whose signature one of these had or has now are
    grouped again. No other file or content is read.
    """
    digest = F.col("digest") if "digest" in new.columns else file_digest(F.col("content"))
    added = cut(new.select("path", "size", digest.alias("digest")))
    replaced = cut(state.files.join(added.select("path"), "path", "left_semi") if replace else state.files.limit(0))
    change = added.withColumn("sign", F.lit(1)).unionByName(replaced.withColumn("sign", F.lit(-1))).withColumnRenamed("digest", "content_id")
    named = added.select(paths.parent(F.col("path")).alias("path"))
    if directories is not None:
        named = named.unionByName(directories.select("path"))
    above = named.distinct().select(F.explode(paths.ancestors(F.col("path"), itself=True)).alias("path")).distinct()
    counted = cut(state.sums.join(above, "path", "left_semi").select("path"))
    delta = cut(folders.folder_sums(change, directories, counted))
    columns = state.sums.columns
    met = state.sums.join(delta.select("path"), "path", "left_semi").unionByName(delta)
    now = cut(met.groupBy("path").agg(*[F.sum(c).alias(c) for c in columns if c != "path"]).select(*columns))
    sums = cut(state.sums.join(now.select("path"), "path", "left_anti").unionByName(now))
    spoilt = cut(_unreadable(new.sparkSession, issues).join(state.poisoned, "path", "left_anti"))
    bad = cut(state.poisoned.unionByName(spoilt))
    # signatures that a changed folder had or has: what is equal under any other stays grouped as it is
    moved = now.select("path").unionByName(spoilt).distinct()
    before, after = folders.signed(state.sums), cut(folders.signed(sums.join(bad, "path", "left_anti")))
    same = ["signature", "n_files"]
    touched = cut(before.join(moved, "path", "left_semi").unionByName(after.join(moved, "path", "left_semi")).select(*same).distinct())
    again = folders.equal_folders(cut(after.join(touched, same, "left_semi")))
    left = state.groups.join(before.join(touched, same, "left_semi").select("path"), "path", "left_anti").select(*state.groups.columns)
    kept = state.files.join(added.select("path"), "path", "left_anti") if replace else state.files
    files = cut(kept.unionByName(added))
    return FolderState(files, sums, bad, cut(left.unionByName(again)))


def tally(files: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """One row: n_files and total_bytes read so far. Files that are later gone stay counted."""
    own = files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"))
    every = own if before is None else own.unionByName(before)
    return every.agg(F.sum("n_files").cast("long").alias("n_files"), F.sum("total_bytes").cast("long").alias("total_bytes"))


def check_settings(before: Matching, after: Matching) -> None:
    if str(before) != str(after):
        raise ValueError("settings changed; scan anew before adding folders")


def drop_stale(state: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, issues): files that are gone or changed leave the state and are told."""
    seen = now.select(F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("modified_ns").alias("_modified"))
    both = state.join(seen, F.col("path") == F.col("_path"), "left")
    same = F.col("_path").isNotNull() & (F.col("size") == F.col("_size")) & (F.col("modified_ns") == F.col("_modified"))
    same = F.coalesce(same, F.lit(False))
    return both.where(same).select(*state.columns), both.where(~same).select("path", F.lit("changed or gone since it was read").alias("reason"))


def remove(state: DataFrame, tombstones: DataFrame) -> DataFrame:
    return state.join(tombstones.select("path").distinct(), "path", "left_anti")


class GroupStream:
    """Keeps the state of exact groups in a folder while a stream adds files.

    A micro-batch writes its own files' keys and digests and nothing else, then names itself in a small marker; a
    batch that is lost half-way is not named, and simply repeated. A batch number is taken once, and of a path that
    comes again the last batch counts.
    """

    def __init__(self, spark: SparkSession, folder: str, want: Matching | None = None):
        self.spark, self.folder, self.want = spark, folder.rstrip("/"), want or matching()
        _plain(self.want)
        held = self._marker()
        if held and held["settings"] != str(self.want):
            raise ValueError("settings changed; scan anew before adding folders")

    def _marker(self) -> dict | None:
        store, path = file_system(self.spark, f"{self.folder}/marker")
        if not store.exists(path):
            return None
        last = self.spark.read.json(f"{self.folder}/marker").orderBy(F.desc("batch")).first()
        return last.asDict() if last else None

    def state(self) -> DataFrame | None:
        held = self._marker()
        if not held:
            return None
        rows = self.spark.read.parquet(f"{self.folder}/state").where(F.col("batch") <= held["batch"])
        last = rows.groupBy("path").agg(F.max("batch").alias("batch"))
        return rows.join(last, ["path", "batch"]).drop("batch")

    def groups(self) -> DataFrame | None:
        state = self.state()
        return None if state is None else members_of(state, self.want)

    def add(self, files: DataFrame, batch: int) -> None:
        held = self._marker()
        if held and held["batch"] >= batch:
            return
        digest = file_digest(F.col("content")) if self.want.evidence else F.lit(None).cast("string")
        rows = files.withColumns(self.want.exact()).withColumn("digest", digest).drop("content")
        rows.write.mode("overwrite").parquet(f"{self.folder}/state/batch={batch}")
        marker = self.spark.createDataFrame([(batch, str(self.want))], "batch long, settings string")
        marker.coalesce(1).write.mode("append").json(f"{self.folder}/marker")

    def start(self, additions: DataFrame, checkpoint: str, **trigger):
        """A streaming query that adds each micro-batch of ``additions``."""
        return additions.writeStream.foreachBatch(lambda df, n: self.add(df, n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
