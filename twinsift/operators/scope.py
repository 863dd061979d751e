"""What belongs to a scan: exclusions, recursion, roots, file categories, and entries that must not be read."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.functions import paths

#: Lists of folders up to this length become literals in the plan; longer ones are joined.
LITERALS = 1000


def _listed(df: DataFrame, values: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in values], "_listed string")


def without_excluded(files: DataFrame, excluded: Iterable[str]) -> DataFrame:
    """Entries that are not an excluded folder and not below one, even where a root lies below it."""
    excluded = sorted({posixpath.normpath(p) for p in excluded})
    if not excluded:
        return files
    if len(excluded) <= LITERALS:
        return files.where(~F.arrays_overlap(paths.ancestors(F.col("path"), itself=True), F.array(*map(F.lit, excluded))))
    hit = files.select("path", F.explode(paths.ancestors(F.col("path"), itself=True)).alias("_listed")).join(_listed(files, excluded), "_listed", "left_semi").select("path").distinct()
    return files.join(hit, "path", "left_anti")


def with_root(files: DataFrame, roots: Iterable[str]) -> DataFrame:
    """Entries below a root, with ``root``: the deepest root above them."""
    roots = sorted({posixpath.normpath(r) for r in roots})
    if len(roots) <= LITERALS:
        above = F.array_intersect(paths.ancestors(F.col("path")), F.array(*map(F.lit, roots)))
        return files.withColumn("root", F.get(above, F.size(above) - 1)).where("root is not null") if roots else files.withColumn("root", F.lit(None).cast("string")).where(F.lit(False))
    up = files.select("path", F.posexplode(paths.ancestors(F.col("path"))).alias("_d", "_listed")).join(_listed(files, roots), "_listed", "left_semi")
    best = up.groupBy("path").agg(F.max_by("_listed", "_d").alias("root"))
    return files.join(best, "path")


def direct_children(files: DataFrame, roots: Iterable[str]) -> DataFrame:
    """Without recursion: the entries right in a root."""
    return files.where(paths.parent(F.col("path")).isin(sorted({posixpath.normpath(r) for r in roots})))


def of_types(files: DataFrame, selected) -> DataFrame:
    selected = paths.check_file_types(selected)
    return files if selected is None else files.where(paths.file_type(F.col("path")).isin(sorted(selected)))


def one_path_per_identity(files: DataFrame) -> DataFrame:
    """Of paths with one (device, inode) the least stays."""
    first = files.groupBy("device", "inode").agg(F.min("path").alias("path"))
    return files.join(first.select("path"), "path", "left_semi")


def readable(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, issues): entries with a reason against reading them or a folder above go to the issues.

    ``files``: path, attributes, reparse_tag, nlink, is_regular. Hard-linked files are issues, each path of them.
    """
    reason = paths.rejection(F.col("attributes"), F.col("reparse_tag"), allow_cloud=True)
    bad = files.where(reason.isNotNull()).select("path", reason.alias("reason"))
    up = files.select("path", F.posexplode(paths.ancestors(F.col("path"), itself=True)).alias("_d", "_up")).join(bad.withColumnRenamed("path", "_up"), "_up")
    first = up.groupBy("path").agg(F.min_by("reason", "_d").alias("_reason"))
    own = F.when(~F.col("is_regular"), "not a regular file").when(F.col("nlink") > 1, "hard link").when(F.col("inode").isNull(), "no identity")
    told = files.join(first, "path", "left").withColumn("_reason", F.coalesce("_reason", own))
    return told.where("_reason is null").drop("_reason"), told.where("_reason is not null").select("path", F.col("_reason").alias("reason"))


def check_scope(roots: Iterable[str], excluded: Iterable[str]) -> None:
    """Every exclusion must lie below a root and not be one."""
    roots, excluded = {posixpath.normpath(r) for r in roots}, {posixpath.normpath(e) for e in excluded}
    for e in excluded:
        if not any(e != r and (r == "/" or e.startswith(r + "/")) for r in roots):
            raise ValueError(f"{e} is not a folder below a searched one")


def added_roots(old: Iterable[str], new: Iterable[str], *, recursive: bool = True) -> list[str]:
    """The roots that an incremental scan has to read; an error where it can't extend the old one."""
    old, new = {posixpath.normpath(r) for r in old}, {posixpath.normpath(r) for r in new}
    if not old <= new:
        raise ValueError("a root of the earlier scan is missing; scan anew")
    below = lambda a, b: a != b and (b == "/" or a.startswith(b + "/"))
    added = new - old
    if any(below(o, a) for a in added for o in old):
        raise ValueError("an added root holds one of the earlier scan; scan anew")
    if recursive:
        added = {a for a in added if not any(below(a, o) for o in old)}
    if not added:
        raise ValueError("no root lies outside what was scanned")
    return sorted(added)
