"""Cleanup plans: what a selection would remove and what speaks against it. Nothing is ever deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.functions import paths
from twinsift.operators.folders import folder_sums
from twinsift.operators.graph import cut

# Streams whose difference needs a consent of its own.
ZONE, DROPBOX = ":zone.identifier:$data", ":com.dropbox.attrs:$data"


def check_selection(members: DataFrame, selection: DataFrame) -> None:
    """Errors for paths or, where members have them, identities that occur twice in the results, and for selected paths outside them."""
    for key in (["path"], ["device", "inode"]):
        if set(key) <= set(members.columns) and not members.groupBy(*key).count().where("count > 1").isEmpty():
            raise ValueError("an identity occurs twice in the results; scan anew")
    if not selection.join(members, "path", "left_anti").isEmpty():
        raise ValueError("the selection holds paths outside the results")


def current(then: DataFrame, now: DataFrame, columns: tuple[str, ...] = ("device", "inode", "size", "modified_ns", "changed_ns", "streams")) -> DataFrame:
    """``then`` with ``is_current``: the path is there now with the same identity, size, times and streams."""
    columns = tuple(c for c in columns if c in then.columns and c in now.columns)
    seen = now.select(F.col("path").alias("_path"), *[F.col(c).alias(f"_{c}") for c in columns])
    same = F.col("_path").isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return then.join(seen, F.col("path") == F.col("_path"), "left").withColumn("is_current", same).select(*then.columns, "is_current")


def stream_differences(reference: Column, target: Column, both_ways: bool | Column) -> Column:
    """Names of streams that two files don't share with one size and content.

    ``reference``, ``target``: maps from name to a digest of size and content. A stream that only a reference which
    stays has can't be lost; it counts only ``both_ways``.
    """
    names = F.array_union(F.map_keys(reference), F.map_keys(target))
    return F.array_sort(F.filter(names, lambda n: ~F.element_at(reference, n).eqNullSafe(F.element_at(target, n)) & (F.lit(both_ways) | F.array_contains(F.map_keys(target), n))))


def _references(rows: DataFrame, group: str, chosen: Column) -> DataFrame:
    """Per group the row that others are held against: the first unselected one, else the last selected."""
    first = F.min(F.when(~chosen, F.col("path")))
    last = F.max(F.when(chosen, F.col("path")))
    return rows.groupBy(F.col(group).alias("_group")).agg(F.coalesce(first, last).alias("_reference"), F.bool_and(chosen).alias("_all"))


def duplicate_plan(members: DataFrame, selection: DataFrame, *, allow_zone: bool = False, allow_dropbox: bool = False) -> DataFrame:
    """path, group_id, role, verdict, reason of every selected file.

    ``members``: group_id, path, size, digest, is_current, contents_verified, stream_map. Files are held against
    their group's reference; if all are selected the reference goes last, and only if a copy of it was verified.
    A selection that names other files, or results that name one twice, are refused (``check_selection``).
    """
    check_selection(members, selection)
    chosen = F.col("_on").isNotNull()
    rows = members.join(selection.select("path", F.lit(1).alias("_on")).distinct(), "path", "left")
    refs = _references(rows, "group_id", chosen)
    about = members.select(F.col("path").alias("_reference"), *[F.col(c).alias(f"ref_{c}") for c in ("size", "digest", "is_current", "stream_map")])
    held = rows.where(chosen).join(refs, F.col("group_id") == F.col("_group")).join(about, "_reference")
    label = F.when(F.col("_all"), "comparison copy").otherwise("remaining copy")
    differ = stream_differences(F.col("ref_stream_map"), F.col("stream_map"), F.col("_all"))
    lower = F.transform(differ, lambda n: F.lower(n))
    other = F.filter(differ, lambda n: ~F.lower(n).isin(ZONE, DROPBOX))
    unequal = ~F.col("size").eqNullSafe(F.col("ref_size")) | ~F.col("digest").eqNullSafe(F.col("ref_digest"))
    reason = (
        F.when(~F.col("ref_is_current"), F.concat(label, F.lit(" can't be verified")))
        .when(~F.col("is_current"), "changed since the scan")
        .when(unequal & ~F.col("contents_verified"), F.concat(F.lit("contents don't match the "), label))
        .when(unequal, F.concat(F.lit("contents no longer match the "), label))
        .when(F.size(other) > 0, F.concat(F.lit("extra streams differ: "), F.array_join(other, ", ")))
        .when(F.array_contains(lower, ZONE) & F.lit(not allow_zone), "download mark differs; consent needed")
        .when(F.array_contains(lower, DROPBOX) & F.lit(not allow_dropbox), "sync mark differs; consent needed")
    )
    is_ref = F.col("path") == F.col("_reference")
    judged = held.withColumn("_why", F.when(~is_ref, reason)).withColumn("_ref_row", is_ref)
    verified = judged.groupBy("_group").agg(F.bool_or(~F.col("_ref_row") & F.col("_why").isNull()).alias("_verified"))
    judged = judged.join(verified, "_group")
    reason = F.when(F.col("_ref_row") & ~F.col("ref_is_current"), F.lit("comparison copy can't be verified")).when(F.col("_ref_row") & ~F.col("_verified"), F.lit("no matching copy could be verified")).otherwise(F.col("_why"))
    return judged.select("path", "group_id", F.when(F.col("_ref_row"), "reference").otherwise("copy").alias("role"), F.when(reason.isNull(), "remove").otherwise("keep").alias("verdict"), reason.alias("reason"))


def reviewed_plan(records: DataFrame, selection: DataFrame) -> DataFrame:
    """Similar files that a person has looked at: only a change since the scan speaks against removal."""
    chosen = records.join(selection.select("path").distinct(), "path", "left_semi")
    return chosen.select("path", F.when(F.col("is_current"), "remove").otherwise("keep").alias("verdict"), F.when(~F.col("is_current"), "changed since the scan").alias("reason"))


def check_nested(selection: DataFrame) -> None:
    """An error if a selected folder lies below another."""
    up = selection.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    if not selection.join(up, "path", "left_semi").isEmpty():
        raise ValueError("select a folder or what is in it, not both")


def folder_plan(folders: DataFrame, files: DataFrame, selection: DataFrame) -> DataFrame:
    """path, role, verdict, reason of selected folders.

    ``folders``: group_id, path, n_files, is_current; ``files``: path, size, digest (of content and streams now). A
    folder goes if it is current and its files match the reference's one to one.
    """
    check_nested(selection)
    chosen = F.col("_on").isNotNull()
    rows = folders.join(selection.select("path", F.lit(1).alias("_on")).distinct(), "path", "left")
    over = selection.select(F.explode(paths.ancestors(F.col("path"), itself=True)).alias("path")).distinct().withColumn("_over", F.lit(1))
    # selected folders that any folder lies below, named first: all folders share what lies near the top, which would meet in one task
    ups = folders.select(F.explode(paths.ancestors(F.col("path"))).alias("_up")).distinct()
    hits = cut(ups.join(selection.select(F.col("path").alias("_up")), "_up", "left_semi"))
    below = folders.select("path").limit(0)
    if not hits.isEmpty():
        below = folders.select("path", F.explode(paths.ancestors(F.col("path"))).alias("_up")).join(hits, "_up", "left_semi").select("path").distinct()
    below = below.withColumn("_below", F.lit(1))
    rows = rows.join(over, "path", "left").join(below, "path", "left")
    touched = F.col("_over").isNotNull() | F.col("_below").isNotNull()
    refs = _references(rows.withColumn("_touched", touched), "group_id", F.col("_touched"))
    # a file moves once, and a folder once per level
    sums = folder_sums(files.select("path", "size", F.struct("size", "digest").alias("content_id")))
    now = sums.where("n_files > 0").select(F.col("path").alias("folder"), F.col("n_files").alias("n"), F.struct("h1", "h2", "h3", "h4").alias("multiset"))
    held = rows.where(chosen).join(refs, F.col("group_id") == F.col("_group"))
    told = lambda p: now.select(F.col("folder").alias(p), F.col("n").alias(f"n_{p}"), F.col("multiset").alias(f"multiset_{p}"))
    about = folders.select(F.col("path").alias("_reference"), F.col("is_current").alias("_ref_current"))
    held = held.join(told("path"), "path", "left").join(told("_reference"), "_reference", "left").join(about, "_reference")
    is_ref = F.col("path") == F.col("_reference")
    why = (
        F.when(~F.col("_ref_current"), "comparison folder can't be verified")
        .when(~F.col("is_current"), "changed since the scan")
        .when(~F.col("n_path").eqNullSafe(F.col("n__reference")), "file counts differ")
        .when(~F.col("multiset_path").eqNullSafe(F.col("multiset__reference")), "contents differ")
    )
    judged = held.withColumn("_why", F.when(~is_ref, why)).withColumn("_ref_row", is_ref)
    verified = judged.groupBy("_group").agg(F.bool_or(~F.col("_ref_row") & F.col("_why").isNull()).alias("_verified"))
    judged = judged.join(verified, "_group")
    reason = F.when(F.col("_ref_row") & ~F.col("_ref_current"), F.lit("changed since the scan")).when(F.col("_ref_row") & (F.col("n_files") > 0) & ~F.col("_verified"), F.lit("no matching folder could be verified")).otherwise(F.col("_why"))
    return judged.select("path", F.when(F.col("_ref_row"), "reference").otherwise("copy").alias("role"), F.when(reason.isNull(), "remove").otherwise("keep").alias("verdict"), reason.alias("reason"))


def empty_folder_plan(folders: DataFrame, entries_now: DataFrame, selection: DataFrame) -> DataFrame:
    """Selected empty folders that are still there and empty may go."""
    full = entries_now.select(paths.parent(F.col("path")).alias("path")).distinct().withColumn("_full", F.lit(1))
    here = entries_now.select("path").distinct().withColumn("_here", F.lit(1))
    rows = folders.join(selection.select("path").distinct(), "path", "left_semi").join(full, "path", "left").join(here, "path", "left")
    reason = F.when(F.col("_here").isNull(), "no longer there").when(F.col("_full").isNotNull(), "no longer empty")
    return rows.select("path", F.when(reason.isNull(), "remove").otherwise("keep").alias("verdict"), reason.alias("reason"))


def prune_groups(members: DataFrame, removed: DataFrame, *, reference: str | None = None, keep_lone: Column | None = None) -> DataFrame:
    """Members left after paths (and all below them) are gone; groups need two, or what ``keep_lone`` says.

    With ``reference``, a column naming each group's reference, a group also needs that one.
    """
    gone = members.select("path", F.explode(paths.ancestors(F.col("path"), itself=True)).alias("_up")).join(removed.select(F.col("path").alias("_up")).distinct(), "_up", "left_semi").select("path").distinct()
    left = members.join(gone, "path", "left_anti")
    if reference:
        left = left.join(gone.withColumnRenamed("path", reference), reference, "left_anti")
    least = F.count("*") >= (1 if reference else 2)
    if keep_lone is not None:
        least = least | F.bool_and(keep_lone)
    alive = left.groupBy("group_id").agg(least.alias("_alive")).where("_alive").select("group_id")
    return left.join(alive, "group_id", "left_semi")


def prune_folders(folders: DataFrame, removed: DataFrame) -> DataFrame:
    """Folder groups after removals, which void the folders below and above them."""
    above = removed.select(F.explode(paths.ancestors(F.col("path"), itself=True)).alias("path")).distinct()
    return prune_groups(folders.join(above, "path", "left_anti"), removed, keep_lone=F.col("n_files") == 0)


def keep_one(members: DataFrame) -> DataFrame:
    """Members but the first of each group: what could go if one copy stays. Order: unselected first, then path."""
    order = Window.partitionBy("group_id").orderBy(F.coalesce("selected", F.lit(False)), "path")
    return members.withColumn("_k", F.row_number().over(order)).where("_k > 1").drop("_k")
