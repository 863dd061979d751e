"""Groups of equal files: keys first, then digests, then contents, then what may differ a little.

Keys are counted before rows meet: a group's members are found by joining its key back, so no group is gathered in one
task. Where contents come as a column, each is digested where it is scanned and left there; only those whose digests are equal
are held against each other, folded to a least and a most per group before they move. Where files have no such column, tasks open them by byte
ranges (``sources.contents``) and no content moves at all. What is left between the stages is narrow and written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions import fingerprints, paths
from twinsift.operators import tolerance
from twinsift.operators.graph import cut
from twinsift.plans.matching import Matching, matching
from twinsift.sources import contents

#: Rows that are sent to every task at most, each a path and its group.
FEW = 200_000
#: Bytes of a content that are compared at once.
CHUNK = 4 << 20


def on_keys(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups`` on equal keys, nulls equal to nulls."""
    named = groups.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    return rows.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], how).drop(*[f"_{k}" for k in keys])


def sharing(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur more than once."""
    return on_keys(rows, rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), keys, "left_semi") if keys else rows


def keyed(files: DataFrame, want: Matching) -> tuple[DataFrame, list[str]]:
    """``files`` with their exact keys as columns; a file that lacks a time that is asked for takes no part."""
    keys = want.exact()
    lacking = [s.column().isNotNull() for s in want.same if s.what == "born"]
    return (files.where(lacking[0]) if lacking else files).withColumns(keys), list(keys)


def candidates(files: DataFrame, want: Matching) -> tuple[DataFrame, list[str]]:
    """Files whose exact keys at least one other file shares, with these keys as columns."""
    rows, keys = keyed(files, want)
    return sharing(rows, keys), keys


def digested(files: DataFrame, want: Matching, issues: list[DataFrame], apart: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Files that share their keys and their digest, without contents, and the columns that they share.

    A content in its row is digested there, as are those of a table of their own, ``apart`` (path, content). Files on disk are read where keys are shared, first at the ends and in the middle, and
    then as a whole where that is equal too; what can't be read is added to ``issues`` (path, reason).
    """
    rows, keys = keyed(files, want)
    if apart is not None:
        told = sharing(rows, keys).join(apart.select("path", fingerprints.file_digest(F.col("content")).alias("digest")), "path")
        return sharing(cut(told), [*keys, "digest"]), [*keys, "digest"]
    if "content" in files.columns:
        told = cut(rows.withColumn("digest", fingerprints.file_digest(F.col("content"))).drop("content"))
        return sharing(told, [*keys, "digest"]), [*keys, "digest"]
    found = cut(sharing(rows, keys))
    for column, read in (("key_sample", contents.samples), ("digest", contents.digests)):
        told = cut(read(found))
        issues.append(told.where("reason IS NOT NULL").select("path", "reason"))
        keys = [*keys, column]
        found = cut(sharing(found.join(told.where("reason IS NULL").drop("reason"), "path"), keys))
    return found, keys


def few(rows: DataFrame) -> DataFrame:
    """``rows``, to be sent to every task if they are at most ``FEW``."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def _apart(members: DataFrame, files: DataFrame) -> DataFrame:
    """(path, group_id): ``members`` grouped anew by the contents themselves."""
    held = members.select("path").join(files.select("path", "content"), "path")
    return held.join(held.groupBy("content").agg(F.min("path").alias("group_id")), "content").select("path", "group_id")


def verified(members: DataFrame, files: DataFrame, issues: list[DataFrame] | None = None) -> DataFrame:
    """``members`` (path, group_id: the least path) with the group in which all bytes are equal; the rest of a group parts from it.

    Contents in rows: per group and chunk the least and the most content are found, in part where rows lie, so a popular file moves
    once per task and not once per copy; they are equal iff all are. Files on disk are opened by pairs, each with its group's first.
    """
    if "content" not in files.columns:
        return _verified_on_disk(members, files, [] if issues is None else issues)
    n = F.octet_length("content")
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / CHUNK).cast("int")), lambda k: F.substring(F.col("content"), k * CHUNK + 1, F.lit(CHUNK)))
    held = files.select("path", "content").join(few(members.select("path", "group_id")), "path")
    each = held.select("group_id", n.alias("_n"), F.posexplode(parts).alias("_part", "_bytes"))
    told = each.groupBy("group_id", "_part").agg((F.min("_bytes") == F.max("_bytes")).alias("_same"), (F.min("_n") == F.max("_n")).alias("_long"))
    mixed = cut(told.where("NOT (_same AND _long)").select("group_id").distinct())
    if mixed.isEmpty():
        return members
    apart = _apart(members.join(mixed, "group_id", "left_semi"), files)
    named = members.join(mixed, "group_id", "left_anti").select("path", "group_id").unionByName(apart)
    return members.drop("group_id").join(named, "path")


def _verified_on_disk(members: DataFrame, files: DataFrame, issues: list[DataFrame]) -> DataFrame:
    """As ``verified``. Of those that differ from their group's first, the least is the first of a further round."""
    left, named = members.select("path", "group_id"), None
    while True:
        told = cut(contents.equal_to(files, left.where("path <> group_id").withColumnRenamed("group_id", "other")))
        issues.append(told.where("reason IS NOT NULL").select("path", "reason"))
        equal = left.where("path = group_id").unionByName(left.join(told.where("equal AND reason IS NULL"), "path", "left_semi"))
        named = equal if named is None else named.unionByName(equal)
        other = cut(left.join(told.where("NOT equal AND reason IS NULL"), "path", "left_semi"))
        if other.isEmpty():
            return members.drop("group_id").join(named, "path")
        left = other.join(other.groupBy("group_id").agg(F.min("path").alias("_first")), "group_id").select("path", F.col("_first").alias("group_id"))


def duplicate_groups(files: DataFrame, want: Matching | None = None, issues: list[DataFrame] | None = None, apart: DataFrame | None = None) -> DataFrame:
    """Members of groups: group_id (their least path), digest, byte_verified and the file's columns but content.

    Needs path (once per file), size and what ``want`` names. Evidence is taken from content, or from ``apart`` (path, content), which lets
    files be joined with other tables while contents stay where they lie, or, without either, from the files themselves, which needs modified_ns and inode; what can't be read, or has changed, is added to ``issues`` as frames of (path,
    reason). Files whose size or name may differ a little are grouped by the rules of ``operators.tolerance`` within what they share exactly.
    """
    want, issues = want or matching(), [] if issues is None else issues
    if want.evidence:
        found, by = digested(files, want, issues, apart)
    else:
        found, by = candidates(files.drop("content"), want)
        found = found.withColumn("digest", F.lit(None).cast("string"))
    if "bytes" in want.evidence:
        first = found.groupBy(*by).agg(F.min("path").alias("group_id"))
        found = verified(cut(on_keys(found, first, by)), files if apart is None else apart, issues).withColumnRenamed("group_id", "key_bytes")
        by = [*by, "key_bytes"]
    names, sizes = want.tolerance("name"), want.tolerance("size")
    if names:
        fitted = found.withColumn("name_key", names.column())
        fitted = tolerance.similar_name_groups(fitted, by, names.within, sizes.within if sizes else None).select("path", F.col("group_id").alias("key_fit"))
        found, by = found.join(fitted, "path"), ["key_fit"]
    elif sizes:
        found = tolerance.size_anchors(found, by, "size", sizes.within).withColumnRenamed("anchor", "key_anchor")
        by = [*by, "key_anchor"]
    found = cut(found)
    folders = F.count_distinct(paths.parent(F.col("path"))) if want.several_folders else F.lit(2)
    groups = found.groupBy(*by).agg(F.count("*").alias("_n"), F.min("path").alias("group_id"), folders.alias("_folders")).where("_n > 1 AND _folders > 1")
    out = on_keys(found, groups.drop("_n", "_folders"), by)
    kept = [c for c in files.columns if c not in ("content", "digest")]
    digest = F.col("digest") if "digest" in want.evidence else F.lit(None).cast("string")
    return cut(out.select("group_id", digest.alias("digest"), F.lit(want.byte_verified).cast("boolean").alias("byte_verified"), *kept))


def member_order() -> tuple[Column, ...]:
    """Members by group and, within a group, by caseless path."""
    return F.col("group_id"), paths.casefold(F.col("path")), F.col("path")


def total_size(size: Column, streams: Column | None = None) -> Column:
    if streams is None:
        return size
    return size + F.aggregate(F.coalesce(streams, F.array()), F.lit(0).cast("long"), lambda a, s: a + s["size"])


def status(verified: Column, digest: Column, checked: Column, differ: Column) -> Column:
    """The five outcomes of a group's verification; their names are fixed values."""
    return (
        F.when(~verified & digest.isNotNull(), "Hash match — bytes not verified")
        .when(~verified, "Possible match — contents not verified")
        .when(~checked, "Metadata not checked — rescan")
        .when(differ, "Metadata differs")
        .otherwise("Exact match")
    )


def differing_streams(members: DataFrame) -> DataFrame:
    """(group_id, name): streams that not all members of a group have with one size and hash.

    ``members``: group_id, path, streams (name, size), stream_hashes (name, sha256). A stream that a member lacks
    shows as a count below the members'.
    """
    n = members.groupBy("group_id").agg(F.count("*").alias("n"))
    each = members.select("group_id", "path", F.explode("streams").alias("s"), "stream_hashes").select("group_id", "path", F.col("s.name").alias("name"), F.col("s.size").alias("size"), F.element_at(F.map_from_entries("stream_hashes"), F.col("s.name")).alias("sha256"))
    seen = each.groupBy("group_id", "name").agg(F.count("*").alias("present"), F.count_distinct("size", F.coalesce("sha256", F.lit(""))).alias("kinds"))
    return seen.join(n, "group_id").where("kinds > 1 OR present < n").select("group_id", "name")


def summarize(members: DataFrame) -> DataFrame:
    """A row per group: n_files, total, recoverable bytes, sizes, status and number, largest recovery first.

    Ties go by the least path. ``members`` holds group_id, path, size, digest and byte_verified; streams and
    stream_hashes if there are any.
    """
    with_streams = "streams" in members.columns
    if with_streams and "stream_hashes" not in members.columns:  # none has been read
        members = members.withColumn("stream_hashes", F.array().cast("array<struct<name:string,sha256:string>>"))
    whole = total_size(F.col("size"), F.col("streams") if with_streams else None)
    names = lambda c: F.array_sort(F.transform(F.coalesce(c, F.array()), lambda s: s["name"]))
    checked = (names(F.col("streams")) == names(F.col("stream_hashes"))) if with_streams else F.lit(True)
    rows = members.withColumn("_total", whole).withColumn("_checked", checked)
    out = rows.groupBy("group_id").agg(
        F.count("*").alias("n_files"),
        F.sum("_total").cast("long").alias("total_bytes"),
        (F.sum("_total") - F.max("_total")).cast("long").alias("extra_bytes"),
        F.min("_total").alias("least_size"),
        F.max("_total").alias("most_size"),
        F.first("digest").alias("digest"),
        F.every(F.coalesce("byte_verified", F.col("digest").isNotNull())).alias("contents_verified"),
        F.every("_checked").alias("metadata_checked"),
    )
    if with_streams:
        differ = differing_streams(members).groupBy("group_id").agg(F.array_sort(F.collect_set("name")).alias("differing_streams"))
        out = out.join(differ, "group_id", "left").withColumn("differing_streams", F.coalesce("differing_streams", F.array().cast("array<string>")))
    else:
        out = out.withColumn("differing_streams", F.array().cast("array<string>"))
    return out.withColumn("status", status(F.col("contents_verified"), F.col("digest"), F.col("metadata_checked"), F.size("differing_streams") > 0))


def stream_states(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(group_id, path, stream, size, state): how each member stands to every named stream that any member of its group has.

    ``groups`` as from ``summarize``; ``members`` holds group_id, path, streams and stream_hashes. States: absent (the member
    lacks it), unread (it has no digest), unequal and equal (among all members of the group).
    """
    names = members.select("group_id", F.explode("streams.name").alias("stream")).distinct()
    differ = groups.select("group_id", F.explode("differing_streams").alias("stream"), F.lit(True).alias("differs"))
    sizes, hashes = F.map_from_entries("streams"), F.map_from_entries("stream_hashes")
    each = members.join(names, "group_id").join(differ, ["group_id", "stream"], "left")
    size = F.element_at(sizes, F.col("stream"))
    state = F.when(size.isNull(), "absent").when(F.element_at(hashes, F.col("stream")).isNull(), "unread").when(F.col("differs"), "unequal").otherwise("equal")
    return each.select("group_id", "path", "stream", size.alias("size"), state.alias("state"))
