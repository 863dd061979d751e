"""Folders as multisets of contents: roll-ups over ancestors, equal folders, empty folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions import paths
from twinsift.scratch import Scratch


def content_ids(files: DataFrame, content_key: str) -> DataFrame:
    """``files`` with ``content_id``: the least path that holds the same content."""
    ids = files.groupBy(F.col(content_key).alias("_key")).agg(F.min("path").alias("content_id"))
    return files.join(ids, files[content_key].eqNullSafe(F.col("_key"))).drop("_key")


#: Sums that make up a folder's facts. Two 64-bit hashes of a content are added up in halves, so that sums never overflow
#: and equal multisets of contents, and by all likelihood no others, have equal sums.
_SUMS = ("n_files", "total_size", "n_dirs", "h1", "h2", "h3", "h4")


def _halved(*what: str) -> list[Column]:
    halves = lambda h: (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))
    return [x.alias(f"h{i}") for i, x in enumerate([*halves(F.xxhash64(*what, F.lit(1))), *halves(F.xxhash64(*what, F.lit(2)))], 1)]


def content_hashes(content: str) -> list[Column]:
    return _halved(content)


def _folded(*what: str | Column) -> Column:
    """Two 64-bit hashes of some columns, to be told apart by: they move instead of what they stand for."""
    return F.struct(F.xxhash64(*what, F.lit(3)).alias("x"), F.xxhash64(*what, F.lit(4)).alias("y"))


def folder_sums(files: DataFrame, directories: DataFrame | None = None, counted: DataFrame | None = None) -> DataFrame:
    """path and _SUMS of every folder that files (path, size, content_id) or directories name or imply, the whole tree below it counted.

    What is added to earlier sums comes about likewise: files may have a ``sign``, -1 for those that earlier sums hold and that
    are no more, and ``counted`` names folders that earlier sums count already.

    Files are added up in their own folders. Then, from the deepest level up, each folder's sums are added to those of the one
    above it, so a file moves once and a folder once per level; a level's rows are its folders, however many lie below.
    """
    scratch = Scratch(files.sparkSession)
    zero = F.lit(0).cast("long")
    sign = F.col("sign").cast("long") if "sign" in files.columns else F.lit(1).cast("long")
    facts = [F.lit(1).cast("long").alias("n_files"), F.col("size").cast("long").alias("total_size"), zero.alias("n_dirs"), *content_hashes("content_id")]
    own = files.select(paths.parent(F.col("path")).alias("path"), sign.alias("_sign"), *facts).select("path", *[(F.col(c) * F.col("_sign")).alias(c) for c in _SUMS])
    if counted is not None:
        own = own.unionByName(counted.select("path", *[(zero - 1 if c == "n_dirs" else zero).alias(c) for c in _SUMS]))
    if directories is not None:
        own = own.unionByName(directories.select("path", *[zero.alias(c) for c in _SUMS]))
    added = lambda df: df.groupBy("path").agg(*[F.sum(c).alias(c) for c in _SUMS])
    level = F.when(F.col("path") == "/", 0).otherwise(paths.depth(F.col("path")))
    named = scratch.write_freed(added(own).withColumn("_level", level))
    deepest = named.agg(F.max("_level")).first()[0]
    if deepest is None:
        return named.select("path", *_SUMS)
    out, below = [], None
    for k in range(deepest, -1, -1):
        rows, itself = named.where(F.col("_level") == k).select("path", *_SUMS), F.col("n_dirs") + 1
        if below is None:  # nothing is added to the deepest level, which is read where it is
            below = rows.withColumn("n_dirs", itself)
        else:
            rows = added(rows.unionByName(below.select(paths.parent(F.col("path")).alias("path"), *_SUMS)))
            below = scratch.write_freed(rows.withColumn("n_dirs", itself))
        out.append(below)
    every = reduce(DataFrame.unionByName, out)
    every._scratch_path = scratch.folder  # of all levels
    return every


def rollup(files: DataFrame, directories: DataFrame | None = None) -> DataFrame:
    """path, n_files, total_size and n_dirs (itself included) of every folder that files or directories name or imply."""
    return folder_sums(files.select("path", "size", F.lit(0).alias("content_id")), directories).select("path", "n_files", "total_size", "n_dirs")


def poisoned(issues: DataFrame) -> DataFrame:
    """Folders that hold an unreadable entry anywhere below, and that entry's own path."""
    return issues.select(F.explode(paths.ancestors(F.col("path"), itself=True)).alias("path")).distinct()


def multiset_signature(members: DataFrame, owner: str, item: str) -> DataFrame:
    """owner, n_items, signature: a digest that owners share iff their multisets of items are equal (but for chance).

    It sums a hash of each (item, count), so a large owner is aggregated in parts and never gathered.
    """
    counts = members.groupBy(owner, item).agg(F.count("*").alias("_n"))
    halves = counts.select(owner, "_n", *_halved(item, "_n"))
    sums = halves.groupBy(owner).agg(F.sum("_n").alias("n_items"), F.count("*").alias("_items"), *[F.sum(f"h{i}").alias(f"h{i}") for i in range(1, 5)])
    return sums.select(owner, "n_items", _folded("_items", "h1", "h2", "h3", "h4").alias("signature"))


def equal_multisets(members: DataFrame, owner: str, item: str) -> DataFrame:
    """owner, n_items, group_id (the least owner): owners whose multisets of items another owner shares."""
    signed = multiset_signature(members, owner, item)
    groups = signed.groupBy("n_items", "signature").agg(F.min(owner).alias("group_id"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return signed.join(groups, ["n_items", "signature"]).select(owner, "n_items", "group_id")


def duplicate_folders(files: DataFrame, directories: DataFrame | None = None, issues: DataFrame | None = None, roots: list[str] | None = None) -> DataFrame:
    """group_id, path, n_files, total_size of folders with equal contents, and of empty folders by themselves.

    ``files``: path, size, content_id. A folder with an unreadable entry below it takes no part, nor does the root
    of the file system. With ``roots`` only these are offered, compared by their whole trees. Folders of a group do
    not lie within each other: equal ones that do are dealt to further groups, from the top down, so that a folder's
    group is told by how many of those above it are equal to it.
    """
    scratch, sums = Scratch(files.sparkSession), folder_sums(files, directories)
    rows = signed(sums)
    if issues is not None:
        rows = rows.join(poisoned(issues), "path", "left_anti")
    if roots is not None:
        rows = rows.where(F.col("path").isin(roots))
    rounds = _rounds(sums)
    rows = scratch.write_freed(_dealt_to(rounds, rows), by="_round")
    scratch.drop(sums)
    return _grouped(rows, rounds, scratch, apart=roots is None)


def signed(sums: DataFrame) -> DataFrame:
    """path, n_files, total_size, n_dirs, signature of folders other than the root of the file system."""
    rows = sums.where(F.col("path") != "/").withColumn("signature", _folded("h1", "h2", "h3", "h4"))
    return rows.select("path", "n_files", "total_size", "n_dirs", "signature")


def equal_folders(rows: DataFrame) -> DataFrame:
    """Groups among ``rows`` as ``signed`` gives them, none with folders that lie within each other. All folders of a signature must be there; other signatures have no say."""
    scratch, rounds = Scratch(rows.sparkSession), _rounds(rows)
    return _grouped(scratch.write_freed(_dealt_to(rounds, rows), by="_round"), rounds, scratch)


#: What equal folders share.
_SAME = ("signature", "n_files")
#: Folders meet by signature in rounds, each with a share of the signatures: as many folders as one may hold, and rounds at most.
#: What is shuffled at once stays small, however many folders there are; few make one round.
_ROUND, _ROUNDS = 8_000_000, 16


def _rounds(rows: DataFrame) -> int:
    return min(_ROUNDS, max(1, -(-rows.count() // _ROUND)))


def _dealt_to(rounds: int, rows: DataFrame) -> DataFrame:
    return rows.withColumn("_round", F.pmod(F.col("signature.x"), F.lit(rounds)).cast("int"))


def _several(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows whose signature another shares, and empty folders, which can be groups by themselves; with their level."""
    shared = rows.groupBy(*_SAME).agg(F.count("*").alias("_n")).where("_n > 1 OR n_files = 0").drop("_n")
    return scratch.write_freed(rows.join(shared, [*_SAME], "left_semi").withColumn("_level", paths.depth(F.col("path"))))


def _dealt(several: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Levels of ``several``, of which nothing is left, with ``part``: how many folders above a folder are equal to it.

    All folders between two that are equal are equal too, so it is one more than that of the folder right above, if that is
    equal. Levels follow each other from the top down, and each is written before the next: a folder moves once, the one above
    it as a hash of 16 bytes.
    """
    columns = [c for c in several.columns if c != "_level"]
    first, last = several.agg(F.min("_level"), F.max("_level")).first()
    if first is None:
        return [several.select(*columns, F.lit(0).alias("part"))]
    out, above = [], None
    for k in range(first, last + 1):
        rows, part = several.where(F.col("_level") == k), F.lit(0)
        if above is not None:
            at = above.select(_folded(*_SAME, "path").alias("_up"), (F.col("part") + 1).alias("_part"))
            rows = rows.withColumn("_up", _folded(*_SAME, paths.parent(F.col("path")))).join(at, "_up", "left")
            part = F.coalesce("_part", part)
        above = scratch.write_freed(rows.select(*columns, part.alias("part")))
        out.append(above)
    scratch.drop(several)
    return out


def _dealt_roots(several: DataFrame) -> DataFrame:
    """As ``_dealt`` where folders between two that are equal needn't be there."""
    several = several.drop("_level").withColumn("_own", _folded(*_SAME, "path"))
    up = several.select(*_SAME, "_own", F.explode(paths.ancestors(F.col("path"))).alias("_above")).select("_own", _folded(*_SAME, "_above").alias("_up"))
    nested = up.join(several.select(F.col("_own").alias("_up")), "_up").groupBy("_own").agg(F.count("*").alias("part"))
    return several.join(nested, "_own", "left").drop("_own").withColumn("part", F.coalesce("part", F.lit(0)))


def _grouped(rows: DataFrame, rounds: int, scratch: Scratch, *, apart: bool = True) -> DataFrame:
    """Groups of ``rows``, of which nothing is left; folders that are equal, or may lie within each other's groups, are in one round."""
    out = []
    for k in range(rounds):
        several = _several(rows.where(F.col("_round") == k).drop("_round"), scratch)
        if k == rounds - 1:
            scratch.drop(rows)
        dealt = _dealt(several, scratch) if apart else [_dealt_roots(several)]
        every = reduce(DataFrame.unionByName, dealt)
        groups = every.groupBy(*_SAME, "part").agg(F.min("path").alias("group_id"), F.count("*").alias("_n"), F.min("n_dirs").alias("_dirs"))
        groups = groups.where((F.col("_n") > 1) | ((F.col("n_files") == 0) & (F.col("_dirs") == 1))).select(*_SAME, "part", "group_id")
        out.append(scratch.write_freed(every.join(groups, [*_SAME, "part"]).select("group_id", "path", "n_files", "total_size")))
        scratch.drop(*dealt, several)
    return reduce(DataFrame.unionByName, out)


def folder_order() -> tuple[Column, ...]:
    """The order of folders: groups by their first path, in them by path, both caseless."""
    return paths.casefold(F.col("group_id")), F.col("group_id"), paths.casefold(F.col("path")), F.col("path")


def empty_folders(directories: DataFrame, entries: DataFrame, roots: list[str]) -> DataFrame:
    """Directories without any entry in them, the given roots left out. ``entries``: path of every file and folder."""
    inside = entries.select(paths.parent(F.col("path")).alias("path")).distinct()
    return directories.join(inside, "path", "left_anti").where(~F.col("path").isin(roots))
