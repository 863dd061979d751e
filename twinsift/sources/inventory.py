"""File inventories as a Spark data source, and tables read as inventories."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from twinsift.scratch import Scratch

SCHEMA = (
    "path string, kind string, size bigint, modified_ns bigint, changed_ns bigint, created_ns bigint, device bigint, inode string, nlink int, "
    "is_regular boolean, attributes bigint, reparse_tag bigint, streams array<struct<name:string,size:bigint>>, content binary, reason string"
)
# The attribute and the tag by which a link is told.
LINK, LINK_TAG = 0x400, 0xA000000C
#: Folders that a task lists in a round of ``walk_inventory``, and rows and bytes of what it hands over at once.
FOLDERS, ROWS, BYTES = 1000, 1000, 32 << 20


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class InventorySource(DataSource):
    """``format("inventory")``: files, directories and issues below ``roots`` (newline-separated absolute paths).

    Options: ``recursive`` (true), ``excluded`` (newline-separated), ``content`` (false), ``suffixes`` (newline-separated: files whose
    names end otherwise, whatever their case, are neither looked at nor opened). Filters on ``kind``, and on how ``path`` begins or ends,
    are met while folders are listed: what they rule out isn't asked for its facts, and no folder outside a beginning is entered. Folders are listed where
    the tasks run, so all executors must see the roots. Zero-length and hidden entries are listed like any other;
    links are not followed, and what can't be read becomes a row with a reason while the walk goes on.
    """

    @classmethod
    def name(cls) -> str:
        return "inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return InventoryReader(self.options)


class InventoryReader(DataSourceReader):
    def __init__(self, options):
        listed = lambda key: [os.path.abspath(p) for p in options.get(key, "").split("\n") if p]
        self.roots, self.excluded = sorted(set(listed("roots"))), set(listed("excluded"))
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.content = options.get("content", "false").lower() == "true"

        self.suffixes = tuple(x.lower() for x in options.get("suffixes", "").split("\n") if x)
        self.kinds: set[str] | None = None
        self.begins: tuple[str, ...] = ()
        self.ends: tuple[str, ...] = ()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            match f:
                case EqualTo(("kind",), str(kind)):
                    self._only({kind})
                case In(("kind",), values):
                    self._only({v for v in values if v is not None})
                case StringStartsWith(("path",), value):
                    self.begins += (value,)
                case StringEndsWith(("path",), value):
                    self.ends += (value,)
                case _:
                    yield f

    def _only(self, kinds: set[str]) -> None:
        self.kinds = kinds if self.kinds is None else self.kinds & kinds

    def _asked(self, *kinds: str) -> bool:
        return self.kinds is None or not self.kinds.isdisjoint(kinds)

    def _named(self, path: str) -> bool:
        return all(path.startswith(x) for x in self.begins) and all(path.endswith(x) for x in self.ends)

    def _entered(self, folder: str) -> bool:
        """Whether anything below a folder can begin as it must."""
        inside = folder.rstrip("/") + "/"
        return all(inside.startswith(x) or x.startswith(inside) for x in self.begins)

    def _closed(self, path: str) -> bool:
        while True:
            if path in self.excluded:
                return True
            up = os.path.dirname(path)
            if up == path:
                return False
            path = up

    def starts(self) -> list[str]:
        """Roots to walk: neither excluded nor, where the walk goes down, within another."""
        within = lambda r: self.recursive and any(r != o and r.startswith(o.rstrip("/") + "/") for o in self.roots)
        return [r for r in self.roots if not self._closed(r) and not within(r) and (self._entered(r) or self._named(r))]

    def partitions(self):
        """One for each root's own entries and one for each folder right below it."""
        out = []
        for root in self.starts():
            out.append(_Folder(root, False))
            if self.recursive:
                try:
                    with os.scandir(root) as entries:
                        below = sorted((e for e in entries if e.is_dir(follow_symlinks=False)), key=lambda e: e.path)
                    out += [_Folder(e.path, True) for e in below if not self._closed(e.path) and (self._entered(e.path) or self._named(e.path))]
                except OSError:
                    pass  # the root's own partition tells it
        return out

    def read(self, partition: _Folder):
        stack = [partition.path]
        while stack:
            folder = stack.pop()
            down: list[str] | None = stack if partition.deep else None
            yield from self.listed(folder, down, itself=folder == partition.path)

    def listed(self, folder: str, down: list[str] | None, *, itself: bool) -> Iterator[tuple]:
        """Rows of a folder's entries, and its own; folders in it are added to ``down``, or left to others."""
        try:
            with os.scandir(folder) as found:
                entries = sorted(found, key=lambda e: e.path)
            if itself:
                yield from self._told(folder, True)
        except OSError as e:
            yield from self._issue(folder, e)
            return
        for e in entries:
            if self._closed(e.path):
                continue
            try:
                is_dir = e.is_dir(follow_symlinks=False)
            except OSError as x:
                yield from self._issue(e.path, x)
                continue
            if is_dir and (not self.recursive or down is None):
                continue
            if is_dir and self._entered(e.path):
                down.append(e.path)
            if is_dir or not self.suffixes or e.name.lower().endswith(self.suffixes):
                yield from self._told(e.path, is_dir)

    def _told(self, path: str, is_dir: bool) -> Iterator[tuple]:
        if not self._named(path) or not (self._asked("directory", "issue") if is_dir else self._asked("file", "link", "issue")):
            return
        try:
            row = self._row(path)
        except OSError as e:
            yield from self._issue(path, e)
            return
        if self._asked(row[1]):
            yield row

    def _row(self, path: str) -> tuple:
        s = os.lstat(path)
        kind = "directory" if stat.S_ISDIR(s.st_mode) else "link" if stat.S_ISLNK(s.st_mode) else "file"
        content = None
        if self.content and stat.S_ISREG(s.st_mode):
            with open(path, "rb") as f:
                content = f.read()
            if (after := os.lstat(path)).st_mtime_ns != s.st_mtime_ns or after.st_size != s.st_size or after.st_ino != s.st_ino:
                raise OSError("changed while it was read")
        attributes, tag = (LINK, LINK_TAG) if kind == "link" else (0, 0)
        return (path, kind, s.st_size, s.st_mtime_ns, s.st_ctime_ns, getattr(s, "st_birthtime_ns", None), s.st_dev, str(s.st_ino), s.st_nlink, stat.S_ISREG(s.st_mode), attributes, tag, [], content, None)

    def _issue(self, path: str, error: OSError) -> Iterator[tuple]:
        if self._asked("issue") and self._named(path):
            yield (path, "issue", None, None, None, None, None, None, None, None, None, None, None, None, str(error))


def _options(roots: list[str], recursive: bool, excluded: tuple[str, ...], content: bool, suffixes: tuple[str, ...]) -> dict[str, str]:
    return {"roots": "\n".join(roots), "excluded": "\n".join(excluded), "recursive": str(recursive).lower(), "content": str(content).lower(), "suffixes": "\n".join(suffixes)}


def _parts(rows: DataFrame, content: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = rows.where("kind in ('file', 'link')").drop("kind", "reason", *([] if content else ["content"]))
    return files, rows.where("kind = 'directory'").select("path", "modified_ns", "changed_ns", "device", "inode"), rows.where("kind = 'issue'").select("path", "reason")


def read_inventory(spark: SparkSession, roots: list[str], *, recursive: bool = True, excluded: tuple[str, ...] = (), content: bool = False, suffixes: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, directories, issues). Without ``content`` files have no such column, and what asks for evidence opens them by ranges.

    Each of the three walks the roots when it is read, asking of entries only what its kind needs; filters are handed to the source, which
    takes the session's setting for that.
    """
    spark.dataSource.register(InventorySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return _parts(spark.read.format("inventory").options(**_options(roots, recursive, excluded, content, suffixes)).load(), content)


def walk_inventory(spark: SparkSession, roots: list[str], *, recursive: bool = True, excluded: tuple[str, ...] = (), content: bool = False, suffixes: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``read_inventory``, listed once and in rounds: the folders that one round finds are dealt to the tasks of the next.

    A deep tree below one folder is so listed by many tasks. Only counts go to the driver; each round is a table.
    """
    reader = InventoryReader(_options(roots, recursive, excluded, content, suffixes))
    schema = StructType.fromDDL(SCHEMA)
    arrow = to_arrow_schema(schema)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, itself in zip(batch["path"].to_pylist(), batch["itself"].to_pylist(), strict=True):
                for row in reader.listed(path, [], itself=itself):
                    values = dict(zip(arrow.names, row, strict=True))
                    rows.append(values)
                    held += len(values["content"] or b"")
                    if len(rows) >= ROWS or held >= BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    scratch = Scratch(spark)
    frontier = spark.createDataFrame([(r, True) for r in reader.starts()], "path string, itself boolean")
    rounds, n = [], frontier.count()
    while n:
        tasks = min(n, max(spark.sparkContext.defaultParallelism, -(-n // FOLDERS)))
        rounds.append(scratch.write(frontier.repartition(tasks).mapInArrow(listed, schema)))
        below = rounds[-1].where("kind = 'directory'").select("path", F.lit(False).alias("itself"))
        frontier = below.join(frontier.select("path"), "path", "left_anti")  # a root tells itself, and isn't below itself
        n = frontier.count() if recursive else 0
    every = reduce(DataFrame.unionByName, rounds) if rounds else spark.createDataFrame([], schema)
    return _parts(every, content)


def documents_as_files(documents: DataFrame) -> DataFrame:
    """A table of texts as files: /source/lang/doc_id.txt with the text's bytes."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return documents.select("doc_id", path.alias("path"), F.octet_length(text).cast("long").alias("size"), text.alias("content"))
