"""Contents of files, read in byte ranges where tasks run: digests, comparisons and chunks of files of any length.

Tasks open the files, so what moves between them are paths, ranges and digests; bytes never do, but in ``chunks``, which
gives them as rows. A range is held against the size, the time and the identity that the inventory saw, before and after it is
read; a file that has changed since is told with a reason and has no result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.functions.fingerprints import RANGE, SAMPLE

#: Bytes that a task holds of a file at a time.
BLOCK = 1 << 20
#: Digests that are folded into one at a time.
FOLD = 4096
#: Bytes of a task's share of ranges.
SHARE = 1 << 30

_SEEN = ("path", "size", "modified_ns", "inode")


class Changed(OSError):
    """The file is no longer what the inventory saw."""


def _held(f, size: int, modified_ns: int, inode: str) -> None:
    s = os.fstat(f.fileno())
    if (s.st_size, s.st_mtime_ns, str(s.st_ino)) != (size, modified_ns, str(inode)):
        raise Changed(f"{f.name} has changed since the scan")


def _blocks(f, at: int, end: int) -> Iterator[bytes]:
    f.seek(at)
    while at < end:
        block = f.read(min(BLOCK, end - at))
        if not block:
            raise Changed("ended early")
        at += len(block)
        yield block


def _ends(size: int) -> list[int]:
    """Where the windows of a sample begin: at the start, in the middle, at the end; equal ones once."""
    return sorted({0, max(0, (size - SAMPLE) // 2), max(0, size - SAMPLE)})


def _told(batches, schema: pa.Schema, work) -> Iterator[pa.RecordBatch]:
    """A row per row of input: what ``work`` gives, or the reason why it can't."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            try:
                out.append({**row, **work(row), "reason": None})
            except OSError as e:
                out.append({**row, "reason": str(e)})
        yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in out], schema)


def _sample(row: dict) -> dict:
    seen = row["size"], row["modified_ns"], row["inode"]
    told = hashlib.sha256()
    with open(row["path"], "rb") as f:
        _held(f, *seen)
        for at in _ends(row["size"]):
            for block in _blocks(f, at, min(row["size"], at + SAMPLE)):
                told.update(block)
        _held(f, *seen)
    return {"key_sample": told.hexdigest()}


def _digest(row: dict) -> dict:
    seen = row["size"], row["modified_ns"], row["inode"]
    told = hashlib.sha256()
    with open(row["path"], "rb") as f:
        _held(f, *seen)
        for block in _blocks(f, row["at"], row["end"]):
            told.update(block)
        _held(f, *seen)
    return {"digest": told.hexdigest()}


def _compare(row: dict) -> dict:
    """Whether two files are equal from ``at`` to ``end``; the first difference ends it."""
    seen = row["size"], row["modified_ns"], row["inode"]
    with open(row["path"], "rb") as f, open(row["other"], "rb") as g:
        _held(f, *seen)
        for a, b in zip(_blocks(f, row["at"], row["end"]), _blocks(g, row["at"], row["end"]), strict=True):
            if a != b:
                return {"equal": False}
        _held(f, *seen)
        _held(g, row["size"], row["other_modified_ns"], row["other_inode"])
    return {"equal": True}


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in tasks of about ``SHARE`` bytes to read, but no fewer than there are cores while rows last."""
    rows, held = df.agg(F.count("*"), F.coalesce(F.sum(F.col("end") - F.col("at")), F.lit(0))).first()
    return df.repartition(max(1, min(rows, df.sparkSession.sparkContext.defaultParallelism + int(held) // SHARE)), *keys)


def ranges(files: DataFrame, length: int = RANGE) -> DataFrame:
    """``files`` with part, at and end: a row per byte range of each file, one for an empty file."""
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / length)).cast("long")
    each = files.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumn("at", F.col("part") * length)
    return each.withColumn("end", F.least(F.col("at") + length, F.col("size")))


def _read(rows: DataFrame, columns: str, work, *keys: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = rows.sparkSession.createDataFrame([], f"{columns}, reason string").schema
    arrow = to_arrow_schema(schema)
    return _dealt(rows, *keys).mapInArrow(lambda batches: _told(batches, arrow, work), schema)


def samples(files: DataFrame) -> DataFrame:
    """(path, key_sample, reason): the digest of the first, the middle and the last window of each file."""
    rows = files.select(*_SEEN, F.lit(0).cast("long").alias("at"), F.least(F.col("size"), F.lit(3 * SAMPLE)).cast("long").alias("end"))
    return _read(rows, "path string, key_sample string", _sample, "path")


def digests(files: DataFrame, length: int = RANGE) -> DataFrame:
    """(path, digest, reason), each range of a file digested by a task of its own.

    A file of one range has the SHA-256 of its bytes. The digests of several are folded, ``FOLD`` neighbours at a time, into
    the SHA-256 of their texts, until one is left; a digest alone stays as it is.
    """
    parts = _read(ranges(files.select(*_SEEN), length), "path string, part long, digest string", _digest, "path", "part")
    most = files.agg(F.max("size")).first()[0] or 0
    left = -(-most // length)
    while True:
        parts = parts.groupBy("path", F.floor(F.col("part") / FOLD).cast("long").alias("part")).agg(F.array_sort(F.collect_list(F.struct("part", "digest"))).alias("_all"), F.max("reason").alias("reason"))
        folded = F.when(F.size("_all") == 1, F.get(F.col("_all.digest"), 0)).otherwise(F.sha2(F.array_join(F.col("_all.digest"), ""), 256))
        parts = parts.select("path", "part", F.when(F.col("reason").isNull(), folded).alias("digest"), "reason")
        left = -(-left // FOLD)
        if left <= 1:
            return parts.select("path", "digest", "reason")


def equal_to(files: DataFrame, pairs: DataFrame, length: int = RANGE) -> DataFrame:
    """(path, equal, reason) of ``pairs`` (path, other) of files of one size, compared range by range."""
    others = files.select(F.col("path").alias("other"), F.col("modified_ns").alias("other_modified_ns"), F.col("inode").alias("other_inode"))
    rows = ranges(pairs.join(files.select(*_SEEN), "path").join(others, "other"), length)
    told = _read(rows, "path string, equal boolean", _compare, "path", "part")
    return told.groupBy("path").agg(F.min("equal").alias("equal"), F.max("reason").alias("reason"))


def chunks(files: DataFrame, length: int = 4 << 20) -> DataFrame:
    """(path, chunk, content, reason): the bytes of each file, a row per ``length`` of them."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                content, reason = None, None
                try:
                    with open(row["path"], "rb") as f:
                        _held(f, row["size"], row["modified_ns"], row["inode"])
                        content = b"".join(_blocks(f, row["at"], row["end"]))
                        _held(f, row["size"], row["modified_ns"], row["inode"])
                except OSError as e:
                    content, reason = None, str(e)
                yield pa.RecordBatch.from_pydict({"path": pa.array([row["path"]], pa.string()), "chunk": pa.array([row["part"]], pa.int64()), "content": pa.array([content], pa.binary()), "reason": pa.array([reason], pa.string())})

    return _dealt(ranges(files.select(*_SEEN), length), "path", "part").mapInArrow(read, "path string, chunk long, content binary, reason string")
