"""Lines that many documents share, found with levelled sorted runs of line hashes.

Runs are tables bucketed and sorted by hash, so that they meet by merging and are never moved. Documents come in
batches: a batch's hashes are counted, merge-anti-joined against the hashes that each run has already found in enough
documents, and the rest are added as a run of level 0. Two runs of one level are merged into one of the next.

What is found is held against the lines of every text where the texts lie, if it fits in a broadcast of a fixed size;
else only the documents that hold such lines are told which by a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsift.llm.scratch import Scratch

SPACES = b" \t\n\r\x0b\x0c"
BATCHES = 4
#: Common lines that are sent to every task at most, of 16 bytes each; more are joined.
BROADCAST_LINES = 1_000_000


def line_key(line: bytes) -> bytes:
    return line.strip(SPACES).lower()


def line_hash(key: bytes) -> bytes:
    """128 bits, so that even 10^12 lines have no two keys with one hash but by a chance of about 10^-15."""
    return xxhash.xxh3_128_digest(key)


class LineRuns:
    """How many documents have each line hash, as levels of sorted runs of which each has at most one."""

    def __init__(self, scratch: Scratch, min_docs: int):
        self.scratch, self.min_docs = scratch, min_docs
        self.buckets = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[DataFrame | None] = []

    def _run(self, rows: DataFrame) -> DataFrame:
        return self.scratch.write_bucketed(rows.select("hash", "n_docs"), "hash", self.buckets, order="hash")

    def add(self, counts: DataFrame) -> None:
        """``counts``: hash, n_docs of one batch, each hash once."""
        for run in filter(None, self.levels):
            counts = counts.join(run.where(F.col("n_docs") >= self.min_docs).select("hash").hint("merge"), "hash", "left_anti")
        new, level = self._run(counts), 0
        while level < len(self.levels) and self.levels[level] is not None:
            new, self.levels[level] = self._merged(self.levels[level], new), None
            level += 1
        if level == len(self.levels):
            self.levels.append(None)
        self.levels[level] = new

    def finish(self) -> DataFrame:
        """Merges all runs; the hashes found in ``min_docs`` documents or more."""
        left = list(filter(None, self.levels))
        while len(left) > 1:
            left = [self._merged(left[0], left[1]), *left[2:]]
        if not left:
            return self.scratch.spark.createDataFrame([], "hash binary")
        return left[0].where(F.col("n_docs") >= self.min_docs).select("hash")

    def _merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.join(b.withColumnRenamed("n_docs", "more").hint("merge"), "hash", "full")
        out = self._run(both.select("hash", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs")))
        self.scratch.drop(a, b)
        return out


def _hashes(min_chars: int):
    @F.arrow_udf(T.ArrayType(T.BinaryType()))
    def hashes(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            data = t.as_buffer().to_pybytes() if t.is_valid else b""
            keys = {line_key(x) for x in data.split(b"\n")}
            out.append([line_hash(k) for k in keys if len(k) >= min_chars and (min_chars < 2 or len(k.decode()) >= min_chars)])
        return pa.array(out, pa.list_(pa.binary()))

    return hashes


class Found:
    """A set of 128-bit hashes as two sorted columns, 16 bytes each."""

    def __init__(self, hashes: bytes):
        pairs = np.frombuffer(hashes, np.uint64).reshape(-1, 2)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        self.heads, self.tails = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])
        # hashes whose first halves are equal, if ever there are any, stand side by side
        self.reach = int(np.unique(self.heads, return_counts=True)[1].max()) if len(pairs) else 0

    def has(self, hashes: list[bytes]) -> np.ndarray:
        asked = np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2)
        at, out = np.searchsorted(self.heads, asked[:, 0]), np.zeros(len(asked), bool)
        for k in range(self.reach):
            p = np.minimum(at + k, len(self.heads) - 1)
            out |= (self.heads[p] == asked[:, 0]) & (self.tails[p] == asked[:, 1])
        return out


_KEPT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def _kept(texts: pa.Array, gone_of) -> pa.Array:
    """``gone_of(place, lines)``: which of a text's lines go."""
    kept, n, gone = [], [], []
    for k, t in enumerate(texts):
        data = t.as_buffer().to_pybytes() if t.is_valid else b""
        lines = data.split(b"\n")
        goes = gone_of(k, lines)
        dropped = int(np.count_nonzero(goes)) if goes is not None else 0
        if dropped:
            data = b"\n".join([x for x, g in zip(lines, goes, strict=True) if not g])
        kept.append(data.decode() if t.is_valid else None)
        n.append(len(lines))
        gone.append(dropped)
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=["text", "n_lines", "n_dropped"])


@F.arrow_udf(_KEPT)
def _without(texts: pa.Array, dropped: pa.Array) -> pa.Array:
    def gone_of(k: int, lines: list[bytes]):
        if not dropped[k].is_valid:
            return None
        drop = set(dropped[k].as_py())
        return [line_hash(line_key(x)) in drop for x in lines]

    return _kept(texts, gone_of)


def _without_found(shipped):
    held: list[Found] = []

    @F.arrow_udf(_KEPT)
    def without(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Found(shipped.value))
        return _kept(texts, lambda k, lines: held[0].has([line_hash(line_key(x)) for x in lines]))

    return without


def common_lines(documents: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(hashes of lines found in ``min_docs`` documents, the hashes of each document by id and digest)."""
    scratch = scratch or Scratch(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(
        "doc_id",
        F.xxhash64("text").alias("digest"),
        _hashes(min_chars)(F.col("text").cast("binary")).alias("hashes"),
    )
    rows = scratch.write(rows)
    runs = LineRuns(scratch, min_docs)
    for b in range(batches):
        batch = rows.where(F.pmod(F.xxhash64("doc_id", "digest"), F.lit(batches)) == b)
        runs.add(batch.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("n_docs")))
    return runs.finish(), rows


def line_report(documents: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES, scratch: Scratch | None = None, broadcast: int = BROADCAST_LINES) -> DataFrame:
    """document (all columns of a row of ``documents``), text (without common lines), n_lines, n_dropped.

    A line is common if ``min_docs`` documents have its key: the line without white space at its ends and with A-Z in
    lower case, of ``min_chars`` code points at least. A row is a document, so repeated rows count each; a line that
    a document repeats counts once. Null and empty texts are one empty line; null texts stay null. The documents'
    columns travel in a struct, where no name can clash. An empty table stays empty.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark)
    found, rows = common_lines(documents, min_docs, min_chars, batches, scratch)
    found = scratch.write(found)
    keyed = documents.select(F.struct("*").alias("document"), F.col("doc_id").cast("long").alias("_own"), F.col("text").cast("string").alias("_text"))
    if found.count() <= broadcast:
        held = found.toArrow().column("hash")
        without = _without_found(spark.sparkContext.broadcast(b"".join(held.to_pylist())))
        out = keyed.select("document", without(F.col("_text").cast("binary")).alias("_out"))
    else:
        dropped = (
            rows.select("doc_id", "digest", F.explode("hashes").alias("hash"))
            .join(found, "hash", "left_semi")
            .groupBy("doc_id", "digest")
            .agg(F.collect_set("hash").alias("_dropped"))
            .select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "_dropped")
        )
        on = F.col("_own").eqNullSafe(F.col("_id")) & (F.xxhash64("_text") == F.col("_digest"))
        out = keyed.join(dropped.hint("shuffle_hash"), on, "left").select("document", _without(F.col("_text").cast("binary"), F.col("_dropped")).alias("_out"))
    return out.select("document", "_out.*")


def drop_common_lines(documents: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES, scratch: Scratch | None = None, broadcast: int = BROADCAST_LINES) -> DataFrame:
    """``documents`` without their common lines, as ``line_report`` tells them; all other columns as they are."""
    out = line_report(documents, min_docs, min_chars, batches, scratch, broadcast)
    return out.select(*[F.col("text") if c == "text" else F.col(f"document.`{c}`") for c in documents.columns])
