"""Document fingerprints by winnowing, and each document held against an edited text and its neighbour.

Every run of ``k`` code points has a rolling hash; of every window of consecutive hashes the least is kept, the
rightmost of equal ones, with its position. Two texts that share a passage of ``k + window - 1`` code points share at
least one kept hash, and no text keeps more than one hash per step of its windows.

The neighbour of a document is the next one in the order of ids. Rows are dealt to contiguous blocks of that order
in one shuffle; the first row of each block travels once more, as the neighbour of the block before.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of a gram, and grams of a window: shared passages of 47 code points and more are always noticed.
GRAM, WINDOW = 16, 32
#: Grams that are hashed at once, and bytes of a batch of results.
_BLOCK, _BATCH_BYTES = 1 << 18, 1 << 23
_BASE = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """The 32-bit hash of every run of ``k`` codes: a polynomial, built from runs of powers of two, and mixed."""
    part, size = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1
    out, length = None, 0
    while True:
        if k & size:
            out = part.copy() if out is None else out[: len(out) - size] * np.uint64(pow(_BASE, size, 1 << 64)) + part[length : length + len(out) - size]
            length += size
        if length == k:
            break
        part, size = part[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + part[size:], 2 * size
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(32)


def window_least(keys: np.ndarray, window: int) -> np.ndarray:
    """The least key of every ``window`` consecutive ones."""
    least, size = keys, 1
    while 2 * size <= window:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    return least if size == window else np.minimum(least[: len(least) - (window - size)], least[window - size :])


def winnowed(text: str, k: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) that winnowing keeps, in order of position.

    A text shorter than a gram is one gram, and fewer grams than a window are one window; the empty text keeps none.
    Long texts are hashed block by block.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    k = min(k, n)
    grams = n - k + 1
    window = min(window, grams)
    kept = []
    for at in range(0, grams - window + 1, _BLOCK):
        end = min(at + _BLOCK + window - 1, grams)
        codes = np.frombuffer(text[at : end + k - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        # a greater position is a smaller key, so that the rightmost of equal hashes wins
        keys = gram_hashes(codes, k) << np.uint64(32) | (np.uint64(0xFFFFFFFF) - np.arange(at, end, dtype=np.uint64))
        least = window_least(keys, window)
        kept.append(least[np.flatnonzero(np.r_[True, least[1:] != least[:-1]])])
    keys = np.concatenate(kept)
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
    return (keys >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (keys & np.uint64(0xFFFFFFFF))).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes over all hashes of two fingerprints, each counted once; 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def written(kept: tuple[np.ndarray, np.ndarray]) -> str:
    """A fingerprint as text: hash@position, in hexadecimal and decimal digits, separated by spaces."""
    return " ".join(["%08x@%d" % x for x in zip(kept[0].tolist(), kept[1].tolist())])


def fingerprints(documents: DataFrame, k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Every column of ``documents`` in ``document``, with ``hashes`` and ``positions`` of its text; null counts as empty."""
    shape = "array<struct<hash:long,position:long>>"

    @F.pandas_udf(shape)
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"hash": h, "position": p} for h, p in zip(*map(np.ndarray.tolist, winnowed(t or "", k, window)))] for t in texts])

    held = documents.select(F.struct("*").alias("document"), kept(F.col("text").cast("string")).alias("_kept"))
    return held.select("document", F.col("_kept.hash").alias("hashes"), F.col("_kept.position").alias("positions"))


def next_in_order(documents: DataFrame) -> DataFrame:
    """block, spare, doc_id, digest, text: blocks of the order of ids, each ended by the first row of the next (``spare``).

    The order is by id, nulls first, then by the text's digest. Blocks have about equally many rows, rows that repeat
    included; of each block the first row's id and digest go to the driver. The last block ends in the first row of all.
    """
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("tie")]
    firsts = rows.select("doc_id", "digest", "tie").repartitionByRange(n, *order).groupBy(F.spark_partition_id().alias("p"))
    firsts = firsts.agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "digest", "tie")).alias("f"))
    cuts = sorted(tuple(r.f) for r in firsts.collect())  # a row per block
    starts: dict[tuple, list[int]] = {}
    for b, (known, at, digest, _) in enumerate(cuts):
        starts.setdefault((known, at, digest), []).append((b - 1) % len(cuts))

    @F.pandas_udf("array<int>")
    def blocks(known: pd.Series, ids: pd.Series, digests: pd.Series, ties: pd.Series) -> pd.Series:
        """A row's block, and the blocks that it ends, as -1 - block; of rows that repeat, one of a batch is enough."""
        out, ended = [], set()
        for row in zip(known, ids, digests, ties):
            out.append([max(0, bisect_right(cuts, row) - 1)])
            if row[:3] in starts and row[:3] not in ended:
                ended.add(row[:3])
                out[-1] += [-1 - b for b in starts[row[:3]]]
        return pd.Series(out)

    of = blocks(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), F.col("digest"), F.col("tie"))
    dealt = rows.select(F.explode(of).alias("b"), "doc_id", "digest", "text")
    dealt = dealt.select(F.when(F.col("b") < 0, -1 - F.col("b")).otherwise(F.col("b")).alias("block"), (F.col("b") < 0).alias("spare"), "doc_id", "digest", "text")
    return dealt.repartitionById(max(1, len(cuts)), F.col("block")).sortWithinPartitions("block", "spare", F.col("doc_id").asc_nulls_first(), "digest")


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_kept long"


def _rows(batches):
    for b in batches:
        for block, spare, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4), strict=True):
            yield block, spare, i, t.as_py()


def edited_fingerprints(documents: DataFrame, k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_chars, its fingerprint, that of its edited text, and how like it both that and the next document are.

    The edited text has its last quarter (rounded down) replaced by as many code points from the start of the next
    document, or all of them. The next document is that of the next greater id, for the last one the first of all; nulls come first, and
    rows that share an id are ordered by a digest of their texts. Null texts count as empty; equal texts have equal fingerprints; a
    document alone is its own next. Likeness is the share of distinct hashes that two fingerprints have in common, 1 if
    both are empty. Rows that repeat give a row each, an empty table gives none, and other columns aren't read. A task
    holds a batch of rows and two documents.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_kept", pa.int64())])

    def compared(batches):
        out, held = [], 0
        before = None  # (block, id, text, fingerprint) of the row that waits for its next
        for block, spare, i, text in _rows(batches):
            if spare and (before is None or before[0] != block):
                continue
            kept = before[3] if before and before[2] == text else winnowed(text, k, window)
            if before and before[0] == block:
                _, of, own, mine = before
                cut = len(own) // 4
                edited = own[: len(own) - cut] + text[:cut]
                theirs = mine if edited == own else winnowed(edited, k, window)
                row = (of, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(mine), written(theirs), likeness(mine[0], theirs[0]), likeness(mine[0], kept[0]), len(mine[0]))
                out.append(row)
                held += len(row[3]) + len(row[4]) + 200
                if held > _BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, held = [], 0
            before = None if spare else (block, i, text, kept)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return next_in_order(documents).mapInArrow(compared, _RESULT)


def shares_passage(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """(position in a, position in b) of the hashes that two fingerprints share, the first of each in b."""
    order = np.argsort(b[0], kind="stable")
    hashes = b[0][order].tolist()
    out = []
    for h, p in zip(a[0].tolist(), a[1].tolist()):
        at = bisect_left(hashes, h)
        if at < len(hashes) and hashes[at] == h:
            out.append((p, int(b[1][order[at]])))
    return out
