"""Packed blocks of documents, and places in a global order, over tables in the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.operators.graph import numbered as numbered_from
from twinsift.scratch import Scratch

NULL_ID = np.iinfo(np.int64).max


BLOCK_SCHEMA = "block long, n_docs long, n_bytes long, ids binary, lens binary, text binary"


def block_rows(batches, block_bytes: int, partition: int):
    """Packs (id, UTF-8 bytes) rows into blocks of about ``block_bytes``; a longer text is a block of its own."""
    ids: list[int] = []
    texts: list[bytes] = []
    held, seq = 0, 0

    def packed():
        nonlocal ids, texts, held, seq
        row = pa.RecordBatch.from_pydict(
            {
                "block": pa.array([(partition << 32) + seq], pa.int64()),
                "n_docs": pa.array([len(ids)], pa.int64()),
                "n_bytes": pa.array([held], pa.int64()),
                "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                "lens": pa.array([np.array([len(t) for t in texts], np.int64).tobytes()], pa.binary()),
                "text": pa.array([b"".join(texts)], pa.binary()),
            }
        )
        ids, texts, held, seq = [], [], 0, seq + 1
        return row

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = t.as_buffer().to_pybytes() if t.is_valid else b""
            if held and held + len(data) > block_bytes:
                yield packed()
            ids.append(NULL_ID if i is None else i)
            texts.append(data)
            held += len(data)
    if ids:
        yield packed()


def document_blocks(scratch: Scratch, documents: DataFrame, block_bytes: int, bucketed: bool = True) -> DataFrame:
    """Every document, packed; written once so that a block's number and content never change between passes.

    Null texts count as empty and null ids as the largest id. Only the two columns are read.
    """

    def pack(batches):
        from pyspark import TaskContext

        yield from block_rows(batches, block_bytes, TaskContext.get().partitionId())

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    blocks = narrow.mapInArrow(pack, BLOCK_SCHEMA)
    if not bucketed:
        return scratch.write(blocks)
    buckets = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scratch.write_bucketed(blocks, "block", buckets)


def numbered(scratch: Scratch, df: DataFrame, *order) -> DataFrame:
    """``df`` with ``row``, its place from 0 in the given order."""
    return numbered_from(df, *order, first=0, scratch=scratch)
