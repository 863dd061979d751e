"""Importance resampling towards a target distribution over hashed features.

Words (or runs of words) are hashed to buckets and counted over the whole corpus and over the whole target. A bucket's gain is the
scaled log ratio of the two shares; a document's weight is the sum of its features' gains, read from an array, and
its score adds Gumbel noise drawn from its id. The highest scores are found from an exact histogram of the integer
scores: counts summed from above give every score its rank offset and the cutoff; only documents of scores at or above
it are ranked, by id within their score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.llm.scratch import Scratch, numbered

#: Documents of one score up to which they are ranked in one window; those of a more frequent score are dealt by range.
HOT_SCORE = 1_000_000
#: Bytes of text whose words are taken at once, and words whose buckets a worker remembers.
_PIECE, _MEMO = 1 << 22, 1 << 19
#: A-Z become a-z; what is no word character becomes a space. Bytes from 0x80 on belong to words.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256))


class Buckets(dict):
    """The bucket of a feature, remembered up to a bound."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature) % self.n
        return bucket


def feature_buckets(text: bytes, longest: int, buckets: Buckets) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them), piece by piece; runs reach over the ends of pieces."""
    text = text.translate(_FOLD)
    at, tail = 0, []
    while at < len(text):
        end = len(text) if len(text) - at <= _PIECE else text.find(b" ", at + _PIECE)
        end = len(text) if end < 0 else end
        words = text[at:end].split()
        at = end
        features = words
        if longest > 1:
            run, old = tail + words, len(tail)
            features = words + [b" ".join(run[i - n + 1 : i + 1]) for n in range(2, longest + 1) for i in range(max(old, n - 1), len(run))]
            tail = run[-(longest - 1) :]
        yield len(words), np.fromiter(map(buckets.__getitem__, features), np.int64, len(features))


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for t in batch.column(column):
        yield t.as_buffer().to_pybytes() if t.is_valid else b""


def bucket_counts(table: DataFrame, n_buckets: int, longest: int) -> np.ndarray:
    """How many features of all texts fall into each bucket. Each task sends its sums; ``n_buckets`` rows reach the driver."""

    def count(batches):
        sums, buckets = np.zeros(n_buckets, np.int64), Buckets(n_buckets)
        for b in batches:
            for text in _texts(b, 0):
                for _, at in feature_buckets(text, longest, buckets):
                    sums += np.bincount(at, minlength=n_buckets)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], names=["bucket", "n"])

    texts = table.select(F.col("text").cast("string").cast("binary").alias("text"))
    out = np.zeros(n_buckets, np.int64)
    for r in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed share in the target over that in the corpus), per bucket."""
    m, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (s + m) / ((int(a) + 1) * (t + m)))) for a, b in zip(corpus, target)], np.int64)


def weighted(documents: DataFrame, gains: np.ndarray, longest: int) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""

    def weigh(batches):
        buckets = Buckets(len(gains))
        for b in batches:
            words, features, weights = [], [], []
            for text in _texts(b, 1):
                w = f = total = 0
                for n, at in feature_buckets(text, longest, buckets):
                    w, f, total = w + n, f + len(at), total + int(gains[at].sum())
                words.append(w)
                features.append(f)
                weights.append(total)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(weights, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return narrow.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int) -> Column:
    """floor of 1000 times a Gumbel variate that depends on the id and the seed alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32)))).cast("long")


def counts_above(scratch: Scratch, histogram: DataFrame) -> DataFrame:
    """``histogram`` (score, n) with ``above``, the rows of all higher scores: a sum per partition, then within partitions."""
    spark = histogram.sparkSession

    def running(batches):
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column(1).to_numpy()
            ends = n.cumsum() + total
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([part] * len(n), pa.int32()), pa.array(ends - n)], names=["score", "n", "part", "before"])
            total = int(ends[-1]) if len(n) else total

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = histogram.repartitionByRange(parts, F.desc("score")).sortWithinPartitions(F.desc("score"))
    held = scratch.write(ordered.select("score", "n").mapInArrow(running, "score long, n long, part int, before long"))
    offsets, total = [], 0
    for r in sorted(held.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        offsets.append((r["part"], total))
        total += r["n"]
    table = spark.createDataFrame(offsets, "part int, offset long")
    return held.join(F.broadcast(table), "part").select("score", "n", (F.col("offset") + F.col("before")).alias("above"))  # a row per partition


def resample(documents: DataFrame, target: DataFrame, percent: int = 10, n_buckets: int = 10_000, longest: int = 1, least_words: int = 20, seed: int = 2024, scratch: Scratch | None = None, hot: int = HOT_SCORE) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (from 1; null if it isn't drawn).

    Of the documents with ``least_words`` words the ``percent`` highest scores are drawn, rounded down, ties to the
    smaller id, null ids first. Words are runs of letters a-z, digits and everything outside ASCII, after folding A-Z. Null texts
    hold no words and weigh 0; a null id counts as the empty text in the draw. Rows that repeat are documents of their own,
    drawn in any order among themselves. Empty tables are fine on either side. Only doc_id and text are read, texts
    twice. Documents of a score that more than ``hot`` of them have are ranked by range, not in one window.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    gains = bucket_gains(bucket_counts(documents, n_buckets, longest), bucket_counts(target, n_buckets, longest))
    rows = weighted(documents, gains, longest).withColumn("score", F.col("weight") + gumbel(seed)).withColumn("tie", F.monotonically_increasing_id())
    rows = scratch.write(rows)
    able = rows.where(F.col("n_words") >= least_words)
    draw = able.count() * percent // 100
    above = scratch.write(counts_above(scratch, able.groupBy("score").agg(F.count("*").alias("n"))).where(F.col("above") < draw))
    cutoff = above.agg(F.min("score")).first()[0]
    if cutoff is None:
        return rows.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    fields = ("doc_id", "n_features", "weight", "score")
    meant = (F.col("n_words") >= least_words) & (F.col("score") >= cutoff)
    best = rows.where(meant)
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    place = F.row_number().over(Window.partitionBy("score").orderBy(*order))
    ranked = best.join(above.where(F.col("n") <= hot), "score").select(*fields, (F.col("above") + place).cast("long").alias("rank"))
    frequent = above.where(F.col("n") > hot)
    if not frequent.isEmpty():
        dealt = numbered(scratch, best.join(frequent, "score"), F.desc("score"), *order)
        firsts = dealt.groupBy("score").agg(F.min("row").alias("first"))
        ranked = ranked.unionByName(dealt.join(firsts, "score").select(*fields, (F.col("above") + F.col("row") - F.col("first") + 1).alias("rank")))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return ranked.unionByName(rows.where(~meant).select(*fields, F.lit(None).cast("long").alias("rank")))
