"""Exact top-k search by inner product, pruned with multi-resolution segment statistics.

A vector's segments have a mean and a deviation each. For any two vectors the squared distance is at least the sum
over segments of length * ((difference of means)^2 + (difference of deviations)^2); with the norms known, that is
an upper bound on the inner product, and it tightens as segments are halved. Vectors are turned into the basis in which
all of them together have their energy in the first components, which keeps distances and gives the segments
something to tell apart. Every query first meets a few hundred vectors exactly, so that it has a threshold from the
start; then pairs are bounded on a few segments, the survivors on more, and exact products are taken of what is left,
of the integer vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsift.llm.scratch import Scratch

#: Segments per level, coarse to fine; levels that have not fewer segments than components are passed over.
LEVELS = (4, 16, 32)
#: Vectors that give every query its first threshold: a sample drawn by hash, whose bound this is.
SEEDS = 512
#: Bytes of the vectors of a group of candidates, and of the queries that meet it at once, at most on average.
GROUP_BYTES = 100 << 20
QUERY_BYTES = 25 << 20
#: Squared lengths up to which products of doubles are exact, and beyond which a score may be no long.
DOUBLES, LONGS = float(1 << 53), float(1 << 63) * (1 - 1e-9)
LEAST_GROUPS = 16
#: Rows and queries that are bounded at once, and the share of survivors up to which products are taken pair by pair
#: and not in one matrix product.
_TILE, _QUERIES, _SPARSE = 1024, 256, 0.02


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products bound those of the rows of ``x`` from above."""
    n, d = x.shape
    width = -(-d // segments)
    padded = np.zeros((n, width * segments))
    padded[:, :d] = x
    cut = padded.reshape(n, segments, width)
    return np.hstack([cut.mean(axis=2), cut.std(axis=2)]) * np.sqrt(width)


def bounds(q: np.ndarray, x: np.ndarray, segments: int) -> np.ndarray:
    """For every pair an upper bound on the inner product, rounding included."""
    slack = 1e-9 * (1 + np.linalg.norm(q, axis=1).max(initial=0) * np.linalg.norm(x, axis=1).max(initial=0))
    return segment_features(q, segments) @ segment_features(x, segments).T + slack


class Best:
    """The k best (score, smaller id first) of each query so far; ``least`` is what the next must reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.k = k
        self.q, self.s, self.i, self.row = np.empty(0, np.int64), np.empty(0, least.dtype), np.empty(0, np.int64), np.empty(0, np.int64)
        self.least = least.copy()

    def add(self, q: np.ndarray, s: np.ndarray, i: np.ndarray, row: np.ndarray) -> None:
        q, s, i, row = np.concatenate([self.q, q]), np.concatenate([self.s, s]), np.concatenate([self.i, i]), np.concatenate([self.row, row])
        o = np.lexsort((row, i, -s, q))
        q, s, i, row = q[o], s[o], i[o], row[o]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.q, self.s, self.i, self.row = q[keep], s[keep], i[keep], row[keep]
        last = np.arange(len(self.q)) - np.searchsorted(self.q, self.q) == self.k - 1
        self.least[self.q[last]] = np.maximum(self.least[self.q[last]], self.s[last])


def lowest(x: np.ndarray):
    return -np.inf if x.dtype.kind == "f" else np.iinfo(x.dtype).min


def first_thresholds(rows: np.ndarray, q: np.ndarray, seed_rows: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """Of each query the k-th best score among the seeds, itself excepted; the lowest of numbers if there are fewer."""
    if len(seeds) < k + 1:
        return np.full(len(q), lowest(q))
    s = q @ seeds.T
    s[rows[:, None] == seed_rows[None, :]] = lowest(q)
    return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]


def search_block(
    q_rows: np.ndarray,
    q: np.ndarray,
    x_rows: np.ndarray,
    x_ids: np.ndarray,
    x: np.ndarray,
    k: int,
    basis: np.ndarray | None = None,
    seeds: tuple[np.ndarray, np.ndarray] | None = None,
    levels: tuple[int, ...] = LEVELS,
    counts: dict | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query rows, ids, rows, scores): the k best of ``x`` for each row of ``q``, itself excepted.

    Vectors of long integers are bounded in doubles, rounding included, and their products taken in integers.
    ``counts`` gets the pairs that were met and those of which a product was taken.
    """
    o = np.argsort(-np.linalg.norm(x.astype(float), axis=1), kind="stable")  # long vectors first: thresholds rise early
    x_rows, x_ids, whole = x_rows[o], x_ids[o], x[o]
    x = whole.astype(float)
    turned = lambda m: m if basis is None else m @ basis
    levels = tuple(n for n in levels if n < x.shape[1])
    features = [segment_features(turned(x), n) for n in levels]
    long_x = np.linalg.norm(x, axis=1).max(initial=0)
    for at in range(0, len(q), _QUERIES):
        own, exact = q_rows[at : at + _QUERIES], q[at : at + _QUERIES]
        qs = exact.astype(float)
        best = Best(np.full(len(qs), lowest(q)) if seeds is None else first_thresholds(own, exact, *seeds, k), k)
        asked = [segment_features(turned(qs), n) for n in levels]
        slack = 1e-9 * (1 + np.linalg.norm(qs, axis=1).max(initial=0) * long_x)
        for to in range(0, len(x), _TILE):
            tile = slice(to, to + _TILE)
            alive = own[:, None] != x_rows[None, tile]
            for fq, fx in zip(asked, features):
                live_q, live_x = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
                if not len(live_q):
                    break
                alive[np.ix_(live_q, live_x)] &= fq[live_q] @ fx[tile][live_x].T + slack >= best.least[live_q, None]
            a, b = np.nonzero(alive)
            if counts is not None:
                counts["met"], counts["computed"] = counts.get("met", 0) + alive.size, counts.get("computed", 0) + len(a)
            if not len(a):
                continue
            if whole.dtype.kind != "f":
                near = (qs @ x[tile].T)[a, b] + slack >= best.least[a]
                a, b = a[near], b[near]
                s = np.einsum("ij,ij->i", exact[a], whole[tile][b])
            elif len(a) <= _SPARSE * alive.size:
                s = np.einsum("ij,ij->i", qs[a], x[tile][b])
            else:
                s = (qs @ x[tile].T)[a, b]
            fine = s >= best.least[a]
            a, b, s = a[fine], b[fine], s[fine]
            best.add(a, s, x_ids[tile][b], x_rows[tile][b])
        yield own[best.q], best.i, best.row, best.s


def integer_vectors(embeddings: DataFrame, scale: int) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component; invalid vectors left out."""
    e = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = F.transform(e, lambda x: F.floor(x * scale).cast("long"))  # floor saturates at the ends of long, which top_k refuses
    return embeddings.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int, kind=np.float64) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lens = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), kind)
    out[np.arange(width)[None, :] < lens[:, None]] = lists.flatten().to_numpy()
    return out


def energy_basis(vectors: DataFrame, width: int) -> np.ndarray:
    """The basis, energy first, of all vectors. Each task adds up a width x width matrix; so do their sums."""

    def products(batches):
        total = np.zeros((width, width))
        for b in batches:
            m = _matrix(b.column(0), width)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = vectors.select("v").mapInArrow(products, "i int, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    gram = np.zeros((width, width))
    for r in sums.toLocalIterator():  # width x width numbers
        gram[r["i"], r["j"]] = r["x"]
    _, basis = np.linalg.eigh((gram + gram.T) / 2)
    return np.ascontiguousarray(basis[:, ::-1])


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20, scale: int = 64, scratch: Scratch | None = None, seeds: int = SEEDS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, its k highest inner products.

    Vectors that are null or hold null or non-finite components, and null ids, take no part. Rows that share an id
    are vectors of their own, as queries too; ties go to the smaller id, then to the earlier row. Shorter vectors count
    as ended by zeros. Scores are exact: where squared lengths pass 2^53, products are taken in long integers, and where
    they pass 2^63 a ValueError says so, as a score might be no long. With fewer than k other rows all are returned; an
    empty table gives no rows. Only vec_id and embedding are read.

    Candidates are dealt to groups of a bounded size by their row, queries to blocks; each block meets each group
    once and returns its k best there, so a query's best are chosen from k rows per group.
    """
    scratch = scratch or Scratch(embeddings.sparkSession)
    vectors = scratch.write(integer_vectors(embeddings, scale).withColumn("row", F.monotonically_increasing_id()))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, width, longest = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    width = max(1, width or 0)
    if (longest or 0) >= LONGS:
        raise ValueError(f"vectors of squared length {longest:.3g} may have scores beyond 2^63; use a smaller scale")
    kind = np.float64 if (longest or 0) < DOUBLES else np.int64
    basis = energy_basis(vectors, width)
    drawn = vectors.select("row", "v").orderBy(F.xxhash64("row", F.lit(3)), "row").limit(seeds).toArrow()
    first = drawn.column("row").to_numpy(), _matrix(drawn.column("v"), width, kind)
    groups = max(LEAST_GROUPS, -(-n * width * 8 // GROUP_BYTES))
    blocks = max(1, -(-n * width * 8 // (every * QUERY_BYTES)))
    place = lambda seed, of: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(of))
    cell = (F.col("block") * groups + F.col("group")).alias("cell")
    rows = vectors.withColumn("group", place(1, groups)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = vectors.where(F.col("vec_id") % every == 0).withColumn("block", place(2, blocks)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def meet(q: pa.Table, x: pa.Table) -> pa.Table:
        schema = pa.schema([("query_row", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])
        if not len(q) or not len(x):
            return schema.empty_table()
        found = search_block(q.column("row").to_numpy(), _matrix(q.column("v"), width, kind), x.column("row").to_numpy(), x.column("vec_id").to_numpy(), _matrix(x.column("v"), width, kind), k, basis, first)
        return pa.concat_tables([schema.empty_table(), *(pa.table([a, b, r, s.astype(np.int64)], schema=schema) for a, b, r, s in found)])

    left = queries.select(cell, "row", "v").groupBy("cell")
    right = rows.select(cell, "row", "vec_id", "v").groupBy("cell")
    part = left.cogroup(right).applyInArrow(meet, "query_row long, vec_id long, row long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    best = part.withColumn("rank", rank).where(F.col("rank") <= k)
    named = vectors.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return best.join(named, "query_row").select("query_id", "rank", "vec_id", "score")
