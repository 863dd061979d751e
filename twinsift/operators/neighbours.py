"""Hamming neighbours of bit signatures: blocks of them meet in tasks, and in a task by few bands, each looked up within a small ball.

Signatures are dealt to blocks by a hash, and each pair of blocks is a cell, which one task compares. So rows move once per block of the other
side, no pair moves before it is known to lie within the radius, and no value of a band, however frequent, makes a task larger than its cell.

In a cell a signature is cut into bands, and band i is given a tolerance t_i so that the sum of (t_i + 1) passes the radius: two
signatures within the radius then differ in at most t_i bits of some band. Both sides are sorted by the band's value, and the rows of a value on
the left, a few at a time, meet all rows on the right of every value within the tolerance. A pair counts in the first band that holds it within its
tolerance, so none is told twice. How many bands there are is weighed by what looking up and comparing cost: few for many signatures, more for few.
Bits above the highest that any two signatures differ in belong to no band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import ceil, comb
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.operators.graph import cut

#: A band's values index a table, which so many bits keep small.
WIDEST = 21
#: Signatures of a block: at most so many, and fewer where that leaves a side with less than ``BLOCKS``.
BLOCK, BLOCKS = 1 << 18, 8
#: Values looked up, and pairs compared, at a time in a task: so many stay in a core's cache.
AT_ONCE = 1 << 16
#: Rows of one value that are compared at once with those of another.
DEEPEST = 16
#: What a pair that meets costs, in values looked up.
MEETING = 1


@dataclass(frozen=True)
class Band:
    low: int
    width: int
    within: int

    def probes(self, left: bool) -> Iterator[int]:
        """What the band's value is xored with to be looked up: all flips within the tolerance on the left, none on the right."""
        for differ in range(self.within + 1 if left else 1):
            for bits in combinations(range(self.width), differ):
                yield sum(1 << b for b in bits)

    def count(self, left: bool) -> int:
        return sum(comb(self.width, d) for d in range(self.within + 1)) if left else 1

    def met(self) -> float:
        """The share of all pairs of random signatures that meet in this band."""
        return self.count(True) / (1 << self.width)

    def of(self, signatures: np.ndarray) -> np.ndarray:
        return ((signatures >> np.uint64(self.low)) & np.uint64((1 << self.width) - 1)).astype(np.int64)


def bands_of(radius: int, bits: int, n: int) -> list[Band]:
    """``n`` bands of about equal width, with the least tolerances that miss no pair within the radius."""
    edges = [bits * i // n for i in range(n + 1)]
    spare, more = divmod(max(0, radius - n + 1), n)
    widths = sorted(range(n), key=lambda i: edges[i] - edges[i + 1])  # the widest bands are given more
    extra = set(widths[:more])
    return [Band(edges[i], edges[i + 1] - edges[i], spare + (i in extra)) for i in range(n)]


def plan_bands(radius: int, bits: int, left: int, right: int) -> list[Band]:
    """The bands that cost least for so many signatures on either side of a cell."""

    def cost(bands: list[Band]) -> float:
        probes = sum(left * b.count(True) + right + (1 << b.width) for b in bands)
        return probes + MEETING * left * right * sum(b.met() for b in bands)

    fitting = [bands_of(radius, bits, n) for n in range(-(-bits // WIDEST), radius + 2)]
    return min(fitting or [bands_of(radius, bits, -(-bits // WIDEST))], key=cost)


def _groups(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of rows as columns of up to ``DEEPEST`` that share a band's value, -1 below the last: where each value's columns begin, each column's value, and the places."""
    counts = np.bincount(values, minlength=1 << width)
    deep = 1
    while deep < DEEPEST and deep << width < len(values):
        deep *= 2
    columns = -(-counts // deep)
    starts = np.concatenate([[0], np.cumsum(columns)])
    order = np.argsort(values, kind="stable")
    held = values[order]
    rank = np.arange(len(values)) - (np.cumsum(counts) - counts)[held]
    places = np.full((deep, starts[-1]), -1)
    places[rank % deep, starts[held] + rank // deep] = order
    return starts, np.repeat(np.arange(1 << width), columns), places


def cell_pairs(a: np.ndarray, b: np.ndarray, bands: list[Band], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``a`` and ``b`` of pairs within the radius that meet in a band, each once."""
    for k, band in enumerate(bands):
        _, own, left = _groups(band.of(a), band.width)
        starts, _, right = _groups(band.of(b), band.width)
        of_a, of_b = a[left], b[right]  # what stands for -1 is left out below
        masks = np.fromiter(band.probes(True), np.int64, band.count(True))
        rows, most = max(1, AT_ONCE // len(masks)), max(1, AT_ONCE // (len(left) * len(right)))
        for at in range(0, len(own), rows):
            keys = (own[at : at + rows, None] ^ masks).ravel()
            first, n = starts[keys], starts[keys + 1] - starts[keys]
            hit = np.flatnonzero(n)
            first, n, row = first[hit], n[hit], at + hit // len(masks)
            ends = np.cumsum(n)
            done = 0
            while done < len(n):  # a value that many share is passed over in parts
                before = ends[done - 1] if done else 0
                upto = max(done + 1, int(np.searchsorted(ends, before + most, "right")))
                part = n[done:upto]
                x = np.repeat(row[done:upto], part)
                y = np.arange(part.sum()) + np.repeat(first[done:upto] - (ends[done:upto] - part - before), part)
                done = upto
                # each row of a column with each of the other's; the pairs of columns lie side by side
                differ = (np.take(of_a, x, axis=1)[:, None] ^ np.take(of_b, y, axis=1)).ravel()
                near = np.flatnonzero(np.bitwise_count(differ) <= radius)
                differ, (ranks, pair) = differ[near], np.divmod(near, len(x))
                p, q = left[ranks // len(right), x[pair]], right[ranks % len(right), y[pair]]
                new = (p >= 0) & (q >= 0)
                for earlier in bands[:k]:
                    new &= np.bitwise_count(earlier.of(differ)) > earlier.within
                yield p[new], q[new]


def dealt(df: DataFrame, blocks: int) -> DataFrame:
    return df.withColumn("_block", F.pmod(F.xxhash64("signature"), F.lit(blocks)).cast("int"))


def meetings(a: DataFrame, b: DataFrame, bands: list[Band], radius: int | None = None, blocks: tuple[int, int] = (1, 1)) -> DataFrame:
    """(a, b): distinct signatures that meet in a band, once, and within the radius where one is given. Both sides hold a distinct signature.

    Where both sides are one, a cell stands for both orders of its blocks.
    """
    same, (m, n) = a is b, blocks
    if same:  # cells (i, j) with i <= j, numbered j by j; side 0 has the rows of i, side 1 those of j
        at = lambda i, j: (j * (j + 1) / 2).cast("int") + i
        cells = lambda block, side: F.transform(F.sequence(block, F.lit(n - 1)) if side == 0 else F.sequence(F.lit(0), block), lambda o: at(block, o) if side == 0 else at(o, block))
    else:
        cells = lambda block, side: F.transform(F.sequence(F.lit(0), F.lit((n if side == 0 else m) - 1)), lambda o: block * n + o if side == 0 else o * n + block)
    spread = lambda df, side: dealt(df, (m, n)[side]).select(F.explode(cells(F.col("_block"), side)).alias("_cell"), F.lit(side).cast("byte").alias("_side"), "signature")
    limit = 64 if radius is None else radius
    own = {j * (j + 3) // 2 for j in range(n)}  # cells (j, j)

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        side, signature = table["_side"].to_numpy(), table["signature"].to_numpy().view(np.uint64)
        left, right = signature[side == 0], signature[side == 1]
        found = [(left[x], right[y]) for x, y in cell_pairs(left, right, bands, limit)]
        found = [np.concatenate(z) if z else left[:0] for z in (list(zip(*found)) or [[], []])]
        if same and cell not in own:
            found = [np.concatenate(found), np.concatenate(found[::-1])]
        return pa.table([pa.array(z.view(np.int64)) for z in found], names=["a", "b"])

    count = n * (n + 1) // 2 if same else m * n
    # cells cost alike: each is a task of its own
    rows = spread(a, 0).unionByName(spread(b, 1)).repartitionById(count, "_cell")
    return rows.groupBy("_cell").applyInArrow(compare, "a long, b long")


def hamming_pairs(a: DataFrame, b: DataFrame, radius: int, *, bits: int = 63) -> DataFrame:
    """(a, b, distance): distinct values of ``signature`` within ``radius``.

    Each side's values are distinct first, and counted: repeated signatures cost nothing. Of ``bits`` only those up to the highest that varies are cut into bands.
    """
    sides = [cut(x.where(F.col("signature").isNotNull()).select("signature").distinct()) for x in ((a,) if a is b else (a, b))]
    seen = [x.agg(F.count("*"), F.bit_or("signature"), F.bit_and("signature")).first() for x in sides]
    counts = [n for n, _, _ in seen]
    if not min(counts):
        bits = 1
    else:
        ones, always = reduce(or_, (x for _, x, _ in seen)), reduce(and_, (x for _, _, x in seen))
        bits = max(1, min(bits, ((ones & ~always) & ((1 << 64) - 1)).bit_length()))
    blocks = [max(BLOCKS, ceil(n / BLOCK)) for n in counts]
    per = [ceil(n / m) for n, m in zip(counts, blocks)]
    bands = plan_bands(radius, bits, per[0], per[-1])
    found = meetings(sides[0], sides[-1], bands, radius, (blocks[0], blocks[-1]))
    return found.withColumn("distance", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))))
