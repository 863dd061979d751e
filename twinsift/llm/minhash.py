"""Near-duplicates by one-permutation MinHash, banded buckets and star-shaped candidate edges.

A text's set holds 64-bit hashes of its five-word shingles. One pass over the set fills 128 bins with the least
hash of each; an empty bin borrows from a bin that a hash of its number and the attempt names, until that one is
filled (optimal densification). Equal runs of four bins meet in a bucket. A bucket of m sets gives m - 1 candidate
pairs, all with its centre: the member that meets most others over all of its buckets, so that the many buckets of one
group agree on a centre and its pairs grow with the group and not with its square. Links are confirmed on the full
sets. Members that no centre reached give their bucket a further star as long as stars join much.

What buckets then still hold apart is joined exactly, over the rarest shingles of the full sets: two sets that are
similar enough share one of them early on (prefix and position filter), whereas a passage that many texts share
brings no two together. No pair is left out by a cap, a count of rounds or an estimate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.scratch import NULL_ID, Scratch
from twinsift.operators.graph import components

BINS, BANDS = 128, 32
SHINGLE = 5
#: Up to so many ids are broadcast to the documents; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Another star follows while the last one joined at least one in so many of the labels that were apart.
WORTH = 50
#: Words whose hashes a task keeps at hand.
MEMO_WORDS = 100_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(32)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def shingle_set(data: bytes, memo: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of fewer words than a shingle has, one hash of all of them."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(3) + h[k : k + len(out)])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """The least hash of each bin; bins are the leading bits, so in a sorted set they are runs."""
    shift = np.uint64(64 - (BINS - 1).bit_length())
    edges = np.searchsorted(s, np.arange(BINS, dtype=np.uint64) << shift)
    ends = np.append(edges[1:], len(s))
    filled = ends > edges
    out = np.zeros(BINS, np.uint64)
    out[filled] = s[edges[filled]]
    empty = np.flatnonzero(~filled)
    attempt = 1
    while len(empty):
        other = (mixed(empty.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(attempt)) >> shift).astype(np.int64)
        hit = filled[other]
        out[empty[hit]] = out[other[hit]]
        empty = empty[~hit]
        attempt += 1
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, -1)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(rows.shape[1]):
        key = mixed(key * np.uint64(3) + rows[:, k])
    return key.view(np.int64)


def _signed_rows(batches):
    memo = WordHashes()
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            n, fps, bands = [], [], []
            for t in part.column(1):
                s = shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"", memo)
                n.append(len(s))
                fps.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(signature(s)) if len(s) else None)
            columns = [part.column(0), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_id", "bands"])


def _set_rows(batches):
    memo = WordHashes()
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            sets = [shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"", memo).view(np.int64) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b), those whose full sets are similar enough."""
    full = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return pairs.join(full("b"), "b").join(full("a"), "a").where(100 * common >= percent * union).select("a", "b").distinct()


def prefix_pairs(scratch: Scratch, sets: DataFrame, apart: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different labels in ``apart`` (id, label) whose ``sets`` (id, shingles, h: a hash of these)
    may be similar enough.

    Shingles are ordered by the number of these sets that hold them, the rarest first. Sets of n and m shingles must
    share percent * (n + m) / (100 + percent); the first shingle that they share leaves room for as many after it in
    both. A shingle's place counts the set's own shingles, which come first and meet nobody, without listing them.
    Labels are held against each other before their members are, so members of one label never meet.
    """
    p, q = percent, 100 + percent
    each = sets.join(apart, "id").select("id", "label", "h", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("g"))
    each = scratch.write(each)
    often = each.groupBy("g").agg(F.count("*").alias("often"), F.min("label").alias("x"), F.max("label").alias("y")).where("often > 1")
    shared = each.join(scratch.write(often), "g").select("id", "label", "h", "n", F.struct("often", "g", (F.col("x") != F.col("y")).alias("mixed")).alias("t"))
    ranked = shared.groupBy("id", "label", "h", "n").agg(F.sort_array(F.collect_list("t")).alias("all"))
    own = F.col("n") - F.size("all")
    last = F.floor((100 - p) * F.col("n") / 100)  # no place beyond it leaves room for a partner of any size
    early = ranked.select("id", "label", "n", own.alias("own"), F.slice("all", 1, F.greatest(F.lit(0), last - own + 1).cast("int")).alias("all"))
    entries = early.select("id", "label", "n", "own", F.posexplode("all").alias("k", "t")).where("t.mixed")
    room = q * (F.col("n") - F.col("own") - F.col("k")) - p * F.col("n")  # at least p times a partner's size
    entries = scratch.write(entries.select("id", "label", "n", F.col("t.g").alias("g"), room.alias("room")))
    of_label = entries.groupBy("g", "label").agg(F.max("room").alias("room"), F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("room") - p * F.col("n")).alias("short"))
    of_label = scratch.write(of_label)
    side = lambda df, x: df.select("g", *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c != "g"])
    # the smaller set of a pair holds the shingle early enough for a partner of its own size at least
    may = (F.col("label_a") != F.col("label_b")) & (F.col("room_a") >= p * F.col("low_b")) & (F.col("room_b") >= p * F.col("low_a")) & (100 * F.col("high_a") >= p * F.col("low_b"))
    labels = side(of_label.where("short >= 0"), "a").join(side(of_label, "b"), "g").where(may).select("g", "label_a", "label_b", F.col("room_b").alias("most"), "low_b", "high_b")
    smaller = side(entries.where(F.col("room") >= p * F.col("n")), "a").join(labels, ["g", "label_a"])
    smaller = smaller.where((F.col("room_a") >= p * F.col("low_b")) & (F.col("most") >= p * F.col("n_a")) & (F.col("n_a") <= F.col("high_b")) & (100 * F.col("n_a") >= p * F.col("low_b")))
    fits = (F.col("n_a") <= F.col("n_b")) & (100 * F.col("n_a") >= p * F.col("n_b")) & (F.col("room_a") >= p * F.col("n_b")) & (F.col("room_b") >= p * F.col("n_a"))
    both = smaller.drop("low_b", "high_b", "most").join(side(entries, "b"), ["g", "label_b"]).where(fits)
    return both.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def near_duplicates(documents: DataFrame, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept (whether it is its component's least id).

    Documents are linked if their sets' intersection is at least ``percent`` % of the union. Texts without words,
    null or empty, have an empty set and no link. Rows that share an id are one document, linked if any of its
    texts is; null ids are one document with the largest id, shown as null and kept only if alone. Columns other than
    doc_id and text aren't read, whatever their names. An empty table gives no rows.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark)
    texts = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = scratch.write(texts.mapInArrow(_signed_rows, "doc_id long, n_shingles long, set_id binary, bands array<long>"))
    classes = scratch.write(rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep")))
    firsts = rows.join(classes.withColumnRenamed("rep", "doc_id"), ["set_id", "doc_id"]).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands", "set_id")
    banded = scratch.write(firsts.dropDuplicates(["id", "set_id"]).select("id", "n", F.explode("bands").alias("key")))
    crowded = banded.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.count("*").alias("size")).where("x <> y").select("key", "size")
    members = scratch.write(banded.join(scratch.write(crowded), "key"))
    ids = scratch.write(members.groupBy("id").agg(F.sum("size").alias("met")))
    n_ids = ids.count()
    held = F.broadcast(ids.select("id")) if n_ids <= BROADCAST_IDS else ids.select("id")
    sets = scratch.write(texts.withColumnRenamed("doc_id", "id").join(held, "id", "left_semi").mapInArrow(_set_rows, "id long, shingles array<long>").dropDuplicates(["id", "shingles"]).withColumn("h", F.xxhash64("shingles")))

    def joined(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
        """``labels`` (id, met, label) after further links, and how many labels these did away with."""
        at = lambda x: labels.select(F.col("id").alias(x), F.col("label").alias(f"l{x}"))
        tied = links.join(at("a"), "a").join(at("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b").distinct()
        to = components(tied, scratch).select(F.col("id").alias("label"), F.col("label").alias("_to"))
        return scratch.write(labels.join(to, "label", "left").select("id", "met", F.coalesce("_to", "label").alias("label"))), to.count()

    def held_apart(named: DataFrame) -> DataFrame:
        return named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")

    labels = ids.withColumn("label", F.col("id"))
    n_apart, gone, centres = n_ids, n_ids, None
    while n_apart and gone * WORTH >= n_apart:
        named = scratch.write(members.join(labels, "id").select("key", "id", "n", "label", "met"))
        if centres is not None:
            named = scratch.write(named.join(held_apart(named), "key", "left_semi"))
        new = named
        if centres is not None:
            reached = centres.join(labels, "id").select("key", "label").distinct()
            new = named.join(reached, ["key", "label"], "left_anti")
        star = new.groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("less"), "label", "n")).alias("c"))
        star = scratch.write(star.select("key", (-F.col("c.less")).alias("c"), F.col("c.label").alias("c_label"), F.col("c.n").alias("c_n")))
        sized = (F.col("label") != F.col("c_label")) & (100 * F.least("n", "c_n") >= percent * F.greatest("n", "c_n"))
        pairs = named.join(star, "key").where(sized).select(F.least("c", "id").alias("a"), F.greatest("c", "id").alias("b")).distinct()
        labels, gone = joined(labels, scratch.write(linked(scratch.write(pairs), sets, percent)))
        star = star.select("key", F.col("c").alias("id"))
        centres = star if centres is None else centres.unionByName(star)
        n_apart = named.select("label").distinct().count()
    if centres is not None:
        # pairs with a centre are settled; what is left of a bucket may hold others
        named = members.join(centres, ["key", "id"], "left_anti").join(labels, "id").select("key", "id", "label")
        named = scratch.write(named)
        apart = scratch.write(named.join(held_apart(named), "key", "left_semi").select("id", "label").distinct())
        pairs = scratch.write(prefix_pairs(scratch, sets, apart, percent))
        labels, _ = joined(labels, scratch.write(linked(pairs, sets, percent)))
    label = F.coalesce("label", "rep", "doc_id")
    out = rows.select("doc_id", "n_shingles", "set_id").join(classes, "set_id", "left").join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left")
    null_again = lambda c: F.when(c != NULL_ID, c)
    return scratch.finish(out.select(null_again(F.col("doc_id")).alias("doc_id"), "n_shingles", null_again(label).alias("component_id"), (F.col("doc_id") == label).alias("kept")))
