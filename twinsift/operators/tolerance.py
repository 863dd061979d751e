"""Groups under tolerances, which are order-dependent: a member is held against the group and never chains on.

Both rules run over distinct values: equal sizes, or equal (name, size) pairs, stand or fall together, so a
repeated value is one row whatever its count. Neither gathers a key: sizes are swept in blocks of their order, whose
results are composed; names are fitted over the pairs that are near, a connected set at a time, or a large one in rounds.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.functions import paths
from twinsift.operators.graph import components
from twinsift.scratch import Scratch


def swept(sizes: np.ndarray, tolerance: int, anchor: int | None = None) -> np.ndarray:
    """Of each of the ascending sizes its anchor, if ``anchor`` is that of what comes before."""
    out = np.empty(len(sizes), np.int64)
    at = 0
    while at < len(sizes):
        if anchor is None or sizes[at] - anchor > tolerance:
            anchor = int(sizes[at])
        end = int(np.searchsorted(sizes, anchor + tolerance, "right"))
        out[at:end] = anchor
        at = end
    return out


def leaving_anchors(sizes: np.ndarray, tolerance: int) -> tuple[list[int], list[int]]:
    """What a block of ascending sizes makes of any anchor from before it, as steps (top, anchor).

    An anchor that comes in ends at the first size beyond it and the tolerance; the last anchor of the block then
    depends on that size alone, and grows with it. Of the sizes with one outcome the top one is told: what comes in leaves as the
    anchor of the first step whose top lies beyond it, and as itself if there is none. Only sizes up to the first
    beyond the block's least and the tolerance can end an anchor, so there are few steps.
    """
    n = len(sizes)
    onward = np.searchsorted(sizes, sizes + tolerance, "right")
    out = sizes.copy()
    for i in range(n - 1, -1, -1):
        if onward[i] < n:
            out[i] = out[onward[i]]
    reach = int(onward[0]) + 1
    sizes, out = sizes[:reach], out[:reach]
    tops = np.flatnonzero(np.r_[out[1:] != out[:-1], True])
    return sizes[tops].tolist(), out[tops].tolist()


def size_anchors(rows: DataFrame, keys: list[str], size: str, tolerance: int) -> DataFrame:
    """``rows`` with ``anchor``: the least size of the group that a row's size falls in.

    Sizes are swept upwards; one that is more than ``tolerance`` above the current anchor becomes the next. Distinct
    sizes are dealt by range into blocks. Each block tells what it makes of an anchor that enters it; the driver passes through
    that in order, a block at a time and with one anchor in hand, and every block is then swept from the anchor that
    enters it. Rows without a size have no anchor and are left out.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    kind = dict(rows.dtypes)[size]
    distinct = rows.where(F.col(size).isNotNull()).select(*keys, F.col(size).cast("long").alias("_size")).distinct()
    # the keys as one text, in which a null is no value
    key = F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)])) if keys else F.lit("")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.withColumn("_key", key).repartitionByRange(n, F.col("_key"), F.col("_size"))
    held = scratch.write(dealt.withColumn("_block", F.spark_partition_id()))

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_key", "_size"])
        first, last = pdf["_key"].iloc[0], pdf["_key"].iloc[-1]
        of = lambda k: pdf.loc[pdf["_key"] == k, "_size"].to_numpy()
        tops, leaving = leaving_anchors(of(first), tolerance)
        alone = -1 if first == last else int(swept(of(last), tolerance)[-1])
        return pd.DataFrame({"_block": [pdf["_block"].iloc[0]], "first": [first], "last": [last], "several": [first != last], "tops": [tops], "leaving": [leaving], "fresh": [int(swept(of(first), tolerance)[-1])], "alone": [alone]})

    steps = held.select("_block", "_key", "_size").groupBy("_block").applyInPandas(told, "_block int, first string, last string, several boolean, tops array<long>, leaving array<long>, fresh long, alone long")
    entering, now = [], (None, None)
    for r in scratch.write(steps).orderBy("_block").toLocalIterator():
        anchor = now[1] if now[0] == r["first"] else None
        entering.append((r["_block"], anchor))
        if r["several"]:
            anchor = r["alone"]
        elif anchor is None:
            anchor = r["fresh"]
        else:
            step = bisect_right(r["tops"], anchor + tolerance)
            anchor = r["leaving"][step] if step < len(r["tops"]) else anchor
        now = (r["last"], anchor)
    table = spark.createDataFrame(entering, "_block int, _enters long")

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_key", "_size"])
        parts, enters = [], pdf["_enters"].iloc[0]
        anchor = None if pd.isna(enters) else int(enters)
        for _, part in pdf.groupby("_key", sort=False):
            parts.append(part[["_key", "_size"]].assign(anchor=swept(part["_size"].to_numpy(), tolerance, anchor)))
            anchor = None
        return pd.concat(parts)

    dealt = held.select("_block", "_key", "_size").join(F.broadcast(table), "_block")  # a row per block
    anchors = dealt.groupBy("_block").applyInPandas(sweep, "_key string, _size long, anchor long")
    named = rows.withColumn("_key", key).withColumn("_size", F.col(size).cast("long"))
    return named.join(anchors, ["_key", "_size"]).select(*[named[c] for c in rows.columns], F.col("anchor").cast(kind).alias("anchor"))


def near_names(names: DataFrame, tolerance: int) -> DataFrame:
    """(a, b), a < b: pairs of distinct values of ``name`` within an edit distance, found without comparing all pairs.

    Cut into tolerance + 1 even parts, a name keeps at least one part whole through that many edits, shifted by that
    many places at most. Parts of one name meet the pieces at these places of the other in an equi-join; candidates
    are then measured.
    """
    k = tolerance + 1
    n = F.length("name")
    cut = lambda i, size: F.floor(size * i / k).cast("int")
    base = names.select("name", n.alias("n"))
    whole = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(tolerance))))
    left = whole.select(F.col("name").alias("a"), F.col("n").alias("of"), "i", F.substring("name", cut(F.col("i"), F.col("n")) + 1, cut(F.col("i") + 1, F.col("n")) - cut(F.col("i"), F.col("n"))).alias("piece"))
    lengths = F.sequence(F.greatest(F.lit(0), F.col("n") - tolerance), F.col("n") + tolerance)
    right = whole.withColumn("of", F.explode(lengths)).withColumn("shift", F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance))))
    at = cut(F.col("i"), F.col("of")) + F.col("shift")
    width = cut(F.col("i") + 1, F.col("of")) - cut(F.col("i"), F.col("of"))
    right = right.where((at >= 0) & (at + width <= F.col("n"))).select(F.col("name").alias("b"), "of", "i", F.substring("name", at + 1, width).alias("piece")).distinct()
    pairs = left.join(right, ["of", "i", "piece"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.where(paths.similar_text(F.col("a"), F.col("b"), tolerance))


def first_fit(scratch: Scratch, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fit): of each node the first member of the group that it joins, the first group all of whose members it is near.

    ``nodes`` has id, in whose order nodes are taken, ``edges`` every near pair as (id, near) both ways. A node is
    fitted when no earlier node is left among its neighbours and theirs: all groups that hold a neighbour of it are then as they
    were when its turn came. Rounds read and write what is still open; no group or set of names is gathered.
    """
    alone = nodes.join(edges.select("id").distinct(), "id", "left_anti")
    done = [scratch.write(alone.select("id", F.col("id").alias("fit")))]
    left = scratch.write(edges.select("id").distinct())
    open_edges = scratch.write(edges.select("id", "near", F.lit(None).cast(edges.schema["id"].dataType).alias("fit")))
    sizes = None
    while not left.isEmpty():
        # the least node still open among a node and its neighbours, then among those of its earlier neighbours and itself
        still = open_edges.join(left.select(F.col("id").alias("near")), "near", "left_semi").groupBy("id").agg(F.min("near").alias("least"))
        own = left.withColumn("own", F.col("id"))
        around = scratch.write(open_edges.select("id").distinct().join(still, "id", "left").join(own, "id", "left").select("id", F.least("least", "own").alias("least")))
        by = around.select(F.col("id").alias("near"), "least")
        blocking = open_edges.where("near < id").join(by, "near").groupBy("id").agg(F.min("least").alias("other"))
        ready = left.join(around, "id").join(blocking, "id", "left").where((F.col("least") == F.col("id")) & (F.col("other").isNull() | (F.col("other") >= F.col("id"))))
        ready = scratch.write(ready.select("id"))
        met = open_edges.where("fit IS NOT NULL").join(ready, "id", "left_semi").groupBy("id", "fit").agg(F.count("*").alias("n"))
        if sizes is None:
            fitted = ready.select("id", F.col("id").alias("fit"))
        else:
            best = met.join(sizes, ["fit", "n"]).groupBy("id").agg(F.min("fit").alias("fit"))
            fitted = ready.join(best, "id", "left").select("id", F.coalesce("fit", "id").alias("fit"))
        fitted = scratch.write(fitted)
        done.append(fitted)
        news = fitted.groupBy("fit").agg(F.count("*").alias("n"))
        after = news if sizes is None else sizes.unionByName(news).groupBy("fit").agg(F.sum("n").alias("n"))
        after, rest = scratch.write(after), scratch.write(left.join(ready, "id", "left_anti"))
        told = fitted.select(F.col("id").alias("near"), F.col("fit").alias("_fit"))
        onward = open_edges.join(told, "near", "left").select("id", "near", F.coalesce("fit", "_fit").alias("fit"))
        # an edge is read as long as one of its ends is open
        kept = onward.join(rest, "id", "left_semi").unionByName(onward.join(rest, "id", "left_anti").join(rest.select(F.col("id").alias("near")), "near", "left_semi").select("id", "near", "fit"))
        kept = scratch.write(kept)
        scratch.drop(open_edges, left, around, ready, *([sizes] if sizes is not None else []))
        open_edges, left, sizes = kept, rest, after
    return reduce(DataFrame.unionByName, done)


def fitted_sets(nodes: DataFrame, edges: DataFrame, order: list[str]) -> DataFrame:
    """The same by the sets of nodes in ``set``, each in a task with its edges. Nodes have path, set and ``order``; edges path and near."""

    def fit(members: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        paths_ = members.sort_values(order)["path"].tolist()
        place = {p: i for i, p in enumerate(paths_)}
        beside: list[list[int]] = [[] for _ in paths_]
        for a, b in zip(near["path"], near["near"]):
            if place[b] < place[a]:
                beside[place[a]].append(place[b])
        group, sizes = [], {}
        for i, earlier in enumerate(beside):
            met: dict[int, int] = {}
            for j in earlier:
                met[group[j]] = met.get(group[j], 0) + 1
            group.append(min((g for g, n in met.items() if n == sizes[g]), default=i))
            sizes[group[i]] = sizes.get(group[i], 0) + 1
        return pd.DataFrame({"path": paths_, "fit": [paths_[g] for g in group]})

    sides = nodes.select("set", "path", *[c for c in order if c != "path"]).groupBy("set"), edges.select("set", "path", "near").groupBy("set")
    return sides[0].cogroup(sides[1]).applyInPandas(fit, "path string, fit string")


#: Near pairs of a connected set of names up to which it is fitted in one task; a larger one is fitted in rounds.
LARGE_SET = 2_000_000


def similar_name_groups(files: DataFrame, keys: list[str], text_tolerance: int, size_tolerance: int | None = None, large: int = LARGE_SET) -> DataFrame:
    """(keys, path, group_id): groups in which every two names are within the tolerance, and sizes if it is given.

    ``files`` holds keys, path, name_key and size. Files are taken by size if it counts, then by path; each joins the
    first group that it fits whole, and only groups of two or more are returned. Files that agree on keys, name and size
    are one node, which comes where the first of them does: the others join the same group whatever lies between.
    Names that no chain of near names connects can't share a group, so each connected set is fitted by itself, from the
    pairs that were found; one with more than ``large`` pairs in rounds.
    """
    scratch = Scratch(files.sparkSession)
    by_size = size_tolerance is not None
    place = F.struct(*([F.col("size").alias("size")] if by_size else []), paths.casefold(F.col("path")).alias("key"), F.col("path").alias("path"))
    what = [*keys, "name_key", *(["size"] if by_size else [])]
    rows = scratch.write(files.select(*keys, "path", "name_key", "size", place.alias("place")))
    near = scratch.write(near_names(rows.select(F.col("name_key").alias("name")).distinct(), text_tolerance))
    linked = components(near).select(F.col("id").alias("_name"), "label")
    nodes = rows.groupBy(*what).agg(F.min("place").alias("id")).join(linked, F.col("name_key") == F.col("_name"), "left").drop("_name")
    # sets whose hashes meet are fitted together, which changes nothing
    nodes = scratch.write(nodes.withColumn("set", F.xxhash64(*keys, F.coalesce("label", "name_key"))))
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if by_size:  # one name in several sizes
        both = both.unionByName(nodes.groupBy("name_key").count().where("count > 1").select(F.col("name_key").alias("a"), F.col("name_key").alias("b")))
    of = lambda name, side, to: nodes.select(F.col("name_key").alias(name), F.col("id").alias(to), F.col("set").alias(f"_{side}"), *[F.col(k).alias(f"_{side}_{i}") for i, k in enumerate(keys)])
    pairs = both.join(of("a", "x", "id"), "a").join(of("b", "y", "near"), ["b"]).where(F.col("id") != F.col("near"))
    for i, _ in enumerate(keys):
        pairs = pairs.where(F.col(f"_x_{i}").eqNullSafe(F.col(f"_y_{i}")))
    if by_size:
        pairs = pairs.where(F.abs(F.col("id.size") - F.col("near.size")) <= size_tolerance)
    pairs = scratch.write(pairs.select("id", "near", F.col("_x").alias("set")))
    counts = scratch.write(pairs.groupBy("set").agg(F.count("*").alias("n")))
    small, big = counts.where(F.col("n") <= large).select("set"), counts.where(F.col("n") > large).select("set")
    order = [*(["size"] if by_size else []), "key", "path"]
    fits = fitted_sets(nodes.join(small, "set", "left_semi").select("set", "id.*"), pairs.join(small, "set", "left_semi").select("set", F.col("id.path").alias("path"), F.col("near.path").alias("near")), order)
    if not big.isEmpty():
        rounds = first_fit(scratch, nodes.join(big, "set", "left_semi").select("id"), pairs.join(big, "set", "left_semi").select("id", "near"))
        fits = fits.unionByName(rounds.select(F.col("id.path").alias("path"), F.col("fit.path").alias("fit")))
    # nodes without a near one are groups of their own files
    fits = fits.select(F.col("path").alias("_path"), "fit")
    placed = nodes.join(fits, F.col("id.path") == F.col("_path"), "left").select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(what)], F.coalesce("fit", "id.path").alias("fit"))
    on = [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate(what)]
    members = scratch.write(rows.join(placed, on).select(*keys, "path", "fit"))
    several = members.groupBy("fit").agg(F.count("*").alias("_n"), F.min("path").alias("group_id")).where("_n > 1").drop("_n")
    return members.join(several, "fit").select(*keys, "path", "group_id")
