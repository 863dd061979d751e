"""Near-equal images and frame sequences, grouped around references by Hamming distance."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions.fingerprints import hamming
from twinsift.functions.paths import casefold, suffix
from twinsift.operators.graph import cut, references, written
from twinsift.operators.neighbours import cell_pairs, hamming_pairs, plan_bands

# Radii of images; radius, slots required and duration tolerance of videos; the aspect limit.
IMAGE_RADII = {"Strict": 4, "Balanced": 8, "Broad": 12}
VIDEO_PRESETS = {"Strict": (5, 11, 0.005), "Balanced": (9, 10, 0.015), "Broad": (12, 9, 0.03)}
ASPECT = 0.08
SLOTS = 12
#: Seconds by which durations of a pair differ at most, whatever the preset.
LONGEST = 5.0
IMAGE_SUFFIXES = ".jpg .jpeg .png .bmp .webp .tif .tiff".split()
VIDEO_SUFFIXES = ".mp4 .m4v .mov .mkv .avi .webm".split()


def same_aspect(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    return F.abs(F.log(w1 * h2 / (h1 * w2))) <= ASPECT


def near_durations(a: Column, b: Column, tolerance: float) -> Column:
    """Whether durations differ by a share of the shorter at most, by a quarter of a second in any case and never by over ``LONGEST``."""
    return F.abs(a - b) <= F.greatest(F.lit(0.25), F.least(F.lit(LONGEST), F.least(a, b) * tolerance))


def comparable_images(images: DataFrame) -> DataFrame:
    return images.where(F.col("signature").isNotNull() & (F.col("width") > 0) & (F.col("height") > 0))


def image_rows(images: DataFrame) -> DataFrame:
    """(place, width, height, signature) of images that can be compared; places are ordered by larger area, then the caseless path."""
    rows = comparable_images(images)
    place = F.struct((-F.col("width").cast("long") * F.col("height")).alias("area"), casefold(F.col("path")).alias("key"), F.col("path").alias("path"))
    return rows.select(place.alias("place"), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), "signature")


def image_links(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """(a, b, e): nodes of ``left`` and ``right`` within the radius and of one shape, a node with itself where both hold it."""
    return _links(hamming_pairs(left, right, radius), left, right).drop("later")


def _links(near: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, e, later): nodes of one shape whose signatures are a pair (a, b, distance) of ``near``, and whether a's place is the later one."""
    side = lambda df, n, k: df.select(F.col("signature").alias(n), F.col("node").alias(f"_{n}"), F.col("place").alias(f"p{k}"), F.col("width").alias(f"w{k}"), F.col("height").alias(f"h{k}"))
    near = near.join(side(left, "a", 1), "a").join(side(right, "b", 2), "b")
    fit = near.where(same_aspect(F.col("w1"), F.col("h1"), F.col("w2"), F.col("h2")))
    return fit.select(F.col("_a").alias("a"), F.col("_b").alias("b"), F.struct("distance").alias("e"), (F.col("p2") < F.col("p1")).alias("later"))


def image_best(rows: DataFrame, links: DataFrame, refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(reference, path, distance): the nearest reference before each row (place, node), ties to the earlier one; none for references."""
    best = _candidates(rows, links, refs, nodes).groupBy("place").agg(F.min(F.struct("e.distance", "ref")).alias("best"))
    return _members(best, refs, nodes).select(F.col("best.ref.path").alias("reference"), F.col("place.path").alias("path"), F.col("best.distance").alias("distance"))


def _candidates(rows: DataFrame, links: DataFrame, refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(place, ref, e): for each row the references that its node is linked with and that come before it."""
    at = nodes.join(refs, "node", "left_semi").select(F.col("node").alias("b"), F.col("place").alias("ref"))
    return rows.join(links.withColumnRenamed("a", "node"), "node").join(at, "b").where("ref < place").select("place", "ref", "e")


def _members(best: DataFrame, refs: DataFrame, nodes: DataFrame) -> DataFrame:
    return best.join(nodes.join(refs, "node", "left_semi").select("place"), "place", "left_anti")


def first_come(links: DataFrame, nodes: DataFrame, later: str = "b < a") -> DataFrame:
    """node of every reference, where nodes are named by their places, or where ``later`` says which links are from a later node to an earlier one."""
    edges = links.where(later).select(F.col("a").alias("later"), F.col("b").alias("earlier"))
    alone = nodes.select(F.col("node").alias("id")).join(edges.select(F.explode(F.array("later", "earlier")).alias("id")), "id", "left_anti")
    return references(edges).unionByName(alone).withColumnRenamed("id", "node")


def image_groups(images: DataFrame, radius: int) -> DataFrame:
    """(reference, path, distance): images that join an earlier, larger one within the radius and of its shape.

    Order: larger area first, then the caseless path. An image joins the nearest compatible reference before it
    (ties: the earlier one), else it becomes a reference itself; members never link further images. Images that
    share signature and size are one node while references are sought: only the first of them can be one.
    """
    # written first: what works signatures out would be done again where rows are chosen, and where they meet their nodes
    given, what = comparable_images(written(images, "path", "width", "height", "signature")), ["signature", "width", "height"]
    near = cut(hamming_pairs(given, given, radius).where("a <> b"))
    # an image whose signature is near no other, and its own only, neither joins nor is joined
    shared = given.groupBy("signature").agg(F.count("*").alias("_n")).where("_n > 1").select("signature")
    met = cut(near.select(F.col("a").alias("signature")).unionByName(shared).distinct())
    rows = image_rows(given.join(met, "signature", "left_semi"))
    nodes = cut(rows.groupBy(*what).agg(F.min("place").alias("place")).withColumn("node", F.monotonically_increasing_id()))
    itself = met.select(F.col("signature").alias("a"), F.col("signature").alias("b"), F.lit(0).alias("distance"))
    links = cut(_links(near.unionByName(itself), nodes, nodes))
    refs = first_come(links, nodes, "later")
    return image_best(rows.join(nodes.drop("place"), what).select("place", "node"), links, refs, nodes)


def match_order(group: str, member: str) -> tuple[Column, ...]:
    """The order of matches: groups by their reference, in them the nearest first, then by caseless path."""
    return casefold(F.col(group)), F.col(group), F.col("distance"), casefold(F.col(member)), F.col(member)


def slot_evidence(a: Column, b: Column, radius: int) -> Column:
    """Of two videos' 24 frame signatures: the least distance in each of 12 slots (null if none), and what it amounts to."""

    def least(slot: Column) -> Column:
        pairs = [hamming(F.get(a, slot * 2 + i), F.get(b, slot * 2 + j)) for i in (0, 1) for j in (0, 1)]
        return F.least(*pairs)  # nulls are passed over

    slots = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), least)
    hit = lambda x: F.coalesce(x <= radius, F.lit(False))
    third = lambda s, k: F.size(F.filter(F.slice(s, k * 4 + 1, 4), hit))
    made = lambda s: F.struct(
        F.size(F.filter(s, hit)).alias("matched"),
        F.size(F.filter(s, lambda x: x.isNotNull())).alias("valid"),
        F.aggregate(s, F.lit(0), lambda t, x: t + F.coalesce(x, F.lit(0))).alias("total"),
        F.least(third(s, 0), third(s, 1), third(s, 2)).alias("thirds"),
    )
    return F.transform(F.array(slots), made)[0]


def video_rows(videos: DataFrame) -> DataFrame:
    """(place, width, height, duration, signatures) of videos within bounds and with a signature in enough slots."""
    place = F.struct((-F.col("width").cast("long") * F.col("height")).alias("area"), F.col("path").alias("path"))
    fit = acceptable_video(F.col("width"), F.col("height"), F.col("duration")) & informative(F.col("signatures"))
    # written first: what works signatures out would be done again for every slot that is asked for
    held = cut(videos.select("path", "width", "height", "duration", "signatures"))
    return held.where(fit).select(place.alias("place"), "width", "height", "duration", "signatures")


VIDEO_COMPARED = ("width", "height", "duration", "signatures")


def video_copies(videos: DataFrame) -> DataFrame:
    """(reference, path, matched, valid): videos that are like another in all that is compared and in the ``digest`` of their contents.

    The first path of each such class is the reference; a video that is merely near, or differs beyond its frames, is no copy.
    """
    rows, what = cut(videos.where("signatures IS NOT NULL")), [*VIDEO_COMPARED, "digest"]
    rows = rows.where(informative(F.col("signatures")))
    first = rows.groupBy(*what).agg(F.min("path").alias("reference"), F.count("*").alias("_n")).where("_n > 1")
    e = slot_evidence(F.col("signatures"), F.col("signatures"), 0)
    return rows.join(first, what).where("path <> reference").withColumn("e", e).select("reference", "path", "e.matched", "e.valid")


#: Videos of a cell, on either side, that one task compares.
CELL = 1 << 14


def duration_cell(duration: Column, tolerance: float) -> Column:
    """A number that differs by one at most between durations that lie near: they are measured in tolerances on the way."""
    low, high = 0.25 / tolerance, LONGEST / tolerance
    short, middle = F.least(duration, F.lit(low)) / 0.25, F.log(F.least(F.greatest(duration, F.lit(low)), F.lit(high)) / low) / tolerance
    return F.floor((short + middle + F.greatest(duration - high, F.lit(0.0)) / LONGEST) * (1 - 1e-9)).cast("long")


def _frames(signatures: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """24 signatures of each video, and which of them there are."""
    lists = signatures.combine_chunks()
    flat, lengths = lists.flatten(), lists.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    first = at < 2 * SLOTS
    frames, there = np.zeros((len(lengths), 2 * SLOTS), np.int64), np.zeros((len(lengths), 2 * SLOTS), bool)
    frames[row[first], at[first]] = flat.fill_null(0).to_numpy()[first]
    there[row[first], at[first]] = flat.is_valid().to_numpy(zero_copy_only=False)[first]
    return frames.view(np.uint64), there


def _slots(frames: np.ndarray, there: np.ndarray, other: np.ndarray, others: np.ndarray, radius: int) -> tuple[np.ndarray, ...]:
    """What ``slot_evidence`` tells of rows of frames, row by row: matched, valid, total, thirds."""
    least = np.full((len(frames), SLOTS), 255, np.uint8)
    for i in (0, 1):
        for j in (0, 1):
            distance = np.bitwise_count(frames[:, i::2] ^ other[:, j::2])
            least = np.minimum(least, np.where(there[:, i::2] & others[:, j::2], distance, 255))
    hit, valid = least <= radius, least < 255
    thirds = hit.reshape(-1, 3, SLOTS // 3).sum(2).min(1)
    return hit.sum(1), valid.sum(1), np.where(valid, least, 0).sum(1, dtype=np.int64), thirds


def video_links(left: DataFrame, right: DataFrame, preset: str, *, halved: bool = False) -> DataFrame:
    """(a, b, e): nodes of ``left`` and ``right`` that match, a node with itself where both hold it; with ``halved`` those with b <= a.

    Videos are dealt to cells by duration, so that those which lie near share a cell or lie in two that touch, and a cell
    of many is dealt out as blocks of its left and right side. A task looks for near frames in as many slots as a match can't miss all
    of, and works the evidence out where it finds some; only matches leave it.
    """
    radius, required, tolerance = VIDEO_PRESETS[preset]
    looked = range(1, SLOTS, 3)[: SLOTS - required + 1]
    cell = duration_cell(F.col("duration"), tolerance)
    own = left.select("node", *VIDEO_COMPARED, cell.alias("_cell"))
    near = right.select("node", *VIDEO_COMPARED, F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    counts = [x.groupBy("_cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias(f"_{n}")) for x, n in ((own, "m"), (near, "n"))]
    parts = cut(counts[0].join(counts[1], "_cell"))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side = lambda df, k, i, j: df.join(parts, "_cell").select(F.lit(k).cast("byte").alias("_side"), "_cell", i.alias("_i"), j.alias("_j"), "node", *VIDEO_COMPARED)
    rows = side(own, 0, block("_m"), every("_n")).unionByName(side(near, 1, every("_m"), block("_n")))
    kept = ["node", "width", "height", "duration"]

    def compare(table: pa.Table) -> pa.Table:
        mask = table["_side"].to_numpy() == 0
        sides = [table.filter(pa.array(x)).combine_chunks() for x in (mask, ~mask)]
        (x_frames, x_there), (y_frames, y_there) = (_frames(t["signatures"]) for t in sides)
        duration, shape = ([f(t) for t in sides] for f in (lambda t: t["duration"].to_numpy(), lambda t: np.log(t["width"].to_numpy() / t["height"].to_numpy())))
        found = [np.zeros((0, 5), np.int64)]
        for slot in looked:
            xs, ys = ([np.flatnonzero(t[:, 2 * slot + i]) for i in (0, 1)] for t in (x_there, y_there))
            x_at, y_at = np.concatenate(xs), np.concatenate(ys)
            x_values, y_values = (np.concatenate([f[at, 2 * slot + i] for i, at in enumerate(z)]) for f, z in ((x_frames, xs), (y_frames, ys)))
            for i, j in cell_pairs(x_values, y_values, plan_bands(radius, 63, len(x_at), len(y_at)), radius):
                x, y = x_at[i], y_at[j]
                d, e = duration[0][x], duration[1][y]
                # a little more than is asked for, which is asked below
                fits = (np.abs(d - e) <= np.maximum(0.25, np.minimum(LONGEST, np.minimum(d, e) * tolerance)) + 1e-6) & (np.abs(shape[0][x] - shape[1][y]) <= ASPECT + 1e-6)
                pairs = np.unique(x[fits] * len(y_there) + y[fits])
                x, y = np.divmod(pairs, max(1, len(y_there)))
                matched, valid, total, thirds = _slots(x_frames[x], x_there[x], y_frames[y], y_there[y], radius)
                good = (matched >= required) & (thirds >= 2)
                found.append(np.stack([pairs, matched, valid, total, thirds], 1)[good])
        found = np.unique(np.concatenate(found), axis=0)
        x, y = np.divmod(found[:, 0], max(1, len(y_there)))
        out = {f"{c}{k}": t[c].take(pa.array(at)) for k, t, at in ((1, sides[0], x), (2, sides[1], y)) for c in kept}
        return pa.table(out | {c: pa.array(found[:, k].astype(np.int32)) for k, c in enumerate(("matched", "valid", "total", "thirds"), 1)})

    told = parts.agg(F.sum(F.col("_m") * F.col("_n"))).first()[0] or 1
    types = [f"{c}{k} {df.schema[c].dataType.simpleString()}" for k, df in ((1, left), (2, right)) for c in kept]
    dealt = rows.repartition(min(told, 1024), "_cell", "_i", "_j").groupBy("_cell", "_i", "_j")
    both = dealt.applyInArrow(compare, ", ".join([*types, "matched int", "valid int", "total int", "thirds int"]))
    both = both.where("node2 <= node1") if halved else both
    both = both.where(near_durations(F.col("duration1"), F.col("duration2"), tolerance) & same_aspect(F.col("width2"), F.col("height2"), F.col("width1"), F.col("height1")))
    return both.select(F.col("node1").alias("a"), F.col("node2").alias("b"), F.struct("matched", "valid", "total", "thirds").alias("e"))


def video_best(rows: DataFrame, links: DataFrame, refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(reference, path, matched, valid, total): for each row (place, node) the reference before it with most slots, then the least
    distance, then the first place; none for references."""
    best = _candidates(rows, links, refs, nodes).groupBy("place").agg(F.min(F.struct((-F.col("e.matched")).alias("m"), F.col("e.total"), "ref", "e")).alias("m"))
    return _members(best, refs, nodes).select(F.col("m.ref.path").alias("reference"), F.col("place.path").alias("path"), F.col("m.e.matched").alias("matched"), F.col("m.e.valid").alias("valid"), F.col("m.e.total").alias("total"))


def video_groups(videos: DataFrame, preset: str) -> DataFrame:
    """(reference, path, matched, valid, total): videos that follow an earlier, larger one.

    Videos out of bounds, or without a signature in enough slots, are compared with none. Two videos match if duration and shape agree, enough slots have a frame pair within the radius, and every third
    of the video has two of them. A video joins the reference before it with most slots, then least distance, then first place.
    """
    rows, what = video_rows(videos), list(VIDEO_COMPARED)
    # equal videos are one node; only the first of them can be a reference
    nodes = cut(rows.groupBy(*what).agg(F.min("place").alias("node")).withColumn("place", F.col("node")))
    links = cut(video_links(nodes, nodes, preset, halved=True))
    return video_best(rows.join(nodes.drop("place"), what).select("place", "node"), links, first_come(links, nodes), nodes)


@dataclass(frozen=True)
class Media:
    """What a kind of media is grouped by: rows with a place, the columns that make a node, links among nodes, and who joins whom."""

    presets: tuple[str, ...]
    comparable: Callable[[DataFrame], DataFrame]
    compared: tuple[str, ...]
    links: Callable[[DataFrame, DataFrame, str], DataFrame]
    best: Callable[[DataFrame, DataFrame, DataFrame, DataFrame], DataFrame]


MEDIA = {
    "images": Media(tuple(IMAGE_RADII), image_rows, ("signature", "width", "height"), lambda a, b, preset: image_links(a, b, IMAGE_RADII[preset]), image_best),
    "videos": Media(tuple(VIDEO_PRESETS), video_rows, VIDEO_COMPARED, video_links, video_best),
}


def acceptable_video(width: Column, height: Column, duration: Column) -> Column:
    """Bounds on what is compared: up to 100 megapixels and seven days, all finite and positive."""
    area = width.cast("double") * height
    return (width > 0) & (height > 0) & (area <= 100_000_000) & ~F.isnan(duration) & (duration > 0) & (duration <= 7 * 86400)


def informative(signatures: Column) -> Column:
    """Whether nine of the twelve slots have a frame with a signature."""
    slots = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: F.coalesce(F.get(signatures, s * 2), F.get(signatures, s * 2 + 1)))
    return F.size(F.filter(slots, lambda x: x.isNotNull())) >= 9


def frame_times(duration: Column) -> Column:
    """24 sample times: twelve around 5 % to 95 % of the duration, an eighth of a second before and after each."""
    at = lambda k: F.greatest(F.lit(0.0), duration * (0.05 + 0.9 * k / 11) - 0.125)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.array(at(k), F.least(duration, at(k) + 0.25))))


def of_media(files: DataFrame, kind: str = "All") -> DataFrame:
    """Files whose suffix is that of an image, a video, or either."""
    suffixes = {"Images": IMAGE_SUFFIXES, "Videos": VIDEO_SUFFIXES, "All": IMAGE_SUFFIXES + VIDEO_SUFFIXES}
    if kind not in suffixes:
        raise ValueError("choose All, Images or Videos")
    return files.where(casefold(suffix(F.col("path"))).isin(suffixes[kind]))


def media_counts(files: DataFrame, compared: DataFrame) -> DataFrame:
    """One row: images and videos found, how many were compared, and files of other kinds."""
    ending = casefold(suffix(F.col("path")))
    found = files.agg(F.count_if(ending.isin(IMAGE_SUFFIXES)).alias("n_images"), F.count_if(ending.isin(VIDEO_SUFFIXES)).alias("n_videos"), F.count_if(~ending.isin(IMAGE_SUFFIXES + VIDEO_SUFFIXES)).alias("n_ignored"))
    return found.crossJoin(compared.agg(F.count("*").alias("n_compared")))  # one row each
