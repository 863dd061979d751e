"""A whole review on disk: what was searched, and each kind of result in a section of its own.

A section is a folder of JSON lines below a folder of its save. One small file, ``about.json``, names that folder and is
written last: until then the save before it is the one that loads, and a save that fails midway leaves nothing behind
that loads.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.operators import similar
from twinsift.operators.graph import written
from twinsift.operators.scope import check_scope
from twinsift.plans.matching import Matching, matching
from twinsift.scratch import file_system
from twinsift.sources import snapshot

VERSION = 2
#: Versions that load; the first kept no criteria and no presets.
READABLE = (1, 2)
_FIRST = "version int, saved_at string, held string, roots array<string>, excluded array<string>, recursive boolean, n_files bigint, n_bytes bigint, sections array<string>"
ABOUT = _FIRST + ", same array<string>, evidence string, several_folders boolean, images string, videos string"
#: Each section's columns; ``groups`` are those of exact duplicates, ``matches`` of images, ``videos`` of videos with their
#: evidence, ``fingerprints`` and ``frames`` the signatures of images and videos.
SECTIONS = {
    "groups": snapshot.SCHEMA,
    "folders": "group_id string, path string, n_files bigint, total_size bigint",
    "matches": "reference string, path string, distance int",
    "videos": "reference string, path string, matched int, valid int, total int",
    "fingerprints": "path string, width int, height int, signature bigint",
    "frames": "path string, width int, height int, duration double, signatures array<bigint>",
    "selection": "path string",
    "issues": "path string, reason string",
}


#: How the folders of saves are named; nothing else below a session's folder is read or removed.
HELD = re.compile(r"session-[0-9a-f]{32}")


@dataclass(frozen=True)
class Session:
    """``results`` holds a DataFrame per section; a kind of scan that was not run has none."""

    roots: tuple[str, ...]
    excluded: tuple[str, ...] = ()
    recursive: bool = True
    n_files: int = 0
    n_bytes: int = 0
    results: dict[str, DataFrame] = field(default_factory=dict)
    saved_at: str | None = None
    want: Matching | None = None
    images: str = "Balanced"
    videos: str = "Balanced"

    def check(self) -> None:
        for p in (*self.roots, *self.excluded):
            if not isinstance(p, str) or not p.startswith("/"):
                raise ValueError(f"{p!r} is not an absolute path")
        check_scope(self.roots, self.excluded)
        for name in ("n_files", "n_bytes"):
            if type(getattr(self, name)) is not int or getattr(self, name) < 0:
                raise ValueError(f"{name} must be a whole number from 0")
        if self.images not in similar.IMAGE_RADII or self.videos not in similar.VIDEO_PRESETS:
            raise ValueError("unknown strictness")
        if unknown := set(self.results) - set(SECTIONS):
            raise ValueError(f"no section is named {sorted(unknown)}")


def save(spark: SparkSession, session: Session, folder: str) -> None:
    """Writes the session in place of what ``folder`` holds, which can't be read any more.

    ``groups`` come as members, the other sections by their columns.
    """
    session.check()
    held = f"session-{uuid.uuid4().hex}"
    for name, rows in session.results.items():
        if name == "groups":
            snapshot.save(rows, f"{folder}/{held}/groups")
        else:
            rows.select(*[c.split()[0] for c in SECTIONS[name].split(", ")]).write.json(f"{folder}/{held}/{name}")
    about = {"version": VERSION, "saved_at": datetime.now(UTC).isoformat(), "held": held, "roots": list(session.roots), "excluded": list(session.excluded), "recursive": session.recursive, "n_files": session.n_files, "n_bytes": session.n_bytes, "sections": sorted(session.results), "images": session.images, "videos": session.videos}
    if session.want:
        about |= {"same": [str(s) for s in session.want.same], "evidence": " ".join(session.want.evidence), "several_folders": session.want.several_folders}
    store, place = file_system(spark, folder)
    store.mkdirs(place)
    out = store.create(file_system(spark, f"{folder}/about.json")[1], True)
    try:
        out.write(bytearray(json.dumps(about).encode()))
    finally:
        out.close()
    for entry in store.listStatus(place):
        name = entry.getPath().getName()
        if entry.isDirectory() and name != held and HELD.fullmatch(name):
            store.delete(entry.getPath(), True)


def _wanted(about: dict) -> Matching | None:
    """The criteria of a description, parsed anew, so that unknown ones are errors."""
    if about["evidence"] is None:
        return None
    return matching(*(about["same"] or []), evidence=about["evidence"], several_folders=bool(about["several_folders"]))


def load(spark: SparkSession, folder: str) -> Session:
    """The session last saved; ValueError if the folder holds none or its description breaks a rule.

    Where frames are saved with matches of videos, a match whose evidence doesn't follow from them is left out.
    """
    store, about = file_system(spark, f"{folder}/about.json")
    if not store.exists(about):
        raise ValueError(f"{folder} holds no session")
    rows = spark.read.schema(ABOUT).option("mode", "FAILFAST").json(f"{folder}/about.json").collect()  # one line
    if len(rows) != 1 or rows[0].version not in READABLE:
        raise ValueError(f"not a session of versions {READABLE}")
    a = rows[0].asDict()
    if missing := [c for c in (x.split()[0] for x in _FIRST.split(", ")) if a[c] is None]:
        raise ValueError(f"the session lacks {missing}")
    if not HELD.fullmatch(a["held"]):
        raise ValueError(f"{a['held']} is not the name of a save")
    try:
        datetime.fromisoformat(a["saved_at"])
    except ValueError as e:
        raise ValueError("saved_at is no timestamp") from e
    results = {name: spark.read.schema(SECTIONS.get(name, "path string")).option("mode", "FAILFAST").json(f"{folder}/{a['held']}/{name}") for name in a["sections"]}
    out = Session(tuple(a["roots"]), tuple(a["excluded"]), a["recursive"], a["n_files"], a["n_bytes"], results, a["saved_at"], _wanted(a), a["images"] or "Balanced", a["videos"] or "Balanced")
    out.check()
    if {"videos", "frames"} <= set(results):
        out.results["videos"] = held_videos(results["videos"], results["frames"], out.videos)
    return out


def restored_folders(folders: DataFrame, now: DataFrame) -> DataFrame:
    """``folders`` that hold as many files and bytes as ``now`` (path, n_files, total_size) says, in groups that keep
    two; an empty folder that was its own group stays."""
    same = folders.join(now.select("path", "n_files", "total_size"), ["path", "n_files", "total_size"], "left_semi").select(*folders.columns)
    sizes = folders.groupBy("group_id").agg(F.count("*").alias("_before"))
    alive = same.groupBy("group_id").agg(F.count("*").alias("_n")).join(sizes, "group_id").where("_n > 1 OR _before = 1")
    return same.join(alive.select("group_id"), "group_id", "left_semi")


def restored_matches(matches: DataFrame, now: DataFrame) -> DataFrame:
    """``matches`` whose item and whose reference are both among ``now`` (path): without its reference a group goes."""
    matches = written(matches, *matches.columns)
    named = matches.select(F.explode(F.array("path", "reference")).alias("path")).distinct()
    here = now.select("path").join(named, "path", "left_semi")  # of all that is there, what matches ask for
    return matches.join(here, "path", "left_semi").join(here.withColumnRenamed("path", "reference"), "reference", "left_semi").select(*matches.columns)


def held_videos(matches: DataFrame, videos: DataFrame, preset: str) -> DataFrame:
    """``matches`` (reference, path, matched, valid, total) whose evidence follows from the signatures of ``videos``.

    Slots, distances and thirds are worked out again; they must be what the record says and meet the preset, and so must
    durations and shapes. A record of a video that isn't there, or of one that follows itself, doesn't hold.
    """
    radius, required, tolerance = similar.VIDEO_PRESETS[preset]
    side = lambda key, k: videos.select(F.col("path").alias(key), *[F.col(c).alias(f"_{c}{k}") for c in ("width", "height", "duration", "signatures")])
    both = matches.where("path <> reference").join(side("path", 1), "path").join(side("reference", 2), "reference")
    e = similar.slot_evidence(F.col("_signatures2"), F.col("_signatures1"), radius)
    same = both.withColumn("_e", e).where(F.col("matched").eqNullSafe(F.col("_e.matched")) & F.col("valid").eqNullSafe(F.col("_e.valid")) & F.col("total").eqNullSafe(F.col("_e.total")))
    fits = same.where((F.col("_e.matched") >= required) & (F.col("_e.thirds") >= 2) & similar.near_durations(F.col("_duration1"), F.col("_duration2"), tolerance))
    return fits.where(similar.same_aspect(F.col("_width2"), F.col("_height2"), F.col("_width1"), F.col("_height1"))).select(*matches.columns)
