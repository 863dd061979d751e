"""One scan of several kinds over one inventory: each kind's result is written as a table, and a ledger tells how it went.

Every kind builds its plan from the inventory itself and is run here, so that a failure belongs to its kind and leaves
the others alone. A scan that extends an earlier one appears whole or not at all.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.functions.fingerprints import file_digest
from twinsift.operators import exact, folders, scope, similar
from twinsift.operators.graph import cut
from twinsift.plans.matching import Matching
from twinsift.scratch import file_system, released
from twinsift.sources import contents


#: Seconds between two looks at a running kind.
EVERY = 0.1


@dataclass
class Inventory:
    """What a scan reads; a kind whose tables are missing can't be asked for."""

    files: DataFrame
    directories: DataFrame | None = None
    issues: DataFrame | None = None
    images: DataFrame | None = None
    videos: DataFrame | None = None


@dataclass(frozen=True)
class Request:
    """The kinds wanted and their settings."""

    kinds: tuple[str, ...]
    files: Matching | None = None
    file_types: tuple[str, ...] | None = None
    images: str = "Balanced"
    videos: str = "Balanced"


def _files(inventory: Inventory, ask: Request) -> DataFrame:
    return exact.duplicate_groups(scope.of_types(inventory.files, ask.file_types), ask.files)


def _folders(inventory: Inventory, ask: Request) -> DataFrame:
    """Trees are compared whole: neither file types nor criteria thin them out."""
    if "content" in inventory.files.columns:
        digests, issues = inventory.files.withColumn("_digest", file_digest(F.col("content"))).drop("content"), inventory.issues
    else:
        told = cut(contents.digests(inventory.files))
        digests = inventory.files.join(told.where("reason IS NULL").select("path", F.col("digest").alias("_digest")), "path")
        issues = told.where("reason IS NOT NULL").select("path", "reason")
        issues = issues if inventory.issues is None else issues.unionByName(inventory.issues.select("path", "reason"))
    return folders.duplicate_folders(folders.content_ids(digests, "_digest"), inventory.directories, issues)


def _images(inventory: Inventory, ask: Request) -> DataFrame:
    return similar.image_groups(inventory.images, similar.IMAGE_RADII[ask.images])


def _videos(inventory: Inventory, ask: Request) -> DataFrame:
    return similar.video_groups(inventory.videos, ask.videos)


#: Each kind: the tables it needs and how its result comes about.
KINDS: dict[str, tuple[str, Callable[[Inventory, Request], DataFrame]]] = {
    "files": ("files", _files),
    "folders": ("files", _folders),
    "images": ("images", _images),
    "videos": ("videos", _videos),
}


def check(inventory: Inventory, ask: Request) -> list[str]:
    """The kinds in order, each once; an error, before anything runs, where a request can't be met."""
    kinds = list(dict.fromkeys(ask.kinds))
    if not kinds:
        raise ValueError("ask for at least one kind of result")
    for kind in kinds:
        if kind not in KINDS or getattr(inventory, KINDS[kind][0]) is None:
            raise ValueError(f"{kind} can't be scanned for: unknown, or its table is missing")
    if ask.images not in similar.IMAGE_RADII or ask.videos not in similar.VIDEO_PRESETS:
        raise ValueError("unknown strictness")
    return kinds


@dataclass(frozen=True)
class Progress:
    """Where a scan stands: its kind, how many kinds are behind it, seconds spent on it, and tasks of the stages that run now."""

    kind: str
    kinds_done: int
    n_kinds: int
    seconds: float
    tasks_done: int
    n_tasks: int


class _Watch(threading.Thread):
    """Tells how a kind gets on every ``EVERY`` seconds, and interrupts its jobs, by their tag, once it is asked to stop."""

    def __init__(self, spark: SparkSession, kind: str, at: tuple[int, int], go_on: Callable[[], bool], tell: Callable[[Progress], None] | None):
        super().__init__(daemon=True)
        self.spark, self.kind, self.at, self.go_on, self.tell = spark, kind, at, go_on, tell
        self.over, self.stopped, self.error = threading.Event(), False, None
        # a tag of this run alone; the session's own tags are told apart by thread, so another thread couldn't name them
        self.tag = f"twinsift-{kind}-{uuid.uuid4().hex}"

    def run(self) -> None:
        begun = time.monotonic()
        while not self.over.wait(EVERY):
            try:
                # asked again each time: between two jobs there is nothing to interrupt
                self.stopped = self.stopped or not self.go_on()
                if self.stopped:
                    self.spark.sparkContext.cancelJobsWithTag(self.tag)
                elif self.tell:
                    tracker = self.spark.sparkContext.statusTracker()
                    stages = [x for x in map(tracker.getStageInfo, tracker.getActiveStageIds()) if x is not None]
                    self.tell(Progress(self.kind, *self.at, time.monotonic() - begun, sum(x.numCompletedTasks for x in stages), sum(x.numTasks for x in stages)))
            except Exception as e:  # noqa: BLE001 - a listener's failure must not go unseen, nor end the scan half-way
                self.stopped, self.error = True, e

    def __enter__(self):
        self.spark.sparkContext.addJobTag(self.tag)
        self.start()
        return self

    def __exit__(self, *_):
        self.over.set()
        self.join()
        self.spark.sparkContext.removeJobTag(self.tag)


def _take_back(spark: SparkSession, folder: str, kind: str) -> None:
    store, path = file_system(spark, f"{folder}/{kind}")
    store.delete(path, True)


def run(spark: SparkSession, inventory: Inventory, ask: Request, folder: str, *, together: bool = False, go_on: Callable[[], bool] = lambda: True, progress: Callable[[Progress], None] | None = None) -> DataFrame:
    """The ledger (kind, state, n_rows, reason); results are tables named after their kind in ``folder``.

    A state is done, failed, cancelled or skipped. ``go_on`` is asked before each kind and, from a thread of its own, while it runs: at the first
    no the kind's jobs are interrupted and no further kind begins. ``progress`` is told from there too. A kind that isn't done leaves no table, neither a result
    nor one on the way. With ``together``, the results of a scan that isn't done in full are taken back.
    """
    kinds, ledger = check(inventory, ask), []
    for kind in kinds:
        stopped = any(state == "cancelled" for _, state, _, _ in ledger)
        if stopped or not go_on() or together and any(state != "done" for _, state, _, _ in ledger):
            ledger.append((kind, "skipped", None, None))
            continue
        watch = _Watch(spark, kind, (len(ledger), len(kinds)), go_on, progress)
        try:
            with released(), watch:
                KINDS[kind][1](inventory, ask).write.mode("overwrite").parquet(f"{folder}/{kind}")
                n = spark.read.parquet(f"{folder}/{kind}").count()
            ledger.append((kind, "done", n, None))
        except Exception as e:  # noqa: BLE001 - told in the ledger
            _take_back(spark, folder, kind)
            state = "cancelled" if watch.stopped and watch.error is None else "failed"
            ledger.append((kind, state, None, str(watch.error or e)[:2000] if state == "failed" else None))
    if together and any(state != "done" for _, state, _, _ in ledger):
        for kind in kinds:
            _take_back(spark, folder, kind)
        ledger = [(kind, "taken back" if state == "done" else state, None, reason) for kind, state, _, reason in ledger]
    return spark.createDataFrame(ledger, "kind string, state string, n_rows long, reason string")
