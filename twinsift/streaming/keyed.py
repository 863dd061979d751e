"""Exact groups kept by keyed state: files come, change and go, and only groups that this touches are told.

Two states follow each other. One, by path, knows the group that a file is in and tells the group that it leaves and the one that it
joins; one, by group, holds members and their number. Neither reads more than the rows it is given, but for the one other member
when a group begins or ends, so a result costs what has changed and not what is held.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from twinsift.functions.fingerprints import file_digest
from twinsift.plans.matching import Matching, matching
from twinsift.scratch import file_system

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOVES = "grp string, path string, size long, joins boolean"
CHANGES = "grp string, path string, size long, member boolean, step long"


class _Paths(StatefulProcessor):
    """The group that each path is in; null once it is removed. Of rows with one path the one of the greatest seq counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "grp string, size long, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        was = tuple(self.now.get()) if self.now.exists() else (None, None, None)
        last = max(((r.seq, r.removed, r.grp, r.size) for r in rows), key=lambda r: r[:2])
        if was[2] is not None and last[0] < was[2]:
            return
        grp, size = (None, None) if last[1] else last[2:]
        self.now.update((grp, size, last[0]))
        if was[:2] == (grp, size):
            return
        if was[0] not in (None, grp):
            yield Row(grp=was[0], path=key[0], size=was[1], joins=False)
        if grp is not None:
            yield Row(grp=grp, path=key[0], size=size, joins=True)

    def close(self) -> None:
        pass


class _Groups(StatefulProcessor):
    """The members of each group; it tells who becomes or ceases to be one of at least two."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.members = handle.getMapState("members", "path string", "size long")
        self.number = handle.getValueState("number", "n long")

    def _only(self) -> tuple[str, int]:
        path, size = next(iter(self.members.iterator()))
        return path[0], size[0]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, step = self.number.get()[0] if self.number.exists() else 0, 0
        for r in rows:
            held = self.members.containsKey((r.path,))
            if held and r.joins:  # it stays, with another size
                self.members.updateValue((r.path,), (r.size,))
                if n >= 2:
                    yield Row(grp=key[0], path=r.path, size=r.size, member=True, step=step)
                    step += 1
            if held == r.joins:
                continue
            told = [(r.path, r.size)]
            if r.joins:
                told += [self._only()] if n == 1 else []
                self.members.updateValue((r.path,), (r.size,))
                n += 1
            else:
                self.members.removeKey((r.path,))
                n -= 1
                told += [self._only()] if n == 1 else []
            if max(n, n + (-1 if r.joins else 1)) >= 2:
                for path, size in told:
                    yield Row(grp=key[0], path=path, size=size, member=r.joins, step=step)
                    step += 1
        if n:
            self.number.update((n,))
        else:
            self.number.clear()

    def close(self) -> None:
        pass


def group_key(want: Matching) -> Column:
    """What the members of a group share, as one text: their exact keys and their digest."""
    parts = [c.alias(k) for k, c in want.exact().items()]
    parts += [file_digest(F.col("content")).alias("digest")] if want.evidence else []
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


class KeyedGroups:
    """Groups of files in a stream of additions and removals, as a log of changes in ``folder``.

    The stream holds path, size, what ``want`` names (content for evidence), removed (true for a path that goes; its other columns are
    not read) and seq, by which of several rows of one path the last is told. A path that comes again replaces what it was.
    """

    def __init__(self, spark: SparkSession, folder: str, want: Matching | None = None):
        self.spark, self.folder, self.want = spark, folder.rstrip("/"), want or matching()
        if self.want.tolerance("name") or self.want.tolerance("size"):
            raise ValueError("groups under a tolerance depend on all files; scan anew")

    def changes(self, stream: DataFrame) -> DataFrame:
        """(grp, path, size, member, step): who joins and leaves groups of two or more; within a batch the last step of a path counts."""
        removed = F.coalesce("removed", F.lit(False))
        rows = stream.select("path", F.col("seq").cast("long").alias("seq"), removed.alias("removed"), F.when(~removed, group_key(self.want)).alias("grp"), F.col("size").cast("long").alias("size"))
        moves = rows.groupBy("path").transformWithState(_Paths(), MOVES, "Append", "None")
        return moves.groupBy("grp").transformWithState(_Groups(), CHANGES, "Append", "None")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """A streaming query that writes each micro-batch's changes; a batch that is repeated replaces what it left."""
        before = self.spark.conf.get(_STORE, None)
        self.spark.conf.set(_STORE, _ROCKS)
        try:
            writer = self.changes(stream).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            return writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{self.folder}/batch={n}")).trigger(**(trigger or {"availableNow": True})).start()
        finally:
            self.spark.conf.set(_STORE, before) if before else self.spark.conf.unset(_STORE)

    def _whole(self) -> list[str]:
        store, place = file_system(self.spark, self.folder)
        found = [s.getPath().toString() for s in store.listStatus(place)] if store.exists(place) else []
        return [p for p in found if "/batch=" in p and store.exists(file_system(self.spark, f"{p}/_SUCCESS")[1])]

    def groups(self) -> DataFrame:
        """group_id (the least path), path, size of all groups now, from the log alone: files that are in no group are not read."""
        if not (batches := self._whole()):
            return self.spark.createDataFrame([], "group_id string, path string, size long")
        log = self.spark.read.schema(f"{CHANGES}, batch long").option("basePath", self.folder).parquet(*batches)
        last = log.groupBy("grp", "path").agg(F.max_by(F.struct("member", "size"), F.struct("batch", "step")).alias("last")).where("last.member")
        first = last.groupBy("grp").agg(F.min("path").alias("group_id"))
        return last.join(first, "grp").select("group_id", "path", "last.size")
