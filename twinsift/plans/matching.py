"""What files of a group have in common, as short specifications from which keys, tolerances and checks follow.

A specification names a property, then ``~n`` for a tolerance, then words that refine it:

    size            equal sizes; size~10: within ten bytes of the group's smallest
    name            equal names; name~3: every two within three edits; unmarked: without the marks of copying
    ending          equal extensions
    changed, born   equal times; day: equal calendar days
    device          on one device
    folder          folders of one name; whole: of one path; below: of one path below the searched root;
                    a number: only so many names from the top
    streams         equal named streams: names, sizes and digests

``name``, ``ending`` and ``folder`` take ``cased``. Evidence is what is known of contents: a digest, a comparison of
the bytes, both or none. Either implies equal sizes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions import paths

#: Words that each property understands.
REFINEMENTS = {
    "size": set(),
    "name": {"cased", "unmarked"},
    "ending": {"cased"},
    "changed": {"day"},
    "born": {"day"},
    "device": set(),
    "folder": {"cased", "whole", "below"},
    "streams": set(),
}
TOLERANT = {"size", "name"}
EVIDENCE = ("digest", "bytes")


@dataclass(frozen=True, order=True)
class Same:
    """One specification, taken apart."""

    what: str
    within: int = 0
    words: frozenset[str] = frozenset()
    levels: int = 0

    @classmethod
    def parse(cls, text: str) -> Same:
        head, *rest = text.split()
        what, _, within = head.partition("~")
        levels = [w for w in rest if w.isdigit()]
        words = frozenset(rest) - set(levels)
        if what not in REFINEMENTS or words - REFINEMENTS[what]:
            raise ValueError(f"{text!r} names no property, or a word that it doesn't take")
        if within and (what not in TOLERANT or not within.isdigit()):
            raise ValueError(f"{text!r}: only sizes and names have a tolerance, and it is a whole number")
        if levels and (what != "folder" or len(levels) > 1 or int(levels[0]) < 1):
            raise ValueError(f"{text!r}: only folders have a number of levels, from 1")
        return cls(what, int(within or 0), words, int(levels[0]) if levels else 0)

    def __str__(self) -> str:
        tolerance = f"~{self.within}" if self.within else ""
        return " ".join([self.what + tolerance, *sorted(self.words), *([str(self.levels)] if self.levels else [])])

    def column(self) -> Column:
        """The value that files of a group share."""
        path, cased = F.col("path"), "cased" in self.words
        match self.what:
            case "name":
                return paths.filename_key(path, ignore_copy="unmarked" in self.words, case_sensitive=cased)
            case "ending":
                return paths.text_key(paths.suffix(path), cased)
            case "changed" | "born":
                return paths.date_key(F.col("modified_ns" if self.what == "changed" else "created_ns"), "day" in self.words)
            case "folder":
                return paths.folder_key(path, F.col("root"), full="whole" in self.words, from_root="below" in self.words, depth_limit=self.levels or None, case_sensitive=cased)
            case "streams":
                return F.struct("streams", "stream_hashes")
        return F.col(self.what)


@dataclass(frozen=True)
class Matching:
    """What a group's files share, what is known of their contents, and whether they must lie in several folders."""

    same: tuple[Same, ...]
    evidence: tuple[str, ...]
    several_folders: bool = False

    def exact(self) -> dict[str, Column]:
        """Grouping columns by name. What isn't asked for is left out, so no null has to equal a null."""
        keys = {f"key_{s.what}": s.column() for s in self.same if not s.within and s.what != "size"}
        whole = self.evidence or any(s.what == "size" and not s.within for s in self.same)
        return ({"key_size": F.col("size")} if whole else {}) | keys

    def tolerance(self, what: str) -> Same | None:
        """The specification of a property that may differ a little. Evidence of contents leaves sizes no room."""
        loose = [s for s in self.same if s.what == what and s.within]
        return loose[0] if loose and not (what == "size" and self.evidence) else None

    @property
    def byte_verified(self) -> bool | None:
        """None where a digest and a comparison of bytes both stand behind a group."""
        return None if len(self.evidence) == 2 else "bytes" in self.evidence

    def unusable(self, files: DataFrame) -> DataFrame:
        """(path, reason) of files that lack a property that is asked for; they take no part."""
        asked = [s.column() for s in self.same if s.what == "born"]
        if not asked:
            return files.select("path", F.lit(None).cast("string").alias("reason")).where(F.lit(False))
        return files.where(asked[0].isNull()).select("path", F.lit("no time of creation").alias("reason"))

    def __str__(self) -> str:
        parts = [*sorted(map(str, self.same)), "+".join(self.evidence) or "no evidence", *(["several folders"] if self.several_folders else [])]
        return "; ".join(parts)


def matching(*same: str, evidence: str = "digest bytes", several_folders: bool = False) -> Matching:
    """A ``Matching`` from specifications; with none, files match by their contents alone."""
    parsed = tuple(Same.parse(s) for s in same)
    known = tuple(e for e in EVIDENCE if e in evidence.split())
    if set(evidence.split()) - set(EVIDENCE):
        raise ValueError(f"evidence is any of {EVIDENCE}")
    if len({s.what for s in parsed}) < len(parsed):
        raise ValueError("each property is named once")
    if not parsed and not known:
        raise ValueError("name at least one property or some evidence")
    return Matching(parsed, known, several_folders)
