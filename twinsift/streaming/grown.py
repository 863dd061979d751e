"""Media groups that grow: nodes, links and references are kept, new signatures alone are joined, and references are repaired.

Items that share all that is compared are one node, named by the place of the first that came; the node's place is
that of its least item, and can only move forward as items are added. Links between nodes never change, so a delta
meets old nodes in one join of new nodes with all. References are chosen anew only where a new or moved node can make a
difference.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.operators import similar
from twinsift.operators.graph import cut, references


@dataclass(frozen=True)
class MediaState:
    """What a scan of images or videos keeps.

    ``rows``: place, node of each item; ``nodes``: node, place and what is compared; ``links``: a, b and evidence, both ways and
    of each node with itself; ``refs``: node; ``groups``: the result so far.
    """

    kind: str
    preset: str
    rows: DataFrame
    nodes: DataFrame
    links: DataFrame
    refs: DataFrame
    groups: DataFrame


def _kind(kind: str, preset: str) -> similar.Media:
    if preset not in similar.MEDIA[kind].presets:
        raise ValueError("unknown strictness")
    return similar.MEDIA[kind]


def scan_media(kind: str, items: DataFrame, preset: str) -> MediaState:
    """The state over ``items``: images or videos, as their groups take them."""
    media = _kind(kind, preset)
    items = cut(media.comparable(items).withColumn("path", F.col("place.path")).dropDuplicates(["path"]).drop("path"))
    nodes = cut(items.groupBy(*media.compared).agg(F.min("place").alias("node")).select("node", F.col("node").alias("place"), *media.compared))
    rows = cut(items.join(nodes, [items[c].eqNullSafe(nodes[c]) for c in media.compared]).select(items["place"], "node"))
    links = cut(media.links(nodes, nodes, preset))
    refs = cut(similar.first_come(links, nodes))
    return MediaState(kind, preset, rows, nodes, links, refs, cut(media.best(rows, links, refs, nodes)))


def extend_media(state: MediaState, new: DataFrame) -> MediaState:
    """The state after ``new`` items. A path that is already held is passed over; what held items look like isn't read again
    except where nodes of new items are joined with all."""
    media = _kind(state.kind, state.preset)
    items = cut(media.comparable(new).withColumn("path", F.col("place.path")).dropDuplicates(["path"]).join(state.rows.select("place.path"), "path", "left_anti").drop("path"))
    arrived = items.groupBy(*media.compared).agg(F.min("place").alias("_least"))
    held = state.nodes.select("node", F.col("place").alias("_old"), *media.compared)
    on = arrived.join(held, [arrived[c].eqNullSafe(held[c]) for c in media.compared], "left")
    met = cut(on.select(*[arrived[c] for c in media.compared], "_least", "node", "_old"))
    fresh = met.where("node IS NULL").select(F.col("_least").alias("node"), F.col("_least").alias("place"), *media.compared)
    moved = met.where("_least < _old").select("node", F.col("_least").alias("place"), *media.compared)
    changed = cut(fresh.select("node").unionByName(moved.select("node")))
    nodes = cut(state.nodes.join(moved.select("node"), "node", "left_anti").unionByName(moved).unionByName(fresh))
    added = cut(fresh)
    ahead = cut(media.links(added, nodes, state.preset))
    # links are the same both ways; new nodes have met each other both ways already
    back = ahead.join(added.select(F.col("node").alias("b")), "b", "left_anti").select(F.col("b").alias("a"), F.col("a").alias("b"), "e")
    links = cut(state.links.unionByName(ahead).unionByName(back))
    names = met.select(F.coalesce("node", "_least").alias("node"), *media.compared)
    placed = items.join(names, [items[c].eqNullSafe(names[c]) for c in media.compared]).select(items["place"], "node")
    rows = cut(state.rows.unionByName(placed))
    edges = directed(links, nodes)
    refs, redone = repair(edges, state.refs, changed)
    # items to be dealt again: of redone nodes and of what is linked with them, and the new ones
    near = links.join(redone.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node"))
    touched = cut(near.unionByName(redone).unionByName(placed.select("node")).distinct())
    again = rows.join(touched, "node", "left_semi")
    theirs = links.join(touched.withColumnRenamed("node", "a"), "a", "left_semi")
    groups = state.groups.join(again.select(F.col("place.path").alias("path")), "path", "left_anti").select(*state.groups.columns)
    groups = cut(groups.unionByName(media.best(again, theirs, refs, nodes)))
    return MediaState(state.kind, state.preset, rows, nodes, links, refs, groups)


def directed(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(earlier, later): links from a node to one of a later place."""
    at = lambda n: nodes.select(F.col("node").alias(n), F.col("place").alias(f"_{n}"))
    both = links.select("a", "b").join(at("a"), "a").join(at("b"), "b").where("_b < _a")
    return cut(both.select(F.col("b").alias("earlier"), F.col("a").alias("later")))


def repair(edges: DataFrame, refs: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references now, nodes chosen anew) after the nodes ``changed`` came or moved forward.

    A node is chosen anew if it changed, or if an earlier neighbour is chosen anew and no reference that stays as it is
    holds it. Each round asks only the later neighbours of such nodes; as more references fall open, more nodes can follow.
    """
    open_ = changed
    n = open_.count()
    while n:
        later = edges.join(open_.withColumnRenamed("node", "earlier"), "earlier", "left_semi").select("later").distinct()
        asked = later.join(open_.withColumnRenamed("node", "later"), "later", "left_anti")
        firm = refs.join(open_, "node", "left_anti").withColumnRenamed("node", "earlier")
        pinned = edges.join(asked, "later", "left_semi").join(firm, "earlier", "left_semi").select("later")
        more = asked.join(pinned, "later", "left_anti").select(F.col("later").alias("node"))
        open_ = cut(open_.unionByName(more))
        after = open_.count()
        if after == n:
            break
        n = after
    firm = cut(refs.join(open_, "node", "left_anti"))
    members = edges.join(firm.withColumnRenamed("node", "earlier"), "earlier", "left_semi").select(F.col("later").alias("node"))
    free = cut(open_.join(members, "node", "left_anti"))
    ends = lambda c: free.withColumnRenamed("node", c)
    left = cut(edges.join(ends("earlier"), "earlier", "left_semi").join(ends("later"), "later", "left_semi").select("later", "earlier"))
    chosen = references(left).withColumnRenamed("id", "node")
    alone = free.join(left.select(F.explode(F.array("later", "earlier")).alias("node")), "node", "left_anti")
    return cut(firm.unionByName(chosen).unionByName(alone)), open_
