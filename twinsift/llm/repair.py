"""Conversation structure repair by error-correcting Earley parsing.

The order of roles is a left-linear grammar. A chart item stands for a nonterminal that is complete at a row and holds
the cheapest (cost, audit) that leads there; error productions delete a row, give it another role, or insert one. As every rule
begins with its only nonterminal, all items begin at the first row, and a chart has as many items as nonterminals. Insertions
are written before the row that follows them, so of two audits over the same rows none begins the other, and the least audit of
a whole is made of the least audits of its parts: a long conversation is parsed in chunks, from every item that a chunk
can begin with, and the chunks' charts are joined.

Conversations are dealt by a hash and streamed in order. Those with more rows or bytes than a bound are cut into
chunks of the global order, so that no task holds one of them whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.scratch import Scratch, numbered

#: (complete, after, role initial): conversations are empty or an optional system row, then pairs of user and assistant.
GRAMMAR = (("S", "", "s"), ("U", "", "u"), ("U", "S", "u"), ("U", "A", "u"), ("A", "U", "a"))
ENDS = ("", "A")
ITEMS = ("", "S", "U", "A")
#: Roles that a row can be given and that can be inserted, by initial, and what edits cost.
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows and bytes of text from which a conversation is parsed in chunks, and rows of a chunk.
LONG_ROWS, LONG_BYTES, CHUNK_ROWS = 20_000, 32 << 20, 2_000
_SPACES = " \t\n\r\x0b\x0c"
_LEGAL = {"su", "ua", "au"}

Chart = dict[str, tuple[int, str]]
_AFTER = {left: [(head, t) for head, of, t in GRAMMAR if of == left] for left in ITEMS}


def _put(chart: Chart, item: str, cost: int, audit: str) -> bool:
    held = chart.get(item)
    if held is None or (cost, audit) < held:
        chart[item] = (cost, audit)
        return True
    return False


def with_insertions(chart: Chart) -> Chart:
    """``chart`` with all items that insertions reach from it."""
    out, todo = dict(chart), list(chart)
    while todo:
        item = todo.pop()
        cost, audit = out[item]
        todo += [head for head, t in _AFTER[item] if t in ROLES and _put(out, head, cost + INSERT, audit + "I")]
    return out


def scanned(chart: Chart, initial: str, fault: str) -> Chart:
    """The chart after one more row: kept, given another role, or deleted."""
    out: Chart = {}
    extra = TRUNCATED if fault == "t" else 0
    for item, (cost, audit) in with_insertions(chart).items():
        _put(out, item, cost + DELETE, audit + "D")
        if fault not in ("b", "d"):
            for head, t in _AFTER[item]:
                if t == initial:
                    _put(out, head, cost + extra, audit + "K")
                elif t in ROLES:
                    _put(out, head, cost + extra + REROLE, audit + "R")
    return out


def repair_of(chart: Chart) -> tuple[int, str]:
    """The cheapest (cost, audit) of a completed chart."""
    done = with_insertions(chart)
    return min(done[item] for item in ENDS if item in done)


def replayed(audit: str, rows: list[tuple[str, str]], item: str) -> Iterator[str]:
    """The lines that ``audit`` makes of ``rows`` (role, text), from an item on."""
    at = 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        role, text = rows[at] if edit != "I" else ("", "")
        at += edit != "I"
        head, t = next((h, t) for h, t in _AFTER[item] if (t == role[:1] if edit == "K" else t in ROLES))
        yield f"{role if edit == 'K' else ROLES[t]}:{text}"
        item = head


class Tally:
    """Counts over rows in order: gaps of turns, faults, and adjacent roles that may not follow each other."""

    def __init__(self):
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        self.blank += fault == "b"
        self.duplicate += fault == "d"
        self.truncated += fault == "t"
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in _LEGAL
        self.last = initial

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def fault_of(text: str, seen: bool) -> str:
    """b(lank), d(uplicate), t(runcated) or nothing: the first that holds."""
    end = text.rstrip(_SPACES)
    return "b" if not end else "d" if seen else "" if end[-1] in ".!?" else "t"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: every row damaged by crc32 of its ``conv_id:turn``; dropped ones stay, as ``gone``.

    Nulls count as one space, in that key too; conv_id and turn themselves stay null.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    gone = F.when(kind == 0, F.array(F.lit(True))).when(kind == 3, F.array(F.lit(False), F.lit(False))).otherwise(F.array(F.lit(False)))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.explode(gone).alias("gone"))


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _whole(batches, id_type: pa.DataType):
    """Rows of whole conversations, in order, to a row each."""
    schema = pa.schema([("conv_id", id_type), *((c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in _FIELDS)])
    out: list[tuple] = []
    now, rows, seen, tally, chart = None, [], set(), Tally(), {"": (0, "")}

    def done():
        cost, audit = repair_of(chart)
        text = "\n".join(replayed(audit, rows, ""))
        return (now[0], tally.gaps(), tally.blank, tally.duplicate, tally.truncated, tally.illegal, cost, audit, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())

    for b in batches:
        for conv, turn, role, text, gone in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")), strict=True):
            if now != (conv,):
                if now:
                    out.append(done())
                now, rows, seen, tally, chart = (conv,), [], set(), Tally(), {"": (0, "")}
            if gone:
                continue
            key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            fault = fault_of(text, key in seen)
            seen.add(key)
            rows.append((role, text))
            tally.add(turn, role[:1], fault)
            chart = scanned(chart, role[:1], fault)
        if len(out) > 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if now:
        out.append(done())
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _in_chunks(scratch: Scratch, rows: DataFrame, chunk_rows: int) -> DataFrame:
    """The same rows as of whole conversations, for long ones: chunks are parsed apart, then their charts joined."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = scratch.write(rows.where("NOT gone").withColumn("own", F.monotonically_increasing_id()))
    same = ("conv_id", "role", "d1", "d2")
    digests = rows.select("conv_id", "role", "turn", "own", F.xxhash64("text").alias("d1"), F.md5("text").alias("d2"))
    first = digests.groupBy(*same).agg(F.min(F.struct("turn", "own")).alias("f")).select(F.col("f.own").alias("own"), F.lit(False).alias("seen"))
    held = rows.join(first, "own", "left").withColumn("seen", F.coalesce("seen", F.lit(True)))
    held = numbered(scratch, held, F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "own")
    held = scratch.write(held.select("conv_id", "turn", "role", "text", "seen", "row", F.floor(F.col("row") / chunk_rows).alias("chunk")))
    part = "entry string, item string, cost long, audit string"
    counts = "low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string"

    def parsed(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        tally, given = Tally(), []
        for turn, role, text, seen in zip(*(table.column(c).to_pylist() for c in ("turn", "role", "text", "seen"))):
            given.append((role[:1], fault_of(text, seen)))
            tally.add(turn, *given[-1])
        charts = []
        for entry in ITEMS:
            chart: Chart = {entry: (0, "")}
            for x in given:
                chart = scanned(chart, *x)
            charts += [{"entry": entry, "item": i, "cost": c, "audit": a} for i, (c, a) in chart.items()]
        row = {"conv_id": table.column("conv_id")[0].as_py(), "chunk": table.column("chunk")[0].as_py(), "charts": charts} | {c.split()[0]: getattr(tally, c.split()[0]) for c in counts.split(", ")}
        return pa.Table.from_pylist([row], schema=parsed_schema(table.schema.field("conv_id").type))

    def parsed_schema(id_type):
        long = [pa.field(c, pa.int64()) for c in ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal")]
        chart = pa.list_(pa.struct([("entry", pa.string()), ("item", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
        return pa.schema([pa.field("conv_id", id_type), pa.field("chunk", pa.int64()), pa.field("charts", chart), *long, pa.field("first", pa.string()), pa.field("last", pa.string())])

    charts = held.groupBy("conv_id", "chunk").applyInArrow(parsed, f"conv_id {kind}, chunk long, charts array<struct<{part.replace(' string', ':string').replace(' long', ':long')}>>, {counts}")

    def joined(table: pa.Table) -> pa.Table:
        """A row per chunk with the item it begins with and its audit, and one (chunk -1) with the whole's counts."""
        chunks = table.sort_by("chunk").to_pylist()
        chart: dict[str, tuple[int, str, tuple]] = {"": (0, "", ())}
        total = Tally()
        for c in chunks:
            after: dict[str, tuple[int, str, tuple]] = {}
            for x in c["charts"]:
                if x["entry"] in chart:
                    cost, audit, way = chart[x["entry"]]
                    new = (cost + x["cost"], audit + x["audit"])
                    if x["item"] not in after or new < after[x["item"]][:2]:
                        after[x["item"]] = (*new, (way, x["entry"], x["audit"]))
            chart = after
            if c["low"] is not None:
                total.turns += c["turns"] - (total.high == c["low"])
                total.low, total.high = c["low"] if total.low is None else total.low, c["high"]
            for name in ("blank", "duplicate", "truncated", "illegal"):
                setattr(total, name, getattr(total, name) + c[name])
            total.illegal += total.last is not None and total.last + c["first"] not in _LEGAL
            total.last = c["last"]
        cost, audit = repair_of({i: (c, a) for i, (c, a, _) in chart.items()})
        tail = len(audit) - len(audit.rstrip("I"))
        # of the items that the last insertions can come from, the one whose audit they end
        way = next(w for c, a, w in chart.values() if a == audit[: len(audit) - tail] and c == cost - INSERT * tail)
        pieces = []
        while way:
            way, entry, piece = way
            pieces.append((entry, piece))
        pieces.reverse()
        pieces[-1] = (pieces[-1][0], pieces[-1][1] + "I" * tail)
        ids = table.column("conv_id")[0].as_py()
        out = [{"conv_id": ids, "chunk": c["chunk"], "entry": e, "audit": a} for c, (e, a) in zip(chunks, pieces, strict=True)]
        out.append({"conv_id": ids, "chunk": -1, "entry": "", "gaps": total.gaps(), "blank": total.blank, "duplicate": total.duplicate, "truncated": total.truncated, "illegal": total.illegal, "cost": cost, "audit": audit})
        schema = pa.schema([("conv_id", table.schema.field("conv_id").type), ("chunk", pa.int64()), ("entry", pa.string()), *((c, pa.int64()) for c in _FIELDS[:6]), ("audit", pa.string())])
        return pa.Table.from_pylist(out, schema=schema)

    ways = scratch.write(charts.groupBy("conv_id").applyInArrow(joined, f"conv_id {kind}, chunk long, entry string, {_COUNTS}"))

    def pieces_of(rows: pa.Table, way: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        lines = replayed(way.column("audit")[0].as_py(), list(zip(rows.column("role").to_pylist(), rows.column("text").to_pylist())), way.column("entry")[0].as_py())
        text = "\n".join(lines).encode("utf-8", "surrogatepass")
        return pa.table([rows.column("conv_id").slice(0, 1), rows.column("chunk").slice(0, 1), pa.array([text], pa.binary())], names=["conv_id", "chunk", "piece"])

    texts = held.groupBy("conv_id", "chunk").cogroup(ways.where("chunk >= 0").groupBy("conv_id", "chunk")).applyInArrow(pieces_of, f"conv_id {kind}, chunk long, piece binary")

    def hashed(batches):
        now, digest, some = None, None, False
        for b in batches:
            for conv, piece in zip(b.column(0).to_pylist(), b.column(2)):
                if now != (conv,):
                    if now:
                        yield pa.RecordBatch.from_arrays([pa.array([now[0]], b.column(0).type), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])
                    now, digest, some = (conv,), hashlib.sha256(), False
                piece = piece.as_py()
                if piece:
                    digest.update(b"\n" + piece if some else piece)
                    some = True
            kind = b.column(0).type
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    hashes = texts.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(hashed, f"conv_id {kind}, repaired_sha256 string")
    whole = ways.where("chunk = -1").drop("chunk", "entry")
    return whole.join(hashes.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id"))).select("conv_id", *_FIELDS)


def repair(rows: DataFrame, scratch: Scratch | None = None, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` has conv_id, turn, role, text and gone; roles and texts aren't null, and rows that are gone only keep their
    conversation in the result, with zeros and the empty audit if no other is left. Rows come in the order of turns, nulls
    first, ties by role and text; rows that repeat are rows of their own, all but the first duplicates. A null conv_id is a conversation
    too. A role's initial is its first character as it stands. An empty table gives no rows. Conversations beyond
    ``long_rows`` rows or ``long_bytes`` bytes are parsed in chunks; only the digest of such a one's repaired text is
    taken in one task, piece by piece.
    """
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark)
    rows = rows.select("conv_id", "turn", "role", "text", "gone")
    sizes = rows.groupBy("conv_id").agg(F.count_if(~F.col("gone")).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    long = scratch.write(sizes.where((F.col("n") > long_rows) | ((F.col("n") > 1) & (F.col("bytes") > long_bytes))).select(F.col("conv_id").alias("_id")))
    some = not long.isEmpty()
    own = F.col("conv_id").eqNullSafe(F.col("_id"))
    short = rows.join(long, own, "left_anti") if some else rows
    dealt = short.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def whole(batches):
        import itertools

        first = next(batches, None)
        if first is not None:
            yield from _whole(itertools.chain([first], batches), first.schema.field("conv_id").type)

    out = dealt.mapInArrow(whole, f"conv_id {kind}, {_COUNTS}, repaired_sha256 string")
    return out.unionByName(_in_chunks(scratch, rows.join(long, own, "left_semi"), chunk_rows)) if some else out
