"""Removal of byte strings that repeat across documents, with depth-limited two-stage suffix sorting.

Equal windows of ``width`` bytes have the same least k-mer hash. Each document is cut into segments, the longest
runs of windows with the same least hash; a segment's hash decides the bucket in which it is sorted, so equal
windows always meet. Hashes that only one document has are sorted out first by exchanging the hashes alone. A hash
that very many different segments have, as a short phrase in varying surroundings gives, is split by further hashes of
the windows. In a bucket the distinct segments form one text, whose needed suffixes are sorted in two stages: those smaller than
their successors directly, by their first ``width`` bytes, and the others by scans over the buckets of first bytes.
Adjacent suffixes whose common prefix reaches ``width`` hold the same window.

Blocks of documents are written once, bucketed by number, so that their bytes are not moved again; only hashes,
shared segments and verdicts are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.minhash import mixed
from twinsift.llm.scratch import NULL_ID, Scratch, document_blocks

BLOCK_BYTES = 4 << 20
K = 16
#: Bytes of text per bucket of the exchanges, and the least number of buckets.
BUCKET_BYTES = 4 << 20
LEAST_BUCKETS = 64
#: Buckets that one task sorts, one after the other, at most on average.
TASK_BUCKETS = 16
#: Different segments of one hash, counted up to a factor of two, from which it is split, and the hashes that split it.
HOT_SEGMENTS = 1 << 15
SALTS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def words_at(text: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each of the first n positions, as a number that orders like them; text is padded."""
    return np.lib.stride_tricks.sliding_window_view(text, 8)[:n].copy().view(">u8").ravel().astype(np.uint64)


def padded(data: bytes) -> np.ndarray:
    return np.frombuffer(data + bytes(64), np.uint8)


def least_hashes(data: bytes, width: int, salt: int = 0) -> np.ndarray:
    """For each window of ``width`` bytes the least hash of the k-mers in it."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    k = min(K, width)
    w = mixed(words_at(padded(data), len(data)))
    count = len(data) - k + 1
    h = mixed(w[:count] * np.uint64(3) + w[k - 8 : k - 8 + count]) if k > 8 else w[:count]
    h = mixed(h ^ np.uint64(salt)) if salt else h
    span, size = width - k + 1, 1
    while 2 * size <= span:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: n], h[span - size : span - size + n])


def segments(data: bytes, lens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, hash, document number) of each segment of a block; windows never cross documents."""
    h = least_hashes(data, width)
    if not len(h):
        return (np.empty(0, np.int64),) * 2 + (h, np.empty(0, np.int64))
    ends = np.cumsum(lens)
    inside = np.zeros(len(data) + 1, np.int64)
    whole = lens >= width
    np.add.at(inside, (ends - lens)[whole], 1)
    np.add.at(inside, (ends - width + 1)[whole], -1)
    inside = np.cumsum(inside)[: len(h)] > 0
    new = np.empty(len(h), bool)
    new[0] = True
    new[1:] = (h[1:] != h[:-1]) | (inside[1:] != inside[:-1])
    new[(ends - lens)[whole]] = True
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(h)))
    ok = inside[start]
    start, count = start[ok], count[ok]
    return start, count, h[start], np.searchsorted(ends, start, side="right")


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(h ^ np.uint64(0xA5A5A5A5)) % np.uint64(buckets)).astype(np.int64)


def two_stage_sort(text: np.ndarray, n: int, needed: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the needed suffixes of text[:n] in the order of their first ``depth`` bytes at least.

    ``needed`` must hold, of each position that is larger than its successor, the successor too.
    """
    step = np.full(n, -1, np.int8)
    step[:-1] = np.where(text[: n - 1] == text[1:n], -1, (text[: n - 1] < text[1:n]).astype(np.int8))
    step[n - 1] = 1
    known = np.where(step >= 0, np.arange(n), n)
    small = step[np.minimum.accumulate(known[::-1])[::-1]] == 1
    first = np.flatnonzero(needed & small)
    first = direct_sort(words_at(text, n), first, depth)
    head = text[first]
    larger = needed & ~small
    # how many places before each are larger suffixes of the same byte, one after the other
    same = np.append(larger[:-1] & (text[: n - 1] == text[1:n]), False)
    run = np.arange(n) - 1 - np.append(-1, np.maximum.accumulate(np.where(same, -1, np.arange(n)))[:-1])
    waiting: dict[int, list[np.ndarray]] = {}
    out = []
    for c in np.flatnonzero(np.bincount(text[:n][needed], minlength=256)):
        layer = np.concatenate(waiting.pop(int(c), [np.empty(0, np.int64)]))
        # the larger suffixes of this bucket: of a run of its byte the shortest come first, each in the order of its end
        times = run[layer] + 1
        back = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        o = np.argsort(back, kind="stable")
        scan = [(np.repeat(layer, times) - back)[o]]
        scan.append(first[np.searchsorted(head, c) : np.searchsorted(head, c, side="right")])
        scan = np.concatenate(scan)
        out.append(scan)
        p = scan[scan > 0] - 1
        p = p[larger[p] & (text[p] > c)]
        p = p[np.argsort(text[p], kind="stable")]
        t = text[p]
        cuts = np.flatnonzero(t[1:] != t[:-1]) + 1
        for part in np.split(p, cuts):
            if len(part):
                waiting.setdefault(int(text[part[0]]), []).append(part)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def direct_sort(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions by their first ``depth`` bytes, eight at a time; only ties go on."""
    at = at[np.argsort(words[at], kind="stable")]
    if len(at) < 2:
        return at
    w = words[at]
    edge = np.append(True, w[1:] != w[:-1])
    for off in _offsets(depth)[1:]:
        tied = ~edge | ~np.append(edge[1:], True)
        live = np.flatnonzero(tied)
        if not len(live):
            break
        group = np.cumsum(edge)[live]
        w = words[np.minimum(at[live] + off, len(words) - 1)]
        o = np.lexsort((w, group))
        at[live] = at[live][o]
        w = w[o]
        edge[live[1:]] |= w[1:] != w[:-1]
    return at


def _offsets(depth: int) -> list[int]:
    return [*range(0, depth - 8, 8), max(0, depth - 8)]


def common_prefixes(words: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Of each position but the first, the bytes in common with the one before, ``depth`` at most."""
    a, b = order[:-1], order[1:]
    out = np.full(len(b), depth, np.int64)
    live = np.arange(len(b))
    for off in _offsets(depth):
        last = len(words) - 1
        x = words[np.minimum(a[live] + off, last)] ^ words[np.minimum(b[live] + off, last)]
        differ = x != 0
        lead = sum((x[differ] < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))
        out[live[differ]] = off + lead
        live = live[~differ]
    return out


def repeated_runs(parts: list[bytes], least: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, from, to): bytes of a part covered by windows that a part with a smaller ``least`` also has."""
    data = b"\0".join(parts) + b"\0"
    n = len(data)
    lens = np.array([len(p) for p in parts], np.int64)
    start = np.cumsum(lens + 1) - lens - 1
    text = padded(data)
    window = np.zeros(n + 1, np.int64)
    np.add.at(window, start, 1)
    np.add.at(window, start + lens - width + 1, -1)
    window = np.cumsum(window)[:n] > 0
    # besides the windows, what follows a segment's last window up to the first suffix that is sorted directly
    rise = np.append(text[: n - 1] < text[1:n], True)
    differs = np.append(text[: n - 1] != text[1:n], True)
    nxt = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    small = rise[nxt]
    to = np.minimum.accumulate(np.where(small, np.arange(n), n)[::-1])[::-1][start + lens - width]
    needed = np.zeros(n + 1, np.int64)
    np.add.at(needed, start, 1)
    np.add.at(needed, to + 1, -1)
    needed = np.cumsum(needed)[:n] > 0
    order = two_stage_sort(text, n, needed, width)
    order = order[window[order]]
    of = np.repeat(np.arange(len(parts)), lens + 1)
    edge = np.append(True, common_prefixes(words_at(text, n), order, width) < width)
    low = np.minimum.reduceat(least[of[order]], np.flatnonzero(edge))[np.cumsum(edge) - 1]
    hit = np.zeros(n + 1, bool)
    hit[order[low < least[of[order]]]] = True
    a = np.flatnonzero(hit[:-1] & ~np.append(False, hit[:-2]))
    b = np.flatnonzero(hit[:-1] & ~hit[1:]) + 1
    part = of[a]
    return part, a - start[part], b - start[part] + width - 1


class Block:
    """A block's documents and, given the verdicts on its hashes, its shared segments by bucket."""

    def __init__(self, row: dict, width: int, buckets: int):
        self.ids, self.lens, self.data = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lens"], np.int64), row["text"]
        self.start, self.count, self.hash, self.doc = segments(self.data, self.lens, width)
        self.bucket = bucket_of(self.hash, buckets)
        self.width, self.buckets = width, buckets

    def by_bucket(self, h: np.ndarray):
        """(bucket, places in ``h``), each bucket once."""
        b = bucket_of(h, self.buckets)
        order = np.argsort(b, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(b[order])) + 1):
            if len(part):
                yield int(b[part[0]]), part

    def hashes(self):
        """(bucket, sorted distinct hashes, facts): whether several of the block's ids have each, in the highest bit,
        and in the others the length in bits of the number of its segments that begin or end otherwise."""
        h, inverse = np.unique(self.hash, return_inverse=True)
        ids = self.ids[self.doc]
        low, high = np.full(len(h), NULL_ID), np.full(len(h), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, ids)
        np.maximum.at(high, inverse, ids)
        w = words_at(padded(self.data), len(self.data))
        ends = mixed(w[self.start] * np.uint64(3) + mixed(w[self.start + self.count + self.width - 9] + self.count.astype(np.uint64)))
        other = np.unique(mixed(ends ^ self.hash) ^ self.hash, return_index=True)[1]
        n = np.bincount(inverse[other], minlength=len(h))
        facts = (np.frexp(np.maximum(n, 1))[1] | (low != high) * 128).astype(np.uint8)
        for bucket, part in self.by_bucket(h):
            yield bucket, h[part], facts[part]

    def split(self, hot: np.ndarray) -> None:
        """Cuts the segments ``hot`` wherever further hashes of their windows change, and hashes them anew."""
        start, count = self.start[hot], self.count[hot]
        of = np.repeat(np.arange(len(start)), count)
        at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + start[of]
        key = self.hash[hot][of]
        for salt in SALTS:
            key = mixed(key * np.uint64(3) + least_hashes(self.data, self.width, salt)[at])
        first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (key[1:] != key[:-1])))
        joined = lambda old, new: np.concatenate([old[~hot], new])
        self.doc = joined(self.doc, self.doc[hot][of[first]])
        self.start, self.count = joined(self.start, at[first]), joined(self.count, np.diff(np.append(first, len(of))))
        self.hash = joined(self.hash, key[first])
        self.bucket = bucket_of(self.hash, self.buckets)

    def shared(self, bits: list[dict] | None):
        """bucket -> (distinct segments, least id of each, [(distinct number, start, id)])."""
        verdict = {r["bucket"]: r["bits"] for r in bits or []}
        h, inverse = np.unique(self.hash, return_inverse=True)
        told = np.zeros(len(h), np.uint8)
        for bucket, part in self.by_bucket(h):
            if bucket in verdict:
                told[part] = np.frombuffer(verdict[bucket], np.uint8)
        told = told[inverse]
        live = told > 0
        if (hot := told > 1).any():
            self.split(hot)
            live = np.concatenate([live[~hot], np.ones(len(self.hash) - np.count_nonzero(~hot), bool)])
        live = np.flatnonzero(live)
        live = live[np.argsort(self.bucket[live], kind="stable")]
        out = {}
        data, width = self.data, self.width
        at = self.start[live]
        rows = zip(self.bucket[live].tolist(), at.tolist(), (at + self.count[live] + width - 1).tolist(), self.ids[self.doc[live]].tolist(), strict=True)
        now, seen, least, where = -1, {}, [], []
        for bucket, a, z, i in rows:
            if bucket != now:
                seen, least, where = {}, [], []
                out[bucket] = (seen, least, where)
                now = bucket
            k = seen.setdefault(data[a:z], len(seen))
            if k == len(least):
                least.append(i)
            elif i < least[k]:
                least[k] = i
            where.append((k, a, z, i))
        return out


def _rows(batches):
    for b in batches:
        for k in range(b.num_rows):
            yield {name: b.column(name)[k].as_py() for name in b.schema.names}


def remove_repeats(documents: DataFrame, width: int = 50, scratch: Scratch | None = None, hot: int = HOT_SEGMENTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: each text without the bytes that ``width``-byte strings of
    documents with smaller ids cover.

    Texts are UTF-8 bytes and ``kept`` is binary, as a cut may part a character. Null texts are empty; null ids
    count as the largest id and stay null; rows that share an id are not held against each other. Only doc_id
    and text are read. An empty table gives no rows. ``width`` must be at least 9. From ``hot`` different segments a
    hash is split.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark)
    blocks = document_blocks(scratch, documents, BLOCK_BYTES)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))
    tasks = -(-buckets // TASK_BUCKETS)
    many = tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_bucket = lambda df: (df.repartition(tasks, "bucket") if many else df).groupBy("bucket")

    def hashes(batches):
        for row in _rows(batches):
            block = Block(row, width, buckets)
            out = [(row["block"], k, h.tobytes(), m.tobytes()) for k, h, m in block.hashes()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["block", "bucket", "hashes", "facts"])

    def verdicts(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        facts = np.concatenate([np.frombuffer(x, np.uint8) for x in t.column("facts").to_pylist()])
        h, inverse, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        verdict = (n > 1).astype(np.uint8)
        verdict[inverse[facts > 127]] = 1
        other = np.bincount(inverse, np.ldexp(0.5, (facts & 127).astype(int)), len(h))
        verdict[(verdict > 0) & (other >= hot)] = 2
        bits = np.split(verdict[inverse], np.cumsum([len(p) for p in parts])[:-1])
        return pa.table([t.column("block"), t.column("bucket"), pa.array([x.tobytes() for x in bits])], names=["block", "bucket", "bits"])

    told = by_bucket(blocks.mapInArrow(hashes, "block long, bucket long, hashes binary, facts binary")).applyInArrow(verdicts, "block long, bucket long, bits binary")
    told = scratch.write(told.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("verdict")))
    known = blocks.join(told.hint("shuffle_hash"), "block", "left")

    def shipped(batches):
        for row in _rows(batches):
            for bucket, (seen, least, _) in Block(row, width, buckets).shared(row["verdict"]).items():
                lens = np.fromiter(map(len, seen), np.int32, len(seen))
                cells = [row["block"], bucket, b"".join(seen), lens.tobytes(), np.array(least, np.int64).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c]) for c in cells], names=["block", "bucket", "parts", "lens", "least"])

    def sort_bucket(t: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        low: list[int] = []
        held = []
        for parts, lens, least in zip(t.column("parts"), t.column("lens").to_pylist(), t.column("least").to_pylist(), strict=True):
            parts, at, own = parts.as_buffer().to_pybytes(), 0, []
            least = np.frombuffer(least, np.int64)
            for n, i in zip(np.frombuffer(lens, np.int32).tolist(), least.tolist(), strict=True):
                k = number.setdefault(parts[at : at + n], len(number))
                at += n
                own.append(k)
                if k == len(low):
                    low.append(i)
                elif i < low[k]:
                    low[k] = i
            held.append((np.array(own), least))
        low = np.array(low, np.int64)
        part, a, b = repeated_runs(list(number), low, width)
        first = np.searchsorted(part, np.arange(len(low) + 1))  # runs come in the order of parts
        full, runs = [], []
        for own, least in held:
            whole = low[own] < least
            full.append(np.packbits(whole).tobytes())
            n = np.where(whole, 0, first[own + 1] - first[own])
            k = np.flatnonzero(n)
            at = np.concatenate([np.arange(first[x], first[x + 1]) for x in own[k]]) if len(k) else np.empty(0, np.int64)
            runs.append(np.stack([np.repeat(k, n[k]), a[at], b[at]]).astype(np.int32).tobytes())
        return pa.table([t.column("block"), t.column("bucket"), pa.array(full), pa.array(runs)], names=["block", "bucket", "full", "runs"])

    sent = known.mapInArrow(shipped, "block long, bucket long, parts binary, lens binary, least binary")
    back = by_bucket(sent).applyInArrow(sort_bucket, "block long, bucket long, full binary, runs binary")
    back = scratch.write(back.groupBy("block").agg(F.collect_list(F.struct("bucket", "full", "runs")).alias("runs")))

    def removed(batches):
        for row in _rows(batches):
            block = Block(row, width, buckets)
            answer = {r["bucket"]: r for r in row["runs"] or []}
            gone = np.zeros(len(block.data) + 1, np.int64)
            for bucket, (seen, least, where) in block.shared(row["verdict"]).items():
                full = np.unpackbits(np.frombuffer(answer[bucket]["full"], np.uint8), count=len(seen)).astype(bool)
                runs = np.frombuffer(answer[bucket]["runs"], np.int32).reshape(3, -1).astype(np.int64)
                k, a, z, i = (np.array(c, np.int64) for c in zip(*where, strict=True))
                whole = full[k] | (i > np.array(least, np.int64)[k])
                np.add.at(gone, a[whole], 1)
                np.add.at(gone, z[whole], -1)
                if runs.shape[1]:
                    from_, to = np.searchsorted(runs[0], k), np.searchsorted(runs[0], k, side="right")
                    for x in np.flatnonzero(~whole & (to > from_)):
                        r = slice(from_[x], to[x])
                        np.add.at(gone, a[x] + runs[1, r], 1)
                        np.add.at(gone, a[x] + runs[2, r], -1)
            gone = np.cumsum(gone)[:-1] > 0
            out, at, data = [], 0, np.frombuffer(block.data, np.uint8)
            for i, n in zip(block.ids.tolist(), block.lens.tolist(), strict=True):
                g = gone[at : at + n]
                spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                out.append((None if i == NULL_ID else i, n, int(g.sum()), spans, data[at : at + n][~g].tobytes()))
                at += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    final = known.join(back.hint("shuffle_hash"), "block", "left")
    return final.mapInArrow(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
