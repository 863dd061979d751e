"""Plain versions of the operators, in one process over small tables."""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\r\x0b\x0c"


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def top_k(rows, k=20, every=20, scale=64):
    vectors = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, of) in enumerate(vectors):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(of, v)), i) for n, (i, v) in enumerate(vectors) if n != at)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


def substrings(rows, width=50):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    rank = lambda i: math.inf if i is None else i
    for i, b in data:
        for a in range(len(b) - width + 1):
            s = b[a : a + width]
            first[s] = min(first.get(s, math.inf), rank(i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for a in range(len(b) - width + 1):
            if first[b[a : a + width]] < rank(i):
                gone[a : a + width] = b"\1" * width
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def shingles(t):
    w = WORD.findall(lower(t or ""))
    return {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    having = defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for x in s:
            having[x].add(k)
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s) in enumerate(sets):
        shared = Counter(j for x in s for j in having[x] if j > k)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((find(i), find(sets[j][0])))
                root[b] = a
    return [(i, len(s), find(i), find(i) == i) for i, s in sets]


def lines(rows, least=10, chars=1):
    key = lambda x: lower(x.strip(SPACES))
    df = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if not (len(key(x)) >= chars and df[key(x)] >= least)]
        out.append((i, len(every), len(every) - len(kept), sha("\n".join(kept).encode())))
    return out


def rules(rows):
    out = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        n = len(w)
        dup = [x for x in t.split("\n") if WORD.search(x)]
        at = defaultdict(list)
        for a in range(n - 4):
            at[tuple(w[a : a + 5])].append(a)
        covered = {x for a in at.values() if len(a) > 1 for s in a for x in range(s, s + 5)}
        chars, symbols, repeats, repeated = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(dup) - len(set(dup)), len(covered)
        failed = n < 10 or 100 * repeated > 20 * n
        kept = not failed and not 100 * symbols > 30 * n and 2 * n <= chars <= 24 * n and not 100 * repeats > 50 * len(dup)
        out.append((i, n, chars, symbols, repeats, repeated, failed, kept))
    return out


def base_scores(rows):
    def tokens(t):
        return [*WORD.findall(lower(t or "")), None]

    out_of = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(x for i, t in rows if not out_of(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(i, out_of(i), len(w := tokens(t)), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for i, t in rows]


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, out, live = share * sum(sizes.values()), {}, list(order)
    while live:
        level = left / sum(weight[s] for s in live)
        full = [s for s in live if level * weight[s] >= most * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in live}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            live.remove(s)
    return out


def chats(messages, tools):
    """(row, conv_id, turn, kind, call_id, status, json) of messages in their order; each a dict."""
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
    rows = [m | {"key": k, "at": -math.inf if m["turn"] is None else m["turn"]} for k, m in enumerate(messages)]
    first = {"call": {}, "result": {}}
    for m in sorted(rows, key=lambda m: (m["at"], m["key"])):
        if m["kind"] in first and m["conv_id"] is not None and m["call_id"] is not None:
            first[m["kind"]].setdefault((m["conv_id"], m["call_id"]), m)
    calls, results = first["call"], first["result"]
    last = {i: max(m["at"], results[i]["at"]) if i in results else m["at"] for i, m in calls.items()}
    needs = {i: {(i[0], x) for x in m["after"] or []} for i, m in calls.items()}
    known = {i: {x for x in n if x in calls} for i, n in needs.items()}
    placed = {}
    if any(last[x] >= calls[i]["at"] for i, n in known.items() for x in n):
        level = 0
        while ready := [i for i in calls if i not in placed and known[i] <= placed.keys()]:
            placed |= {i: (max([calls[i]["at"], *(max(placed[x][0], last[x]) for x in known[i])]), level) for i in ready}
            level += 1
    else:
        placed = {i: (m["at"], 0) for i, m in calls.items()}

    def parsed(text):
        try:
            return json.loads(text)
        except (TypeError, ValueError):
            return text

    def fits(name, v):
        of = tools[name]
        right = lambda x, kind: isinstance(x, kinds[kind]) and (kind in ("boolean",) or not isinstance(x, bool))
        return isinstance(v, dict) and v.keys() <= of.keys() and all(right(v[a], kind) if a in v else not required for a, (kind, required) in of.items())

    plain = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    out = []
    for m in rows:
        i, kind = (m["conv_id"], m["call_id"]), m["kind"]
        linked = None not in i
        status, at, depth = "ok", m["at"], 1 if kind == "result" else 0
        body = {"role": m["role"], "text": m["text"]}
        if kind == "call":
            v = parsed(m["arguments"])
            body |= {"arguments": v, "call_id": m["call_id"], "name": m["name"]}
            if not linked:
                status = "unidentified"
            elif calls[i] is not m:
                status = "duplicate"
            else:
                at, depth = placed[i][0] if i in placed else at, 2 * placed[i][1] if i in placed else 0
                if needs[i] - known[i]:
                    status = "missing_need"
                elif i not in placed:
                    status = "circle"
                elif m["name"] not in tools:
                    status = "unknown_tool"
                elif not fits(m["name"], v):
                    status = "bad_arguments"
                elif i not in results:
                    status = "unanswered"
        elif kind == "result":
            body |= {"call_id": m["call_id"]}
            if not linked or i not in calls:
                status = "orphan"
            else:
                at, depth = max(at, placed[i][0]) if i in placed else at, 2 * placed[i][1] + 1 if i in placed else 1
                if results[i] is not m:
                    status = "repeated"
        out.append(((m["conv_id"] is not None, m["conv_id"] or 0, at, depth, m["at"], m["key"]), m, status, plain(body)))
    return [(k, m["conv_id"], m["turn"], m["kind"], m["call_id"], status, text) for k, (_, m, status, text) in enumerate(sorted(out, key=lambda x: x[0]))]


def shards(rows, n=16):
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), equal texts side by side in the order of their hashes."""
    import xxhash

    data = [((t or "").encode(), i) for i, t in rows]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    data.sort(key=lambda x: (zlib.crc32(x[0]), signed(xxhash.xxh64_intdigest(x[0], 42)), x[1] is not None, x[1]))
    total = sum(len(t) + 1 for t, _ in data)
    group, at = {}, 0
    for t, _ in data:
        g = group.setdefault(t, [at, 0])
        g[1] += len(t) + 1
        at += len(t) + 1
    out, at, slots = [], 0, Counter()
    for t, i in data:
        start, size = group[t]
        whole = size <= 0.02 * total / n
        middle = 2 * start + size if whole else 2 * at + len(t) + 1
        shard = min(n - 1, middle * n // (2 * total))
        out.append((i, len(t) + 1, zlib.crc32(t), "bytes", shard, slots[shard], None))
        slots[shard] += 1
        at += len(t) + 1
    return out
