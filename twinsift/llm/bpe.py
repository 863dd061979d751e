"""Byte-level BPE as a streaming transducer, with an incremental decoder.

A merge list is read from a tokenizer file. ``sufficient_lookahead`` computes how many bytes past a token boundary can
still change it; a stream keeps that many bytes and emits every earlier token at once. Texts come in blocks and are cut
into pieces by the tokenizer's word pattern, each piece as soon as it is settled; no piece is held in whole but those
that are shorter than the window, which a bounded memo answers for, and whatever outgrows it (a run of letters, signs
or white space) goes through the transducer as it comes. Tokens go on to the decoder and to digests block by block, so
beyond a text as Spark hands it over and the row that it becomes, nothing grows with its length.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts are fed to the encoder in blocks of so many characters.
BLOCK_CHARS = 1 << 16
#: A piece of more characters is streamed through the transducer and not remembered.
LONG_PIECE = 256
#: Entries of the memos of short chunks and pieces, half of them since the memo was last full; speed only.
MEMO_CHUNKS, MEMO_PIECES = 400_000, 100_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token boundary that decide it, whatever follows them.

    Text that is appended can only move a boundary to the left through merges of rising rank, each ending where
    the one before began: a merge (u, v) takes part if v was built, at its left edge, from the left part of an
    earlier merge of the chain. The bound is the largest sum of left parts over such chains.
    """
    left: dict[bytes, bytes] = {}
    reach: dict[bytes, int] = {}
    most = 0
    for u, v in merges:
        before, edge = 0, v
        while edge is not None:
            before = max(before, reach.get(edge, 0))
            edge = left.get(edge)
        here = len(u) + before
        reach[u] = max(reach.get(u, 0), here)
        left.setdefault(u + v, u)
        most = max(most, here)
    return most


class Vocabulary:
    """Tokens, merges and word pattern of a byte-level BPE tokenizer file (its JSON text)."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        model = parsed["model"]
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = model["vocab"]
        self.byte_ids = [0] * 256
        for letter, b in letters.items():
            self.byte_ids[b] = ids[letter]
        self.bytes_of = {i: raw(t) for t, i in ids.items()}
        self.rank_of = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self.lookahead = sufficient_lookahead([(raw(a), raw(b)) for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self._patterns(Tokenizer.from_str(spec).pre_tokenizer)

    def _patterns(self, splitter) -> None:
        """The word pattern, with letters and numbers as the library knows them.

        Libraries follow different Unicode versions; code points that are new to this Python are tried on the
        library's own splitter, all others have not changed class.
        """
        every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
        odd = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
        one = lambda s: len(splitter.pre_tokenize_str(s)) == 1
        wrong_l = [c for c in odd if regex.match(r"\p{L}", c) and not one("a" + c)]
        wrong_n = [c for c in odd if regex.match(r"\p{N}", c) and not one("1" + c)]

        def known(name: str, wrong: list[str]) -> str:
            return rf"[\p{{{name}}}--[{_ranges(wrong)}]]" if wrong else rf"\p{{{name}}}"

        letter, number = known("L", wrong_l), known("N", wrong_n)
        other = rf"[^\s{letter}{number}]" if not (wrong_l or wrong_n) else rf"[^\s||{letter}||{number}]"
        self.pattern = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+")
        self.spaces = "".join(regex.escape(c) for c in regex.findall(r"\s", every))
        self.chunk = re.compile(rf" ?[^{self.spaces}]+|[{self.spaces}]+(?![^{self.spaces}])|[{self.spaces}]+")
        self.runs = [regex.compile(rf"(?V1){c}*") for c in (letter, number, other)]
        self.white = regex.compile(r"(?V1)\s*")
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.special_reach = max(map(len, self.special), default=0)


def _ranges(chars: list[str]) -> str:
    out: list[list[int]] = []
    for c in map(ord, chars):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\U{a:08X}-\U{b:08X}" for a, b in out)


def merge_all(tokens: list[int], rank_of: dict, made: list[int]) -> list[int]:
    """Merges of the lowest rank first, leftmost first among equals."""
    if len(tokens) > 64:
        return _merge_heap(tokens, rank_of, made)
    none, rank = len(made), rank_of.get
    ranks = [rank(p, none) for p in pairwise(tokens)]
    while ranks:
        best = min(ranks)
        if best == none:
            break
        i = ranks.index(best)
        new = tokens[i] = made[best]
        del tokens[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = rank((new, tokens[i + 1]), none)
        if i:
            ranks[i - 1] = rank((tokens[i - 1], new), none)
    return tokens


def _merge_heap(tokens: list[int], rank_of: dict, made: list[int]) -> list[int]:
    n = len(tokens)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(rank_of[p], i, p) for i, p in enumerate(zip(tokens, tokens[1:])) if p in rank_of]
    heapq.heapify(heap)
    while heap:
        best, i, pair = heapq.heappop(heap)
        j = after[i]
        if tokens[i] < 0 or j < 0 or (tokens[i], tokens[j]) != pair:
            continue
        tokens[i], tokens[j] = made[best], -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
            if (p := (tokens[i], tokens[after[j]])) in rank_of:
                heapq.heappush(heap, (rank_of[p], i, p))
        if before[i] >= 0 and (p := (tokens[before[i]], tokens[i])) in rank_of:
            heapq.heappush(heap, (rank_of[p], before[i], p))
    return [t for t in tokens if t >= 0]


class PieceStream:
    """Tokens of one piece of any length: bytes in, tokens out once no later byte can change them."""

    def __init__(self, vocabulary: Vocabulary, window: int | None = None):
        self.v = vocabulary
        self.window = max(window or 0, 4 * vocabulary.lookahead, 64)
        self.held = b""

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), self.window):
            self.held += data[at : at + self.window]
            if len(self.held) <= self.window:
                continue
            stable, end = len(self.held) - self.v.lookahead, 0
            for t in merge_all([self.v.byte_ids[b] for b in self.held], self.v.rank_of, self.v.made):
                if end + len(self.v.bytes_of[t]) > stable:
                    break
                end += len(self.v.bytes_of[t])
                out.append(t)
            self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        out = merge_all([self.v.byte_ids[b] for b in self.held], self.v.rank_of, self.v.made)
        self.held = b""
        return out


class Bounded(dict):
    """A memo in two halves: a full one becomes the older half, from which what is asked for again comes back."""

    def __init__(self, most: int):
        super().__init__()
        self.half, self.old = most // 2, {}

    def __missing__(self, key: str) -> tuple[int, ...]:
        out = self.old.get(key)
        if out is None:
            out = self.made(key)
            if len(key) > LONG_PIECE:
                return out
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class Memo(Bounded):
    """Tokens of short pieces; long ones go through the transducer and are not kept."""

    def __init__(self, vocabulary: Vocabulary, most: int = MEMO_PIECES):
        super().__init__(most)
        self.v = vocabulary
        self.chunks = ChunkMemo(self)

    def made(self, piece: str) -> tuple[int, ...]:
        if len(piece) > LONG_PIECE:
            stream = PieceStream(self.v)
            return tuple(stream.feed(piece.encode()) + stream.finish())
        return tuple(merge_all([self.v.byte_ids[b] for b in piece.encode()], self.v.rank_of, self.v.made))


class ChunkMemo(Bounded):
    """Tokens of short chunks: a word with the space before it. No piece reaches across the edge of a chunk."""

    def __init__(self, pieces: Memo, most: int = MEMO_CHUNKS):
        super().__init__(most)
        self.pieces = pieces

    def made(self, chunk: str) -> tuple[int, ...]:
        if chunk.isascii() and (chunk[1:] if chunk[0] == " " else chunk).isalpha():
            return self.pieces.made(chunk)  # A-Z and a-z with a space before them are one piece by any pattern
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, self.pieces.v.pattern.findall(chunk))))


def _pop_tail(parts: list[str]) -> str:
    tail = ""
    while parts and len(tail) < 2:
        tail = parts.pop() + tail
    return tail


class Encoder:
    """Text in blocks of any size in, token ids out; ``finish`` ends the text. Equal to encoding the text at once."""

    def __init__(self, vocabulary: Vocabulary, memo: Memo | None = None):
        self.v = vocabulary
        self.memo = memo if memo is not None else Memo(vocabulary)
        self.held = ""
        self.long: PieceStream | None = None
        self.run: regex.Pattern | None = None

    def feed(self, text: str) -> list[int]:
        self.held += text
        return self._specials(False)

    def finish(self) -> list[int]:
        return self._specials(True)

    def _specials(self, last: bool) -> list[int]:
        """Special tokens end what stands before them and become their own ids."""
        if not self.v.special_pattern:
            return self._plain(last)
        out: list[int] = []
        parts = self.v.special_pattern.split(self.held) if any(s in self.held for s in self.v.special) else [self.held]
        for part in parts[:-1]:
            if part in self.v.special:
                out.append(self.v.special[part])
            else:
                self.held = part
                out += self._plain(True)
        self.held = parts[-1]
        if last:
            return out + self._plain(True)
        # the end of the block may be the start of a special token
        keep = next((k for k in range(min(self.v.special_reach - 1, len(self.held)), 0, -1) if any(s.startswith(self.held[-k:]) for s in self.v.special)), 0)
        tail = self.held[len(self.held) - keep :]
        self.held = self.held[: len(self.held) - keep]
        out += self._plain(False)
        self.held += tail
        return out

    def _plain(self, last: bool) -> list[int]:
        out: list[int] = []
        if self.long is not None:
            end = self.run.match(self.held).end()
            more = end == len(self.held) and not last
            if self.run is self.v.white and (more or end < len(self.held)):
                end -= 1  # the last white character before a word is not of the run's piece
            out += self.long.feed(self.held[:end].encode())
            self.held = self.held[end:]
            if more:
                return out
            out += self.long.finish()
            self.long = None
        chunks = self.v.chunk.findall(self.held)
        # a chunk or piece is settled once two more characters are known: no alternative of the patterns looks further
        tail = "" if last else _pop_tail(chunks)
        out += chain.from_iterable(map(self.memo.chunks.__getitem__, chunks))
        self.held = tail
        if len(tail) > LONG_PIECE:
            pieces = self.v.pattern.findall(tail)
            self.held = _pop_tail(pieces)
            out += chain.from_iterable(map(self.memo.__getitem__, pieces))
            if len(self.held) > LONG_PIECE:
                out += self._start_long()
        return out

    def _start_long(self) -> list[int]:
        """The held piece is long: streams all of it that is certain to be one piece."""
        if self.v.white.match(self.held).end() == len(self.held):
            self.run, self.long = self.v.white, PieceStream(self.v)
            data, self.held = self.held[:-1], self.held[-1:]
            return self.long.feed(data.encode())
        at = 1 if self.held[0] == " " else 0
        for run in self.v.runs:
            if run.match(self.held, at).end() == len(self.held):
                self.run, self.long = run, PieceStream(self.v)
                data, self.held = self.held, ""
                return self.long.feed(data.encode())
        return []


class Names(dict):
    """Token ids in decimal."""

    def __missing__(self, i: int) -> str:
        out = self[i] = str(i)
        return out


class Decoder:
    """Token ids in, text out: a state machine whose state is the bytes of an unfinished character.

    The step of a token from a state is worked out once; tokens of whole characters are joined without steps as long as
    no character is unfinished. Bytes that are no UTF-8 become U+FFFD as in a decoder
    that replaces every maximal ill-formed part once.
    """

    def __init__(self, bytes_of: dict[int, bytes], steps: dict | None = None):
        self.bytes_of = bytes_of
        self.state = b""
        self.steps = steps if steps is not None else {}
        self.whole = self.steps.setdefault("whole", {})  # states are bytes, so no state has this key

    def feed(self, ids: list[int]) -> str:
        steps, state, whole, out = self.steps, self.state, self.whole, []
        if not state:
            try:
                return "".join(map(whole.__getitem__, ids))
            except KeyError:
                pass  # a token of parts of characters, or one not seen before
        at = steps.setdefault(state, {})
        for i in ids:
            step = at.get(i)
            if step is None:
                step = at[i] = self._step(state, i)
                if not state and not step[1]:
                    whole[i] = step[0]
            text, then = step
            out.append(text)
            if then != state:
                state = then
                at = steps.setdefault(state, {})
        self.state = state
        return "".join(out)

    def finish(self) -> str:
        text, self.state = self.state.decode("utf-8", "replace"), b""
        return text

    def _step(self, state: bytes, token: int) -> tuple[str, bytes]:
        data = state + self.bytes_of[token]
        for keep in range(min(3, len(data)), 0, -1):
            if _unfinished(data[-keep:]):
                return data[:-keep].decode("utf-8", "replace"), data[-keep:]
        return data.decode("utf-8", "replace"), b""


def _unfinished(tail: bytes) -> bool:
    """Whether these bytes are the start of one character that more bytes could end."""
    try:
        tail.decode("utf-8")
    except UnicodeDecodeError as e:
        return e.start == 0 and e.reason == "unexpected end of data"
    return False


def encode_blocks(text: str, vocabulary: Vocabulary, memo: Memo | None = None, block: int = BLOCK_CHARS) -> Iterator[list[int]]:
    """Token ids of a text, block by block as they are settled."""
    encoder = Encoder(vocabulary, memo)
    for at in range(0, len(text) - block, block):
        yield encoder.feed(text[at : at + block])
    encoder.held += text[max(0, -(-len(text) // block) - 1) * block :]
    yield encoder.finish()


def encode(text: str, vocabulary: Vocabulary, memo: Memo | None = None, block: int = BLOCK_CHARS) -> list[int]:
    return list(chain.from_iterable(encode_blocks(text, vocabulary, memo, block)))


class Kept:
    """What a row with tokens and text becomes: both are gathered, as the row holds them."""

    def __init__(self):
        self.ids: list[int] = []
        self.decoded: list[str] = []

    def add(self, ids: list[int], decoded: str) -> None:
        self.ids += ids
        self.decoded.append(decoded)

    def row(self, i) -> tuple:
        return i, self.ids, "".join(self.decoded)


class Ids(Kept):
    """Tokens alone."""

    def add(self, ids: list[int], decoded: str) -> None:
        self.ids += ids

    def row(self, i) -> tuple:
        return i, len(self.ids), self.ids


class Digests:
    """A count and two digests, fed block by block."""

    names = Names()

    def __init__(self):
        self.n, self.of_ids, self.of_text = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: list[int], decoded: str) -> None:
        if ids:
            self.of_ids.update(("," if self.n else "").encode() + ",".join(map(self.names.__getitem__, ids)).encode())
            self.n += len(ids)
        self.of_text.update(decoded.encode())

    def row(self, i) -> tuple:
        return i, self.n, self.of_ids.hexdigest(), self.of_text.hexdigest()


def encode_documents(documents: DataFrame, spec: str) -> DataFrame:
    """doc_id, token_ids and the text decoded from them, for every whole text.

    Null texts count as empty and give no token. Repeated rows, null ids and further columns change nothing:
    each row is encoded alone and only doc_id and text are read. An empty table gives an empty result.
    """
    return _apply(documents, spec, "doc_id long, token_ids array<int>, decoded string", Kept)


def token_documents(documents: DataFrame, spec: str) -> DataFrame:
    """As ``encode_documents``, without the decoded text: doc_id, n_tokens, token_ids."""
    return _apply(documents, spec, "doc_id long, n_tokens long, token_ids array<int>", Ids)


def digest_documents(documents: DataFrame, spec: str) -> DataFrame:
    """As ``encode_documents``, with counts and digests in place of tokens and text."""
    return _apply(documents, spec, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", Digests)


@lru_cache(maxsize=1)
def _tools(spec: str) -> tuple[Vocabulary, Memo, dict]:
    """A vocabulary, its memo and the decoder's steps, once per worker process and not per task."""
    vocabulary = Vocabulary(spec)
    return vocabulary, Memo(vocabulary), {}


def _apply(documents: DataFrame, spec: str, schema: str, sink: type) -> DataFrame:
    shipped = documents.sparkSession.sparkContext.broadcast(spec)
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def run(batches):
        vocabulary, memo, steps = _tools(shipped.value)
        for batch in batches:
            rows, size = [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out, decoder = sink(), Decoder(vocabulary.bytes_of, steps)
                for ids in encode_blocks(text.as_py() or "", vocabulary, memo):
                    out.add(ids, decoder.feed(ids))
                    size += len(ids)
                out.add([], decoder.finish())
                rows.append(out.row(i))
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow, strict=True)], schema=arrow)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow, strict=True)], schema=arrow)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
