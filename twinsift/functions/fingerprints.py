"""Digests, signatures and their distances."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from math import floor, sin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 64 * 1024
#: Bytes of a file that are digested at once.
RANGE = 64 << 20


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def file_digest(content: Column, length: int = RANGE) -> Column:
    """SHA-256 of binary content; of more than one range, that of the texts of its ranges' digests (as ``contents.digests``)."""
    last = F.floor((F.octet_length(content) - 1) / length).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), last)), lambda k: digest(F.substring(content, k * length + 1, F.lit(length))))
    return F.when(F.octet_length(content) <= length, digest(content)).otherwise(F.sha2(F.array_join(parts, ""), 256))


def sample_digest(content: Column, window: int = SAMPLE) -> Column:
    """Digest of the first, the middle and the last window of binary content; windows that coincide count once."""
    n = F.octet_length(content)
    middle = F.greatest(F.lit(0), F.floor((n - window) / 2)).cast("int")
    last = F.greatest(F.lit(0), n - window)
    part = lambda at: F.substring(content, at + 1, F.lit(window))
    empty = F.lit(b"")
    return F.sha2(F.concat(part(F.lit(0)), F.when(middle > 0, part(middle)).otherwise(empty), F.when((last > 0) & (last != middle), part(last)).otherwise(empty)), 256)


def stream_digests(streams: Column) -> Column:
    """(name, sha256) of each named stream, in the order of the names."""
    return F.array_sort(F.transform(streams, lambda s: F.struct(s["name"].alias("name"), F.sha2(s["content"], 256).alias("sha256"))))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


_BASIS = np.cos(np.pi * np.outer(np.arange(8), 2 * np.arange(32) + 1) / 64) * np.where(np.arange(8) == 0, np.sqrt(0.5), 1.0)[:, None]
#: Variance of grey values below which an image has no signature.
LEAST_VARIANCE = 4.0


def perceptual_bits(pixels: np.ndarray) -> list[int | None]:
    """Of each 32 x 32 grey image: which of the 63 lowest cosine coefficients exceed their median; None if too flat."""
    images = pixels.reshape(-1, 32, 32).astype(float)
    low = (_BASIS @ images @ _BASIS.T).reshape(len(images), 64)[:, 1:]
    above = low > np.median(low, axis=1, keepdims=True)
    flat = images.reshape(len(images), -1).var(axis=1) < LEAST_VARIANCE
    return [None if f else int(sum(1 << i for i in np.flatnonzero(a))) for a, f in zip(above, flat, strict=True)]


@F.arrow_udf(T.LongType())
def perceptual_hash(pixels: pa.Array) -> pa.Array:
    """63-bit signature of 1,024 grey values, row by row; null where there are not 1,024 or too little detail."""
    rows = pixels.to_pylist()
    fine = [k for k, r in enumerate(rows) if r is not None and len(r) == 1024 and None not in r]
    out: list[int | None] = [None] * len(rows)
    for k, bits in zip(fine, perceptual_bits(np.array([rows[k] for k in fine])) if fine else [], strict=True):
        out[k] = bits
    return pa.array(out, pa.int64())


#: Bits of a word's hash that vote, and bytes of text whose words a task holds at once.
WORD_BITS, TEXT_AT_ONCE = 60, 4 << 20
#: Words that are hashed side by side.
HASHED_AT_ONCE = 1 << 15

_SINES = [floor(abs(sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_of_blocks(block: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The first 64 bits of the MD5 of ``n`` texts of one block each, whose 32-bit numbers come by place; those not given are 0."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _BEGIN)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            at = i
            np.bitwise_xor(np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f), d, out=f)
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f), c, out=f)
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
        else:
            at = 7 * i % 16
            np.bitwise_xor(np.bitwise_or(np.invert(d, out=f), b, out=f), c, out=f)
        np.add(np.add(f, a, out=f), np.uint32(_SINES[i]), out=f)
        if at in block:
            np.add(f, block[at], out=f)
        turn = _TURNS[i // 16][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=g)
        np.bitwise_or(np.left_shift(f, np.uint32(turn), out=f), g, out=f)
        a, b, c, d = d, np.add(f, b, out=a), b, c
    first, second = a + np.uint32(_BEGIN[0]), b + np.uint32(_BEGIN[1])
    return first.byteswap().astype(np.uint64) << np.uint64(32) | second.byteswap()


def word_hashes(words: pa.Array) -> np.ndarray:
    """The first 64 bits of each word's MD5. Words of up to 55 bytes, which fill one block, are hashed side by side."""
    words = words.cast(pa.binary())
    _, edges, content = words.buffers()
    edges = np.frombuffer(edges, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    held = np.concatenate([np.frombuffer(content or b"", np.uint8), np.zeros(64, np.uint8)])
    eight = np.ndarray(len(held) - 7, "<u8", held, strides=1)  # the number that begins at each byte
    lengths, out = np.diff(edges), np.empty(len(words), np.uint64)
    full = np.minimum(lengths >> 3, 7).astype(np.uint8)
    for i in np.flatnonzero(full == 7).tolist():
        word = held[edges[i] : edges[i + 1]].tobytes()
        out[i] = int.from_bytes(md5(word, usedforsecurity=False).digest()[:8], "big")
    for k in range(7):
        alike = np.flatnonzero(full == k)
        for at in range(0, len(alike), HASHED_AT_ONCE):
            some = alike[at : at + HASHED_AT_ONCE]
            parts = [eight[edges[some] + 8 * j] for j in range(k + 1)]
            rest = (lengths[some] & 7).astype(np.uint64) << np.uint64(3)
            parts[k] = parts[k] & ((np.uint64(1) << rest) - np.uint64(1)) | np.uint64(0x80) << rest  # the word's end is marked
            block = {2 * j + i: (x >> np.uint64(32 * i)).astype(np.uint32) for j, x in enumerate(parts) for i in (0, 1)}
            block[14] = lengths[some].astype(np.uint32) << np.uint32(3)
            out[some] = _md5_of_blocks(block, len(some))
    return out


def votes(texts: pa.Array) -> np.ndarray:
    """Of each text how many distinct words it has, and then for each bit how many of their hashes, the first 60 bits of MD5, have it set."""
    out = np.zeros((len(texts), 1 + WORD_BITS), np.int64)
    parts = pc.split_pattern(texts, " ")
    words = parts.flatten().dictionary_encode()
    if not len(words):
        return out
    known = words.dictionary
    hashes = word_hashes(known) >> np.uint64(64 - WORD_BITS)
    row = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).fill_null(0).to_numpy())
    key = np.sort(row * len(known) + words.indices.to_numpy())
    row, word = np.divmod(key[np.diff(key, prepend=-1) > 0], len(known))
    if (empty := pc.index(known, "").as_py()) >= 0:
        there = word != empty
        row, word = row[there], word[there]
    if not len(row):
        return out
    own = hashes[word]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    at, n = row[starts], np.diff(starts, append=len(row))
    out[at, 0] = n
    lane = 16 if n.max() < 1 << 16 else 32  # one sum counts a bit in each lane
    mask = np.uint64(sum(1 << k for k in range(0, 64, lane)))
    for i in range(lane):
        sums = np.add.reduceat((own >> np.uint64(i)) & mask, starts)
        for k in range(i, WORD_BITS, lane):
            out[at, 1 + k] = (sums >> np.uint64(k - i)) & np.uint64((1 << lane) - 1)
    return out


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in runs of about ``TEXT_AT_ONCE`` bytes."""
    run = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // TEXT_AT_ONCE
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    return (texts.slice(a, b - a) for a, b in zip(edges, edges[1:]))


@F.arrow_udf(T.ArrayType(T.LongType()))
def word_votes(texts: pa.Array) -> pa.Array:
    """``votes`` of each text, two bits to a number: the count of words, then bit i in the lower 31 bits and bit i + 30 above; zeros where there is no word."""
    half = WORD_BITS // 2
    held = np.concatenate([votes(x) for x in _parts(texts)])
    packed = np.concatenate([held[:, :1], held[:, 1 : half + 1] | (held[:, half + 1 :] << 31)], axis=1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(packed) + 1, dtype=np.int32) * (half + 1)), pa.array(packed.ravel()))


def _word_votes_signature(texts: pa.Array) -> pa.Array:
    """Of each text the bits that more than half of its distinct words' hashes have set; null where there is no word."""
    held = np.concatenate([votes(x) for x in _parts(texts)])
    signatures = (2 * held[:, 1:] > held[:, :1]) @ (np.int64(1) << np.arange(WORD_BITS))
    return pa.array(signatures, mask=held[:, 0] == 0)


#: Said to be non-deterministic so that a filter on it doesn't have it worked out a second time.
word_votes_signature = F.arrow_udf(_word_votes_signature, T.LongType()).asNondeterministic()
