"""Operators on odd tables and on the smallest test tables, against plain versions."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from twinsift.llm import bpe, lines, lm, minhash, mixing, queries, rules, search, sharding, substrings
from twinsift.llm.scratch import Scratch


@pytest.fixture(scope="module")
def spec():
    return queries.tokenizer_spec()


@pytest.fixture(scope="module")
def vocabulary(spec):
    return bpe.Vocabulary(spec)


@pytest.fixture(scope="module")
def library(spec):
    return Tokenizer.from_str(spec)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def rows(df, n=None):
    return Counter(tuple(r)[:n] for r in df.collect())


def pairs(odd_rows):
    return [(i, t) for i, t, _ in odd_rows]


# BPE


def test_classes_of_all_code_points(vocabulary, library):
    memo = bpe.Memo(vocabulary)
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 13 == 0)]
    for at in range(0, len(every), 512):
        s = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)} x" for c in every[at : at + 512])
        assert bpe.encode(s, vocabulary, memo) == library.encode(s, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "'", "'re", "é", "1", "!!", "<|endoftext|>", "<|end", "\t", "漢", "😀", "ab" * 300, " " * 400, "\n" * 900, " \t" * 300, "-" * 700, "\x1c", "\x85", "\u3000" * 500]), max_size=40), st.integers(1, 60))
def test_streaming_equals_the_library(vocabulary, library, parts, block):
    s = "".join(parts)
    want = library.encode(s, add_special_tokens=False).ids
    assert bpe.encode(s, vocabulary, None, block) == want
    d = bpe.Decoder(vocabulary.bytes_of)
    assert "".join(d.feed([i]) for i in want) + d.finish() == library.decode(want, skip_special_tokens=False) == s


@pytest.mark.parametrize("unit", ["x", " ", "\n", "-", "ab ", "漢"])
def test_nothing_is_held_of_a_long_run(vocabulary, library, unit):
    encoder, out, most = bpe.Encoder(vocabulary), [], 0
    for _ in range(40):
        out += encoder.feed(unit * 500)
        most = max(most, len(encoder.held) + (len(encoder.long.held) if encoder.long else 0))
    out += encoder.finish()
    assert most <= 8 * vocabulary.lookahead + 3 * bpe.LONG_PIECE
    if unit != "x":  # the library takes long over a long word
        assert out == library.encode(unit * 20_000, add_special_tokens=False).ids


def test_ill_formed_tokens_decode_as_the_library_does(vocabulary, library):
    r = random.Random(4)
    for _ in range(300):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 12))]
        d = bpe.Decoder(vocabulary.bytes_of)
        assert d.feed(ids) + d.finish() == library.decode(ids, skip_special_tokens=False)


def test_lookahead_is_sufficient(vocabulary):
    r = random.Random(6)
    look = vocabulary.lookahead
    for _ in range(40):
        s = "".join(r.choice("etaoinsh") for _ in range(4 * look)).encode()
        whole = bpe.merge_all([vocabulary.byte_ids[b] for b in s], vocabulary.rank_of, vocabulary.made)
        cut = r.randrange(2 * look, 4 * look)
        part = bpe.merge_all([vocabulary.byte_ids[b] for b in s[:cut]], vocabulary.rank_of, vocabulary.made)
        end = 0
        for k, t in enumerate(part):
            end += len(vocabulary.bytes_of[t])
            if end > cut - look:
                break
            assert whole[k] == t


def test_bpe_on_odd_tables(odd, empty, odd_rows, spec, library):
    want = Counter()
    for i, t in pairs(odd_rows):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), brute.sha(",".join(map(str, ids)).encode()), brute.sha((t or "").encode()))] += 1
    assert rows(bpe.digest_documents(odd, spec)) == want
    assert bpe.digest_documents(empty, spec).count() == 0
    assert {r.decoded for r in bpe.encode_documents(odd, spec).collect()} == {t or "" for _, t in pairs(odd_rows)}


# search


def test_bounds_hold():
    rng = np.random.default_rng(1)
    q, x = rng.normal(0, 50, (20, 64)), rng.normal(0, 50, (300, 64))
    exact = q @ x.T
    levels = [search.bounds(q, x, n) for n in search.LEVELS]
    assert all((b >= exact).all() for b in levels) and all((a + 1e-3 >= b).all() for a, b in zip(levels, levels[1:]))


def test_bounds_leave_few_products():
    """Over several tiles of vectors whose energy lies in a few directions, most pairs are never multiplied."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 60, (40, 64)) * np.exp(-np.arange(64) / 6)
    x = np.floor((centres[rng.integers(0, 40, 6000)] + rng.normal(0, 3, (6000, 64))) @ np.linalg.qr(rng.normal(size=(64, 64)))[0])
    ids, q = np.arange(6000), np.arange(0, 6000, 20)
    _, basis = np.linalg.eigh(x.T @ x)
    counts: dict = {}
    seeds = rng.choice(6000, 300, replace=False)
    found = search.search_block(q, x[q], ids, ids, x, 20, np.ascontiguousarray(basis[:, ::-1]), (seeds, x[seeds]), counts=counts)
    got = {(int(a), int(i), int(s)) for own, i, _, s in found for a, i, s in zip(own, i, s)}
    scores = x[q] @ x.T
    scores[np.arange(len(q)), q] = -np.inf
    want = {(int(q[k]), int(i), int(scores[k, i])) for k in range(len(q)) for i in np.lexsort((ids, -scores[k]))[:20]}
    assert got == want
    assert counts["met"] == 300 * 6000 and counts["computed"] < 0.2 * counts["met"]


def test_search_on_odd_tables(spark):
    r = random.Random(2)
    vectors = [(i, [r.randint(-3, 3) / 7 for _ in range(8)]) for i in range(150)]
    vectors += [(i, vectors[0][1]) for i in range(150, 230)]
    vectors += [(300, None), (320, [float("nan")] * 8), (340, [None] + [1.0] * 7), (None, [1.0] * 8), (360, [float("inf")] * 8), (20, vectors[20][1])]
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<float>, score string")
    single = [(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in vectors]
    assert rows(search.top_k(df)) == Counter(brute.top_k(single))
    assert rows(search.top_k(df, seeds=0)) == Counter(brute.top_k(single))
    few = spark.createDataFrame([(20, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert rows(search.top_k(few)) == Counter([(20, 1, 1, 64 * 128)])
    assert search.top_k(few.where("vec_id > 100")).count() == 0


# mixing


def test_mixing(spark, odd, empty, odd_rows):
    got = mixing.mix(odd).collect()
    source = Counter()
    for _, t, s in odd_rows:
        source[s] += len(brute.WORD.findall(t or ""))
    want = brute.targets(dict(source))
    assert len(got) == len(odd_rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert sum(r.taken for r in got) == pytest.approx(1.5 * sum(source.values()), abs=len(source))
    by_size = {v: want[k] for k, v in source.items()}
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(by_size[r.source_size])
        taken[r.source_size] += r.taken
    assert all(abs(taken[n] - by_size[n]) <= 1 for n in taken)
    assert rows(mixing.mix(odd)) == Counter(map(tuple, got))
    assert mixing.mix(empty).count() == 0
    out = mixing.take(odd, mixing.mix(odd))
    assert out.columns == odd.columns
    one_id = [r.doc_id for r in got if r.doc_id not in (9, None)]
    n = Counter()
    for r in out.where("doc_id is not null and doc_id <> 9").collect():
        n[r.doc_id] += len(brute.WORD.findall(r.text))
    assert all(n[r.doc_id] == r.taken for r in got if r.doc_id in one_id)


def test_bins_keep_the_order_of_keys(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat_ws(" ", F.array_repeat(F.lit("w"), F.col("id").cast("int") % 5)).alias("text"))
    df = df.unionByName(df.limit(100).withColumn("source", F.lit("t")).withColumn("text", F.lit("w " * 2000)))
    got = [r for r in mixing.mix(df).collect() if r.source_size == 40_000]
    rest = round(got[0].target) % 40_000
    before = 0
    for r in sorted(got, key=lambda r: (r.key, r.doc_id)):
        assert r.taken - round(got[0].target) // 40_000 * r.size == max(0, min(r.size, rest - before))
        before += r.size


# substrings


def test_substrings_on_odd_tables(odd, empty, odd_rows):
    got = substrings.remove_repeats(odd).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    small = [(i, t if t is None or len(t) < 100_000 else t) for i, t in pairs(odd_rows)]
    assert rows(got) == Counter(brute.substrings(small))
    assert substrings.remove_repeats(empty).count() == 0


def test_suffixes_are_in_order():
    r = random.Random(3)
    for _ in range(30):
        parts = sorted({bytes(r.choice(b"ab\0\xff") for _ in range(r.randint(12, 40))) for _ in range(8)})
        data = b"\0".join(parts) + b"\0"
        order = substrings.two_stage_sort(substrings.padded(data), len(data), np.ones(len(data), bool), 12)
        heads = [(data + bytes(64))[a : a + 12] for a in order.tolist()]
        assert sorted(order.tolist()) == list(range(len(data))) and heads == sorted(heads)
        shared = substrings.common_prefixes(substrings.words_at(substrings.padded(data), len(data)), order, 12)
        for x, y, n in zip(heads, heads[1:], shared, strict=False):
            assert n == next((k for k in range(12) if x[k] != y[k]), 12)


def test_phrases_in_varying_surroundings(spark):
    """A hash that many different segments have is split, and no repeat between them is lost."""
    r = random.Random(8)
    noise = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    phrase, shared = "the same phrase of thirty bytes", [noise(40) for _ in range(6)]
    texts = [(k, noise(30) + r.choice(shared) + phrase + r.choice(shared) + noise(30)) for k in range(150)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for hot in (1, 4, 1 << 15):
        out = substrings.remove_repeats(df, 50, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
        assert rows(out) == Counter(brute.substrings(texts))
    block = {"ids": np.arange(150).tobytes(), "lens": np.array([len(t) for _, t in texts]).tobytes(), "text": "".join(t for _, t in texts).encode()}
    b = substrings.Block(block, 50, 64)
    windows = b.count.sum()
    b.split(np.ones(len(b.hash), bool))
    assert b.count.sum() == windows and (b.bucket == substrings.bucket_of(b.hash, 64)).all()


def test_runs_of_one_byte(spark):
    texts = [(1, "-" * 300), (2, "x" + "-" * 120 + "y"), (3, "-" * 50), (4, "-" * 49), (5, "z" * 60 + "-" * 60), (6, "a" * 55 + "-" * 70)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = substrings.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert rows(got) == Counter(brute.substrings(texts))


# language model


def test_language_model(spark, odd, empty, odd_rows, documents):
    got = {}
    for r in lm.score_documents(odd).collect():
        got.setdefault(r.doc_id, r)
    for want in brute.base_scores(pairs(odd_rows)):
        r = got[want[0]]
        assert tuple(r)[:5] == want[:5] and r.base_score == pytest.approx(want[5]) and r.score < 0
    assert lm.score_documents(empty).count() == 0
    df = spark.createDataFrame(documents, "doc_id long, text string")
    held = [r for r in lm.score_documents(df).collect() if r.held_out]
    n = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / n > sum(r.base_score for r in held) / n + 0.1


def some_outputs(words=300):
    rng = np.random.default_rng(0)
    return lm.Outputs(rng.integers(1, 1 << 63, words, dtype=np.uint64), np.arange(words, 0, -1.0), {e: (e % 7 + 1, e % 3 + 1) for e in range(500)})


def test_probabilities_are_normalised():
    """Over all outputs, and over the words and one unknown word of a shared output."""
    outputs = some_outputs()
    model, rng = lm.Model(outputs), np.random.default_rng(1)
    model.flat += rng.normal(0, 1, len(model.flat)).astype(np.float32)
    for before in rng.integers(0, outputs.size, (5, lm.CONTEXT)):
        logs = lm.log_probabilities(model, outputs, np.repeat(before[None], outputs.size, 0), np.arange(outputs.size))
        h = model.contexts(before[None])[0]
        plain = np.exp(model.part["class"] @ h + model.part["class_bias"])
        for w in range(0, outputs.size, 37):
            c = outputs.class_of[w]
            inside = np.exp(model.part["word"][outputs.members[c]] @ h + model.part["word_bias"][outputs.members[c]])
            assert logs[w] == pytest.approx(np.log10(plain[c] / plain.sum() * inside[outputs.place[w]] / inside.sum()), abs=1e-4)
        assert (10**logs).sum() == pytest.approx(1, abs=1e-4)
    tails = {e: (e % 7 + 1, e % 3 + 1) for e in range(500)}
    for k in range(outputs.tail):
        words = [(n, v) for e, (n, v) in tails.items() if e % outputs.tail == k]
        assert sum(n + 0.5 * v for n, v in words) + 0.5 == outputs.shares[k]


def test_noise_contrastive_estimation_learns_what_follows():
    """Each output is followed by one of two: the model finds which, and its size follows the corpus."""
    outputs, rng = some_outputs(60), np.random.default_rng(2)
    text = [0]
    for _ in range(60_000):
        text.append((text[-1] * 2 + int(rng.integers(2))) % 60)
    text = np.array(text)
    before = np.stack([np.append(np.zeros(j + 1, int), text[: -j - 1]) for j in range(lm.CONTEXT)], axis=1)
    model = lm.Model(outputs)
    learner = lm.Learner(model, outputs)
    for _ in range(3):
        for at in range(0, len(text), lm.BATCH):
            learner.learn(before[at : at + lm.BATCH], text[at : at + lm.BATCH], rng)
    mean = lm.log_probabilities(model, outputs, before, text).mean()
    assert np.log10(0.5) - 0.15 < mean < 0 and mean > np.log10(outputs.unigram[text]).mean() + 0.8
    assert [lm.size_of_vocabulary(n) for n in (0, 10**8, 10**12)] == [lm.LEAST_WORDS, 2320, 50_000]


def test_contexts_stay_within_their_text():
    texts = [b"a b c", b"", b"d e"]
    row = {"ids": np.arange(3).tobytes(), "lens": np.array([len(t) for t in texts]).tobytes(), "text": b"".join(texts)}
    t, outputs = lm.Tokens(lm.tokenise(row)), some_outputs()
    before, now = t.with_contexts(outputs)
    a, b, c, d, e = (int(now[k]) for k in (0, 1, 2, 5, 6))
    assert before.tolist() == [[0, 0, 0], [a, 0, 0], [b, a, 0], [c, b, a], [0, 0, 0], [0, 0, 0], [d, 0, 0], [e, d, 0]]


# near-duplicates


def test_near_duplicates_on_odd_tables(odd, empty, odd_rows):
    got = rows(minhash.near_duplicates(odd, percent=85))
    plain = brute.near([(10**6 if i is None else i, t) for i, t in pairs(odd_rows)])
    null = lambda i: None if i == 10**6 else i
    assert got == Counter((null(i), n, null(c), k) for i, n, c, k in plain)
    assert minhash.near_duplicates(empty).count() == 0


def test_chains_are_one_component(spark):
    """Documents of which each is linked to the next one only."""
    words = [f"w{k}" for k in range(200)]
    texts = [(k, " ".join(words[k * 4 : k * 4 + 100])) for k in range(20)]
    texts += [(100 + k, " ".join(words[:60] + [f"v{k}-{j}" for j in range(4)] + words[60:100])) for k in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows(minhash.near_duplicates(df, percent=85)) == Counter(brute.near(texts, 85))


def test_pairs_hidden_among_texts_with_one_template(spark):
    """2,200 texts share a passage and stay below the threshold; 350 pairs among them are linked."""
    template = " ".join(f"t{k}" for k in range(160))
    tail = lambda k: [f"u{k}-{j}" for j in range(20)]
    texts = [(k, " ".join([template, *tail(k)])) for k in range(1850)]
    texts += [(10_000 + k, " ".join([template, *tail(k)[:6], *(f"v{k}-{j}" for j in range(14))])) for k in range(350)]
    got = rows(minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), percent=85))
    assert got == Counter((i, 176, i % 10_000, i < 10_000) for i, _ in texts)


def test_prefix_pairs_are_whole_and_few(spark):
    """Every pair of different labels that is similar enough is found; near copies that are not stay few."""
    rng, base, sets = random.Random(3), list(range(1, 151)), []
    for k in range(500):
        s = set(base)
        for e in range(rng.choice([1, 2, 3, 5, 8])):
            at = rng.randrange(145)
            s = s - set(base[at : at + 5]) | {1000 * (k + 1) + 10 * e + j for j in range(5)}
        sets.append((k, sorted(s)))
    apart = [(k, k if k % 5 else 0) for k, _ in sets]
    label = dict(apart)
    want = set()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            common = len(set(x) & set(y))
            if label[a] != label[b] and 100 * common >= 85 * (len(x) + len(y) - common):
                want.add((b, a))
    frames = spark.createDataFrame(sets, "id long, shingles array<long>").withColumn("h", F.xxhash64("shingles")), spark.createDataFrame(apart, "id long, label long")
    got = {tuple(r) for r in minhash.prefix_pairs(Scratch(spark), *frames, 85).collect()}
    assert want and want <= got and len(got) < 500 * 499 / 2 / 2
    alone = frames[1].withColumn("label", F.lit(7).cast("long"))
    assert minhash.prefix_pairs(Scratch(spark), frames[0], alone, 85).count() == 0


def test_densified_signatures_agree_as_often_as_sets():
    rng = np.random.default_rng(5)
    agree = []
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 25, dtype=np.uint64)
        a, b = np.unique(pool[:22]), np.unique(pool[3:])
        agree.append((minhash.signature(a) == minhash.signature(b)).mean())
    assert abs(np.mean(agree) - 19 / 25) < 0.03


# shards


def test_sharding(odd, empty, odd_rows):
    import zlib

    got = sharding.shard_by_bytes(odd).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs(odd_rows))
    for s in {r.shard for r in got}:
        own = [r.slot for r in got if r.shard == s]
        assert sorted(own) == list(range(len(own))) and 0 <= s < 16
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    assert sharding.shard_by_bytes(empty).count() == 0


def test_shards_against_a_plain_version(spark, sf_dir, odd, odd_rows, documents):
    assert rows(sharding.shard_by_bytes(odd)) == Counter(brute.shards(pairs(odd_rows)))
    assert rows(queries.op8_sharding(spark, sf_dir)) == Counter(brute.shards(documents))
    copies = [(k, f"text {k // 4} " + "x" * 60) for k in range(8000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(copies, "doc_id long, text string"))
    assert rows(got) == Counter(brute.shards(copies))
    assert got.groupBy("text_crc32").agg(F.count_distinct("shard").alias("n")).where("n > 1").isEmpty()


def test_heavy_documents_come_first(spark):
    """Of equal documents, those of a larger weight fill the part of an epoch that isn't whole."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("s").alias("source"))
    weights = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 8.0).otherwise(0.5).alias("weight"))
    got = mixing.mix(df, weights, weights=(1.0,), share=1.5).collect()
    assert sum(r.taken for r in got) == 18_000 and all(r.taken in (3, 4, 5, 6) for r in got)
    extra = Counter(r.doc_id % 2 for r in got if r.taken > 3)
    assert extra[0] > 0.85 * 2000 and extra[1] < 0.15 * 2000
    plain = mixing.mix(df, None, weights=(1.0,), share=1.5).collect()
    assert abs(sum(1 for r in plain if r.taken > 3 and r.doc_id % 2) - 1000) < 150


def test_shards_are_even(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    sizes = [r[1] for r in sharding.shard_by_bytes(df).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 2 * 97


# lines


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_lines_on_odd_tables(odd, empty, odd_rows, broadcast):
    out = lines.line_report(odd, min_docs=4, broadcast=broadcast)
    got = out.select("document.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256))
    assert rows(got) == Counter(brute.lines(pairs(odd_rows), 4))
    kept = lines.drop_common_lines(odd.withColumn("n_lines", F.lit(-1)), min_docs=4, broadcast=broadcast)
    assert kept.columns == [*odd.columns, "n_lines"] and {r.n_lines for r in kept.collect()} == {-1}
    assert lines.drop_common_lines(empty, broadcast=broadcast).count() == 0


def test_levels_are_merged(spark):
    def found(batches, least):
        runs = lines.LineRuns(Scratch(spark), least)
        for rows_ in batches:
            runs.add(spark.createDataFrame([(bytes([h]), n) for h, n in rows_], "hash binary, n_docs long"))
        assert sum(r is not None for r in runs.levels) == bin(len(batches)).count("1")
        return {r[0][0] for r in runs.finish().collect()}

    assert found([[(k, 1), (k + 1, 1), (99, 2)] for k in range(7)], 3) == {99}
    assert found([[(k, 1), (k + 1, 1)] for k in range(6)], 2) == set(range(1, 6))
    assert found([], 2) == set()


def test_batches_meet_runs_without_moving_them(spark):
    """A run is read as it lies: the only exchange is the batch's own."""
    runs = lines.LineRuns(Scratch(spark), 2)
    one = spark.createDataFrame([(bytes([h]), 1) for h in range(50)], "hash binary, n_docs long")
    runs.add(one)
    batch = one.groupBy("hash").agg(F.sum("n_docs").alias("n_docs"))
    plan = batch.join(runs.levels[0].where("n_docs >= 2").select("hash").hint("merge"), "hash", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1


def test_found_lines_with_equal_halves():
    half = lambda k: k.to_bytes(8, "little")
    found = lines.Found(b"".join(half(a) + half(b) for a, b in [(1, 5), (1, 7), (1, 9), (3, 5)]))
    asked = [(1, 5), (1, 6), (1, 9), (3, 5), (3, 7), (0, 0), (9, 9)]
    assert found.has([half(a) + half(b) for a, b in asked]).tolist() == [True, False, True, True, False, False, False]
    assert not lines.Found(b"").has([half(1) + half(2)]).any()


# rules


def test_rules_on_odd_tables(odd, empty, odd_rows):
    assert rows(rules.judge(odd)) == Counter(brute.rules(pairs(odd_rows)))
    kept = rules.keep_good(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in brute.rules(pairs(odd_rows)) if r[-1])
    assert rules.judge(empty).count() == 0 and rules.keep_good(empty).count() == 0


@pytest.mark.parametrize("name, plain, n", [("op5_substrings", brute.substrings, None), ("op7_near_duplicates", brute.near, None), ("op9_lines", brute.lines, None), ("op10_rules", brute.rules, None)])
def test_queries_against_plain_versions(spark, sf_dir, documents, name, plain, n):
    assert rows(queries.QUERIES[name](spark, sf_dir), n) == Counter(plain(documents))


def test_every_training_token_is_learned_from(spark, sf_dir, monkeypatch):
    """Whatever the size: each round takes as many tokens as the counts say, on both sides of four million."""
    told = []
    plain = lm.train
    monkeypatch.setattr(lm, "train", lambda *a: told.append(plain(*a)) or told[-1])
    gains = []
    for table, large in ((f"{sf_dir}/documents.parquet", False), ("/root/testdata/sf0.1/documents.parquet", True)):
        df = spark.read.parquet(table)
        got = lm.score_documents(df.unionByName(df) if large else df).groupBy("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens"), F.max("train_tokens")).collect()
        tokens = got[0][3]
        assert (tokens > 4_000_000) == large and told[-1][1] == [tokens] * lm.ROUNDS
        gains += [r[1] - r[2] for r in got if r.held_out]
    print(gains)
    assert min(gains) > 0.1 and gains[1] > gains[0]


@pytest.mark.parametrize("size", [3e6, 1.5e7])
def test_scores_beyond_exact_doubles(spark, size):
    r = random.Random(int(size))
    vectors = [(i, [r.uniform(-size, size) for _ in range(6)]) for i in range(60)] + [(200 + i, [size] * 6) for i in range(3)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    want = Counter(brute.top_k(vectors))
    assert rows(search.top_k(df)) == want == rows(search.top_k(df, seeds=0)) and max(s for *_, s in want) > 1 << 53


def test_scores_beyond_longs_are_refused(spark):
    for x in (3e8, 1e300):
        df = spark.createDataFrame([(20, [x] * 8), (1, [1.0] * 8)], "vec_id long, embedding array<double>")
        with pytest.raises(ValueError, match="2\\^63"):
            search.top_k(df)
