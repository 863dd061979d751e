"""Winnowing against a plain version, its guarantees, and the query's rows on odd and whole tables."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinsift.llm import queries, winnow


def plain(text, k, window):
    """Position by position: of each window the rightmost of the least hashes."""
    n = len(text)
    if not n:
        return []
    k = min(k, n)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    hashes = [int(winnow.gram_hashes(codes[a : a + k], k)[0]) for a in range(n - k + 1)]
    window = min(window, len(hashes))
    at = {max(range(s, s + window), key=lambda p: (-hashes[p], p)) for s in range(len(hashes) - window + 1)}
    return [(hashes[p], p) for p in sorted(at)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab é漢😀\ud800"), max_size=120), st.integers(1, 9), st.integers(1, 12))
def test_keeps_the_rightmost_least_of_every_window(text, k, window):
    h, p = winnow.winnowed(text, k, window)
    assert list(zip(h.tolist(), p.tolist())) == plain(text, k, window)


def test_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("abcde "), 5000)) + "a" * 3000 + "tail"
    whole = winnow.winnowed(text)
    monkeypatch.setattr(winnow, "_BLOCK", 97)
    parts = winnow.winnowed(text)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))


@settings(max_examples=50, deadline=None)
@given(st.text("abc ", max_size=100), st.text("abc ", max_size=100), st.text("xyz", min_size=winnow.GRAM + winnow.WINDOW - 1, max_size=80))
def test_a_shared_passage_is_noticed(before, after, passage):
    a, b = winnow.winnowed(before + passage), winnow.winnowed(passage + after)
    found = winnow.shares_passage(a, b)
    assert any((before + passage)[p : p + 16] == (passage + after)[q : q + 16] for p, q in found)


def brute(rows):
    """rows of (id, text): what the query returns, in one process."""
    order = lambda r: (r[0] is not None, r[0] or 0)
    rows = sorted(((i, t or "") for i, t in rows), key=order)
    out = []
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        prints = [plain(x, winnow.GRAM, winnow.WINDOW) for x in (t, edited, after)]
        sets = [{h for h, _ in p} for p in prints]
        like = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        text = [" ".join(f"{h:08x}@{p}" for h, p in x) for x in prints]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text[0], text[1], round(like[0], 9), round(like[1], 9), len(prints[0])))
    return Counter(out)


def got(df):
    return Counter((*r[:5], round(r.near_edited, 9), round(r.near_next, 9), r.n_kept) for r in df.collect())


def test_query_against_the_plain_version(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op11_fingerprints(spark, sf_dir)) == brute(rows)


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_odd_rows(spark, odd, odd_rows, partitions):
    """Ids that repeat are ordered by digests of their texts; the fixture's share their texts, so any order is right."""
    short = [(i, t) for i, t, _ in odd_rows if t is None or len(t) < 5000]
    df = odd.where("text IS NULL OR length(text) < 5000").repartition(partitions)
    assert got(winnow.edited_fingerprints(df)) == brute(short)


def test_many_equal_ids_and_rows(spark):
    """A third of all rows repeat one row: blocks part them, and every row still meets its next."""
    rows = [(None, "a null id, with a text that is longer than a gram and a window of grams taken together")] * 40 + [(k, f"text {k} " * 20) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(winnow.edited_fingerprints(df)) == brute(rows)


def test_empty_and_single(spark, empty):
    assert winnow.edited_fingerprints(empty).count() == 0
    one = winnow.edited_fingerprints(spark.createDataFrame([(7, "only a text of its own, which is its own next document too")], "doc_id long, text string")).collect()
    assert [r.near_next for r in one] == [1.0] and one[0].doc_id == 7


def test_operator_keeps_positions(spark, odd):
    rows = winnow.fingerprints(odd).collect()
    for r in rows:
        h, p = winnow.winnowed(r.document.text or "")
        assert r.hashes == h.tolist() and r.positions == p.tolist()
