"""Importance resampling against a plain version over whole tables and odd ones."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from twinsift.llm import queries, resampling
from twinsift.llm.scratch import Scratch

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=1):
    w = WORDS.findall(brute.lower(text or ""))
    return w, [" ".join(w[a : a + n]) for n in range(1, longest + 1) for a in range(len(w) - n + 1)]


def plain(rows, target, percent=10, m=10_000, longest=1, least=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % m
    count = lambda texts: Counter(bucket(f) for t in texts for f in features(t, longest)[1])
    s, t = count([x for _, x in rows]), count(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + m) / ((s[b] + 1) * (big_t + m))))
    out = []
    for i, x in rows:
        w, f = features(x, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(y)) for y in f)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = {}
    for n, r in enumerate(able[: len(able) * percent // 100], 1):
        ranks.setdefault(r, []).append(n)
    return Counter((*r[:4], ranks[r].pop() if ranks.get(r) else None) for r in out)


def rows_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_query_against_the_plain_version(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = rows_of(queries.op12_resampling(spark, sf_dir))
    assert got == plain(docs, target) and any(r[4] for r in got)


@pytest.mark.parametrize("longest,percent,hot", [(1, 60, 10**6), (3, 100, 1), (2, 35, 2)])
def test_odd_rows(spark, odd, odd_rows, longest, percent, hot):
    rows = [(i, t) for i, t, _ in odd_rows]
    target = ["one two three", None, "", "W3X1 w3x2 same"]
    of = spark.createDataFrame([(t,) for t in target], "text string")
    got = rows_of(resampling.resample(odd, of, percent, 97, longest, 3, hot=hot))
    assert got == plain(rows, target, percent, 97, longest, 3)


def test_pieces_change_nothing(monkeypatch):
    text = "Aa bB\tcc é1-zz,q " * 40 + "x" * 50
    whole = Counter(x for _, at in resampling.feature_buckets(text.encode(), 3, resampling.Buckets(1009)) for x in at.tolist())
    monkeypatch.setattr(resampling, "_PIECE", 11)
    monkeypatch.setattr(resampling, "_MEMO", 4)
    parts = Counter(x for _, at in resampling.feature_buckets(text.encode(), 3, resampling.Buckets(1009)) for x in at.tolist())
    assert whole == parts == Counter(zlib.crc32(f.encode()) % 1009 for f in features(text, 3)[1])


def test_a_score_of_many_is_ranked_by_range(spark):
    """A third of all rows have one id and text, so one score; both ways of ranking agree."""
    rows = [(5, "word " * 30)] * 60 + [(k, f"w{k} " * 25) for k in range(100, 220)]
    docs, of = spark.createDataFrame(rows, "doc_id long, text string").repartition(6), spark.createDataFrame([("word",)], "text string")
    a, b = (rows_of(resampling.resample(docs, of, 50, 101, hot=h)) for h in (10**6, 3))
    assert a == b == plain(rows, ["word"], 50, 101)


def test_offsets_over_partitions(spark):
    rows = [(s, s % 7 + 1) for s in range(-50, 50)]
    got = {r.score: r.above for r in resampling.counts_above(Scratch(spark), spark.createDataFrame(rows, "score long, n long").withColumn("n", F.col("n"))).collect()}
    assert got == {s: sum(n for x, n in rows if x > s) for s, _ in rows}


def test_empty_tables(spark, empty, odd):
    assert resampling.resample(empty, empty).count() == 0
    assert resampling.resample(odd, empty).where("rank IS NOT NULL").count() >= 0
    assert resampling.resample(odd.where("text = ''"), odd).where("rank IS NOT NULL").count() == 0
