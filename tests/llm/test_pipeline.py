"""The pipeline's stages, each held against what it must do to its own input."""

from collections import Counter

import corpus_pipeline
from tests.llm import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    (_, quality), (_, lines), (_, near), (_, mix), (_, encode) = corpus_pipeline.STAGES
    out = quality(spark, docs, sf_dir).cache()
    assert out.columns == columns
    want = {r[0] for r in brute.rules(rows) if r[-1]}
    assert Counter(r.doc_id for r in out.collect()) == Counter(i for i, _ in rows if i in want)
    rows = [(r.doc_id, r.text) for r in out.collect()]
    out = lines(spark, out, sf_dir).cache()
    assert out.columns == columns
    assert Counter((r.doc_id, brute.sha(r.text.encode())) for r in out.collect()) == Counter((i, h) for i, _, _, h in brute.lines(rows))
    rows = [(r.doc_id, r.text) for r in out.collect()]
    out = near(spark, out, sf_dir).cache()
    assert out.columns == columns
    assert {r.doc_id for r in out.collect()} == {i for i, _, c, _ in brute.near(rows, 80) if i == c}
    size = {r.doc_id: (r.source, len(brute.WORD.findall(r.text or ""))) for r in out.collect()}
    out = mix(spark, out, sf_dir).cache()
    assert out.columns == columns
    taken, sizes = Counter(), Counter()
    for r in out.collect():
        taken[r.source] += len(brute.WORD.findall(r.text))
    for s, n in size.values():
        sizes[s] += n
    for s, t in brute.targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= 1
    done = encode(spark, out, sf_dir)
    assert done.count() == out.count() and all(r.n_tokens == len(r.token_ids) for r in done.collect())


def test_run_on_an_odd_table(spark, sf_dir, odd, tmp_path):
    odd.selectExpr("doc_id", "text", "cast(null as string) lang", "source", "cast(length(text) as bigint) n_chars", "size", "`count`").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"file://{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert got.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_near_dedup_keeps_rows_that_share_an_id(spark):
    """Only a row whose own text is a near copy of a kept row's goes, whatever its id."""
    text = lambda k: " ".join(f"w{k}-{j}" for j in range(30))
    rows = [(None, text(0)), (None, text(1)), (5, text(2)), (5, text(3)), (6, text(3)), (None, text(2)), (7, ""), (7, None), (None, text(1))]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert Counter(tuple(r) for r in got.collect()) == Counter([*rows[:4], rows[6], rows[7]])


def test_run_on_an_empty_table(spark, sf_dir, tmp_path):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    documents.where("false").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"file://{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert got.count() == 0 and "token_ids" in got.columns


def test_mix_takes_rows_that_share_an_id_one_by_one(spark, sf_dir):
    """Sources meet their targets though most rows have no id and others share one."""
    text = lambda k, n: " ".join(f"w{k}-{j}" for j in range(n))
    rows = [(None, text(k, 50 + 40 * k), "a" if k % 2 else "b") for k in range(8)] + [(5, text(k, 90), "c") for k in range(20, 26)] + [(k, text(k, 70), "c") for k in range(30, 34)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    taken, sizes = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    copies = Counter()
    for r in corpus_pipeline.mix(spark, docs, sf_dir).collect():
        taken[r.source] += len(r.text.split())
        copies[r.text.split()[0]] += 1
    for s, t in brute.targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= 1
    assert max(copies.values()) <= 2


def test_run_gives_the_rows_of_its_stages(spark, sf_dir):
    """run() against the stages one after another, by the mix's tokens of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
    rows = lambda df: Counter((r.doc_id, tuple(r.token_ids)) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, sf_dir)) == rows(docs)
