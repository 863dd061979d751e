"""The registered queries of this subpackage: thin callers that read a table and derive the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm import bpe, chat, lines, lm, minhash, mixing, repair, resampling, rules, search, sharding, substrings, winnow
from twinsift.llm.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_spec() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(_table(spark, sf_dir, "documents"), tokenizer_spec())


#: Tools of op2: their arguments with type and whether they are required.
TOOLS = {"ask": {"query": ("string", True), "words": ("integer", True)}, "note": {"query": ("string", True), "words": ("integer", False), "brief": ("boolean", False)}}


def chat_messages(turns: DataFrame) -> DataFrame:
    """Turns of users as calls and those of assistants as results of the turn before; the rest are messages.

    The table holds prose only, so identifiers, tools and arguments are derived from columns: a text of several
    lines gives its number of words as text, a fault wherever the tool asks for an integer, and every other pair of
    turns needs the call two turns on.
    """
    user, several = F.col("role") == "user", F.instr("text", "\n") > 0
    words = F.size(F.split("text", " "))
    head = F.concat(F.lit('{ "words" : '), F.when(several, F.concat(F.lit('"'), words, F.lit('"'))).otherwise(words.cast("string")))
    arguments = F.concat(head, F.lit(","), F.substr(F.to_json(F.struct(F.col("text").alias("query"))), F.lit(2)))
    kind = F.when(user, "call").when(F.col("role") == "assistant", "result").otherwise("message")
    name = F.when(F.length("text") < 200, "note").otherwise("ask")
    at = F.when(user, F.col("turn")).when(kind == "result", F.col("turn") - 1)
    needs = F.when(user & (F.col("turn").bitwiseAND(2) == 0), F.array((F.col("turn") + 2).cast("string")))
    return turns.select("conv_id", "turn", "role", "text", kind.alias("kind"), at.cast("string").alias("call_id"), F.when(user, name).alias("name"), F.when(user, arguments).alias("arguments"), needs.alias("after"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(chat_messages(_table(spark, sf_dir, "conversations")), TOOLS)


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(_table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight: 2 where labelled good, 0.5 where labelled bad."""
    of = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return of.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("weight"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = quality_weights(_table(spark, sf_dir, "labels"))
    return mixing.mix(_table(spark, sf_dir, "documents"), weights, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    out = substrings.remove_repeats(_table(spark, sf_dir, "documents"), 50, scratch)
    return scratch.finish(out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return scratch.finish(lm.score_documents(_table(spark, sf_dir, "documents"), scratch))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), 16)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_report(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("document.doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=10, n_buckets=10_000, longest=1, least_words=20, seed=2024)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(_table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_chat, op3_top_k, op4_mixing, op5_substrings, op6_lm, op7_near_duplicates, op8_sharding, op9_lines, op10_rules, op11_fingerprints, op12_resampling, op13_repair)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ROWS = "d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents)"
_LINES = f"{_ROWS}, s AS (SELECT rid, doc_id, string_split(t, chr(10)) AS s FROM d), l AS (SELECT rid, doc_id, i, s[i + 1] AS line FROM s, unnest(range(len(s))) x(i))"

#: SQL for the operators whose rows it can give.
ORACLE_SQL: dict[str, str] = {
    "op3_top_k": (
        "WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
        "p AS (SELECT q.rid AS q, v.rid, q.vec_id AS query_id, v.vec_id, list_inner_product(q.v, v.v)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.rid <> v.rid), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, rid) AS rank FROM p) SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20"
    ),
    "op7_near_duplicates": (
        f"WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents), "
        "g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM w), "
        "n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL), "
        "e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), "
        "r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, x.b FROM r JOIN both_ways x ON x.a = r.b), m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a) "
        "SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM documents d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"
    ),
    "op9_lines": (
        f"WITH {_LINES}, k AS (SELECT *, {_LOWER.format(f'trim(line, {_SPACES})')} AS key FROM l), f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10), j AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key) "
        "SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY rid, doc_id"
    ),
    "op10_rules": (
        f"WITH {_LINES}, u AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid), "
        f"w AS (SELECT rid, doc_id, t, {_WORDS.format('t')} AS w FROM d), p AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(w) - 3)) x(i) WHERE len(w) >= 6), "
        "c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM p), h AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM c, range(5) y(o) WHERE n > 1 GROUP BY rid), "
        "b AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines FROM w LEFT JOIN u USING (rid) LEFT JOIN h USING (rid)), "
        "v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b) SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * n_symbols <= 30 * n_words AND word_chars BETWEEN 2 * n_words AND 24 * n_words AND 100 * n_dup_lines <= 50 * n_lines AS kept FROM v"
    ),
}
