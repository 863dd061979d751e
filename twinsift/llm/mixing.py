"""Mixing sources to target weights by weighted sampling without replacement; DataFrame operations only.

Each document draws an Efraimidis-Spirakis key, an exponential variate divided by its quality weight. A source's
budget of words is spent on complete epochs first; the rest goes to its documents in the order of their keys until
the budget ends, inside a document at most once per source. The order of a source is never gathered: keys fall into
small bins whose sums are prefix-summed in two levels, and only the rows of a bin are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.llm.scratch import Scratch, numbered

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a bin of keys holds on average.
BIN_ROWS = 256
#: Up to so many sources are broadcast to the documents; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def exponential(seed: int) -> Column:
    """-ln(u); u depends on the row's id, text and the seed alone, so reruns agree."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u)


def targets(scratch: Scratch, sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> tuple[DataFrame, int]:
    """A target for each row (source, n, source_size): ``share`` of all sizes by weight, at most ``most`` times its size.

    Weights repeat over the sources in code point order, null last. What sources can't take is shared again among
    the others, until none is above its limit: the level at which this ends is found from sums, one round per
    further group of sources that reach their limit.
    """
    ranked = numbered(scratch, sizes, F.col("source").asc_nulls_last())
    n = ranked.count()
    weight = F.lit(float(weights[-1]))
    for k, w in enumerate(weights[:-1]):
        weight = F.when(F.col("row") % len(weights) == k, F.lit(float(w))).otherwise(weight)
    ranked = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:
        full = F.col("limit") <= F.lit(level) * F.col("weight")
        spent, left = ranked.agg(F.sum(F.when(full, F.col("limit")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        reached = (share * total - spent) / left if left else level
        if reached <= level:
            break
        level = reached
    return ranked.withColumn("target", F.least("limit", F.lit(level) * F.col("weight"))).drop("weight", "limit"), n


def mix(documents: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 17, scratch: Scratch | None = None, row: str | None = None) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, key, and ``row``, a column that tells rows apart, if it is given.

    ``taken`` counts the words that the mix takes of it, repeats included. ``quality`` (doc_id, weight; each id once)
    gives positive weights; ids that it lacks, and all without it, weigh 1. Key bins are even where weights stay within
    a few powers of two. Texts are reduced to their sizes before weights are joined, so no text is moved. Null texts
    have size 0 and nothing is taken of them; null sources are one source, the last. Repeated rows are documents of
    their own. An empty table gives no rows.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark)
    own = [F.col(row).alias("_row")] if row else []
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), *own)
    own = ["_row"] if row else []
    rows = narrow.select(*own, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), exponential(seed).alias("drawn"))
    weight = F.lit(1.0)
    if quality is not None:
        rows = rows.join(quality.select(F.col("doc_id").alias("_id"), F.col("weight").cast("double").alias("_weight")), F.col("doc_id") == F.col("_id"), "left")
        weight = F.coalesce("_weight", F.lit(1.0))
    rows = scratch.write(rows.select(*own, "doc_id", "source", "size", (F.col("drawn") / weight).alias("key")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    aims, n_sources = targets(scratch, sizes, weights, share, most)
    budget = F.round("target").cast("long")
    bins = F.ceil(F.sqrt(F.ceil(F.col("n") / BIN_ROWS)))
    aims = scratch.write(
        aims.select(
            F.col("source").alias("of"),
            F.col("row").alias("source_no"),
            "source_size",
            "target",
            F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
            bins.cast("double").alias("bins"),
        ).withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
    )
    if n_sources <= BROADCAST_SOURCES:
        aims = F.broadcast(aims)
    at = (1 - F.exp(-F.col("key"))) * F.col("bins")
    coarse = F.least(F.floor(at), F.col("bins") - 1)
    keyed = (
        rows.join(aims, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("coarse", coarse.cast("long"))
        .withColumn("fine", F.least(F.floor((at - F.col("coarse")) * F.col("bins")), F.col("bins") - 1).cast("long"))
    )
    sums = keyed.groupBy("source_no", "coarse", "fine").agg(F.sum("size").alias("words"))
    sums = scratch.write(sums)
    upto = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    coarse_sums = sums.groupBy("source_no", "coarse").agg(F.sum("words").alias("words"))
    coarse_sums = coarse_sums.select("source_no", "coarse", F.coalesce(F.sum("words").over(upto("source_no", "coarse")), F.lit(0)).alias("coarse_before"))
    fine_sums = sums.select("source_no", "coarse", "fine", F.coalesce(F.sum("words").over(upto("source_no", "coarse", "fine")), F.lit(0)).alias("fine_before"))
    before = fine_sums.join(coarse_sums, ["source_no", "coarse"])
    inside = Window.partitionBy("source_no", "coarse", "fine").orderBy("key", "doc_id", *own).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.col("coarse_before") + F.col("fine_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - spent))
    return keyed.join(before, ["source_no", "coarse", "fine"]).select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "key", *[F.col(c).alias(row) for c in own])


def take(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mixed corpus: a row per copy, each with all columns of ``documents``, the cut copy with its first words only.

    Documents are matched by id; rows that share an id share the number of copies of the first of them.
    """
    taken = mixed.groupBy("doc_id").agg(F.max(F.struct("taken", "size")).alias("t")).select(F.col("doc_id").alias("row"), "t.taken", "t.size")
    # the documents' columns travel in a struct, where their names can't meet these
    return take_rows(documents.select(F.struct("*").alias("_d"), F.col("doc_id").cast("long").alias("_own")), taken)


def take_rows(held: DataFrame, mixed: DataFrame) -> DataFrame:
    """The same for rows ``_d`` (a struct of all columns) with their own key ``_own``, of which ``mixed`` has row, taken and size."""
    taken = mixed.select(F.col("row").alias("_id"), F.col("taken").alias("_taken"), F.col("size").alias("_size"))
    joined = held.join(taken, F.col("_own").eqNullSafe(F.col("_id"))).where("_taken > 0")
    whole = F.floor(F.col("_taken") / F.col("_size")).cast("int")
    cut = (F.col("_taken") % F.col("_size")).cast("int")
    copies = joined.select("_d", F.explode(F.concat(F.array_repeat(F.lit(0), whole), F.when(cut > 0, F.array(cut)).otherwise(F.array().cast("array<int>")))).alias("_cut"))
    parts = F.split("_d.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # a word with the white space before it
    text = F.when(F.col("_cut") == 0, F.col("_d.text")).otherwise(F.array_join(F.slice(parts, 1, F.greatest(F.col("_cut"), F.lit(1))), ""))
    return copies.select(*[text.alias("text") if c == "text" else F.col(f"_d.`{c}`") for c in held.schema["_d"].dataType.names])
