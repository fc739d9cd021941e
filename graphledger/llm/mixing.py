"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source's rate is the number of times each of its documents should stand in
the mixture on average. Each document draws its number of copies by inverting
the Poisson distribution with that mean at a uniform number hashed from a seed
and its doc_id, so the draw needs no state and repeats exactly. Copies are
exploded and shuffled globally by hash.

Rows: null sources are one source of their own. A null doc_id draws as the
word null. Rows with the same doc_id draw alike. A source without a weight
takes no part. All columns are carried; the copy's number is added on request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphledger.llm.common import width

#: Up to so many sources the table of rates goes to every executor; beyond, documents are joined to it in salted shares.
FEW_SOURCES = 4096
SALT = 64


def uniform(seed: int, key: Column) -> Column:
    """A number from 0 to 1 (excluded), from 52 bits of a digest."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: DataFrame | None, size: int | None) -> DataFrame:
    """For each source its Poisson distribution function as an array: source, cdf.

    Rates are weight / all weights * size / the source's documents; without
    weights all sources count alike, without size it is the input's number.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.withColumn("weight", F.lit(1.0))
    if weights is not None:
        w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight"))
        shares = counts.join(w, counts.source.eqNullSafe(w.w_source)).drop("w_source").where("weight > 0")
    total = shares.agg(F.sum("weight").alias("all_weights"))
    everything = counts.agg((F.lit(size) if size is not None else F.sum("n")).cast("double").alias("size"))
    rated = shares.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(everything)).select("source", (F.col("weight") / F.col("all_weights") * F.col("size") / F.col("n")).alias("rate"))
    # As far as 52 bits can tell; logarithms keep large rates finite.
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    terms = rated.select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    order = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_factorial = F.sum(F.ln(F.greatest("k", F.lit(1)).cast("double"))).over(order)
    terms = terms.withColumn("p", F.exp(F.col("k") * F.ln("rate") - F.col("rate") - log_factorial))
    terms = terms.withColumn("below", F.sum("p").over(order))
    return terms.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "below"))), lambda x: x["below"]).alias("cdf"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, size: int | None = None, seed: int = 17, with_copy: bool = False) -> DataFrame:
    """The mixture: every document as often as it drew, in a random order over all partitions.

    weights: source and weight. The result has the columns of docs, and copy
    (from 1) if asked for; with as many underscores behind it as the name needs
    to be new.
    """
    width_ = width(docs.sparkSession)
    # The user's columns travel in one struct, so that no name of theirs meets one of ours.
    fields = docs.columns
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("source"), F.xxhash64("text").alias("content"), F.struct(*docs.columns).alias("row"))
    table = rates(docs, weights, size).select(F.col("source").alias("r_source"), "cdf")
    if table.count() <= FEW_SOURCES:
        joined = rows.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("r_source")))
    else:
        spread = table.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"))
        joined = salted.join(spread, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("salt") == F.col("r_salt")))
    drawn = joined.withColumn("u", uniform(seed, F.col("id"))).withColumn("drawn", F.size(F.filter("cdf", lambda c: c < F.col("u"))))
    copies = drawn.where("drawn > 0").select("row", "id", "content", F.explode(F.sequence(F.lit(1), F.col("drawn"))).alias("nth"))
    dealt = copies.withColumn("place", F.xxhash64(F.lit(seed), "id", "nth", "content")).repartition(width_, "place").sortWithinPartitions("place")
    named = "copy"
    while named in {c.lower() for c in fields}:
        named += "_"
    return dealt.select(*(F.col("row").getField(c).alias(c) for c in fields), *([F.col("nth").alias(named)] if with_copy else []))
