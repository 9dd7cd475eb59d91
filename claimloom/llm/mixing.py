"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Every source gets a mean repetition rate; every document draws its number of copies from a Poisson distribution with
that mean by inverting the distribution at a number in [0, 1) hashed from the seed and the document.  Copies are dealt
out and ordered by a hash again, which is a global shuffle.  The result depends on the rows and the seed alone, never
on partitions, and a lost task gives the same rows again.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from .tables import cut_lineage

SEED = "mix-1"
#: Weights follow size ** TEMPERATURE: below 1, small sources are repeated and large ones thinned.
TEMPERATURE = 0.5
#: 52 bits of a hash as a number in [0, 1).
_BITS = 52


def unit_interval(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts, joined by ``|``."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, _BITS // 4), 16, 10).cast("bigint") / F.lit(float(1 << _BITS))


def poisson_steps(rate: Column) -> Column:
    """P(N <= k) for k = 0, 1, ... up to where the rest is below the resolution of the hash.

    Terms are built as logarithms, so that a large rate does not underflow.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    zero = F.struct(F.lit(0.0).alias("log_fact"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("steps"))

    def add(state: Column, k: Column) -> Column:
        log_fact = state["log_fact"] + F.log(k.cast("double"))
        return let(state["sum"] + F.exp(k * F.log(rate) - rate - log_fact), lambda total: F.struct(
            log_fact.alias("log_fact"), total.alias("sum"), F.concat(state["steps"], F.array(total)).alias("steps")))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), zero, add)["steps"]).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, *, temperature: float = TEMPERATURE,
                 epochs: float = 1.0) -> DataFrame:
    """One row per source: its size in characters, target weight and mean repetition rate.

    ``weights`` are the wanted shares of the output's characters (any positive scale; a source that is not named gets
    none); without them a source gets size ** ``temperature``.  The output has ``epochs`` times the characters of the
    input on average.  A source without characters is kept as it is (rate 1) unless ``weights`` leaves it out.
    """
    sizes = cut_lineage(docs.groupBy("source").agg(
        F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).alias("n_chars_total"), F.count(F.lit(1)).alias("n_docs")))
    if weights is None:
        want = F.pow(F.col("n_chars_total").cast("double"), F.lit(temperature))
    else:
        named = [F.when(F.col("source") == name, F.lit(float(w))) for name, w in sorted(weights.items())]
        want = F.coalesce(*named, F.lit(0.0)) if named else F.lit(0.0)
    sizes = sizes.withColumn("_want", want)
    # One row of two numbers; null where there is no row.
    total = sizes.agg(F.sum("n_chars_total"), F.sum(F.when(F.col("n_chars_total") > 0, F.col("_want")))).first()
    chars, wanted = total[0] or 0, total[1] or 0.0
    share = F.col("_want") / F.lit(wanted) if wanted > 0 else F.lit(0.0)
    rate = F.when(F.col("n_chars_total") > 0, F.lit(float(epochs)) * share * F.lit(float(chars)) / F.col("n_chars_total"))
    rate = F.coalesce(rate, F.lit(1.0) if weights is None else F.when(F.col("_want") > 0, 1.0).otherwise(0.0))
    return sizes.select("source", "n_docs", "n_chars_total", share.alias("weight"), rate.alias("rate"))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, *, seed: str = SEED, temperature: float = TEMPERATURE,
                epochs: float = 1.0) -> DataFrame:
    """Every document as often as its draw says, in a globally shuffled order.

    Adds ``copy`` (0, 1, ...) and ``mix_key`` (hash of seed, document and copy, the order inside a partition).  Other
    columns stay as they are; a column of either name in the input is replaced.  A null source is a source of its
    own.  The draw hashes the document's id, so that equal texts draw independently; without an id the text takes its
    place.  Repeated rows with one id draw the same number.  A null or empty text is a row like any other.
    """
    docs = docs.drop("copy", "mix_key", "_source", "_steps")
    # Written once, so that Spark sees its size: a small table is broadcast, a large one is joined by shuffle, where
    # a hot source's partitions can be split.
    rates = cut_lineage(source_rates(docs, weights, temperature=temperature, epochs=epochs).select(
        F.col("source").alias("_source"), poisson_steps(F.col("rate")).alias("_steps")))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.col("text")), F.lit("none"))
    drawn = docs.join(rates, F.col("source").eqNullSafe(F.col("_source")))
    count = let(unit_interval(F.lit(seed), key), lambda u: F.size(F.filter("_steps", lambda step: step <= u)))
    copies = drawn.withColumn("_n", count).drop("_source", "_steps").filter("_n > 0")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    shuffled = copies.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), key, F.col("copy").cast("string")).cast("binary")))
    # Without a number of partitions, adaptive execution sizes them by what is there.
    return shuffled.repartition("mix_key").sortWithinPartitions("mix_key")
