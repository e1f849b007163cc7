"""Mixing sources to target weights, in native expressions.

Word counts are added up by source. A source's target is its weight's part of the mix,
but no more than `most` times its size; the excess goes to the others by weight. What
a source's target is to its size is its rate of repetition: each document is taken
floor(rate) times, and once more with the remaining fraction as probability, drawn from
a hash of its id, so that reruns agree.

The targets are those of water filling: sources in the order of size by weight fill up
first, so running sums over them (ranges plus offsets, see `ordinals.running`) say which
are full, without rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, durable, join_each, release
from .ordinals import running

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
MADE = ["size", "source_size", "target", "rate", "copies"]

#: Bytes of sources and their rates that are broadcast at most.
SMALL = 16 << 20


def targets(sources: DataFrame, weights: Sequence[float] | DataFrame = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, source_size, ...) with weight and target, a double.

    weights: numbers that sources get in turn, by code point, null last; or a table
    (source, weight) with a row for each, where sources that it lacks weigh nothing and
    get nothing. Targets add up to `share` times all sizes, or to less where all
    sources that weigh something are full.
    """
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("__named"), F.col("weight").cast("double").alias("weight"))
        weighed = sources.join(given, F.col("source").eqNullSafe(F.col("__named")), "left").drop("__named").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    else:
        placed = running(sources, [F.col("source").isNull(), F.col("source")], {"__place": F.lit(1)})
        turn = (F.col("__place") % len(weights) + 1).cast("int")
        weighed = placed.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)).drop("__place")
    weighed = weighed.withColumn("__full", F.col("source_size") * F.lit(float(most)))
    size, weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    whole, weight = float(share) * (size or 0), float(weight or 0)
    order = [F.try_divide("__full", "weight").asc_nulls_last(), F.col("source").isNull(), F.col("source")]
    filled = running(weighed, order, {"__before": F.col("__full"), "__lighter": F.col("weight")})
    full = (F.col("weight") > 0) & (F.col("__full") * (weight - F.col("__lighter")) <= F.col("weight") * (whole - F.col("__before")))
    filled = durable(filled.withColumn("__is_full", full))
    left, open_weight = filled.agg(F.sum(F.when(F.col("__is_full"), F.col("__full"))), F.sum(F.when(~F.col("__is_full"), F.col("weight")))).first()
    left = whole - (left or 0.0)
    part = F.col("weight") * F.lit(left) / F.lit(open_weight or 1.0)
    return filled.withColumn("target", F.when(F.col("__is_full"), F.col("__full")).otherwise(part)).drop("__full", "__before", "__lighter", "__is_full")


def draw(id_col: str, seed: str):
    """A number in [0, 1) from the id's text: 52 bits of an MD5 sum. Null is empty text."""
    text = F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def plan(docs: DataFrame, weights: Sequence[float] | DataFrame = WEIGHTS, share: float = 1.5, most: float = 2.0, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", keep=None, seed: str = "mix:") -> DataFrame:
    """One row for each document: the carried columns, size (words), source_size, target
    (its source's), rate and copies, how often the mix takes it.

    Null and empty texts have no words; null is a source of its own. A source without
    words has the rate 0. Rows of one id, repeated ones too, draw alike, and null ids
    draw like the empty text. Columns of docs named like the results are replaced. No
    documents, no rows.
    """
    names = carried(docs, keep, MADE)
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"keep_{c}") for c in names], F.col(source_col).cast("string").alias("source"), draw(id_col, seed).alias("u"), size.alias("size"))
    if text_col not in names:  # narrow rows are written, so that texts are read once
        rows = durable(rows)
    sources = durable(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    aimed = durable(targets(sources, weights, share, most))
    n_bytes, total = aimed.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64), F.sum("n")).first()
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))
    rate = F.least(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)), F.lit(float(most)))
    rates = aimed.select(key.alias("key"), "source_size", "target", rate.alias("rate"), "n")
    keyed = rows.withColumn("key", key).drop("source")
    if (n_bytes or 0) <= SMALL:
        met = keyed.join(F.broadcast(rates.drop("n")), "key")
    else:
        met = join_each(keyed, rates, "key", "n", total)
    release(sources)
    copies = (F.floor("rate") + F.when(F.col("u") < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return met.select(*[F.col(f"`keep_{c}`").alias(c) for c in names], "size", "source_size", "target", "rate", copies.alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float] | DataFrame = WEIGHTS, share: float = 1.5, most: float = 2.0, copy_col: str = "copy", **columns) -> DataFrame:
    """The mix itself: each document as often as `plan` takes it, with the number of the
    copy from 1 in copy_col, which replaces a column of that name."""
    found = plan(docs, weights, share, most, **columns).where("copies > 0")
    kept = [c for c in found.columns if c not in MADE and c.lower() != copy_col.lower()]
    return found.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(copy_col))
