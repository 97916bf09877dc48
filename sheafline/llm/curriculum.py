"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over the training time 0..1. The integral of the schedule says
how much of the source's target has been asked for at a time; inverting it gives each document the
time at which the source's stream reaches it, and a range sort by that time is the training order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.llm.words import free_name, n_words, order_hash
from sheafline.session import materialize

#: (time, weight) knots from time 0 to 1, straight lines between them.
Schedule = Sequence[tuple[float, float]]

WEIGHTS = (5, 2, 1)
#: One per weight: heavy sources come early, light ones late, the middle ones peak half-way.
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 1.4), (1.0, 0.6)),
    ((0.0, 0.8), (0.5, 1.2), (1.0, 0.8)),
    ((0.0, 0.6), (1.0, 1.4)),
)
#: Hash ranges per source; at 10**10 documents a range of the largest source sorts about 10**6 rows.
RANGES_BITS = 12


def integral(knots: Schedule) -> list[float]:
    """The schedule's integral from time 0 to each knot."""
    if [knots[0][0], knots[-1][0]] != [0.0, 1.0] or any(w <= 0 for _, w in knots):
        raise ValueError("a schedule runs from time 0 to 1 with positive weights")
    areas = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        if t1 <= t0:
            raise ValueError("the times of a schedule rise")
        areas.append(areas[-1] + (t1 - t0) * (w0 + w1) / 2)
    return areas


def time_of(share: Column, knots: Schedule) -> Column:
    """The time at which ``share`` (0..1) of the schedule's integral is reached."""
    areas = integral(knots)
    asked = share * F.lit(areas[-1])
    out = None
    for (t0, w0), (t1, w1), a0 in reversed(list(zip(knots, knots[1:], areas))):
        slope, left = (w1 - w0) / (t1 - t0), asked - F.lit(a0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * left, F.lit(0.0)))
        here = F.lit(t0) + F.lit(2.0) * left / (F.lit(w0) + root)
        out = here if out is None else F.when(asked >= F.lit(upper), out).otherwise(here)
        upper = a0
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most_repeats: float) -> DataFrame:
    """source, source_size -> also weight_class and target.

    Sources in code-point order, null last, take the weights in turn. Targets are proportional to
    the weights, but none is above ``most_repeats`` times its source; the excess goes to the others
    by weight. With the sources ordered by cap / weight, the common level is the largest of
    (total - caps so far) / (weights left). One row per source: a single small window.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    each = (
        sizes.withColumn("turn", turn)
        .withColumn("weight_class", F.col("turn") % F.lit(len(weights)))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("weight_class") + 1).cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(most_repeats)))
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    left = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(so_far), F.lit(0.0))) / F.sum("weight").over(left)
    return (
        each.withColumn("level", level)
        .withColumn("target", F.least(F.max("level").over(every) * F.col("weight"), F.col("cap")))
        .select("source", "source_size", "weight_class", "target")
    )


def mix(
    documents: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.5,
    most_repeats: float = 2.0,
    schedules: Sequence[Schedule] = SCHEDULES,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, positions: one row per document row.

    ``size`` is the number of words (null text: 0). ``taken`` is how many words of the document the
    mix takes, repeats counted: whole passes over the source, then documents in the order of their
    id's hash until the target is met, the last one in part, so a source's sum is its target rounded
    to a word. ``positions`` are the training times of the passes that take the document, rising,
    empty if none does; an empty document is taken by whole passes only. Rows with equal ids and
    sizes are interchangeable. Null ids and sources are allowed. The result is range-sorted by the
    first position. Other columns are not read.
    """
    return _planned(documents, weights, share, most_repeats, schedules).drop("text_key")


def _planned(
    documents: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.5,
    most_repeats: float = 2.0,
    schedules: Sequence[Schedule] = SCHEDULES,
) -> DataFrame:
    """:func:`mix` with a hash of the row's text, ``text_key``."""
    if len(schedules) != len(weights):
        raise ValueError("one schedule per weight is needed")
    docs = materialize(
        documents.select("doc_id", "source", F.xxhash64("text").alias("text_key"), n_words(F.col("text")).alias("size"))
        .withColumn("hash", order_hash(F.col("doc_id")))
        .withColumn("range", F.shiftright("hash", 60 - RANGES_BITS))
    )
    ranges = docs.groupBy("source", "range").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(ranges.withColumn("range_start", F.coalesce(F.sum("words").over(running), F.lit(0))))
    targets = materialize(
        source_targets(starts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most_repeats)
        .withColumn("words_wanted", F.round("target").cast("long"))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.expr("words_wanted div source_size")).otherwise(0))
        .withColumn("rest", F.col("words_wanted") - F.col("passes") * F.col("source_size"))
    )
    within = (
        Window.partitionBy("source", "range")
        .orderBy("hash", "doc_id", "size", "text_key")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    s, t = starts.drop("words").alias("s"), targets.alias("t")
    placed = (
        docs.withColumn("earlier", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .alias("d")
        .join(s, F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.range") == F.col("s.range")))
        .join(t, F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("d.doc_id", "d.source", "d.text_key", "d.size", "t.*", (F.col("range_start") + F.col("earlier")).alias("start"))
        .drop(F.col("t.source"))
    )
    partly = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("start")))
    last = F.when(partly > 0, F.array(F.col("passes"))).otherwise(F.array().cast("array<bigint>"))
    whole = F.when(F.col("passes") > 0, F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)).otherwise(
        F.array().cast("array<bigint>")
    )

    def time(number: Column) -> Column:
        asked = (number * F.col("source_size") + F.col("start")) / F.greatest(F.col("words_wanted"), F.lit(1))
        out = time_of(asked, schedules[-1])
        for k, knots in enumerate(schedules[:-1]):
            out = F.when(F.col("weight_class") == k, time_of(asked, knots)).otherwise(out)
        return out

    out = placed.withColumn("taken", F.col("passes") * F.col("size") + partly).withColumn(
        "positions", F.transform(F.concat(whole, last), time)
    )
    return (
        out.select("doc_id", "source", "text_key", "size", "source_size", "target", "taken", "positions")
        .withColumn("first", F.get("positions", F.lit(0)))
        .repartitionByRange(F.col("first").asc_nulls_last(), "doc_id")
        .sortWithinPartitions(F.col("first").asc_nulls_last(), "doc_id")
        .drop("first")
    )


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The training stream: all columns of ``documents``, in the order of the training time.

    A document appears once per pass that takes it; a pass that takes a part of it (one per source)
    counts if it takes half of the words or more. Documents that no pass takes are left out. Rows
    are matched by id, source and a hash of the text (nulls included); rows that repeat all three
    follow the plan of the first of them. The names of other columns do not matter; an empty table
    gives an empty stream.
    """
    names = {c: free_name(f"_mixed_{c}", documents.columns) for c in ("doc_id", "source", "text_key", "position")}
    keys = ("doc_id", "source", "text_key")
    plan = _planned(documents, **options).groupBy(*keys).agg(F.min(F.struct("positions", "taken", "size")).alias("p"))
    plan = plan.select(*keys, "p.*")
    copies = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + F.lit(0.5)).cast("int")
    copies = F.when(F.col("size") == 0, F.size("positions")).otherwise(copies)
    plan = plan.select(
        *(F.col(c).alias(names[c]) for c in keys), F.explode(F.slice("positions", F.lit(1), copies)).alias(names["position"])
    )
    same = F.col("doc_id").eqNullSafe(F.col(names["doc_id"])) & F.col("source").eqNullSafe(F.col(names["source"]))
    same = same & (F.xxhash64("text") == F.col(names["text_key"]))
    return (
        documents.join(plan, same)
        .repartitionByRange(names["position"], "doc_id")
        .sortWithinPartitions(names["position"], "doc_id")
        .drop(*names.values())
    )
