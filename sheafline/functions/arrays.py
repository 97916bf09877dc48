"""Array expressions for token rows and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED_LABEL = -100  # fixed value: a label position that no metric counts


def fill_like(ids: Column, value: int) -> Column:
    """An array of ``value`` as long as ``ids``."""
    return F.array_repeat(F.lit(value), F.size(ids))


def truncate(ids: Column, limit: int) -> Column:
    return F.slice(ids, 1, limit)


def left_pad(ids: Column, width: Column, pad: int) -> Column:
    """``ids`` padded on the left to ``width``."""
    return F.concat(F.array_repeat(F.lit(pad), width - F.size(ids)), ids)


def left_pad_mask(ids: Column, width: Column) -> Column:
    """0 for padding, 1 for ids."""
    return F.concat(F.array_repeat(F.lit(0), width - F.size(ids)), fill_like(ids, 1))


def shifted_hits(preds: Column, labels: Column) -> Column:
    """``struct(correct, counted)``: prediction *i* against label *i+1*, ignored labels left out."""
    n = F.size(labels)
    ahead = F.slice(labels, 2, F.greatest(n - 1, F.lit(0)))
    behind = F.slice(preds, 1, F.greatest(F.size(preds) - 1, F.lit(0)))
    pairs = F.filter(F.arrays_zip(behind.alias("p"), ahead.alias("l")), lambda x: x["l"] != IGNORED_LABEL)
    return F.struct(
        F.size(F.filter(pairs, lambda x: x["p"] == x["l"])).cast("long").alias("correct"),
        F.size(pairs).cast("long").alias("counted"),
    )
