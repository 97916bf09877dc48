"""A TOTAL row from a small per-group table, in the same pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOTAL = "TOTAL"  # fixed value: name of the summary row


def with_total(
    per_group: DataFrame,
    key: str,
    aggs: list[Column],
    keep: list[str] = (),
    flag: str = "is_total",
    within: list[str] = (),
) -> DataFrame:
    """GROUPING SETS over the per-group table: its rows again, plus one row over all of them (one
    for each value of the ``within`` columns).

    The rows were already aggregated once, so the expansion copies group rows, not corpus rows, and
    the corpus is scanned a single time. ``keep`` columns are carried for group rows only (in the
    TOTAL row they are null). ``flag`` is 1 for the TOTAL row.
    """
    is_total = F.grouping(key)
    carried = [F.when(is_total == 0, F.min(c)).alias(c) for c in keep]
    return (
        per_group.groupingSets([[*within, key], [*within]], *within, key)
        .agg(is_total.cast("int").alias(flag), *carried, *aggs)
        .withColumn(key, F.when(F.col(flag) == 1, F.lit(TOTAL)).otherwise(F.col(key)))
    )
