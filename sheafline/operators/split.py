"""Reproducible train/test splits that never shuffle the texts.

Every split is "the first k rows of a seeded order within a group". The position is not computed for
all rows: ``rank_cutoffs`` finds the key at each wanted rank from the narrow columns, and the wide
rows are then compared with their group's keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.operators.ranking import pivot_cutoffs, rank_cutoffs, row_key
from sheafline.session import materialize


def split_quota(df: DataFrame, sheet: str = "sheet", label: str = "label") -> DataFrame:
    """Per sheet: class sizes, ``half`` of the smaller class, and rows that fit in neither split."""
    counts = df.groupBy(sheet).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(label) == 1).alias("positive"),
        F.count_if(F.col(label) == 0).alias("negative"),
    )
    half = F.expr("least(positive, negative) div 2")
    return counts.withColumn("half", half).withColumn("dropped", F.col("rows") - 4 * half)


def _at_most(key: str, row_id: str, seed: int) -> Column:
    return F.coalesce(row_key(row_id, seed) <= F.col(key), F.lit(False))


def balanced_split(
    df: DataFrame,
    row_id: str,
    sheet: str = "sheet",
    label: str = "label",
    seed: int = 42,
    narrow: DataFrame | None = None,
) -> DataFrame:
    """``split`` = train, test or dropped: both splits get ``half`` positives and ``half`` negatives
    of every sheet.

    ``narrow`` may give the same rows with only id, sheet and label when those are cheaper to read
    than through ``df``.
    """
    narrow = df if narrow is None else narrow
    narrow = narrow.select(row_id, sheet, label)
    quota = split_quota(narrow, sheet, label).filter(F.col("half") > 0)
    targets = quota.select(
        sheet,
        F.explode(F.array(F.lit(0), F.lit(1))).alias(label),
        F.explode(F.expr("map('train', half, 'test', 2 * half)")).alias("cut", "rank"),
    )
    rows = narrow.filter(F.col(label).isin(0, 1)).withColumn(label, F.col(label).cast("int"))
    cuts = rank_cutoffs(rows, [sheet, label], row_id, targets, seed)
    keys = materialize(pivot_cutoffs(cuts, [sheet, label], ["train", "test"]))
    keys = keys.select(
        F.col(sheet).alias("_s"), F.col(label).alias("_l"), F.col("train").alias("_train"), F.col("test").alias("_test")
    )
    marked = df.join(keys, df[sheet].eqNullSafe(F.col("_s")) & (df[label] == F.col("_l")), "left")
    split = (
        F.when(_at_most("_train", row_id, seed), F.lit("train"))
        .when(_at_most("_test", row_id, seed), F.lit("test"))
        .otherwise(F.lit("dropped"))
    )
    return marked.withColumn("split", split).drop("_s", "_l", "_train", "_test")


def holdout_split(
    df: DataFrame,
    row_id: str,
    sheet: str = "sheet",
    percent: int = 20,
    seed: int = 42,
    names: tuple[str, str] = ("train", "validation"),
    narrow: DataFrame | None = None,
) -> DataFrame:
    """Per sheet, ``ceil(percent %)`` of the rows are held out; not stratified by label."""
    narrow = df if narrow is None else narrow
    narrow = narrow.select(row_id, sheet)
    held = F.expr(f"(count(1) * {percent} + 99) div 100")
    targets = narrow.groupBy(sheet).agg(held.alias("rank")).withColumn("cut", F.lit("held"))
    keys = materialize(pivot_cutoffs(rank_cutoffs(narrow, [sheet], row_id, targets, seed), [sheet], ["held"]))
    keys = keys.select(F.col(sheet).alias("_s"), F.col("held").alias("_held"))
    marked = df.join(keys, df[sheet].eqNullSafe(F.col("_s")), "left")
    split = F.when(_at_most("_held", row_id, seed), F.lit(names[1])).otherwise(F.lit(names[0]))
    return marked.withColumn("split", split).drop("_s", "_held")


def learning_subsets(
    df: DataFrame,
    row_id: str,
    percents: tuple[int, ...] = (10, 20, 30, 40, 50, 60, 70, 80, 90, 100),
    seed: int = 42,
) -> DataFrame:
    """Adds ``from_percent``: the smallest training share a row belongs to; the subsets are nested.

    The share ``p`` is the ``floor(p % of n)`` first rows of the seeded order, all rows at 100.
    """
    ids = df.select(row_id)
    total = ids.count()
    wanted = [(str(p), total * p // 100) for p in percents if p < 100]
    spark = df.sparkSession
    targets = spark.createDataFrame([w for w in wanted if w[1] > 0], "cut string, rank long")
    keys = {r["cut"]: r["key"] for r in rank_cutoffs(ids, [], row_id, targets, seed).collect()}  # one per share
    share = F.lit(None).cast("int")
    id_type = df.schema[row_id].dataType
    for p, rank in reversed(wanted):
        if rank > 0:
            key = keys[p]
            bound = F.struct(F.lit(key["h"]).alias("h"), F.lit(key["id"]).cast(id_type).alias("id"))
            share = F.when(row_key(row_id, seed) <= bound, F.lit(int(p))).otherwise(share)
    return df.withColumn("from_percent", F.coalesce(share, F.lit(100)))


def split_complement(df: DataFrame, chosen: DataFrame, row_id: str) -> DataFrame:
    """Rows that are in no split."""
    return df.join(chosen.select(row_id), row_id, "left_anti")
