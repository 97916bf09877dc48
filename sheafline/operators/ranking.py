"""Exact ranks and row numbers without sorting a whole group in one task.

A window over ``partitionBy(sheet)`` puts a whole sheet into one task, and one sheet may hold a third
of all rows. Positions come from two passes over range partitions (``prefix_positions``); the keys at given
ranks from hash buckets that follow the seeded order, of which only the wanted ones are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.session import materialize

HASH_DIGITS = 3  # 16**3 hash buckets per group
ROWS_PER_TASK = 500_000  # rows that one task of ``prefix_positions`` sorts, about


def seeded_hash(row_id: str | Column, seed: int = 42) -> Column:
    """Uniform sort key of a row; any engine with md5 reproduces the same order."""
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))


def _offsets(df: DataFrame, group: list[str], bucket: list[str], before: str, size: str) -> DataFrame:
    """Bucket sizes and the number of rows of the same group in earlier buckets."""
    window = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*group, *bucket).agg(F.count(F.lit(1)).alias(size))
    return counts.withColumn(before, F.coalesce(F.sum(size).over(window), F.lit(0)))


def _ranges(df: DataFrame, group: list[str], order: list[str | Column], rows_per_task: int) -> DataFrame:
    """The rows with ``_range`` and ``_row``, sorted in ranges of (group, order), as files.

    The number of ranges follows the row count; a retried task finds the same ranges. A row count
    runs first: where counting ``df`` is dear, materialize it before.
    """
    tasks = max(1, -(-df.count() // rows_per_task))
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    return materialize(ranged.withColumn("_row", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_row", 33))


def _earlier(group: list[str]) -> Window:
    return Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def prefix_positions(
    df: DataFrame, group: list[str], order: list[str | Column], name: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Dense positions from 0 per group in a total order, by two passes over range partitions.

    The rows are sorted inside ranges of ``(group, order)``; every (range, group) piece knows its
    length, and a running sum over the pieces, one small row each, gives the position of a piece's
    first row. No task sorts more than one range, whatever share of the rows a group holds. ``order``
    entries are column names or sort expressions; rows that tie in all of them get their positions in
    the order the range holds them. Null groups are a group. Every column of ``df`` travels, so
    callers pass keys, not texts.
    """
    placed = _ranges(df, group, order, rows_per_task)
    pieces = placed.groupBy(*group, "_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    offset = F.coalesce(F.sum("_n").over(_earlier(group)), F.lit(0)) - F.col("_first")
    pieces = materialize(pieces.select(*group, "_range", offset.alias("_offset")))
    return _null_safe(placed, pieces, [*group, "_range"]).withColumn(name, F.col("_row") + F.col("_offset")).drop(
        "_row", "_range", "_offset"
    )


def prefix_sums(
    df: DataFrame, group: list[str], order: list[str | Column], value: str, name: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Running sum of a column per group in a total order: a segmented parallel scan.

    Ranges as in ``prefix_positions``: the sums of the (range, group) pieces are scanned, one small
    row each, and every piece is then scanned by itself from what came before it. Null values add
    nothing; before the first value the sum is null, as in SQL.
    """
    placed = _ranges(df, group, order, rows_per_task)
    pieces = placed.groupBy(*group, "_range").agg(F.sum(value).alias("_sum"))
    pieces = materialize(pieces.select(*group, "_range", F.sum("_sum").over(_earlier(group)).alias("_before")))
    inside = Window.partitionBy(*group, "_range").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    joined = _null_safe(placed, pieces, [*group, "_range"]).withColumn("_here", F.sum(value).over(inside))
    total = F.coalesce(F.col("_before") + F.col("_here"), F.col("_here"), F.col("_before"))
    return joined.withColumn(name, total).drop("_row", "_range", "_before", "_here")


def with_row_number(df: DataFrame, group: list[str], order: str, name: str, start: int = 0, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Dense row number per group in the order of a unique column; see ``prefix_positions``."""
    placed = prefix_positions(df, group, [order], name, rows_per_task)
    return placed.withColumn(name, (F.col(name) + F.lit(start)).cast("long"))


def rank_cutoffs(
    df: DataFrame,
    group: list[str],
    row_id: str,
    targets: DataFrame,
    seed: int = 42,
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """The sort key found at given ranks of the seeded order of each group.

    ``targets`` has ``group`` columns, ``cut`` (a name) and ``rank`` (1-based). Returns ``group, cut,
    key`` with ``key = struct(hash, id)``; ranks outside the group are absent. A row of the group is
    among the first ``rank`` rows exactly when its own ``row_key`` is ``<= key``, so callers mark wide
    rows against this small table and never shuffle or sort them. Only the one bucket per target that
    contains the wanted rank is shuffled and sorted. Runs a narrow job: the wanted buckets are
    written first, so that Spark joins them by their true size.
    """
    keyed = df.select(*group, row_key(row_id, seed).alias("key"))
    narrow = keyed.withColumn("_bucket", F.substring(F.col("key.h"), 1, digits))
    if not group:  # one group: a constant key, so that the target join stays an equi-join
        group = ["_all"]
        narrow, targets = narrow.withColumn("_all", F.lit(0)), targets.withColumn("_all", F.lit(0))
    offsets = _offsets(narrow, group, ["_bucket"], "_before", "_size")
    wanted = _null_safe(offsets, targets, group).filter(
        (F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("_size"))
    )
    wanted = materialize(wanted.select(*group, "_bucket", "cut", (F.col("rank") - F.col("_before")).alias("_need")))
    window = Window.partitionBy(*group, "_bucket", "cut").orderBy("key")
    found = _null_safe(narrow, wanted, [*group, "_bucket"]).withColumn("_at", F.row_number().over(window))
    return found.filter(F.col("_at") == F.col("_need")).select(*group, "cut", "key")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` in which null equals null; the keys come from the left."""
    renamed = right.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, same).drop(*(f"_r_{c}" for c in keys))


def row_key(row_id: str, seed: int = 42) -> Column:
    """Total order of rows: seeded hash, then id."""
    return F.struct(seeded_hash(row_id, seed).alias("h"), F.col(row_id).alias("id"))


def pivot_cutoffs(cutoffs: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    """One row per group with one key column per cut name."""
    columns = [F.max(F.when(F.col("cut") == n, F.col("key"))).alias(n) for n in names]
    return cutoffs.groupBy(*group).agg(*columns)
