"""Row budgets and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafline.session import materialize


def sheet_quotas(
    sheets: DataFrame, max_per_sheet: int | None, max_total: int | None, count: str = "rows"
) -> DataFrame:
    """How many rows of each sheet are processed.

    ``sheets`` has ``sheet, sheet_ord, rows`` and optionally ``failed``. Budget is used up in sheet
    order; a failed sheet uses none. ``reached`` is false for sheets after exhaustion: they are
    absent from the output. 0 or None means unlimited. Only this one-row-per-sheet table meets a
    window without partitions.
    """
    if any(limit is not None and limit < 0 for limit in (max_per_sheet, max_total)):
        raise ValueError("limits are not negative")
    size = F.col(count)
    if "failed" in sheets.columns:
        size = F.when(F.col("failed"), F.lit(0)).otherwise(size)
    capped = F.least(size, F.lit(max_per_sheet)) if max_per_sheet else size
    table = sheets.withColumn("_c", capped.cast("long"))
    earlier = Window.orderBy("sheet_ord", "sheet").rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("used_before", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
    if max_total:
        left = F.lit(max_total) - F.col("used_before")
        quota, reached = F.greatest(F.lit(0), F.least(F.col("_c"), left)), left > 0
    else:
        quota, reached = F.col("_c"), F.lit(True)
    return table.withColumn("quota", quota.cast("long")).withColumn("reached", reached).drop("_c")


def sheet_table(df: DataFrame, sheet: str = "sheet") -> DataFrame:
    """One row per sheet: ``sheet, sheet_ord, rows``."""
    return df.groupBy(sheet, "sheet_ord").agg(F.count(F.lit(1)).alias("rows"))


def row_budget(
    df: DataFrame,
    max_per_sheet: int | None = None,
    max_total: int | None = None,
    sheets: DataFrame | None = None,
) -> DataFrame:
    """Rows of the sheets that were reached, with ``in_budget``; later rows of a sheet stay, unscored.

    ``sheets`` may be given where the sizes are known (ingest metadata); otherwise one narrow count.
    The quota table is written first, so that Spark joins it by its true size: broadcast while small
    (the rows are not shuffled), and when it is not, AQE splits the partition of a hot sheet.
    """
    sheets = sheet_table(df) if sheets is None else sheets
    quotas = sheet_quotas(sheets, max_per_sheet, max_total).filter("reached").select("sheet", "quota")
    quotas = materialize(quotas)
    return df.join(quotas, "sheet").withColumn("in_budget", F.col("row_idx") < F.col("quota")).drop("quota")


def with_batch(df: DataFrame, size: int = 10) -> DataFrame:
    """Batch number of each row within its sheet."""
    return df.withColumn("batch_no", F.floor(F.col("row_idx") / F.lit(size)).cast("long"))


def batches_per_sheet(sheets: DataFrame, size: int = 10, count: str = "rows") -> DataFrame:
    """Number of batches per sheet."""
    return sheets.withColumn("batches", F.ceil(F.col(count) / F.lit(size)).cast("long"))
