"""Writers. Corpora are partitioned by sheet; only small report tables become single files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.operators.embedding import to_wide
from sheafline.operators.metrics import COUNTS, RATES
from sheafline.operators.regression import REPORT_COLUMNS

METRICS_HEADER = ["sheet_name", *COUNTS, *RATES]


def write_scored(scored: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """All original columns with ``ai_label, ai_reply``.

    No repartitioning by sheet: a hot sheet keeps its many writers, each task adds files to the
    folders of the sheets it holds.
    """
    scored.write.mode(mode).partitionBy("sheet").parquet(path)


def write_splits(marked: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Train and test rows, same layout per split."""
    marked.filter(F.col("split") != "dropped").write.mode(mode).partitionBy("split", "sheet").parquet(path)


def metrics_table(report: DataFrame, order: str = "sheet_ord") -> DataFrame:
    """The 14 metrics columns in sheet order, TOTAL last."""
    ordered = report.withColumn("sheet_name", F.col("sheet")).orderBy("is_total", order, "sheet_name")
    return ordered.select(*METRICS_HEADER)


def write_metrics_csv(report: DataFrame, path: str, order: str = "sheet_ord", mode: str = "errorifexists") -> None:
    """``;``-separated metrics, one row per sheet: small enough for one ordered file."""
    metrics_table(report, order).coalesce(1).write.mode(mode).option("sep", ";").option("header", True).csv(path)


def write_report_csv(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Comma-separated report, categories by name, TOTAL last."""
    keys = ["is_total", "sheet"] if "is_total" in report.columns else ["sheet"]
    report.orderBy(*keys).select(*REPORT_COLUMNS).coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_table_csv(table: DataFrame, path: str, order: list[str], sep: str = ",", mode: str = "errorifexists") -> None:
    """A small summary table (learning curve, epoch statistics) as one ordered CSV file."""
    table.orderBy(*order).coalesce(1).write.mode(mode).option("sep", sep).option("header", True).csv(path)


def write_embeddings(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Metadata first, the vector as one array column."""
    rest = [c for c in df.columns if c != "embedding"]
    df.select(*rest, "embedding").write.mode(mode).parquet(path)


def write_wide_embeddings(df: DataFrame, path: str, dims: int, mode: str = "errorifexists") -> None:
    """Wide CSV export for tools that need one column per dimension."""
    to_wide(df, dims).write.mode(mode).option("header", True).option("escape", '"').csv(path)

