"""Regression metrics, prediction distribution, and the 20-column per-category report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions.numbers import harmonic, safe_div
from sheafline.operators.totals import TOTAL
from sheafline.session import materialize

# The report header, in this order.
REPORT_COLUMNS = [
    "sheet", "n_samples", "n_label_0", "n_label_1", "mse", "rmse", "mae", "r2_score",
    "accuracy", "precision", "recall", "f1_score",
    "true_positives", "true_negatives", "false_positives", "false_negatives",
    "pred_mean", "pred_std", "pred_min", "pred_max",
]


def binarize(pred: Column | str, threshold: float = 0.5) -> Column:
    pred = F.col(pred) if isinstance(pred, str) else pred
    return (pred >= threshold).cast("int")


def regression_aggs(y: Column, p: Column) -> list[Column]:
    """MSE, RMSE, MAE and R2. Constant truth: R2 is 1 without error, else 0; one row: NaN."""
    mse = F.avg(F.pow(y - p, 2))
    variance = F.var_pop(y)
    r2 = (
        F.when(F.count(y) < 2, F.lit(float("nan")))
        .when(F.min(y) == F.max(y), F.when(mse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(1.0 - mse / variance)
    )
    return [
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(y - p)).alias("mae"),
        r2.alias("r2_score"),
    ]


def distribution_aggs(p: Column) -> list[Column]:
    """Mean, population standard deviation, minimum and maximum."""
    return [
        F.avg(p).alias("pred_mean"),
        F.stddev_pop(p).alias("pred_std"),
        F.min(p).alias("pred_min"),
        F.max(p).alias("pred_max"),
    ]


def regression_metrics(df: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    truth, pred = F.col(y).cast("double"), F.col(p).cast("double")
    aggs = [F.count(F.lit(1)).alias("n_samples"), *regression_aggs(truth, pred), *distribution_aggs(pred)]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def category_report(
    df: DataFrame,
    y: str = "y_true",
    p: str = "y_pred",
    sheet: str = "sheet",
    threshold: float = 0.5,
    total: bool = False,
) -> DataFrame:
    """One row per category, and with ``total`` a TOTAL row computed from the rows themselves.

    All twenty columns come from one aggregation. For TOTAL the same narrow columns are expanded by
    GROUPING SETS before the partial aggregation, so only per-category partials are shuffled.
    """
    rows = df.select(
        F.col(sheet).alias("sheet"),
        F.col(y).cast("double").alias("y"),
        F.col(p).cast("double").alias("p"),
        binarize(F.col(p).cast("double"), threshold).alias("b"),
    )
    y_, p_, b_ = F.col("y"), F.col("p"), F.col("b")
    aggs = [
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(y_ == 0).alias("n_label_0"),
        F.count_if(y_ == 1).alias("n_label_1"),
        *regression_aggs(y_, p_),
        F.count_if(b_ == y_).alias("_hits"),
        F.count_if((b_ == 1) & (y_ == 1)).alias("true_positives"),
        F.count_if((b_ == 0) & (y_ == 0)).alias("true_negatives"),
        F.count_if((b_ == 1) & (y_ == 0)).alias("false_positives"),
        F.count_if((b_ == 0) & (y_ == 1)).alias("false_negatives"),
        *distribution_aggs(p_),
    ]
    if total:
        table = rows.rollup("sheet").agg(F.grouping("sheet").alias("_total"), *aggs)
        table = table.withColumn("sheet", F.when(F.col("_total") == 1, F.lit(TOTAL)).otherwise(F.col("sheet")))
        table = table.withColumn("is_total", F.col("_total").cast("int"))
    else:
        table = rows.groupBy("sheet").agg(*aggs)
    c = F.col
    table = table.withColumns(
        {
            "accuracy": safe_div(c("_hits"), c("n_samples")),
            "precision": safe_div(c("true_positives"), c("true_positives") + c("false_positives")),
            "recall": safe_div(c("true_positives"), c("true_positives") + c("false_negatives")),
        }
    ).withColumn("f1_score", harmonic(c("precision"), c("recall")))
    return table.select(*REPORT_COLUMNS, *(["is_total"] if total else []))


def macro_mean(report: DataFrame, exclude_total: bool = False) -> DataFrame:
    """Plain mean over report rows of accuracy, F1 and R2; the TOTAL row takes part unless excluded."""
    if exclude_total:
        report = report.filter(F.col("is_total") == 0)
    r2 = F.when(~F.isnan("r2_score"), F.col("r2_score"))  # a mean over a table column skips NaN
    return report.agg(
        F.avg("accuracy").alias("avg_accuracy"), F.avg("f1_score").alias("avg_f1"), F.avg(r2).alias("avg_r2")
    )


def prediction_histogram(df: DataFrame, y: str = "y_true", p: str = "y_pred", bins: int = 20) -> DataFrame:
    """Counts in ``bins`` equal-width bins between each label's own smallest and largest prediction.

    A label whose predictions are all equal gets the unit range around that value. Empty bins are
    listed with zero rows.
    """
    rows = df.select(F.col(y).alias("label"), F.col(p).cast("double").alias("p"))
    low_high = rows.groupBy("label").agg(F.min("p").alias("_lo"), F.max("p").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    # written first, so that the rows meet it as the small table it is and are not shuffled by label
    ranges = materialize(low_high.select(
        "label",
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("hi"),
    ))
    position = F.floor((F.col("p") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins))
    counted = (
        rows.join(ranges, "label")
        .withColumn("bin", F.least(position, F.lit(bins - 1)).cast("int"))
        .groupBy("label", "bin")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counted, ["label", "bin"], "left").select(
        "label",
        "bin",
        (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_low"),
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
    )
