"""Classification metrics per category, in every numeric variant, with TOTAL rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions.numbers import harmonic, round_exact, safe_div
from sheafline.operators.totals import with_total

COUNTS = ["n", "lp", "ln", "pp", "pn", "tp", "fp", "tn", "fn"]
RATES = ["accuracy", "precision", "recall", "f1"]


def confusion_aggs(label: Column, pred: Column) -> list[Column]:
    """The nine counts over rows where label and prediction are both known.

    A label other than 0 and 1 counts in ``n`` and in ``pp``/``pn`` only.
    """
    known = label.isNotNull() & ~F.isnan(label.cast("double")) & pred.isNotNull()

    def n(condition: Column) -> Column:
        return F.count_if(known & condition)

    return [
        F.count_if(known).alias("n"),
        n(label == 1).alias("lp"),
        n(label == 0).alias("ln"),
        n(pred == 1).alias("pp"),
        n(pred == 0).alias("pn"),
        n((label == 1) & (pred == 1)).alias("tp"),
        n((label == 0) & (pred == 1)).alias("fp"),
        n((label == 0) & (pred == 0)).alias("tn"),
        n((label == 1) & (pred == 0)).alias("fn"),
    ]


def rate_columns(digits: int | None = 3, f1_from: str = "exact", denominators: str = "margins") -> dict[str, Column]:
    """Accuracy, precision, recall and F1 as expressions over the nine counts.

    ``digits`` rounds the four values (None: not at all). ``f1_from="rounded"`` computes F1 from the
    rounded precision and recall. ``denominators`` is ``margins`` (``tp/pp``, ``tp/lp``) or
    ``confusion`` (``tp/(tp+fp)``, ``tp/(tp+fn)``); they differ where labels other than 0/1 occur.
    """
    if f1_from not in ("exact", "rounded") or denominators not in ("margins", "confusion"):
        raise ValueError("f1_from is exact|rounded, denominators is margins|confusion")

    def rounded(c: Column) -> Column:
        return c if digits is None else round_exact(c, digits)

    c = F.col
    by_pred, by_label = (c("pp"), c("lp")) if denominators == "margins" else (c("tp") + c("fp"), c("tp") + c("fn"))
    precision, recall = safe_div(c("tp"), by_pred), safe_div(c("tp"), by_label)
    f1 = harmonic(rounded(precision), rounded(recall)) if f1_from == "rounded" else harmonic(precision, recall)
    return {
        "accuracy": rounded(safe_div(c("tp") + c("tn"), c("n"))),
        "precision": rounded(precision),
        "recall": rounded(recall),
        "f1": rounded(f1),
    }


def add_rates(counts: DataFrame, **variant) -> DataFrame:
    return counts.withColumns(rate_columns(**variant))


def confusion_counts(
    scored: DataFrame,
    by: list[str],
    label: str = "label",
    pred: str = "ai_label",
    order: str | None = None,
    labelled: str | None = None,
) -> DataFrame:
    """Nine counts per group in one pass with map-side combine.

    ``order`` carries the smallest value of a column as the group's position. ``labelled`` names a
    BOOLEAN column telling whether the group's table has a label column at all; groups without one
    get ``n`` = scored rows, ``pp`` = positive predictions, ``pn`` the rest and zero elsewhere.
    """
    aggs = confusion_aggs(F.col(label), F.col(pred))
    if labelled:
        aggs += [
            F.bool_or(labelled).alias("_has"),
            F.count(pred).alias("_scored"),
            F.coalesce(F.sum(F.col(pred)), F.lit(0)).cast("long").alias("_ones"),
        ]
    if order:
        aggs.append(F.min(order).alias(order))
    counts = scored.groupBy(*by).agg(*aggs)
    if labelled:
        fallback = {"n": F.col("_scored"), "pp": F.col("_ones"), "pn": F.col("_scored") - F.col("_ones")}
        counts = counts.withColumns(
            {c: F.when(F.col("_has"), F.col(c)).otherwise(fallback.get(c, F.lit(0))) for c in COUNTS}
        ).drop("_has", "_scored", "_ones")
    return counts


def fill_missing_groups(counts: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Zero counts for groups that were skipped or failed: every row of ``groups`` appears."""
    filled = groups.join(counts.select(key, *COUNTS), key, "left")
    return filled.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in COUNTS})


def report_with_total(
    counts: DataFrame, key: str = "sheet", order: str | None = None, within: list[str] = (), **variant
) -> DataFrame:
    """Per-group metrics and the TOTAL row computed from the summed counts (per ``within`` value)."""
    sums = [F.sum(c).cast("long").alias(c) for c in COUNTS]
    summed = with_total(counts, key, sums, keep=[order] if order else [], within=within)
    return add_rates(summed, **variant)


def weighted_prf(counts: DataFrame) -> DataFrame:
    """Support-weighted precision, recall and F1 over the two classes; zero division gives 0."""
    c = F.col
    p1, r1 = safe_div(c("tp"), c("tp") + c("fp")), safe_div(c("tp"), c("tp") + c("fn"))
    p0, r0 = safe_div(c("tn"), c("tn") + c("fn")), safe_div(c("tn"), c("tn") + c("fp"))
    ones, zeros = c("tp") + c("fn"), c("tn") + c("fp")

    def weighted(of_one: Column, of_zero: Column) -> Column:
        return safe_div(of_one * ones + of_zero * zeros, ones + zeros)

    return counts.withColumns(
        {
            "precision": weighted(p1, p0),
            "recall": weighted(r1, r0),
            "f1": weighted(harmonic(p1, r1), harmonic(p0, r0)),
        }
    )


def confusion_percent(counts: DataFrame, digits: int = 2) -> DataFrame:
    """Confusion cells as percent of the evaluated rows."""
    total = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    cells = {"true_positives": "tp", "true_negatives": "tn", "false_positives": "fp", "false_negatives": "fn"}
    return counts.withColumns(
        {name: round_exact(safe_div(F.col(cell) * 100, total), digits) for name, cell in cells.items()}
    )


def verdict_rows(scored: DataFrame, label: str = "label", pred: str = "ai_label", text: str = "text") -> DataFrame:
    """Per-row verdict: mark, 80-character preview, prediction and truth."""
    from sheafline.functions.text import class_name, preview

    # a null label equals nothing, so it is a miss
    hit = F.coalesce(F.col(pred) == F.col(label), F.lit(False))
    return scored.withColumns(
        {
            "verdict": F.when(hit, F.lit("✓")).otherwise(F.lit("✗")),
            "text_preview": preview(text, 80, ellipsis=False),
            "predicted": F.col(pred),
            "predicted_class": class_name(pred),
            "actual": F.col(label),
        }
    )


def label_counts(df: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """Rows per label value (nulls left out), in total (``by=[]``) or per group."""
    return df.filter(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("rows"))
