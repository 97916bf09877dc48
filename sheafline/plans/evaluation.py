"""The end-to-end flow: budget, cleaning, scoring, label parsing, metrics, TOTAL, sinks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.operators.budget import row_budget, sheet_quotas
from sheafline.operators.metrics import confusion_counts, fill_missing_groups, report_with_total
from sheafline.operators.scoring import Scorer, dry_run, score
from sheafline.session import materialize
from sheafline.sources.sinks import write_metrics_csv, write_scored


@dataclass(frozen=True)
class Evaluation:
    """``scored`` holds all rows of the sheets that were reached; ``report`` ends with TOTAL."""

    scored: DataFrame
    report: DataFrame


def evaluate_corpus(
    corpus: DataFrame,
    factory: Callable[[], Scorer],
    max_per_sheet: int | None = None,
    max_total: int | None = None,
    batch_size: int = 10,
    failed_sheets: DataFrame | None = None,
    sheets: DataFrame | None = None,
    partitions: int | None = None,
) -> Evaluation:
    """Score a corpus (``sheet, sheet_ord, row_idx, text, label`` and any other columns).

    The scored rows are written once to the shared scratch folder, because they feed the output and
    the metrics. ``sheets`` (``sheet, sheet_ord``) lists sheets that may have no rows: they report
    zeros. So do ``failed_sheets`` and, where labels are text, sheets with a label among the rows to
    process that is no number: they use no budget, their rows stay with null results.
    """
    known = _with_label_failures(_all_sheets(corpus, sheets, failed_sheets), max_per_sheet, max_total)
    budgeted = row_budget(corpus, max_per_sheet, max_total, known)
    scored = materialize(score(budgeted, factory, batch_size, budget="in_budget", partitions=partitions))
    reached = sheet_quotas(known, max_per_sheet, max_total).filter("reached")
    return Evaluation(scored, evaluation_report(scored, reached))


def _all_sheets(corpus: DataFrame, listed: DataFrame | None, failed: DataFrame | None) -> DataFrame:
    """One row per sheet, whichever table names it: ``sheet, sheet_ord, rows, failed, first_bad``.

    ``first_bad`` is the first row whose label is text that is no number; null where labels are
    numbers. The only scan of the corpus before the scoring, of its keys and labels.
    """
    bad = F.lit(None).cast("long")
    if corpus.schema["label"].dataType.typeName() == "string":
        bad = F.when(F.col("label").isNotNull() & F.col("label").try_cast("double").isNull(), F.col("row_idx").cast("long"))
    table = corpus.groupBy("sheet", "sheet_ord").agg(F.count(F.lit(1)).alias("rows"), F.min(bad).alias("first_bad"))
    table = table.withColumn("failed", F.lit(False))
    for more, flag in ((listed, False), (failed, True)):
        if more is not None:
            none = F.lit(0).cast("long").alias("rows")
            named = more.select("sheet", "sheet_ord", none, F.lit(None).cast("long").alias("first_bad"), F.lit(flag).alias("failed"))
            table = table.unionByName(named)
    merged = table.groupBy("sheet", "sheet_ord")
    merged = merged.agg(F.sum("rows").alias("rows"), F.max("failed").alias("failed"), F.min("first_bad").alias("first_bad"))
    return materialize(merged)


def _with_label_failures(sheets: DataFrame, max_per_sheet: int | None, max_total: int | None) -> DataFrame:
    """Mark sheets whose rows to process hold a label that is no number.

    Which rows a sheet may process depends on the budget that the sheets before it used, and a failed
    sheet uses none: a fold over the table of sheets, which has one small row per sheet, carries the
    budget used so far and decides sheet after sheet.
    """
    entry = F.struct("sheet_ord", "sheet", "rows", "failed", "first_bad")
    rows = sheets.agg(F.array_sort(F.collect_list(entry)).alias("all"))
    state = "struct<used:bigint,broken:array<boolean>>"
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<boolean>").alias("broken")).cast(state)

    def decide(done: Column, sheet: Column) -> Column:
        size = F.least(sheet["rows"], F.lit(max_per_sheet).cast("long")) if max_per_sheet else sheet["rows"]
        if max_total:
            size = F.greatest(F.lit(0).cast("long"), F.least(size, F.lit(max_total).cast("long") - done["used"]))
        broken = sheet["failed"] | (F.coalesce(sheet["first_bad"] < size, F.lit(False)))
        used = done["used"] + F.when(broken, F.lit(0)).otherwise(size)
        return F.struct(used.alias("used"), F.array_append(done["broken"], broken).alias("broken")).cast(state)

    decided = rows.select("all", F.aggregate("all", start, decide, lambda s: s["broken"]).alias("broken"))
    pairs = decided.select(F.explode(F.arrays_zip("all", "broken")).alias("p"))
    return materialize(pairs.select("p.all.sheet", "p.all.sheet_ord", "p.all.rows", F.col("p.broken").alias("failed")))


def evaluation_report(scored: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """Metrics per sheet and in total; sheets of ``sheets`` that have no counts report zeros."""
    labelled = "has_label" if "has_label" in scored.columns else None
    if scored.schema["label"].dataType.typeName() == "string":
        scored = scored.withColumn("label", F.col("label").try_cast("double"))
    counts = confusion_counts(scored, ["sheet"], order="sheet_ord", labelled=labelled)
    if sheets is not None:
        counts = fill_missing_groups(counts, sheets.select("sheet", "sheet_ord"), "sheet")
    return report_with_total(counts, "sheet", order="sheet_ord")


def preview_prompts(corpus: DataFrame, system: str, max_per_sheet: int | None = None, max_total: int | None = None) -> DataFrame:
    """The prompts of a run with these limits, without running it."""
    return dry_run(row_budget(corpus, max_per_sheet, max_total), system)


def save_evaluation(result: Evaluation, path: str) -> None:
    """Scored table and metrics CSV side by side."""
    write_scored(result.scored.drop("in_budget"), f"{path}/scored")
    write_metrics_csv(result.report, f"{path}/metrics")
