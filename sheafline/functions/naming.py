"""Names of runs, result files and iterations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(name: Column) -> Column:
    return F.translate(name, "/.", "--")


def method_name(max_rows_per_sheet: Column | int, max_total_rows: Column | int) -> Column:
    def text(v):
        return (v if isinstance(v, Column) else F.lit(v)).cast("string")

    return F.concat(F.lit("m"), text(max_rows_per_sheet), F.lit("-n"), text(max_total_rows))


def run_id(provider: Column, model: Column, prompt_no: Column, method: Column, label: Column | None = None) -> Column:
    """``Result-[label-]provider-model-promptP-method``; an empty label counts as none."""
    label = F.lit(None).cast("string") if label is None else F.nullif(label, F.lit(""))
    prompt = F.concat(F.lit("prompt"), prompt_no.cast("string"))
    return F.concat_ws("-", F.lit("Result"), label, provider, slug(model), prompt, method)


def result_name(run: Column, experiment: Column, extension: str = ".xlsx") -> Column:
    return F.concat(run, F.lit("-experiment"), experiment.cast("string"), F.lit(extension))


def metrics_name(result: Column) -> Column:
    """The result's name with its extension replaced by ``.csv``."""
    return F.concat(F.regexp_replace(result, r"(?s)\.[^.]*\z", ""), F.lit(".csv"))


def iteration_name(number: Column) -> Column:
    return F.format_string("finetune-%02d", number.cast("int"))


def trailing_iteration(name: Column) -> Column:
    """Integer after the last ``-`` of a name; 0 where that part is no integer."""
    part = F.element_at(F.split(name, "-"), -1)
    digits = F.when(part.rlike(r"^\s*[+]?[0-9]+(_[0-9]+)*\s*$"), F.regexp_replace(part, r"[\s_+]", ""))
    return F.coalesce(digits.try_cast("int"), F.lit(0))
