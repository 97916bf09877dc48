"""Validation of labels and marked texts: issue rows and summaries.

Issues are rows, never arrays collected per sheet: a broken column of a hot sheet has as many issues
as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.functions.numbers import bind
from sheafline.functions.text import marked_groups, preview, strip_space, word_count
from sheafline.operators.ranking import ROWS_PER_TASK, prefix_positions
from sheafline.session import materialize

HEADER_ROWS = 2  # a row index of 0 is line 2 of a sheet: one header line, counting from 1
REQUIRED = ("text", "label")
MAX_GROUP_WORDS = 5

# Order in which the issues of one sheet are reported.
SECTIONS = {"missing_column": 0, "label_null": 1, "label_invalid": 2, "text_null": 3, "text_format": 4}

ISSUE = "struct<severity:string,column:string,section:int,code:string,message:string>"


def missing_columns(columns: list[str], required: tuple[str, ...] = REQUIRED) -> list[str]:
    return [c for c in required if c not in columns]


def require_columns(df: DataFrame, on_missing: str = "fail", required: tuple[str, ...] = REQUIRED) -> DataFrame | None:
    """Column contract of a table. ``skip`` returns None, ``fail`` raises, ``zero`` adds typed nulls."""
    missing = missing_columns(df.columns, required)
    if not missing:
        return df
    if on_missing == "skip":
        return None
    if on_missing == "zero":
        return df.withColumns({c: F.lit(None).cast("double" if c == "label" else "string") for c in missing})
    raise ValueError(f"missing column(s) {missing}; available: {df.columns}")


def header_issues(headers: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Issues of whole sheets, from ``sheet, sheet_ord, columns ARRAY<STRING>`` (one row per sheet)."""
    missing = F.array_except(F.array(*map(F.lit, required)), F.col("columns"))
    where = F.concat(F.lit("Sheet '"), F.col("sheet"), F.lit("': "))

    def issue(severity: str, column: Column, code: str, message: Column) -> Column:
        return F.struct(
            F.lit(severity).alias("severity"),
            column.alias("column"),
            F.lit(SECTIONS["missing_column"]).alias("section"),
            F.lit(code).alias("code"),
            message.alias("message"),
        ).cast(ISSUE)

    errors = F.transform(
        missing,
        lambda c: issue("error", c, "missing_column", F.concat(where, F.lit("Missing required column '"), c, F.lit("'"))),
    )
    listing = quoted_list(F.col("columns"))
    note = F.array(
        issue("warning", F.lit(None), "available_columns", F.concat(where, F.lit("Available columns: "), listing))
    )
    both = F.when(F.size(missing) > 0, F.concat(errors, note)).otherwise(F.array().cast(f"array<{ISSUE}>"))
    return headers.select("sheet", "sheet_ord", F.lit(None).cast("long").alias("row_idx"), F.explode(both).alias("i")).select(
        "sheet", "sheet_ord", "row_idx", (F.lit(None).cast("long")).alias("excel_row"), "i.*"
    )


def label_value(label: Column, data_type: T.DataType) -> Column:
    """The label truncated to an integer, null where it cannot be one.

    Truncation toward zero makes 0.5, 1.9 and -0.5 valid. Text is accepted where it is a plain
    number; forms that only Spark would read as one (``1d``) are not.
    """
    if isinstance(data_type, T.StringType):
        number = strip_space(label)
        plain = number.rlike(r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$")
        value = F.when(plain, F.replace(number, F.lit("_"), F.lit("")).try_cast("double"))
    else:
        value = label.try_cast("double")
    return F.when(~F.isnan(value), F.when((value > -1e18) & (value < 1e18), value).try_cast("long"))


def label_issue(label: Column, data_type: T.DataType, where: Column) -> Column:
    """Issue of one label, null when it is valid. ``where`` ends the location part of the message."""
    value = label_value(label, data_type)
    is_null = label.isNull()
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        is_null = is_null | F.isnan(label)
    bad = value.isNull() | ~value.isin(0, 1)
    invalid = F.concat(where, F.lit("Invalid value '"), label.cast("string"), F.lit("' (should be 0 or 1)"))
    return (
        F.when(is_null, _issue("error", "label", "label_null", "missing", F.concat(where, F.lit("Missing/null value"))))
        .when(bad, _issue("error", "label", "label_invalid", "invalid_label", invalid))
    )


def text_issue(text: Column, where: Column) -> Column:
    """Issue of one text, null when it has exactly one ordinary ``<...>`` group."""

    def issue(severity: str, section: str, code: str, *parts: Column | str) -> Column:
        message = F.concat(where, *[F.lit(p) if isinstance(p, str) else p for p in parts])
        return _issue(severity, "text", section, code, message)

    def of_group(group: Column) -> Column:
        n = word_count(group)
        blank = issue("warning", "text_format", "blank_group", "Empty angular bracket group '<>'")
        long = issue(
            "warning", "text_format", "long_group",
            "Long angular bracket group (", n.cast("string"), " words) '<", group, ">'",
        )
        return F.when(group == "", blank).when(n > MAX_GROUP_WORDS, long)

    def of_text(stripped: Column) -> Column:
        def of_groups(groups: Column) -> Column:
            n = F.size(groups)
            none = issue(
                "error", "text_format", "no_group", "No angular bracket group found - '", preview(stripped, 50), "'"
            )
            many = issue(
                "error", "text_format", "multiple_groups",
                "Multiple angular bracket groups found (", n.cast("string"), "): ", quoted_list(groups),
            )
            only = bind(strip_space(F.get(groups, F.lit(0))), of_group)
            return F.when(n == 0, none).when(n > 1, many).otherwise(only)

        empty = issue("error", "text_format", "empty", "Empty text value")
        return F.when(stripped == "", empty).otherwise(bind(marked_groups(stripped), of_groups))

    missing = issue("error", "text_null", "missing", "Missing/null value")
    return F.when(text.isNull(), missing).when(~_ordinary(text), bind(strip_space(text), of_text))


def _ordinary(text: Column) -> Column:
    """One pass that settles the usual row: a single group, neither blank nor long."""
    group = F.regexp_extract(text, r"\A[^<>]*+<([^<>]++)>[^<>]*+\z", 1)
    return bind(group, lambda g: (strip_space(g) != "") & (word_count(g) <= MAX_GROUP_WORDS))


def quoted_list(values: Column) -> Column:
    """``['a', 'b']``: double quotes around a value that contains only single ones, escapes for controls."""

    def quoted(v: Column) -> Column:
        plain = v
        for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            plain = F.replace(plain, F.lit(raw), F.lit(shown))
        single = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
        only_single = F.contains(v, F.lit("'")) & ~F.contains(v, F.lit('"'))
        no_quote = ~F.contains(v, F.lit("'"))
        return (
            F.when(only_single, F.concat(F.lit('"'), plain, F.lit('"')))
            .when(no_quote, F.concat(F.lit("'"), plain, F.lit("'")))
            .otherwise(single)
        )

    return F.concat(F.lit("["), F.array_join(F.transform(values, quoted), ", "), F.lit("]"))


def _issue(severity: str, column: str, section: str, code: str, message: Column) -> Column:
    return F.struct(
        F.lit(severity).alias("severity"),
        F.lit(column).alias("column"),
        F.lit(SECTIONS[section]).alias("section"),
        F.lit(code).alias("code"),
        message.alias("message"),
    ).cast(ISSUE)


def _where(column: str) -> Column:
    row = (F.col("row_idx") + HEADER_ROWS).cast("string")
    return F.concat(F.lit("Sheet '"), F.col("sheet"), F.lit(f"', Column '{column}', Row "), row, F.lit(": "))


def _rows(df: DataFrame, issue: Column) -> DataFrame:
    keys = [c for c in ("sheet", "sheet_ord", "row_idx") if c in df.columns]
    found = df.select(*keys, issue.alias("i")).filter(F.col("i").isNotNull())
    return found.select(*keys, (F.col("row_idx") + HEADER_ROWS).alias("excel_row"), "i.*")


def label_issues(df: DataFrame, label: str = "label") -> DataFrame:
    """Issue rows of the label column; reads no text."""
    return _rows(df, label_issue(F.col(label), df.schema[label].dataType, _where("label")))


def text_issues(df: DataFrame, text: str = "text") -> DataFrame:
    """Issue rows of the text column; row-local, no shuffle."""
    return _rows(df, text_issue(F.col(text).cast("string"), _where("text")))


def row_issues(df: DataFrame) -> DataFrame:
    """Issues of both columns from one scan: two optional issues per row, exploded."""
    both = F.array_compact(
        F.array(
            label_issue(F.col("label"), df.schema["label"].dataType, _where("label")),
            text_issue(F.col("text").cast("string"), _where("text")),
        )
    )
    found = df.select("sheet", "sheet_ord", "row_idx", F.explode(both).alias("i"))
    return found.select("sheet", "sheet_ord", "row_idx", (F.col("row_idx") + HEADER_ROWS).alias("excel_row"), "i.*")


def summarize(df: DataFrame, extra_sheets: DataFrame | None = None) -> DataFrame:
    """Per sheet: rows, errors, warnings, valid flag, label and text tallies; one pass, no lists.

    ``extra_sheets`` has ``sheet, sheet_ord, errors, warnings`` for sheets without usable rows
    (unreadable, or required columns missing).
    """
    label, dtype = F.col("label"), df.schema["label"].dataType
    no_where = F.lit("")
    rows = df.select(
        "sheet",
        "sheet_ord",
        label.try_cast("double").alias("v"),
        label_issue(label, dtype, no_where)["severity"].alias("ls"),
        label.isNotNull().alias("has"),
        text_issue(F.col("text").cast("string"), no_where)["severity"].alias("ts"),
    )
    bad_label, bad_text = F.count_if(F.col("ls") == "error"), F.count_if(F.col("ts") == "error")
    table = rows.groupBy("sheet", "sheet_ord").agg(
        F.count(F.lit(1)).alias("total_rows"),
        bad_label.alias("label_errors"),
        bad_text.alias("text_errors"),
        F.count_if(F.col("ts") == "warning").alias("warnings"),
        F.count_if("has").alias("labelled_rows"),
        F.count_if(F.col("v") == 0).alias("zeros"),
        F.count_if(F.col("v") == 1).alias("ones"),
        (F.count(F.lit(1)) - bad_text).alias("valid_texts"),
    )
    table = table.withColumn("sheet_errors", F.lit(0).cast("long")).withColumn("readable", F.lit(True))
    if extra_sheets is not None:
        extra = extra_sheets.select("sheet", "sheet_ord", F.col("errors").cast("long").alias("sheet_errors"), F.col("warnings").cast("long").alias("warnings"), "readable", "total_rows")
        table = table.unionByName(extra, allowMissingColumns=True).fillna(0)
    errors = F.col("label_errors") + F.col("text_errors") + F.col("sheet_errors")
    return table.withColumn("errors", errors).withColumn("valid", errors == 0)


def overall(summary: DataFrame, total_sheets: int | None = None) -> DataFrame:
    """The file-level verdict from the per-sheet summary: valid only if some sheet exists and none has errors."""
    return summary.agg(
        (F.coalesce(F.bool_and("valid"), F.lit(False))).alias("valid"),
        (F.count(F.lit(1)) if total_sheets is None else F.lit(total_sheets)).cast("long").alias("total_sheets"),
        F.count_if("readable").alias("sheets_processed"),
        F.coalesce(F.sum(F.when(F.col("readable"), F.col("total_rows"))), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
        F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"),
    )


def numbered(issues: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Issues of each severity numbered from 1 in report order: sheet, section, row, column, message.

    One written pass over ranges of the report order (``prefix_positions``): the texts are checked a
    single time and no task sorts a whole sheet. Issues of a whole sheet come before those of its rows.
    """
    placed = prefix_positions(
        materialize(issues),
        ["severity"],
        ["sheet_ord", "sheet", "section", F.asc_nulls_first("row_idx"), "column", "message"],
        "issue_no",
        rows_per_task,
    )
    return placed.withColumn("issue_no", F.col("issue_no") + 1)
