"""Verification of corpus files: folders of CSV files, one folder per sheet, headers and all.

The files are read once with generic columns, whatever their headers say: header lines are data. One
pass over the cells checks every row and writes the narrow result (no texts), while an observation on
that same pass counts rows, errors and warnings for the verdict on the whole input. Numbers of rows,
messages in report order and the summary per sheet come from the narrow table.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.operators import validate
from sheafline.operators.ranking import prefix_positions
from sheafline.session import materialize

WIDTH = 16  # columns of a sheet that are read; a file with more is reported as unreadable
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Verification:
    """``verdict``: one row; ``sheets``: one row per sheet; ``issues``: numbered messages."""

    verdict: DataFrame
    sheets: DataFrame
    issues: DataFrame


def list_sheets(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders ``sheet=...`` below ``path``, those without files too, in order of name."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    entries = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    names = [e.getPath().getName() for e in entries if e.isDirectory()]
    return sorted(unquote(n.removeprefix("sheet=")) for n in names if n.startswith("sheet=") and n != f"sheet={NO_VALUE}")


def read_cells(spark: SparkSession, path: str, width: int = WIDTH) -> DataFrame:
    """sheet, file, at, cells, torn: every line of every file as cells, header lines included.

    ``at`` grows with the lines of a file. ``torn`` is set where a line has more cells than ``width``
    or its quotes do not close.
    """
    cells = [T.StructField(f"_c{i}", T.StringType()) for i in range(width)]
    schema = T.StructType([*cells, T.StructField("_torn", T.StringType()), T.StructField("sheet", T.StringType())])
    options = {"header": False, "multiLine": True, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"}
    rows = spark.read.schema(schema).options(**options).csv(path)
    # a line with fewer cells than the generic columns is not torn
    torn = F.col("_torn").isNotNull() & F.col(f"_c{width - 1}").isNotNull()
    return rows.select(
        "sheet",
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("at"),
        F.array(*(f"_c{i}" for i in range(width))).alias("cells"),
        torn.alias("torn"),
    )


def headers(cells: DataFrame) -> DataFrame:
    """file, first, columns, torn: the first line of every file."""
    first = cells.groupBy("file").agg(F.min("at").alias("first"))
    lines = cells.join(materialize(first).withColumnRenamed("file", "_file"), (F.col("file") == F.col("_file")) & (F.col("at") == F.col("first")))
    return materialize(lines.select("sheet", "file", "first", F.array_compact("cells").alias("columns"), "torn"))


def _cell(name: str) -> Column:
    """A row's cell under a header, null where it is blank or the file lacks it."""
    at = F.array_position("columns", name)
    return F.when(at > 0, F.nullif(F.get("cells", (at - 1).cast("int")), F.lit("")))


def verify_files(spark: SparkSession, path: str, width: int = WIDTH) -> Verification:
    """Check all sheets below ``path`` (``sheet=NAME/*.csv``).

    A sheet that lacks a required column in one of its files, has no readable header or no file at
    all is reported as such and its rows are not checked. Rows are numbered through a sheet's files
    in the order of their names. Sheets are reported in the order of their names.
    """
    listed = list_sheets(spark, path)
    names = spark.createDataFrame([(s, i) for i, s in enumerate(listed)], "sheet string, sheet_ord int")
    if not listed:
        empty = spark.createDataFrame([], "sheet string, file string, first long, columns array<string>, torn boolean")
        return _report(spark, names, empty, None, {})
    cells = read_cells(spark, path, width)
    tops = headers(cells)
    usable = ~F.col("torn") & F.array_contains("columns", "text") & F.array_contains("columns", "label")
    broken = materialize(tops.groupBy("sheet").agg(F.bool_and(usable).alias("usable")).filter("not usable").select("sheet"))

    rows = cells.drop("torn").join(tops.select(F.col("file").alias("_file"), "first", "columns"), F.col("file") == F.col("_file"))
    rows = rows.filter(F.col("at") > F.col("first")).join(broken, "sheet", "left_anti")
    rows = rows.select("sheet", "file", "at", _cell("text").alias("text"), _cell("label").alias("label"))
    issues = F.array_compact(
        F.array(
            validate.label_issue(F.col("label"), T.StringType(), F.lit("")),
            validate.text_issue(F.col("text"), F.lit("")),
        )
    )
    value = F.col("label").try_cast("double")
    checked = rows.select("sheet", "file", "at", value.alias("value"), F.col("label").isNotNull().alias("labelled"), issues.alias("issues"))
    seen = Observation()

    def found(severity: str) -> Column:
        return F.coalesce(F.sum(F.size(F.filter("issues", lambda i: i["severity"] == severity))), F.lit(0))

    counted = checked.observe(seen, F.count(F.lit(1)).alias("rows"), found("error").alias("errors"), found("warning").alias("warnings"))
    checked = materialize(counted)
    return _report(spark, names, tops, checked, seen.get)


def _report(spark: SparkSession, names: DataFrame, tops: DataFrame, checked: DataFrame | None, seen: dict) -> Verification:
    table = materialize(_sheet_issues(names, tops))
    if checked is None:
        checked = spark.createDataFrame([], f"sheet string, file string, at long, value double, labelled boolean, issues array<{validate.ISSUE}>")
    placed = prefix_positions(checked.select("sheet", "file", "at", "issues"), ["sheet"], ["file", "at"], "row_idx")
    where = F.concat(
        F.lit("Sheet '"), F.col("sheet"), F.lit("', Column '"), F.col("i.column"), F.lit("', Row "),
        (F.col("row_idx") + validate.HEADER_ROWS).cast("string"), F.lit(": "),
    )
    of_rows = placed.select("sheet", "row_idx", F.explode("issues").alias("i")).join(names, "sheet")
    of_rows = of_rows.select(
        "sheet", "sheet_ord", "row_idx", (F.col("row_idx") + validate.HEADER_ROWS).alias("excel_row"),
        "i.severity", "i.column", "i.section", "i.code", F.concat(where, F.col("i.message")).alias("message"),
    )
    issues = validate.numbered(of_rows.unionByName(table))

    severity = F.filter("issues", lambda i: i["severity"] == "error")
    ones = checked.select(
        "sheet", "value", "labelled", F.size(severity).alias("errors"), (F.size("issues") - F.size(severity)).alias("warnings")
    )
    sums = ones.groupBy("sheet").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if("labelled").alias("labelled_rows"),
        F.count_if(F.col("value") == 0).alias("zeros"), F.count_if(F.col("value") == 1).alias("ones"),
        F.sum("errors").alias("row_errors"), F.sum("warnings").alias("row_warnings"),
    )
    whole = table.groupBy("sheet").agg(
        F.count_if(F.col("severity") == "error").alias("sheet_errors"), F.count_if(F.col("severity") == "warning").alias("sheet_warnings"),
        (~F.bool_or(F.col("code") == "unreadable")).alias("readable"),
    )
    sheets = names.join(sums, "sheet", "left").join(whole, "sheet", "left").fillna(0).fillna(True, ["readable"])
    errors = F.col("row_errors") + F.col("sheet_errors")
    sheets = sheets.select(
        "sheet", "sheet_ord", "readable", "total_rows", "labelled_rows", "zeros", "ones", errors.alias("errors"),
        (F.col("row_warnings") + F.col("sheet_warnings")).alias("warnings"), (errors == 0).alias("valid"),
    )

    # the verdict: what the pass over the rows observed, and the few issues of whole sheets
    extra = table.agg(F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warning"), F.count_if(F.col("code") == "unreadable")).first()
    errors, warnings = seen.get("errors", 0) + extra[0], seen.get("warnings", 0) + extra[1]
    total = names.count()
    row = (bool(total) and errors == 0, total, total - extra[2], seen.get("rows", 0), errors, warnings)
    kinds = "valid boolean, total_sheets long, sheets_processed long, total_rows long, errors long, warnings long"
    return Verification(spark.createDataFrame([row], kinds), sheets, issues)


def _sheet_issues(names: DataFrame, tops: DataFrame) -> DataFrame:
    """Issues of whole sheets: no header to read, or required columns missing.

    A sheet lacks a column if one of its files does; the columns listed are those of its first such file.
    """
    per_sheet = tops.groupBy("sheet").agg(F.bool_or("torn").alias("torn"), F.array_sort(F.collect_list(F.struct("file", "columns"))).alias("files"))
    lacking = F.filter("files", lambda f: F.size(F.array_intersect(f["columns"], F.array(*map(F.lit, validate.REQUIRED)))) < len(validate.REQUIRED))
    columns = F.coalesce(F.get(lacking, F.lit(0))["columns"], F.get("files", F.lit(0))["columns"])
    found = names.join(per_sheet, "sheet", "left")
    unreadable = F.coalesce("torn", F.lit(True))
    message = F.concat(F.lit("Error reading sheet "), F.col("sheet"), F.lit(": "), F.when(F.col("torn"), "too many columns").otherwise("no header"))
    blank = F.lit(None).cast("long")
    broken = found.filter(unreadable).select(
        "sheet", "sheet_ord", blank.alias("row_idx"), blank.alias("excel_row"), F.lit("error").alias("severity"),
        F.lit(None).cast("string").alias("column"), F.lit(validate.SECTIONS["missing_column"]).alias("section"),
        F.lit("unreadable").alias("code"), message.alias("message"),
    )
    missing = validate.header_issues(found.filter(~unreadable).select("sheet", "sheet_ord", columns.alias("columns")))
    return broken.unionByName(missing)
