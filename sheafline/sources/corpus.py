"""Reading categorised corpora and embedding tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.operators.embedding import from_wide, vector_columns
from sheafline.session import materialize

CORPUS_SCHEMA = T.StructType(
    [
        T.StructField("sheet", T.StringType()),
        T.StructField("sheet_ord", T.IntegerType()),
        T.StructField("row_idx", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.DoubleType()),
    ]
)


def read_corpus(spark: SparkSession, path: str, extra: T.StructType | None = None) -> DataFrame:
    """A corpus table written with ``partitionBy("sheet")``; a filter on ``sheet`` prunes folders."""
    fields = [*CORPUS_SCHEMA.fields, *(extra.fields if extra else [])]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def read_corpus_csv(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """CSV tables (one folder or file per sheet). Lines that do not fit are kept in ``corrupt``."""
    schema = T.StructType(
        [
            T.StructField("text", T.StringType()),
            T.StructField("label", T.DoubleType()),
            T.StructField("corrupt", T.StringType()),
        ]
    )
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "corrupt")
        .csv(path)
    )
    return rows.withColumn("sheet", F.lit(sheet)) if sheet else rows


def sheet_order(df: DataFrame, sheet: str = "sheet", name: str = "sheet_ord") -> DataFrame:
    """Sheets numbered by name: a one-row-per-sheet table, written so that joins see its true size."""
    return materialize(df.select(sheet).distinct().withColumn(name, F.row_number().over(Window.orderBy(sheet))))


def with_sheet_order(df: DataFrame, sheet: str = "sheet", name: str = "sheet_ord") -> DataFrame:
    """Adds each row's sheet position."""
    return df.join(sheet_order(df, sheet, name), sheet)


def union_sheets(frames: list[DataFrame]) -> DataFrame:
    """All rows of all sheets; columns that a sheet lacks are null."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_wide_embeddings(spark: SparkSession, path: str, dims: int, metadata: str) -> DataFrame:
    """Wide CSV (``emb_0 …``) with a declared schema, folded into ``embedding``."""
    wide = ", ".join(f"emb_{i} float" for i in range(dims))
    table = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(
        path, schema=f"{metadata}, {wide}"
    )
    assert len(vector_columns(table.columns)) == dims
    return from_wide(table)
