"""Corpus statistics and shape reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.functions.numbers import percent_text, safe_div
from sheafline.operators.totals import with_total


def corpus_stats(df: DataFrame, sheet: str = "sheet", label: str = "label", order: str | None = None) -> DataFrame:
    """Rows, positives and negatives per sheet and in total; other labels count as rows only."""
    has_label = label in df.columns
    positive = F.count_if(F.col(label) == 1) if has_label else F.lit(0).cast("long")
    negative = F.count_if(F.col(label) == 0) if has_label else F.lit(0).cast("long")
    aggs = [F.count(F.lit(1)).alias("rows"), positive.alias("positive"), negative.alias("negative")]
    per_sheet = df.groupBy(sheet).agg(*aggs, *([F.min(order).alias(order)] if order else []))
    total = with_total(
        per_sheet, sheet, [F.sum(c).alias(c) for c in ("rows", "positive", "negative")], keep=[order] if order else []
    )
    ratio = safe_div(F.col("positive"), F.col("positive") + F.col("negative"))
    return total.withColumn("positive_ratio", ratio).withColumn("positive_percent", percent_text(ratio))


def shape_report(df: DataFrame, vector: str = "embedding", metadata: list[str] | None = None) -> DataFrame:
    """Rows, metadata width and vector width of an embedding table."""
    metadata = [c for c in df.columns if c != vector] if metadata is None else metadata
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(metadata)).cast("long").alias("metadata_columns"),
        F.coalesce(F.max(F.size(vector)), F.lit(0)).cast("long").alias("dimensions"),
    )


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows and distinct sheets per split."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("sheet").alias("sheets")
    )


def distinct_texts(df: DataFrame, by: list[str], text: str = "text", approximate: bool = False) -> DataFrame:
    """Distinct texts per group: exact, or HyperLogLog++ when asked for."""
    # digests: the texts themselves would be shuffled as keys
    count = F.approx_count_distinct(text) if approximate else F.count_distinct(F.sha2(F.col(text).cast("string"), 256))
    return df.groupBy(*by).agg(count.alias("distinct_texts"))


SKETCH_BITS = 14  # 2**14 registers: a relative standard error of about 0.8 %


def text_sketches(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """A mergeable sketch of the distinct texts per group, to be stored with the group."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(F.col(text).cast("string"), F.lit(SKETCH_BITS)).alias("sketch"))


def merged_estimates(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Estimated distinct texts per group of ``by`` (none: in total), from stored sketches alone."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_texts"))


def head_rows(df: DataFrame, order: list[str], k: int = 3) -> DataFrame:
    """First ``k`` rows in a given order (a distributed top-k, not a global sort)."""
    return df.orderBy(*order).limit(k)


def vector_head(df: DataFrame, order: list[str], k: int = 1, dims: int = 10, vector: str = "embedding") -> DataFrame:
    """First rows with the leading dimensions of their vectors."""
    return head_rows(df, order, k).withColumn(vector, F.slice(vector, 1, dims))


def first_seen(df: DataFrame, sheet: str = "sheet", order: tuple[str, ...] = ("sheet_ord", "row_idx")) -> DataFrame:
    """Categories with the position of their first row; order by ``first_at`` for first-seen order."""
    return df.groupBy(sheet).agg(F.min(F.struct(*order)).alias("first_at"))
