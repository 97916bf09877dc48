"""The corpus model on top of the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.operators.ranking import with_row_number
from sheafline.sources.corpus import with_sheet_order


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def marked_text() -> Column:
    """Bracket the second word; every 17th document gets a second group."""
    second = F.regexp_replace("text", r"^(\S+\s+)(\S+)", "$1<$2>")
    both = F.regexp_replace("text", r"^(\S+)(\s+)(\S+)", "<$1>$2<$3>")
    return F.when(F.col("doc_id") % 17 == 0, both).otherwise(second)


def documents(spark: SparkSession, sf_dir: str, sheet: str = "source", row_idx: bool = False) -> DataFrame:
    """``doc_id, sheet, text`` with marks (and ``row_idx``), without labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col(sheet).alias("sheet"), marked_text().alias("text"))
    if row_idx:
        # the index is found on the keys alone; the texts join it by id
        keys = table(spark, sf_dir, "documents").select("doc_id", F.col(sheet).alias("sheet"))
        numbered = with_row_number(keys, ["sheet"], "doc_id", "row_idx")
        docs = docs.join(numbered.select("doc_id", "row_idx"), "doc_id")
    return docs


def keys(spark: SparkSession, sf_dir: str, sheet: str = "source", row_idx: bool = False) -> DataFrame:
    """``doc_id, sheet, label, toxic``: everything but the texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col(sheet).alias("sheet"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), "toxic")
    joined = docs.join(labels, "doc_id", "left")
    return with_row_number(joined, ["sheet"], "doc_id", "row_idx") if row_idx else joined


def corpus(spark: SparkSession, sf_dir: str, sheet: str = "source") -> DataFrame:
    """The whole model: ``sheet, sheet_ord, row_idx, doc_id, text, label, toxic``."""
    texts = table(spark, sf_dir, "documents").select("doc_id", marked_text().alias("text"))
    rows = with_sheet_order(keys(spark, sf_dir, sheet, row_idx=True))
    return rows.join(texts, "doc_id").select("sheet", "sheet_ord", "row_idx", "doc_id", "text", "label", "toxic")


def stub_reply(flip: int = 5) -> Column:
    """A reply computed from the row, in every shape a scorer may answer."""
    q = F.coalesce(F.col("toxic"), (F.col("doc_id") % 2).cast("int"))
    return (
        F.when(F.col("doc_id") % 7 == 0, F.lit("0 Error"))
        .when(F.col("doc_id") % flip == 0, F.concat(F.lit("answer: "), (1 - q).cast("string")))
        .when(F.col("doc_id") % 11 == 0, F.lit("unsure"))
        .otherwise(F.concat(q.cast("string"), F.lit(" …")))
    )


def scored_keys(spark: SparkSession, sf_dir: str, sheet: str = "source", flip: int = 5) -> DataFrame:
    """Keys with ``ai_reply, ai_label``; no text is read."""
    from sheafline.functions.text import parse_label

    rows = keys(spark, sf_dir, sheet).withColumn("ai_reply", stub_reply(flip))
    return rows.withColumn("ai_label", parse_label("ai_reply"))


def regression_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, sheet, y_true, y_pred`` from the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id",
        F.concat(F.lit("c"), (F.col("vec_id") % 11).cast("string")).alias("sheet"),
        (F.col("label") % 2).cast("int").alias("y_true"),
        F.round(0.5 + F.col("embedding")[0].cast("double"), 3).cast("decimal(9,3)").alias("y_pred"),
    )


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, sheet, label, embedding, is_test`` for model fits."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id",
        F.concat(F.lit("c"), (F.col("vec_id") % 11).cast("string")).alias("sheet"),
        (F.col("label") % 2).cast("double").alias("label"),
        "embedding",
        (F.col("vec_id") % 4 == 3).alias("is_test"),
    )


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``step, epoch, loss, eval_loss, eval_accuracy`` from the events; error events are evaluations."""
    ev = table(spark, sf_dir, "events")
    is_eval = F.col("event_type") == "error"
    return ev.select(
        F.col("event_id").alias("step"),
        (F.col("event_id") / F.lit(2000.0)).alias("epoch"),
        F.when(~is_eval, F.col("value")).alias("loss"),
        F.when(is_eval, F.col("value")).alias("eval_loss"),
        F.when(is_eval, F.col("user_id") / F.lit(1000.0)).alias("eval_accuracy"),
    )


def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result files of earlier runs, derived from the orders: provider, model, prompt, number."""
    o = table(spark, sf_dir, "orders")
    providers = F.array(*[F.lit(p) for p in ("openai", "gemini", "qwen", "groq")])
    models = F.array(*[F.lit(m) for m in ("gpt-5.4", "gemini-3.1-flash-lite", "Qwen/Qwen2.5-7B-Instruct", "")])
    pick = F.col("o_custkey") % 4
    return o.select(
        F.col("o_orderkey"),
        F.get(providers, pick.cast("int")).alias("provider"),
        F.get(models, pick.cast("int")).alias("model"),
        (F.col("o_custkey") % 5 + 1).cast("int").alias("prompt_no"),
        F.when(F.col("o_custkey") % 3 == 0, F.lit("base")).alias("label"),
        (F.col("o_orderkey") % 97 + F.col("o_orderkey") % 13 + 1).cast("int").alias("experiment"),
    )
