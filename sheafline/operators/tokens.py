"""Token rows: training examples, padded batches, token accuracy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions.arrays import fill_like, left_pad, left_pad_mask, shifted_hits, truncate
from sheafline.functions.numbers import round_exact, safe_div
from sheafline.functions.text import render_prompt, words

MAX_TOKENS = 512  # fixed value: longest training example

Tokenizer = Callable[[list[str]], list[list[int]]]


def hashed_word_ids(text: Column, vocabulary: int = 32000) -> Column:
    """Built-in tokenizer: one stable id per word."""
    return F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(vocabulary)).cast("int"))


def word_length_ids(text: Column) -> Column:
    """Built-in tokenizer without hashing: the length of each word."""
    return F.transform(words(text), F.length)


def tokenizer_udf(factory: Callable[[], Tokenizer]):
    """Tokenizer hook, made once per worker."""

    @F.pandas_udf("array<int>")
    def tokenize(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = factory()
        for texts in parts:
            yield pd.Series(list(tokenizer(texts.tolist())), index=texts.index)

    # evaluated once per row, even where a filter uses the result
    return tokenize.asNondeterministic()


def token_columns(ids: Column, limit: int = MAX_TOKENS) -> dict[str, Column]:
    kept = truncate(ids, limit)
    return {"input_ids": kept, "attention_mask": fill_like(kept, 1), "token_type_ids": fill_like(kept, 0)}


def training_examples(
    df: DataFrame,
    system: str | None,
    tokenizer: Callable[[], Tokenizer] | None = None,
    ids: Callable[[Column], Column] = hashed_word_ids,
    limit: int = MAX_TOKENS,
    label: str = "label",
) -> DataFrame:
    """Prompt with label, tokenised and cut: ``input_ids, attention_mask, token_type_ids``."""
    prompt = render_prompt("text", system, F.col(label))
    tokens = tokenizer_udf(tokenizer)(prompt) if tokenizer else ids(prompt)
    staged = df.withColumn("_ids", tokens)
    return staged.withColumns(token_columns(F.col("_ids"), limit)).drop("_ids")


def left_padded(df: DataFrame, batch: list[str], ids: str = "input_ids", pad: int = 0) -> DataFrame:
    """Ids padded to the longest of their batch, with the mask. A batch has a fixed, small size."""
    width = F.max(F.size(ids)).over(Window.partitionBy(*batch))
    staged = df.withColumn("_width", width)
    return staged.withColumns(
        {
            "padded_ids": left_pad(F.col(ids), F.col("_width"), pad),
            "padded_mask": left_pad_mask(F.col(ids), F.col("_width")),
        }
    ).drop("_width")


def token_accuracy(df: DataFrame, preds: str = "preds", labels: str = "labels", by: list[str] = ()) -> DataFrame:
    """Micro-averaged accuracy of the next token over all counted positions, 4 decimals; 0 if none."""
    hits = df.select(*by, shifted_hits(F.col(preds), F.col(labels)).alias("h"))
    sums = [
        F.coalesce(F.sum("h.correct"), F.lit(0)).alias("correct"),
        F.coalesce(F.sum("h.counted"), F.lit(0)).alias("counted"),
    ]
    table = hits.groupBy(*by).agg(*sums) if by else hits.agg(*sums)
    return table.withColumn("accuracy", round_exact(safe_div(F.col("correct"), F.col("counted")), 4))
