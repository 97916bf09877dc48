"""Sentence + span vectors as one array column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions.text import first_span, strip_marks
from sheafline.session import spread

Encoder = Callable[[list[str]], np.ndarray]

PIECE = 1 << 16  # grams of a text that are hashed at once
HASH_FACTOR, HASH_MIX, HASH_PRIME = 1_000_003, 48_271, 2_147_483_647


def clean_corpus(df: DataFrame) -> DataFrame:
    """Adds ``bracketed_text, full_sentence`` and drops rows where one of them or the label is null."""
    return df.withColumns({"bracketed_text": first_span("text"), "full_sentence": strip_marks("text")}).dropna(
        subset=["bracketed_text", "full_sentence", "label"]
    )


def hash_texts(texts: pa.Array, dims: int, n: int) -> pa.Array:
    """The vectors of :func:`hashed_vector`; one text of the batch is a Python string at a time."""

    def vector(t: str) -> np.ndarray:
        counts = np.zeros(2 * dims, np.int64)
        for low in range(0, len(t) - n + 1, PIECE):
            codes = np.frombuffer(t[low : low + PIECE + n - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            h = np.zeros(len(codes) - n + 1, np.int64)
            for k in range(n):
                h = (h * HASH_FACTOR + codes[k : k + len(h)]) % HASH_PRIME
            slot = h * HASH_MIX % HASH_PRIME % (2 * dims)  # twice the dimension, plus the sign
            counts += np.bincount(slot, minlength=2 * dims)
        out = (counts[0::2] - counts[1::2]).astype(np.float64)
        norm = np.sqrt((out * out).sum())
        return (out / norm if norm else out).astype(np.float32)

    out = np.zeros((len(texts), dims), np.float32)
    for i, t in enumerate(texts):
        if t.is_valid:
            out[i] = vector(t.as_py())
    ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dims)
    return pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1)), mask=texts.is_null())


def hashed_vector(text: Column, dims: int = 64, n: int = 3) -> Column:
    """Signed feature hashing of the character n-grams of a text, L2-normalised.

    A gram's hash is a polynomial of its code points modulo a prime, which any engine can reproduce:
    it picks the dimension and the sign. A text's grams are hashed as arrays of numbers, ``PIECE`` at a
    time, so a worker holds little besides Spark's batch of texts. A null text gives null, a text of
    fewer than ``n`` characters zeros.
    """

    @F.arrow_udf("array<float>")
    def vectors(texts: pa.Array) -> pa.Array:
        return hash_texts(texts, dims, n)

    return vectors(F.lower(text))


def hashed_ngrams(df: DataFrame, text: str, output: str, dims: int = 64, n: int = 3) -> DataFrame:
    """Built-in encoder: ``hashed_vector`` of a column."""
    return df.withColumn(output, hashed_vector(F.col(text), dims, n))


def encoder_udf(factory: Callable[[], Encoder], batch_size: int = 256):
    """Encoder hook: the model is made once per worker and sees slices of ``batch_size`` texts."""

    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in parts:
            values = texts.tolist()
            vectors: list[np.ndarray] = []
            for at in range(0, len(values), batch_size):
                vectors += list(np.asarray(model(values[at : at + batch_size]), dtype=np.float32))
            yield pd.Series(vectors, index=texts.index)

    # evaluated once per row, even where a filter uses the result
    return encode.asNondeterministic()


def compound(sentence: Column, span: Column) -> Column:
    """Sentence vector followed by span vector."""
    return F.concat(sentence, span)


def compound_embedding(
    df: DataFrame, factory: Callable[[], Encoder] | None = None, dims: int = 64, partitions: int | None = None
) -> DataFrame:
    """``embedding`` from ``full_sentence`` and ``bracketed_text``; ``partitions`` as in ``spread``."""
    df = spread(df, partitions)
    if factory is None:
        both = hashed_ngrams(hashed_ngrams(df, "full_sentence", "_sv", dims), "bracketed_text", "_bv", dims)
    else:
        encode = encoder_udf(factory)
        both = df.withColumn("_sv", encode("full_sentence")).withColumn("_bv", encode("bracketed_text"))
    return both.withColumn("embedding", compound(F.col("_sv"), F.col("_bv"))).drop("_sv", "_bv")


METADATA = ["sheet", "full_sentence", "bracketed_text", "label"]


def to_wide(df: DataFrame, dims: int, vector: str = "embedding", metadata: list[str] | None = None) -> DataFrame:
    """Export form: metadata first, then ``emb_0 … emb_{d-1}``. A vector of another length is an
    error, a null vector a row of nulls."""
    metadata = [c for c in METADATA if c in df.columns] if metadata is None else metadata
    length = F.size(F.col(vector))
    wrong = F.col(vector).isNotNull() & (length != dims)
    message = F.concat(F.lit(f"expected {dims} dimensions, found "), length.cast("string"))
    checked = F.when(wrong, F.raise_error(message).cast("array<float>")).otherwise(F.col(vector).cast("array<float>"))
    wide = df.withColumn(vector, checked)
    return wide.select(*metadata, *[F.get(vector, F.lit(i)).alias(f"emb_{i}") for i in range(dims)])


def vector_columns(columns: list[str], prefix: str = "emb_") -> list[str]:
    """Vector columns of a wide table, in column order."""
    return [c for c in columns if c.startswith(prefix)]


def from_wide(df: DataFrame, prefix: str = "emb_", vector: str = "embedding") -> DataFrame:
    """Fold ``emb_*`` columns into one array column."""
    wide = vector_columns(df.columns, prefix)
    rest = [c for c in df.columns if c not in wide]
    return df.select(*rest, F.array(*[F.col(c).cast("float") for c in wide]).alias(vector))
