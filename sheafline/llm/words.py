"""Words and rows as the operators of this package count them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_hash(key: Column) -> Column:
    """60 bits of the md5 of a key's decimal digits: an order that any engine can reproduce.

    A null key is hashed like the empty string.
    """
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores behind it as make it differ from all ``columns``."""
    while name in columns:
        name += "_"
    return name
