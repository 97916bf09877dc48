"""A training-data pipeline over the table of documents; part of the package ``sheafline.llm``.

Rejects bad documents by risk-controlled rules and by a classifier, keeps one document of each group
of near duplicates, mixes the sources to their target weights and encodes the mix into pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.llm import curriculum, quality_rules, setsketch, viterbi_scan, weak_labels
from sheafline.llm.words import table
from sheafline.session import materialize


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base conditions and the certified cutoffs keep."""
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer takes for good."""
    return weak_labels.classified(docs).filter("_kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return setsketch.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: documents in training order, as often as the mix takes them."""
    return curriculum.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every document of the stream."""
    encoded = viterbi_scan.encode(docs, viterbi_scan.share(spark))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("quality_classifier", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The sketches, the fitted scorer and the piece lattice are not SQL; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
