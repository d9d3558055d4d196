"""The corpus pipeline: documents in, clean encoded documents out.

Every stage takes what its predecessor kept: toxic documents go, one document of each group of near copies
stays, documents that hold a benchmark passage go, personal data is replaced in the text, and the rest is
encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dwellgrid.llm import decontamination, near_copies, pieces, pii, toxicity
from dwellgrid.llm.common import table
from dwellgrid.llm.queries import PIECES
from dwellgrid.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs, letters="n_chars")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, pieces.model_path(PIECES))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", replace_personal_data),
    ("sentencepiece", encode_pieces),
]
#: Trained scores, alignments and tokenizers are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
