"""The corpus pipeline: quality classifier, line dedup, SimHash near-dedup, suffix-array dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each result
as Parquet in the shared folder and reads it for the next. All stages but the last return the columns of
documents, texts and n_chars as they then are.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import linededup, packing, quality, simhash, suffix
from dossier.llm.common import shared_dir, table
from dossier.llm.queries import BYTE_BPE, training_labels

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OTHERS = ("lang", "source")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of label 1."""
    model = quality.fit(docs, training_labels(spark, sf_dir))
    return quality.score(docs, model, keep=COLUMNS[1:]).filter("predicted = 1").select(*COLUMNS)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that 10 documents or more hold."""
    return linededup.dedup_lines(docs, keep=OTHERS).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return simhash.representatives(docs).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that stand elsewhere too; what is left of a character cut in two goes with them."""
    found = suffix.remove_repeated(docs, keep=OTHERS, whole_characters=True)
    return found.withColumn("text", F.col("kept").cast("string")).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1024 tokens."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path(BYTE_BPE)))


STAGES = [("quality_classifier", good_quality), ("line_dedup", without_common_lines), ("simhash_near_dedup", one_of_each_group), ("suffix_dedup", without_repeats), ("best_fit_packing", packed)]
#: The stages use a fitted model, XXH64 and a tokenizer, which SQL doesn't have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
