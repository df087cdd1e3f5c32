"""The corpus pipeline: quality, near copies, benchmark passages, personal data, packing.

STAGES lists its stages; each takes (spark, docs, sf_dir) and returns a DataFrame. run()
writes each stage's result as Parquet to the shared folder and reads it back as the docs
of the next; what a stage stored on its way is deleted then. All but the last stage return
the columns of documents.

A row stays or goes as a whole, whatever other columns it has. Null texts count as empty.
Rows that share an id: quality judges each; near_duplicates compares the one with the least
text and keeps or drops all of them; decontamination drops all if one is hit; the other
stages treat each by itself. Rows without an id are only dropped for their quality. Empty
tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm import decontamination, jaccard_join, packing, pii, quality
from veldt.llm.common import crc_mod, drop_stored, scratch, stored_outside, table

#: Documents with a quality score below this are rejected.
LEAST_QUALITY = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network doesn't reject; null and empty texts have a score too.
    It learns from the labelled rows of the documents table that op1 learns from; without
    labels of both kinds it rejects all or, if there are only good ones or none, no document."""
    sample = quality.training_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0, "quality")
    return quality.passing(docs, quality.train(*sample), LEAST_QUALITY)


def keep_first_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more, that of least id.
    Texts without words, and rows without an id, are linked with none and stay."""
    found = jaccard_join.near_duplicates(docs)
    gone = found.where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window. Rows without an id can't be told apart and stay."""
    stretches = decontamination.overlaps(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(stretches.select(F.col("of_doc").alias("doc_id")).distinct(), "doc_id", "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced by its kind, n_chars brought up to date. Null
    texts stay null."""
    return pii.masked(docs, pii.fitted(docs))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a sequence, with its ids as little-endian unsigned 32-bit numbers. A
    null or empty text has the end's id alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_first_of_similar),
    ("decontamination", keep_uncontaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack_tokens),
]

#: No stage but decontamination can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs, path = stored_outside(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            drop_stored(spark, before)
        before = path
    return docs
