"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embedding_dedup, jaccard_join, license_scan, packing, pii, quality, substring_dedup, toxicity, warc
from .common import crc_mod, table
from .oracles import ORACLES


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = quality.train(*quality.training_sample(docs, labels, crc_mod(F.col("doc_id"), 5) != 0, "quality"))
    return quality.scored(docs, net).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    warc.register(spark)
    path = warc.fresh_path(spark)
    warc.archived(table(spark, sf_dir, "pages"), path)
    return warc.catalogue(spark, path)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.personal_data(docs, pii.fitted(docs))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["finish"])), ",")
    rank = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, pii.KINDS)), s["kind"]).alias("place"), s["finish"].alias("finish"), s["kind"].alias("kind"))
    every = F.array_sort(F.transform(F.concat("base", "added"), rank))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(every).alias("spans"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    bags, marks = quality.training_sample(docs, labels, crc_mod(F.col("doc_id"), 3) != 1, "toxic", rows=toxicity.TRAIN_ROWS, sent=toxicity.sent_bags)
    machine = toxicity.train_bags(toxicity.received_bags(bags), marks)
    return toxicity.scored(docs, machine).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_packing": op2_packing,
        "op3_warc": op3_warc,
        "op4_decontamination": op4_decontamination,
        "op5_pii": op5_pii,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_toxicity": op7_toxicity,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_license_scan": op10_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
