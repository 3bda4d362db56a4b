"""The queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcintel.llm import kneser_ney, langid, lines, mixing, mjpeg, neardup, packing, repair, repetition, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(by: int) -> Column:
    """crc32 of doc_id as text, modulo."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % by


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = kneser_ney.train_and_score(docs, docs.where(_remainder(10) != 0))
    return found.select("doc_id", (_remainder(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.cleaned(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op4_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mjpeg.clips(_table(spark, sf_dir, "documents"))


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.score(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), docs.where(_remainder(3) != 1))
    return found.select("doc_id", (_remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op10_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.encode(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kneser_ney": op1_kneser_ney,
    "op2_lines": op2_lines,
    "op3_neardup": op3_neardup,
    "op4_mjpeg": op4_mjpeg,
    "op5_repetition": op5_repetition,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_langid": op9_langid,
    "op10_repair": op10_repair,
}

ORACLES: dict[str, str] = {}
