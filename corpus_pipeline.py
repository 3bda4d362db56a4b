"""A corpus pipeline: five stages, each a function (spark, docs, sf_dir) -> the documents that it keeps.

language ID -> line dedup -> MinHash near-dedup -> mixing -> packing. All but the last return the columns of
documents. Every stage reads all rows that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcintel.llm import langid, lines, mixing, neardup, packing
from srcintel.llm.shared import keyed, mark, named, release
from srcintel.storage import place

#: A document goes if no language holds this share of its words.
LEAST_LANGUAGE_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of which no language holds half of the words, go; lang becomes what was found.

    The model learns from the texts and langs of the stage's own input."""
    model = langid.model(langid.train(docs))
    plain, names = keyed(docs, text="string")
    found = langid.predict(plain, *model, id_columns=tuple(f"c{k}" for k in range(len(names))))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SHARE))
    return named(kept, names, lang=F.col("lang_pred"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-equal lines one occurrence stays; documents left without a word go. n_chars follows the text."""
    return lines.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    kept = neardup.classes(docs).where("keep").select("_k1", "_k2").distinct()
    plain, names = keyed(docs)
    # rows equal in all columns have one key: any one of them stays
    return named(plain.join(kept, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]), names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times. Documents without words go."""
    plain, names = keyed(docs)
    sized = keyed(docs, text="string", source="string")[0].select("_k1", "_k2", "text", "source")
    copies = mixing.mix(sized, ids=("_k1", "_k2")).groupBy("_k1", "_k2").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    # rows equal in all columns have one key and are taken together
    taken = plain.dropDuplicates(["_k1", "_k2"]).join(copies, ["_k1", "_k2"])
    return named(taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 ids."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]

#: The stages can't be put in SQL; tests/llm/test_whole.py compares each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's output written as Parquet and read again. What a stage itself has written on the way is deleted
    when its output is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    outputs = [place(spark, f"pipeline-{name}") for name, _ in STAGES]
    for (_, stage), at in zip(STAGES, outputs):
        since = mark()
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        release(since)
    return docs
