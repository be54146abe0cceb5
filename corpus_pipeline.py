"""The corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, made, table
from tidemark.llm.ngram_join import one_of_each
from tidemark.llm.packing import pack
from tidemark.llm.pii import DEMO_KEY, anonymise
from tidemark.llm.quality import filter_quality
from tidemark.llm.suffix_dedup import without_repeats


#: Session setting with the key of the surrogates; without it they are made with a key for tests.
KEY_SETTING = "spark.tidemark.pii.key"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the smallest doc_id."""
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes and more that started earlier go from the texts; every document stays."""
    return without_repeats(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to surrogates; every document stays. The secret key is read from the session."""
    key = spark.conf.get(KEY_SETTING, None)
    done = anonymise(docs, key.encode() if key else DEMO_KEY)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("private_data", private_data), ("packing", packing)]
#: SQL can't express the tokenizer, nor byte-exact string dedup at reasonable cost; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is written before the next begins, and what it left behind is deleted then."""
    docs, scratch, last = table(spark, sf_dir, "documents"), Scratch(spark), None
    for name, stage in STAGES:
        before = len(made(spark))
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        while len(made(spark)) > before:
            made(spark).pop().clear()
        if last:
            scratch.drop(last)
        last = name
    return docs
