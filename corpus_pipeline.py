"""The corpus pipeline: each stage's result is written as Parquet and read as the next stage's documents.

Toxic documents go; one document of each near-duplicate group stays; contaminated documents go; secrets are masked; the
rest is encoded. All stages but the last return the columns of ``documents``, of which ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe import encode_documents
from graphloom.llm.common import staged, table, unpacked
from graphloom.llm.decontaminate import decontaminate
from graphloom.llm.ngram_join import keep_one_each
from graphloom.llm.queries import tokenizer_path
from graphloom.llm.secrets import redact
from graphloom.llm.toxicity import score, train

#: Near-duplicate stage: words of a shingle, and the least Jaccard similarity in percent.
SHINGLE_WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine rejects go. It is trained on the labelled documents of the input table."""
    machine = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return unpacked(score(docs, machine, keep=True).where("predicted = 0"), docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return keep_one_each(docs, SHINGLE_WORDS, PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return unpacked(decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=True).where("not contaminated"), docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret becomes a mark."""
    return redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text."""
    return encode_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

# The toxicity machine is no SQL; the tests hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
