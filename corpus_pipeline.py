"""A corpus pipeline of five stages over `documents`: quality rules, near-duplicates, decontamination, secrets, BPE.

Each stage takes what its predecessor kept, written as Parquet and read again. The first three drop documents, the
fourth replaces secrets in the text, the last returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.llm import bpe, simhash
from tallymart.llm.common import free_name, read_table, stage
from tallymart.llm.decontamination import drop_contaminated
from tallymart.llm.quality import judge
from tallymart.llm.queries import vocabulary_path
from tallymart.llm.secrets import find_secrets, redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word rules and the compression bands."""
    verdict = free_name(docs, "_quality")
    return judge(docs, out=verdict).where(F.col(verdict)["kept"]).drop(verdict)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage of a twentieth of their words or more."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and `n_chars` counted anew where that changed the text."""
    spans = free_name(docs, "_secrets")
    marked = redact(find_secrets(docs, out=spans), secrets=spans)
    changed = F.when(F.size(spans) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return marked.withColumn("n_chars", changed).select(*docs.columns)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the length of the text that they decode to."""
    path = vocabulary_path()
    coded = bpe.decode(bpe.encode(docs, path), path)
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.char_length("decoded").cast("long").alias("n_decoded_chars"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("BPE tokens", bpe_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: Fingerprints, compression and token ids are beyond SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None
