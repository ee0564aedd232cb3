"""The registered queries of this subpackage: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.llm import alignment, bpe, oracles, packing, simhash, token_files, warc
from tallymart.llm.collocations import mine_phrases
from tallymart.llm.common import read_table
from tallymart.llm.decontamination import find_contamination
from tallymart.llm.licenses import TEMPLATES, find_licenses, template_table
from tallymart.llm.quality import judge
from tallymart.llm.reputation import judge_urls
from tallymart.llm.secrets import BASE_KINDS, find_secrets, listed
from tallymart.llm.suffix_dedup import remove_repeats

VOCABULARY, END_ID = "word_bpe_49k.json", 2
#: Of packing, and of the two sides of the alignment.
PACKED_VOCABULARY, PACKED_END_ID = "byte_bpe_50k.json", 0
SIDES = ("byte_bpe_50k.json", "piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES = oracles.ORACLES


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def joined_sha256(parts: Column, separator: str = ",") -> Column:
    return F.sha2(F.concat_ws(separator, parts), 256)


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.col("items").cast("array<string>"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        joined_sha256(items).alias("items_sha256"), "contaminated",
    )


@query
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"),
    )


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
             "ratio", "n_chunks", "n_bad_chunks")
    return judged.select("doc_id", *[F.col("quality")[n].alias(n) for n in names])


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_files.read_tokens(token_files.write_tokens(docs, vocabulary_path(), END_ID))


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, vocabulary_path()), vocabulary_path())
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        joined_sha256(F.col("ids").cast("array<string>"), " ").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(read_table(spark, sf_dir, "documents"), template_table(spark, TEMPLATES))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.concat_ws(",", "licenses").alias("licenses"),
    )


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))
    return judged.drop("upper")


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(read_table(spark, sf_dir, "pages"))
    return warc.read_warc(manifest, with_payload=False).drop("url", "payload")


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(read_table(spark, sf_dir, "documents"))


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    pieces = packing.cut_pieces(docs, vocabulary_path(PACKED_VOCABULARY), PACKED_END_ID)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = alignment.align(read_table(spark, sf_dir, "documents"), *map(vocabulary_path, SIDES))
    return done.withColumnRenamed("digest", "groups_sha256")
