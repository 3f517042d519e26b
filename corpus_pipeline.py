"""A corpus from raw documents: the stages of STAGES, each on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and reads nothing else of the documents than docs.
Rows count by themselves: null texts, null or repeated doc_ids and columns of any further
name are allowed, and each stage says what becomes of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatloom.llm import byte_bpe, decontaminate, ngram_join, pii, quality
from repeatloom.llm._staging import new_path, remove, remove_staged, stage, staged_so_far
from repeatloom.llm.queries import token_digests


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier predicts to be good, all columns unchanged.

    Null and empty texts are scored as empty ones, repeated rows go or stay together, very
    long texts are scored whole; an empty table stays empty; without labels all rows stay.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of each row, of its file and place there, so that all reads agree; and the key's name."""
    name = "__row"
    while name in docs.columns:
        name += "_"
    key = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(name)
    try:
        return docs.select("*", key), name
    except AnalysisException:  # not read from files
        return stage(docs).select("*", key), name


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row, of the smallest doc_id; a null one only where no row has another.

    Rows whose text is null or without words are in no group, and all stay. Repeated rows
    are a group, whether they share a doc_id or not. Columns are unchanged; very long texts
    are taken whole; an empty table stays empty.
    """
    keyed, row = _keyed(docs)
    found = ngram_join.near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text"))
    groups = found.select(F.col("doc_id").alias(row), "component_id").join(keyed.select(row, "doc_id"), row)
    keeper = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("at"))).alias("k")
    keepers = groups.groupBy("component_id").agg(keeper).select(F.col("k.at").alias(row))
    return keyed.join(keepers, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, all columns unchanged.

    Rows with a null or empty text hold none; repeated rows go or stay together; very long
    texts are searched whole; an empty table stays empty.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in their texts replaced by pseudonyms; n_chars, if there, follows the new text.

    A null text stays null, and so does its n_chars if the text has none; equal values have
    equal pseudonyms in all rows; very long texts are searched whole; an empty table stays
    empty. The key is that of the session, see ``pii.key_of``.
    """
    replaced = pii.pseudonymise(docs, pii.key_of(spark), count=None)
    if "n_chars" not in docs.columns:
        return replaced
    length = F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return replaced.withColumn("n_chars", length)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the encoded and decoded text of every row.

    A null text counts as empty; repeated rows give repeated rows, a null doc_id stays null;
    very long texts are encoded whole; an empty table gives an empty result.
    """
    return token_digests(byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]

#: The classifier's fit and the tokenizer can't be expressed in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's result is written as Parquet and read again.

    What a stage read and staged is removed once its result is written; the last result is
    removed when the driver ends.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, step in STAGES:
        path, mark = new_path(spark, "corpus"), staged_so_far()
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        remove_staged(spark, mark)
        if before:
            remove(spark, before)
        before = path
    return docs
