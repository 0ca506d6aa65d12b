"""From raw documents to packed training sequences, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and reads it
again as the next stage's docs, so a lost executor costs at most the stage that runs. All stages but the last return the
columns of documents; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id, near_dedup, packing, secret_scan, substring_dedup
from tessera.llm.common import written
from tessera.llm.files import tokenizer_file, tokenizer_pattern
from tessera.session import spread


def _retexted(docs: DataFrame, before: DataFrame) -> DataFrame:
    """The columns of before, with n_chars counted anew."""
    if "n_chars" in before.columns:
        docs = docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(before.schema["n_chars"].dataType))
    return docs.select(*before.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language that the model knows; the others go."""
    model = language_id.fit(docs)
    found = language_id.identify(docs, model, host=F.col("source"))
    return found.where(F.col(found.columns[-1])).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: five-word shingles, similarity 0.8."""
    return near_dedup.drop_near_duplicates(docs, size=5, threshold=0.8)


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentence spans that an earlier document has."""
    return _retexted(substring_dedup.dedup(docs), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mask for each secret."""
    scanned = secret_scan.scan(docs, secret_scan.train(spark), path="source")
    return _retexted(scanned.withColumn("text", secret_scan.redacted(F.col("text"), F.col(scanned.columns[-1]))), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary length, with their ids."""
    pieces = packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), ranks=tokenizer_file("byte_bpe_50k.tiktoken"), pattern=tokenizer_pattern())
    return pieces.select("doc_id", "start", "length", "bucket", "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_spans),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL can't express the language model, the sketches, the forest or the tokenizer: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
