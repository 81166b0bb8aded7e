"""Corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

 1. quality rules: documents that fail the fixed rules or the robust outlier test go;
 2. SimHash near-dedup: of every group of near duplicates one document stays;
 3. secret scan: every secret is replaced by a mark, n_chars follows;
 4. mixing: sources are taken towards their target weights, a document 0, 1 or 2 times;
 5. byte-level BPE: every text taken is encoded, and decoded again.

All stages but the last return the columns of documents. Nulls, empty and repeated rows, extra columns and an empty
table are handled as the operators' own docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import mcd_quality, pivotal, prefix_bpe, secrets_crf, simhash
from sparkloom.llm.common import drop_staged, stage, table
from sparkloom.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mcd_quality.filter_documents(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, shingle=3, distance=2)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets_crf.redact(docs, secrets_crf.fit(docs), chars_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    numbered = stage(docs.withColumn("__mix_row", F.monotonically_increasing_id()), "numbered", compression="zstd")
    sized = pivotal.sizes(numbered, row_col="__mix_row")
    mixed = pivotal.mix(sized, pivotal.targets(sized, weights=(3, 1, 2), share=1.5, cap=2.0))
    return pivotal.mixed_rows(numbered, mixed, "__mix_row")


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = prefix_bpe.encode(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_dedup),
    ("secret scan", secret_scan),
    ("mix sources", mix_sources),
    ("byte-level bpe", encode_bpe),
]

#: Trained models, seeded draws and byte-pair merges aren't SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        before, docs = docs, stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_staged(before)  # a stage's input isn't needed once its output is written
    return STAGES[-1][1](spark, docs, sf_dir)
