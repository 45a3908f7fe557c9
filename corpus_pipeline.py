"""A corpus pipeline of operators of the llm subpackage: from documents to token ids.

Each stage takes what its predecessor kept and returns the columns of documents, the last one token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bpe, lines, mixing, quality, shingles, simhash
from vellum.llm.common import fold, table, text_of


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from labels outside the held-out fifth."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~fold(0, 5)))
    return quality.subwords.keep(docs, model, quality.THRESHOLD)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that recur across them."""
    return _counted(lines.drop_recurring_lines(docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash first, then what shares 0.8 of its five-word shingles."""
    return shingles.keep_one(simhash.keep_one(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return _counted(mixing.mixed(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian, 32 bits), and the digest of the bytes decoded from them."""
    coded = bpe.decode(bpe.encode(docs.withColumn("text", text_of()), packed=True))
    tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return coded.select("doc_id", "lang", "source", tokens, "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("quality_classifier", classify_quality),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]
#: A fitted classifier and pseudorandom draws have no SQL form; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
