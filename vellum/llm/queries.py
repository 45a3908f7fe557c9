"""Queries of the subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import alignment, bpe, kneser, lines, mixing, multiindex, passages, phrases, quality, simhash, subwords, toxicity, vectorcodes, wrapper
from vellum.llm.common import fold, table, text_of

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of each document's ids and of the bytes decoded from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    coded = bpe.decode(bpe.encode(docs, packed=True))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _classified(spark: SparkSession, sf_dir: str, kind, held_out) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = kind.fit(docs, labels.where(~held_out))
    scored = subwords.classify(docs.select("doc_id", "text"), model, kind.THRESHOLD)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learnt from the labels outside the held-out quarter."""
    return _classified(spark, sf_dir, toxicity, fold(2, 4))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document, learnt from the labels outside the held-out fifth."""
    return _classified(spark, sf_dir, quality, fold(0, 5))


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of each document."""
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without recurring lines, and how many it lost."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_recurring_lines(docs, dropped="n_dropped").select("doc_id", "n_dropped", "text")


ORACLE_SQL["op2_line_dedup"] = lines.SQL


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.taken(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query
def op5_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each document and of its edited text, and how alike they are."""
    return phrases.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of each document, learnt from the documents outside the held-out fifth."""
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), fold(1, 5)
    model = kneser.fit(docs.where(~held_out))
    scored = kneser.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "lm.n_tokens", "lm.n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "lm.base_score", "lm.score")


@query
def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return multiindex.search(vectors, vectors.where("vec_id % 50 = 0"))


@query
def op8_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    found = wrapper.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, error, error of its label and digest of the codebooks for each vector."""
    coded = vectorcodes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    digits = F.array_join(F.transform("code", lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))), "")
    return coded.select("vec_id", digits.alias("code"), "error", "label_error", "codebooks_sha256")


ORACLE_SQL["op13_vector_codes"] = vectorcodes.SQL


@query
def op12_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document, how many stand in passages that recur, and the digest of the others."""
    kept = passages.drop_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL["op12_fm_index"] = passages.SQL


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers over each document, and how common its links are."""
    return alignment.score_links(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
