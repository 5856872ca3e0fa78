"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

Rows are whole documents (doc_id, text, lang, source, n_chars); the last stage turns them into token ids. Null ids
stay as they are; a null text is in no language and goes in the first stage. Columns that a stage does not use pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agroclime.llm import bpe, decontaminate, langid, near_dedup, pii
from agroclime.llm.queries import TOKENIZER, importable
from agroclime.llm.store import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that the model learned from their own lang column go; lang becomes the language identified, where it is missing or the model is sure of another."""
    return langid.keep_identified(docs, langid.fit(docs, "doc_id", "text", "lang"), lang_col="lang")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    gone = near_dedup.near_duplicates(docs).filter("not kept").select(F.col("id").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; n_chars follows the text."""
    return pii.redact_documents(docs, "text", "n_chars" if "n_chars" in docs.columns else None)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of the ids and of the decoded bytes."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, ["n_tokens", "ids", "ids_sha256", "decoded_sha256"])


STAGES = [
    ("language_crf", language),
    ("minhash_near_dedup", near_duplicates),
    ("simhash_decontamination", decontamination),
    ("pii_boosted", personal_data),
    ("bpe_tokens", tokens),
]

#: SQL has no trained language model, boosted trees or byte-pair merges; tests/llm compares run() with plain Python.
ORACLE_SQL = None


@importable
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
