"""From raw documents to token ids, in stages that are written and read again.

Language ID keeps documents in a known language, near-dedup one of each group of
documents with near fingerprints, substring dedup cuts passages that occur more than once, decontamination
drops documents with benchmark passages, and encoding turns what is left into tokens.
A stage works on all that the one before it kept, texts of any length as a whole; an empty
table passes through as one.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path as tokenizer_path

from moundworks.llm import bpe, decontamination, language, simhash, substrings
from moundworks.sources.store import drop_paths, durable, intermediates

TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; learned from those that name theirs. Texts that are
    null, without letters or unlike every language go; repeated rows stay or go together."""
    return language.in_known_language(docs, language.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that fingerprints within two bits connect, that with the
    smallest id (nulls last); of repeated rows one."""
    return simhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; n_chars is that of the new text. Null texts
    stay null, with the n_chars they had."""
    cut = substrings.without_passages(docs)
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; null and empty texts stay."""
    return decontamination.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of its round trip; null texts have none."""
    return bpe.encode_documents(docs, tokenizer_path(TOKENIZER), with_ids=True, carry=("lang", "source"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("bpe_encode", encode),
]

#: The stages learn a model, hash with XXH64 and merge byte pairs, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written and read again, and then
    what it wrote on the way, and its input if a stage wrote that, is dropped."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    spent: list[str] = []
    for _, stage in first:
        with intermediates(spark) as made:
            found = stage(spark, docs, sf_dir)
        with intermediates(spark) as kept:
            docs = durable(found)
        drop_paths(spark, spent + made)
        spent = kept
    return last(spark, docs, sf_dir)
