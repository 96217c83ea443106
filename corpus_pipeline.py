"""From raw documents to packed sequences: five stages, each written and read again."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedledger.llm import language, mixing, near_copies, packing, pii
from feedledger.llm.shared import new_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough, ``lang`` set to it. The labelled documents
    themselves fit the text model; a document's own label counts as its declared language."""
    return language.keep_identified(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of 0.8 or more), the
    document with the smallest id."""
    return near_copies.drop_near_copies(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    clean = pii.redact_pii(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, dealt into shuffled shards."""
    return mixing.shuffled(mixing.mix(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 token ids."""
    return packing.pack_documents(docs)


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("pii", redact_pii),
          ("mixing", mix_sources), ("packing", pack)]

#: The language model, fingerprints and tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
