"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

The first four return the columns of documents: they drop rows (language, near-duplicates, contamination) or rewrite text
(personal data). The last encodes what is left. Null and empty texts have no letters, so they go at the first stage. Of
repeated rows one stays (near-duplicates); rows that share a doc_id are told apart by their texts. Extra columns pass
through the first four stages untouched, whatever their names. A stage's table is deleted when the next one is written, the
last when the driver ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.llm import decontam, lang_id, near_texts, pieces, pii
from sheafline.llm.base import discard, intermediate, remainder, stored, table, unused


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows without a letter, and rows that no learned language explains."""
    trained = lang_id.fit(docs, remainder("doc_id", 4) != 2)
    lang, score, bits = unused(docs, "lang_pred", "score", "bits")
    found = lang_id.predict(docs, trained, names=(lang, score, bits))
    strange = (F.col(bits) > lang_id.MAX_BITS) & (F.octet_length("text") >= lang_id.MAX_BITS_FROM)
    return found.filter((F.col(lang) != lang_id.UNDETERMINED) & ~strange).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts at a similarity of 0.8 or more of 5-word shingles."""
    return near_texts.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in text by its kind; n_chars follows the text."""
    clean = pii.redact(docs, pii.train(pii.sample(docs)))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled pieces of every document."""
    return pieces.encode(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("personal_data", redact_personal_data),
    ("sentencepiece", encode),
]

#: SQL cannot express trained models, SimHash or sampling; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            folder = intermediate(spark, name)
            docs = stored(docs, name, folder)
            if before:
                discard(spark, before)
            before = folder
    return docs
