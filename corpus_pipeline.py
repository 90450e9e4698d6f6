"""A training corpus from raw documents, stage by stage.

run() applies STAGES to the documents table. Every stage takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.llm.common import table, written
from threadline.llm.decontaminate import drop_contaminated
from threadline.llm.pii import fit_pii, redact_docs
from threadline.llm.quality_classifier import document_statistics, fit_quality, keep_good
from threadline.llm.queries import tokenizer_path
from threadline.llm.sentencepiece_wfst import encode_checked, load_transducer
from threadline.llm.simhash import near_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    stats = written(document_statistics(docs), "statistics")
    return keep_good(docs, fit_quality(stats, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a phrase of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    out = redact_docs(docs, fit_pii(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, pieces, exact): piece ids, and whether they decode to the text again."""
    return encode_checked(docs, load_transducer(tokenizer_path("piece_bpe_32k.model")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("sentencepiece", sentence_pieces),
]

#: No SQL expresses the learnt stages; tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
