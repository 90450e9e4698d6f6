"""The registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .common import table
from .decontaminate import contamination
from .license_scan import scan_licences
from .oracle import OP1_SQL, OP3_SQL, OP4_SQL, OP5_SQL, OP12_SQL, OP13_SQL
from .pii import KINDS as PII_KINDS
from .pii import fit_pii, pii_spans
from .quality_classifier import classify_quality
from .quality_rules import quality_rules
from .secret_scan import KINDS as SECRET_KINDS
from .secret_scan import fit_secrets, secret_spans
from .sentencepiece_wfst import load_transducer, round_trip
from .simhash import simhash_components
from .token_output import shared_shards, token_index
from .url_filter import Rule, filter_urls, link_heavy
from .warc import round_trip as warc_round_trip
from .whitening import whiten


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file; they are read where they lie, never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer_json = f.read()
    return token_index(shared_shards(table(spark, sf_dir, "documents"), tokenizer_json))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: every source is a root with two levels of folders, and every
    tenth document is the licence file of its folder (of the root, for every twentieth)."""
    of = lambda n: F.pmod(F.floor(F.col("doc_id") / n), F.lit(7)).cast("string")
    is_file = F.pmod("doc_id", F.lit(10)) == 0
    path = (
        F.when(F.pmod("doc_id", F.lit(20)) == 0, F.concat_ws("/", F.coalesce("source", F.lit("")), F.lit("LICENSE")))
        .when(is_file, F.concat_ws("/", F.coalesce("source", F.lit("")), of(10), F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", F.coalesce("source", F.lit("")), of(10), of(70), F.concat("doc_id", F.lit(".txt"))))
    )
    return scan_licences(table(spark, sf_dir, "documents"), path, F.col("path").endswith("/LICENSE"))


#: The rules that the query asks for.
URL_RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
#: Words of host names that put a host on the block list, beside the hosts that hold more links than paragraphs.
BLOCKED_WORDS = ("ads-track", "adult", "casino", "cheap-pills", "free-bets", "spam")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, link_heavy(pages, BLOCKED_WORDS), URL_RULES)


def _span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts of the rule spans by kind, the digest of those, and all spans as text."""
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _span_digest(pii_spans(docs, fit_pii(docs)), PII_KINDS)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), load_transducer(tokenizer_path("piece_bpe_32k.model")))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _span_digest(secret_spans(docs, fit_secrets(docs)), SECRET_KINDS)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_token_binary_output, op3_quality_rules, op4_license_scans, op5_url_filters, op6_pii, op7_quality_classifier, op8_sentencepiece, op9_secret_scans,
        op10_simhash_near_dedup, op11_embedding_whitening, op12_warc, op13_phrase_collocations,
    )
}
ORACLE_SQL = {
    "op1_benchmark_decontamination": OP1_SQL, "op3_quality_rules": OP3_SQL, "op4_license_scans": OP4_SQL, "op5_url_filters": OP5_SQL, "op12_warc": OP12_SQL, "op13_phrase_collocations": OP13_SQL,
}
