"""One query per operator over its whole table; :mod:`cartloom.llm.oracles` has the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.llm import (
    collocations, decontamination, html, language, lines, manifest, mixing, pieces, pii, quality, simhash, suffixes, urls
)
from cartloom.llm.tables import table

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(documents, table(spark, folder, "labels"))
    return quality.with_verdict(documents, model).select(
        "doc_id", *[f"quality.{c}" for c in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
        )]
    )


def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    found = html.extracted(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    """The key only serves the query; a user passes a secret one."""
    found = pii.with_pseudonyms(table(spark, folder, "documents").select("doc_id", "text"), b"a key for tests")
    return found.select("row.doc_id", "pii.*")


def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document and test item that was found in it; clean documents have none."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.with_hits(documents, table(spark, folder, "benchmark"))
    return found.select("row.doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def op5_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.deduplicated(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("rest")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("rest", 256).alias("kept_sha256"),
    )


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return lines.drop_lines(documents, lines.frequent_lines(documents)).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2("rest", 256).alias("kept_sha256")
    )


def op7_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """The tables hold no outcomes of pages, so the labels of equal number stand in for them."""
    labels = table(spark, folder, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 0)
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urls.judge(pages, outcomes, RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    learning = F.col("doc_id").isNotNull() & ~language.held_out(F.col("doc_id"))
    found = language.learn_and_predict(documents, learning)
    return found.select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"),
        "language.score", "language.accepted",
    )


def op9_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_copies(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.taken(documents).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op11_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = pieces.encoded(documents, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        "row.doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents").select("lang", "text"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Tampering, where 7 divides the CRC of the id, adds one to n_chars; a null id is never tampered with."""
    documents = table(spark, folder, "documents").select(*manifest.FIELDS)
    columns = {name: F.col(name) for name in manifest.FIELDS}
    changed = manifest.leaf((columns | {"n_chars": F.col("n_chars") + 1}).values())
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    own = manifest.leaf(columns.values())
    leaves = documents.select(
        "lang", "doc_id", own.alias("leaf"),
        F.struct("doc_id", F.when(chosen, F.unhex(changed)).otherwise(F.unhex(own)).alias("claimed")).alias("payload"),
    )
    found = manifest.verified(manifest.proofs(leaves), F.col("payload.claimed"))
    return found.select(
        "payload.doc_id", *[F.lower(F.hex(c)).alias(name) for c, name in (
            ("leaf", "leaf"), ("subroot", "subroot"), ("root", "root"), ("proof", "proof_sha256"), ("folded", "folded_root")
        )], (F.col("folded") == F.col("root")).alias("verified"),
    )


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_html_extraction": op2_html_extraction,
    "op3_pii": op3_pii,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_language_id": op8_language_id,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_mixing": op10_mixing,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_merkle_manifest": op13_merkle_manifest,
}
