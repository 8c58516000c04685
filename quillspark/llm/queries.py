"""The queries of the training-data operators, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import divergence, html_style, imatch, langid, lines, mixing, negatives, neighbours, packing, repeats, secrets, simhash, tokens
from quillspark.llm.oracles import ORACLE_SQL
from quillspark.session import Scratch, ship_package, table


def public_tokenizer(name: str) -> str:
    """Place of a public tokenizer file on this machine; workers have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    scratch = Scratch(spark, "op1")
    uri = scratch.path("files")
    manifest = scratch.table(
        tokens.write_token_files(table(spark, sf_dir, "documents"), uri, public_tokenizer("word_bpe_49k.json"), 2), "manifest"
    )
    return tokens.read_token_files(spark, manifest, uri).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark, "op2"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"), Scratch(spark, "op3"), end_id=1, size=4096
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark, "op4"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_exact_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark, "op6")).drop("kept")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return html_style.main_text(table(spark, sf_dir, "pages"), Scratch(spark, "op7"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs, langid.public_pieces(public_tokenizer("piece_bpe_32k.model"))))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example", "n_spread")


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.drop_shared_lines(table(spark, sf_dir, "documents"), Scratch(spark, "op11"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), Scratch(spark, "op12"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), Scratch(spark, "op13"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_exact_repeats": op6_exact_repeats,
    "op7_main_text": op7_main_text,
    "op8_language_id": op8_language_id,
    "op9_secret_scan": op9_secret_scan,
    "op10_imatch": op10_imatch,
    "op11_line_dedup": op11_line_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_source_divergence": op13_source_divergence,
}

__all__ = ["ORACLE_SQL", "QUERIES", "public_tokenizer"]
