"""Training-data pipeline: five stages over ``documents``, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import langid, mixing, packing, secrets, simhash
from quillspark.llm.queries import public_tokenizer
from quillspark.session import Scratch, ship_package, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no text, no letter in it, or letters that no known language explains. A null lang becomes the predicted one, which the mixing weighs."""
    ship_package(spark)
    model = langid.train(docs, langid.public_pieces(public_tokenizer("piece_bpe_32k.model")))
    return langid.keep_identified(docs, model)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    ship_package(spark)
    return simhash.keep_one(docs, Scratch(spark, "pipeline-simhash"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked in the texts; no document goes."""
    return secrets.redact(docs, Scratch(spark, "pipeline-secrets"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the epochs that the budget of their source gives them."""
    return mixing.apply(docs, Scratch(spark, "pipeline-mixing"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences of 4096."""
    ship_package(spark)
    return packing.pack(docs, public_tokenizer("word_bpe_49k.json"), Scratch(spark, "pipeline-packing"), end_id=1, size=4096)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: The language model is fitted by expectation-maximisation, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to packed pieces."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.table(docs, name)
    return docs
