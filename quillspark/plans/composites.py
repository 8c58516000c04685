"""Composite plans: library search, and retrieval with verified passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import measures as M
from quillspark.functions import text as T
from quillspark.operators import entities, provenance, search
from quillspark.operators.audit import doctor
from quillspark.plans.adapters import entity
from quillspark.session import Scratch, table


def library_search(
    papers: DataFrame,
    notes: DataFrame,
    vectors: DataFrame,
    *,
    years: tuple[int, int] | None = None,
    journal: str | None = None,
    terms: list[str] | None = None,
    tag: str | None = None,
    min_rating: int | None = None,
    similar_to: int | None = None,
    limit: int = 50,
) -> DataFrame:
    """Facets, annotations, keywords, then similarity, as one plan; columns appear only when asked for."""
    out = search.filter_papers(papers.filter("deleted_at is null"), journal=journal, years=years)
    if tag is not None or min_rating is not None:
        out = search.filter_annotations(out, notes, tag=tag, min_rating=min_rating, key="paper_id")
    shown = [F.col("paper_id"), F.col("title"), F.col("journal")]
    if terms:
        out = search.keyword_filter(out, F.col("text"), terms)
        shown.append(M.snippet([F.col("title"), F.col("text")], terms).alias("snippet"))
    if similar_to is None:
        return out.select(*shown).orderBy("paper_id").limit(limit)
    target = vectors.filter(F.col("evidence_id") == similar_to).select(F.col("vector").alias("_t")).limit(1)
    near = vectors.filter(F.col("evidence_id") != similar_to).join(F.broadcast(target)).select(F.col("evidence_id").alias("paper_id"), search.cosine(F.col("vector"), F.col("_t")).alias("score"))
    return out.join(near.filter("score is not null"), "paper_id").select(*shown, F.round("score", 6).alias("score")).orderBy(F.desc("score"), "paper_id").limit(limit)


def retrieve(spark: SparkSession, d: str, *, k: int = 5, per_paper: int = 2, depth: int = 40, hits: int = 160) -> DataFrame:
    """For each question: papers by fused lexical and semantic ranks, with passages verified against snapshots.

    Questions are the benchmark's items. Lexical ranks are BM25 over chunks, best chunk per paper;
    the question's vector is the one that its number names. Passages are re-sliced from snapshots, and
    only those whose digests hold are shown.
    """
    scratch = Scratch(spark, "retrieve")
    sources = entity(spark, d, "sources").withColumn("content_hash", provenance.content_hash(F.col("text")))
    chunks = scratch.table(search.chunk_table(sources).withColumn("doc", F.concat_ws("#", "source_id", "start")), "chunks")
    asked = table(spark, d, "benchmark")
    terms = search.query_terms(asked, F.col("text"), query="item_id")
    scored = search.bm25_of_each(chunks, F.col("text"), terms, doc="doc", k=hits)
    ranked = scratch.table(search.top(scored.withColumn("score", F.round("score", 9)), hits), "ranked")
    placed = ranked.join(chunks.select("doc", "paper_id", "source_id", "start", "end"), "doc")
    lexical = search.best_chunk_per_paper(placed, depth, hits)
    vectors = entity(spark, d, "vectors")
    q = asked.select("item_id", F.col("item_id").alias("evidence_id")).join(vectors, "evidence_id").select(F.col("item_id").alias("query"), "vector")
    semantic = search.nearest_of_each(vectors.select(F.col("evidence_id").alias("id"), "vector"), q, depth, itself=False)
    legs = [lexical.select("query", F.col("paper_id").alias("id"), "rank", F.lit("lexical").alias("leg")), semantic.select("query", F.col("doc").alias("id"), "rank", F.lit("semantic").alias("leg"))]
    fused = search.top(search.fuse(*legs).withColumn("score", F.round("score", 9)), k, tie="id").select("query", F.col("id").alias("paper_id"), F.col("rank").alias("place"), "score", "found_by")
    snaps = entity(spark, d, "sources").select("source_id", F.col("url"), F.lit("full_text").alias("access"), "text")
    ids = snaps.select(F.col("source_id").alias("source"), provenance.source_id(F.col("url"), F.col("text")).alias("source_id"), provenance.content_hash(F.col("text")).alias("content_hash"), "url", "access", "text")
    spans = placed.join(fused.select("query", "paper_id", "place", "score", "found_by"), ["query", "paper_id"])
    # Texts of other sources stay where they are: the questions' best papers are few, whatever the number of sources.
    ids = ids.join(F.broadcast(spans.select(F.col("source_id").alias("source")).distinct()), "source", "left_semi")
    spans = spans.withColumnRenamed("source_id", "source").drop("text").join(ids.select("source", "source_id"), "source").withColumn("access", F.lit("full_text")).withColumn("excerpt", F.lit(None).cast("string")).drop("score").join(fused.select("query", "paper_id", "score"), ["query", "paper_id"])
    checked = provenance.verify_spans(spans, ids.drop("source"))
    best = search.passages(checked.withColumn("hit_rank", F.col("rank")).select("query", "paper_id", "rank", "ok", "start", "end", "sliced").withColumnRenamed("sliced", "passage"), per_paper)
    return fused.join(best.select("query", "paper_id", F.col("place").alias("passage_no"), "start", "end", "passage"), ["query", "paper_id"], "left").select(
        "query", "place", "paper_id", "score", F.array_join("found_by", "+").alias("found_by"), "passage_no", "start", "end", "passage"
    )


def doctor_and_reindex(tables: dict[str, DataFrame], sources: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings, and the chunk table after an incremental run."""
    return doctor(tables, T.CHUNKER_VERSION), search.reindex(sources, chunks)


def rebuild_indexes(records: DataFrame) -> dict[str, DataFrame]:
    """Relational mirror and metadata postings of registry records, in one pass each."""
    t = entities.mirror(records)
    text = F.concat_ws(" ", "title", "journal", "abstract")
    return t | {"postings": search.postings(t["papers"], text, doc="paper_id", stem=True)}
