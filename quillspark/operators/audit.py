"""Integrity audits: what constraints would forbid in a database is counted here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBLEM, ADVICE = "problem", "advice"


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose key has no parent; null keys aren't orphans."""
    return child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys with more than one row, and how many."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def owner_mismatch(rows: DataFrame, owners: DataFrame, key: str, owner: str) -> DataFrame:
    """Rows whose reference exists but belongs to another owner."""
    held = owners.select(key, F.col(owner).alias("_owner"))
    return rows.join(held, key).filter(F.col("_owner") != F.col(owner)).withColumnRenamed("_owner", "actual_owner")


def finding(name: str, kind: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("finding"), F.lit(kind).alias("kind"), "n")


def doctor(t: dict[str, DataFrame], chunker_version: int) -> DataFrame:
    """All findings as ``finding, kind, n``.

    ``t`` has papers, identifiers, assets, attachments, chunks, terms, figures and index_rows. Drift
    that a rebuild mends is advice, everything else a problem.
    """
    papers = t["papers"]
    deleted = papers.filter("deleted_at is not null").select("paper_id")
    rows = [
        finding("orphan_assets", ADVICE, orphans(t["assets"], t["attachments"], "asset_id", "asset_id")),
        finding("orphan_attachments", PROBLEM, orphans(t["attachments"], papers, "paper_id", "paper_id")),
        finding("orphan_chunks", PROBLEM, orphans(t["chunks"], papers, "paper_id", "paper_id")),
        finding("orphan_terms", PROBLEM, orphans(t["terms"], papers, "paper_id", "paper_id")),
        finding("orphan_figures", PROBLEM, orphans(t["figures"], papers, "paper_id", "paper_id")),
        finding("orphan_index_rows", PROBLEM, orphans(t["index_rows"], papers, "paper_id", "paper_id")),
        finding("unindexed_papers", ADVICE, orphans(papers.filter("deleted_at is null"), t["index_rows"], "paper_id", "paper_id")),
        finding("figure_owner_mismatch", PROBLEM, owner_mismatch(t["figures"], t["attachments"], "attachment_id", "paper_id")),
        finding("duplicate_primaries", PROBLEM, duplicates(t["identifiers"].filter("is_primary"), "paper_id", "scheme")),
        finding("duplicate_identifiers", PROBLEM, duplicates(t["identifiers"], "scheme", "value")),
        finding("identifiers_on_deleted", PROBLEM, t["identifiers"].join(deleted, "paper_id", "left_semi")),
        finding("stale_chunks", ADVICE, t["chunks"].filter(F.col("chunker_version") != chunker_version)),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def file_audit(tracked: DataFrame, present: DataFrame, *, deep: bool = False) -> DataFrame:
    """Tracked files (path, size, sha256) against those present: ``path, state``.

    Sizes are compared first; digests only where sizes agree and the audit is deep.
    """
    a = tracked.select("path", F.col("size").alias("_size"), F.col("sha256").alias("_sha"), F.lit(True).alias("_t"))
    b = present.select("path", "size", *(["sha256"] if deep else []), F.lit(True).alias("_p"))
    j = a.join(b, "path", "full_outer")
    state = F.when(F.col("_p").isNull(), "missing").when(F.col("_t").isNull(), "untracked").when(F.col("_size") != F.col("size"), "size")
    if deep:
        state = state.when(F.col("_sha") != F.col("sha256"), "checksum")
    return j.withColumn("state", state).filter("state is not null").select("path", "state")


def coverage(live_papers: DataFrame, rows: DataFrame, key: str = "paper_id") -> DataFrame:
    """One row: live papers, papers with rows, rows."""
    n = live_papers.agg(F.count(F.lit(1)).alias("papers"))
    m = rows.join(live_papers.select(key), key, "left_semi").agg(F.count_distinct(key).alias("covered"), F.count(F.lit(1)).alias("rows"))
    return n.join(F.broadcast(m))  # one row each


def percentiles(rows: DataFrame, value: Column, *by: str) -> DataFrame:
    """p50 and p95 of a value, with least and greatest."""
    return rows.groupBy(*by).agg(
        F.percentile(value, 0.5).alias("p50"),
        F.percentile(value, 0.95).alias("p95"), F.min(value).alias("least"), F.max(value).alias("greatest"),
    )
