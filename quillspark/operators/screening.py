"""Screening: verdicts, agreement, flow of records through a review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DECISIONS = ("include", "exclude", "unclear")


def resolve_verdicts(verdicts: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Final decision of each record: adjudicated, of one screener, or unanimous; else null (pending).

    ``verdicts``: evidence_id, screener_id, decision, reason, criterion_failed, retraction_flag.
    """
    flags = F.when(F.col("retraction_flag") != "none", F.struct("screener_id", "retraction_flag"))
    own = verdicts.groupBy("evidence_id").agg(
        F.count_distinct("decision").alias("kinds"),
        F.min_by("decision", "screener_id").alias("first_decision"),
        F.min_by("reason", "screener_id").alias("first_reason"),
        F.min_by("criterion_failed", "screener_id").alias("criterion"),
        F.min(flags)["retraction_flag"].alias("flag"),
    )
    final = adjudications.select("evidence_id", F.col("final_decision").alias("_final"), F.col("rationale").alias("_why"))
    return own.join(final, "evidence_id", "left").select(
        "evidence_id",
        F.coalesce("_final", F.when(F.col("kinds") == 1, F.col("first_decision"))).alias("decision"),
        F.when(F.col("_final").isNotNull(), F.col("_why")).when(F.col("kinds") == 1, F.col("first_reason")).alias("reason"),
        "criterion",
        F.coalesce("flag", F.lit("none")).alias("retraction_flag"),
    )


def dual_screening(verdicts: DataFrame, a: str, b: str) -> DataFrame:
    """Records that both screeners judged: ``evidence_id, a, b``."""
    own = verdicts.filter(F.col("screener_id").isin(a, b)).groupBy("evidence_id").agg(
        F.max(F.when(F.col("screener_id") == a, F.col("decision"))).alias("a"),
        F.max(F.when(F.col("screener_id") == b, F.col("decision"))).alias("b"),
    )
    return own.filter("a is not null and b is not null")


def disagreements(pairs: DataFrame, adjudications: DataFrame, *, pending_only: bool = False) -> DataFrame:
    """Records on which the two screeners differ, and what was decided."""
    final = adjudications.select("evidence_id", "final_decision")
    out = pairs.filter("a <> b").join(final, "evidence_id", "left").withColumn("adjudicated", F.col("final_decision").isNotNull())
    return out.filter("not adjudicated") if pending_only else out


def agreement(pairs: DataFrame) -> DataFrame:
    """One row: n, raw agreement and Cohen's kappa; kappa is null where chance agreement is 1."""
    cells = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    total = cells.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    rows = cells.groupBy(F.col("a").alias("d")).agg(F.sum("c").alias("ra"))
    cols = cells.groupBy(F.col("b").alias("d")).agg(F.sum("c").alias("cb"))
    chance = rows.join(cols, "d").agg(F.coalesce(F.sum(F.col("ra") * F.col("cb")), F.lit(0)).alias("both"))
    po = F.col("same") / F.col("n")
    pe = F.col("both") / (F.col("n") * F.col("n"))
    # Two one-row frames meet here.
    return total.join(F.broadcast(chance)).select(
        "n",
        F.when(F.col("n") > 0, F.round(po, 4)).alias("raw_agreement"),
        F.when((F.col("n") > 0) & (F.abs(1 - pe) >= 1e-12), F.round((po - pe) / (1 - pe), 4)).alias("kappa"),
    )


def funnel(records: DataFrame) -> DataFrame:
    """Flow of a review in one aggregation.

    ``records``: merged_from, decision, ft_status, access_route, extraction_path,
    appraisal_path, retraction_status, is_preprint. Duplicates removed are absorbed ids.
    """
    c = F.col
    sought = c("decision") == "include"
    missing = c("ft_status") == "missing"
    got = sought & ~missing

    def n(cond, name: str):  # noqa: ANN001, ANN202
        return F.count_if(cond).alias(name)

    merged = F.coalesce(F.sum(F.greatest(F.size("merged_from"), F.lit(0))), F.lit(0))
    return records.agg(
        (F.count(F.lit(1)) + merged).alias("identified"),
        merged.cast("long").alias("duplicates_removed"),
        F.count(F.lit(1)).alias("after_dedupe"),
        n(c("decision").isNotNull(), "screened"),
        n(c("decision").isNull(), "not_yet_screened"),
        n(c("decision") == "exclude", "excluded"),
        n(c("decision") == "unclear", "unclear"),
        n(sought, "sought"),
        n(got, "obtained"),
        n(sought & missing & c("access_route").isNotNull(), "unobtainable"),
        n(sought & missing & c("access_route").isNull(), "not_attempted"),
        n(got & (c("ft_status") == "abstract_only"), "abstract_only"),
        n(got & c("extraction_path").isNotNull(), "with_extraction"),
        n(got & c("appraisal_path").isNotNull(), "with_appraisal"),
        n(got & (c("retraction_status") != "none"), "retracted"),
        n(got & c("is_preprint"), "preprints"),
    )


def exclusion_reasons(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """Excluded records by failed criterion; none given is ``unspecified``."""
    own = records.filter("decision = 'exclude'").join(resolved.select("evidence_id", "criterion"), "evidence_id", "left")
    return own.groupBy(F.coalesce("criterion", F.lit("unspecified")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def tier_histogram(records: DataFrame) -> DataFrame:
    """Acquisition tiers 0 to 8, empty ones too, and records never tried or of unknown tier."""
    kind = (
        F.when(F.col("source_tier").isNotNull(), F.col("source_tier").cast("string"))
        .when(F.col("access_route").isNull(), "not_attempted")
        .otherwise("unknown")
    )
    counts = records.groupBy(kind.alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    spark = records.sparkSession
    dense = spark.range(9).select(F.col("id").cast("string").alias("tier")).unionByName(
        spark.createDataFrame([("not_attempted",), ("unknown",)], "tier string")
    )
    return dense.join(counts, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


def apply_verdicts(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """Records with their decisions; a retraction flag of a screener sticks."""
    own = resolved.select("evidence_id", F.col("decision").alias("_d"), F.substring("reason", 1, 300).alias("_r"), F.col("retraction_flag").alias("_f"))
    return (
        records.join(own, "evidence_id", "left")
        .withColumn("decision", F.coalesce("_d", "decision"))
        .withColumn("reason", F.when(F.col("_d").isNotNull(), F.col("_r")).otherwise(F.col("reason")))
        .withColumn("retraction_status", F.when(F.coalesce("_f", F.lit("none")) != "none", F.col("_f")).otherwise(F.col("retraction_status")))
        .drop("_d", "_r", "_f")
    )


def screening_views(records: DataFrame) -> dict[str, DataFrame]:
    """Named views of a review run."""
    sought = records.filter("decision = 'include'")
    return {
        "included": sought.filter("ft_status <> 'missing'"),
        "quarantined": sought.filter("ft_status = 'missing' and access_route is not null"),
        "not_attempted": sought.filter("ft_status = 'missing' and access_route is null"),
        "abstract_only": sought.filter("ft_status = 'abstract_only'"),
    }


def latest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Last row of each key in the order of a sequence number."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
