"""Evidence tables: one row per study and outcome, tallies by outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import measures as M
from quillspark.functions import normalize as N

# Rank of an overall judgement, lower is better, and directions in their order.
RISK_RANK = {"low": 0, "yes": 0, "high quality": 0, "some_concerns": 2, "some concerns": 2, "moderate": 3, "unclear": 4, "serious": 5, "high": 5, "critical": 6, "critically_low": 6}
DIRECTIONS = ("favours_intervention", "favours_control", "no_difference", "mixed", "unclear")


def risk_rank(judgement: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in RISK_RANK.items() for x in kv])[F.lower(judgement)], F.lit(7))


def study_label(authors: Column, date: Column, title: Column, eid: Column) -> Column:
    first = F.nullif(F.substring_index(F.trim(F.try_element_at(authors, F.lit(1))), " ", 1), F.lit(""))
    year = N.year_of(date).cast("string")
    return F.coalesce(F.when(first.isNotNull(), F.concat(first, F.lit(" "), F.coalesce(year, F.lit("(year not stated)")))), M.clip(title, 48), eid.cast("string"))


def evidence_rows(records: DataFrame, extractions: DataFrame, appraisals: DataFrame) -> DataFrame:
    """Records with their extraction and appraisal, a row per outcome; without outcomes one row.

    The primary outcome is the first named ``primary``, else the one with the least p value, else the first.
    """
    x = extractions.select("evidence_id", "design", "n_total", "outcomes", F.col("evidence_basis").alias("basis"))
    a = appraisals.select("evidence_id", "tool", F.col("overall_judgement").alias("rob"))
    j = records.join(x, "evidence_id", "left").join(a, "evidence_id", "left")
    rows = j.select(
        "evidence_id", study_label(F.col("authors"), F.col("publication_date"), F.col("title"), F.col("evidence_id")).alias("label"),
        F.coalesce("design", F.lit(M.NOT_REPORTED)).alias("design"), "n_total", F.coalesce("rob", F.lit("not appraised")).alias("rob"),
        risk_rank(F.col("rob")).alias("rob_rank"), F.coalesce("basis", "ft_status").alias("basis"), F.posexplode_outer("outcomes").alias("position", "o"),
    )
    o = F.col("o")
    rows = rows.select(
        *[c for c in rows.columns if c != "o"], F.coalesce(o["name"], F.lit("no outcome extracted")).alias("outcome"), o["effect_measure"].alias("measure"), o["effect"].alias("effect"),
        o["ci_low"].alias("ci_low"), o["ci_high"].alias("ci_high"), o["p_value"].alias("p_value"), F.coalesce(o["direction"], F.lit("unclear")).alias("direction"),
        M.precision_class(o["effect"], o["ci_low"], o["ci_high"], o["effect_measure"]).alias("precision"),
    )
    w = Window.partitionBy("evidence_id").orderBy(F.contains(F.lower("outcome"), F.lit("primary")).desc(), F.asc_nulls_last("p_value"), F.asc_nulls_last("position"))
    return rows.withColumn("is_primary", F.row_number().over(w) == 1)


def outcome_tallies(rows: DataFrame) -> DataFrame:
    """Directions of each outcome, its largest study and its rows of low risk."""
    return rows.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col("direction") == d).alias(d) for d in DIRECTIONS],
        F.max_by("label", F.struct("n_total", "label")).alias("largest_study"), F.max("n_total").alias("largest_n"),
        F.array_sort(F.collect_set(F.when(F.col("rob_rank") <= 1, F.col("label")))).alias("low_risk"),
        F.count_if(F.col("precision") == "unreported").alias("without_interval"), F.count_if(F.col("basis") == "abstract_only").alias("abstract_only"),
    ).orderBy(F.desc("n_rows"), "outcome")


def quotes_of(studies: DataFrame, spans: DataFrame) -> DataFrame:
    """Quotes of each study: those re-sliced from verified spans, and the legacy ones without a span."""
    held = spans.filter("ok").groupBy("evidence_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "start", "end", "sliced"))).alias("verified"))
    legacy = F.filter("quotes", lambda q: q["source_id"].isNull() | q["start"].isNull())
    return studies.join(held, "evidence_id", "left").withColumn("legacy", legacy)


def kernel_view(verdicts: DataFrame) -> DataFrame:
    """Accepted and unresolved artifacts of each record by kind."""
    return verdicts.groupBy("evidence_id", "kind").agg(F.count_if(F.col("verdict") == "accepted").alias("accepted"), F.count_if(F.col("verdict") != "accepted").alias("unresolved"))


def completeness(records: DataFrame) -> DataFrame:
    """Warnings on what an export would lack: ``evidence_id, warnings``."""
    def none(c: str, text: str) -> Column:
        return F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", text)

    w = F.array_compact(F.array(none("title", "no title"), F.when(F.size("authors") < 1, "no authors"), none("publication_date", "no date"), none("journal", "no journal"), F.when(F.coalesce("pmid", "doi", "pmcid").isNull(), "no identifier")))
    return records.select("evidence_id", w.alias("warnings")).filter(F.size("warnings") > 0)
