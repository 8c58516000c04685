"""The next step of every paper on its way to a verified summary, from facts alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.incremental import promotable
from quillspark.session import Scratch

# Statuses of a paper in the order in which it passes them, and the stages whose tasks they wait for.
STATUSES = ("pending_retrieval", "pending_extraction", "pending_appraisal", "pending_summary", "verification_failed", "completed")
STAGE_OF = {"pending_retrieval": "retrieve", "pending_extraction": "extract", "pending_appraisal": "appraise"}

Facts = dict[str, DataFrame]


def reuse(papers: DataFrame, own: DataFrame, pooled: DataFrame) -> DataFrame:
    """A run's own work with pooled work put in its place, where the paper allows it; rows are (evidence_id, ...) once each."""
    allowed = papers.filter("reuse and not force").select("evidence_id")
    taken = pooled.select(*own.columns).join(allowed, "evidence_id", "left_semi")
    return own.join(taken.select("evidence_id"), "evidence_id", "left_anti").unionByName(taken)


def plan(facts: Facts) -> DataFrame:
    """State of each paper: ``evidence_id, status, task_id, queue, skipped, errors``; one row a paper.

    ``papers``: evidence_id, ft_status, reuse, force, appraise, extract_only. ``extractions`` and ``pooled_extractions``: evidence_id, file_exists,
    file_evidence_id, basis. ``spans``: evidence_id, ok (of the extraction that counts). ``appraisals`` and ``pooled_appraisals``: evidence_id. ``summaries``:
    evidence_id, problems (number of faults in its shape). ``refs``: evidence_id, ok (span references of its claims). ``board``: task_id, status.

    A paper without a verified extraction waits for its text or for the extraction; forced ones always do. One with an extraction waits for
    its appraisal, unless that is skipped (only an abstract, or not wanted), then for its summary, and is then completed, or failed by
    faults of the summary. ``queue`` tells that the stage's task is to be put on the board: there is none, or it was cancelled.
    """
    papers = facts["papers"]
    extractions = reuse(papers, facts["extractions"], facts["pooled_extractions"])
    verified = promotable(extractions, facts["spans"]).filter("accepted").select("evidence_id", "basis", F.lit(True).alias("_extracted"))
    appraised = facts["appraisals"].select("evidence_id").unionByName(facts["pooled_appraisals"].join(papers.filter("reuse and not force"), "evidence_id", "left_semi").select("evidence_id")).distinct()
    broken = facts["refs"].filter("not coalesce(ok, false)").groupBy("evidence_id").agg(F.count(F.lit(1)).alias("_bad"))
    j = papers.join(verified, "evidence_id", "left").join(appraised.withColumn("_appraised", F.lit(True)), "evidence_id", "left")
    j = j.join(facts["summaries"].select("evidence_id", F.col("problems").alias("_problems")), "evidence_id", "left").join(broken, "evidence_id", "left")
    extracted = F.coalesce("_extracted", F.lit(False)) & ~F.col("force")
    skipped = F.when(F.coalesce("basis", F.lit("fulltext")) == "abstract_only", "abstract_only").when(~F.col("appraise"), "no_appraise_flag")
    errors = F.coalesce("_problems", F.lit(0)) + F.coalesce("_bad", F.lit(0))
    status = (
        F.when(~extracted & (F.coalesce("ft_status", F.lit("missing")) == "missing"), STATUSES[0]).when(~extracted, STATUSES[1]).when(F.col("extract_only"), STATUSES[5])
        .when(skipped.isNull() & F.col("_appraised").isNull(), STATUSES[2]).when(F.col("_problems").isNull(), STATUSES[3]).when(errors > 0, STATUSES[4]).otherwise(STATUSES[5])
    )
    stage = F.create_map(*[F.lit(x) for kv in STAGE_OF.items() for x in kv])
    rows = j.select(
        "evidence_id", status.alias("status"), F.when(extracted & ~F.col("extract_only"), skipped).alias("skipped"), F.when(status.isin("completed", "verification_failed") & ~F.col("extract_only"), errors).otherwise(0).cast("long").alias("errors")
    )
    rows = rows.withColumn("task_id", F.concat(stage[F.col("status")], F.lit(":"), F.col("evidence_id")))
    board = facts["board"].select("task_id", F.col("status").alias("_status"))
    met = rows.join(board, "task_id", "left")
    queue = F.col("task_id").isNotNull() & (F.col("_status").isNull() | (F.col("_status") == "cancelled"))
    return met.select("evidence_id", "status", "task_id", queue.alias("queue"), "skipped", "errors")


def run_to_end(facts: Facts, work: Callable[[DataFrame, Facts], Facts], scratch: Scratch) -> tuple[DataFrame, list[int]]:
    """Plan, let ``work`` do what is pending (given the plan and the facts, it gives new facts), and plan again until no status changes.

    Returns the last plan and how many papers changed in each round. It ends: a round counts only papers that moved on in the order of
    ``STATUSES``, there are six of these, and a round without such a paper is the last; so there are six rounds at most, however
    many papers there are and whatever the work does.
    """
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    before = scratch.table(plan(facts), "plan-0")
    moved: list[int] = []
    for k in range(1, len(STATUSES) + 1):
        facts = work(before, facts)
        now = scratch.table(plan(facts), f"plan-{k}")
        was = before.select("evidence_id", rank.alias("_was"))
        n = now.select("evidence_id", rank.alias("_is")).join(was, "evidence_id").filter("_is > _was").count()
        moved.append(n)
        before = now
        if n == 0:
            break
    return before, moved
