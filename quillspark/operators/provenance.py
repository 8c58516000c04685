"""Snapshots, spans, freshness, and the verdicts built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONGEST_SPAN = 2000
# Access from the weakest on, event types that may be fresh, first-failure order of an
# artifact, and the vocabulary of each appraisal tool: judgements, overall (values or a pattern),
# domain groups, number of domains, target type.
ACCESS = ("web", "abstract", "preprint", "guideline", "full_text")
EVENT_TYPES = ("fetch", "local_pdf", "register", "read")
FRESH_TYPES = ("fetch", "local_pdf")
CHECK_ORDER = ("span", "paper", "url", "fresh", "verdict")
APPRAISAL_TOOLS = (
    ("RoB2", ("low", "some_concerns", "high", "unclear"), "^(low|some_concerns|high|unclear)$", (), 5, ""),
    ("ROBINS-I", ("low", "moderate", "serious", "critical", "unclear"), "^(low|moderate|serious|critical|unclear)$", (), 7, ""),
    ("Newcastle-Ottawa", ("yes", "no"), r"^\d{1,2}/9$", (), None, ""),
    ("AMSTAR-2", ("yes", "partial_yes", "no", "unclear"), "^(high|moderate|low|critically_low)$", (), 16, ""),
    ("QUADAS-2", ("low", "high", "unclear"), "^(low|high|unclear)$", ("risk_of_bias", "applicability"), 7, "index_test"),
    ("PROBAST", ("low", "high", "unclear"), "^(low|high|unclear)$", ("risk_of_bias", "applicability"), 7, "prediction_model"),
    ("CASP-qualitative", ("yes", "partial_yes", "no", "unclear"), r"^\d{1,2}/10$", (), 10, ""),
    ("JBI-prevalence", ("yes", "no", "unclear"), r"^\d{1,2}/9$", (), 9, ""),
    ("JBI-cross-sectional", ("yes", "no", "unclear"), r"^\d{1,2}/8$", (), 8, ""),
)


def source_id(url: Column, text: Column) -> Column:
    """Identity of a snapshot: digest of url, a zero byte, and text."""
    return F.concat(F.lit("src-"), F.sha2(F.concat(url.cast("binary"), F.lit(bytearray(1)), text.cast("binary")), 256))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def integrity(snapshots: DataFrame) -> DataFrame:
    """Snapshots with ``intact``: both digests are computed again."""
    ok = (source_id(F.col("url"), F.col("text")) == F.col("source_id")) & (content_hash(F.col("text")) == F.col("content_hash"))
    return snapshots.withColumn("intact", F.coalesce(ok, F.lit(False)))


def verify_spans(spans: DataFrame, snapshots: DataFrame, *, strict_access: bool = False) -> DataFrame:
    """Each span with ``ok, reason_code, sliced, warning``; the first failing rule names the reason.

    ``spans``: source_id, start, end, access, excerpt (null: nothing to compare), and what else it has.
    ``snapshots``: source_id, content_hash, url, access, text.
    """
    own = integrity(snapshots).select("source_id", F.col("access").alias("_access"), F.col("text").alias("_text"), "intact")
    j = spans.join(own, "source_id", "left")
    length = F.col("end") - F.col("start")
    inside = (F.col("start") >= 0) & (length > 0) & (F.col("end") <= F.length("_text"))
    sliced = F.substring(F.col("_text"), F.col("start") + 1, length)
    differs = F.col("access").isNotNull() & (F.col("access") != F.col("_access"))
    reason = (
        F.when(F.col("_text").isNull(), "UNKNOWN_SOURCE")
        .when(~F.col("intact"), "SNAPSHOT_HASH_MISMATCH")
        .when(~F.coalesce(inside, F.lit(False)), "SPAN_OUT_OF_RANGE")
        .when(length > LONGEST_SPAN, "SPAN_TOO_LONG")
    )
    if strict_access:
        reason = reason.when(differs, "SCHEMA_ERROR")
    reason = reason.when(F.col("excerpt").isNotNull() & (F.col("excerpt") != sliced), "EXCERPT_MISMATCH")
    out = j.withColumn("reason_code", reason)
    fine = F.col("reason_code").isNull() | (F.col("reason_code") == "EXCERPT_MISMATCH")
    return (
        out.withColumn("ok", F.col("reason_code").isNull())
        .withColumn("sliced", F.when(fine, sliced))
        .withColumn("warning", F.when(fine & differs, "access differs from the snapshot's"))
        .drop("_access", "_text", "intact")
    )


def fresh_events(events: DataFrame, snapshots: DataFrame, run_start: Column, assets: DataFrame | None = None) -> DataFrame:
    """The first event in file order that makes each source fresh: ``source_id, event_id``.

    All must hold on one event: type, fresh flag, not before the run's start, and the digest that
    the text (or for a local file the asset) has now. Without a start nothing is fresh.
    """
    own = integrity(snapshots).filter("intact").select("source_id", F.sha2("text", 256).alias("_text_digest"), F.lit(None).cast("string").alias("_asset_digest"))
    if assets is not None:
        own = own.drop("_asset_digest").join(assets.select("source_id", F.col("sha256").alias("_asset_digest")), "source_id", "left")
    j = events.filter(F.col("type").isin(*FRESH_TYPES) & F.col("fresh")).filter(F.col("at") >= run_start).join(own, "source_id")
    same = F.when(F.col("type") == "fetch", F.col("sha256") == F.col("_text_digest")).otherwise(F.col("sha256") == F.col("_asset_digest"))
    return j.filter(same).groupBy("source_id").agg(F.min_by("event_id", "seq").alias("event_id"))


def stale_sources(cited: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cited sources that nothing made fresh."""
    return cited.select("source_id").distinct().join(fresh, "source_id", "left_anti")


def weakest_access(access: Column) -> Column:
    """Weakest access of a group, as an aggregate."""
    place = F.array_position(F.array(*[F.lit(a) for a in ACCESS]), access)
    return F.min_by(access, F.when(place > 0, place))


def assemble(artifacts: DataFrame, checks: DataFrame) -> DataFrame:
    """Verdict of each artifact: accepted, or the reason of its first failing check.

    ``artifacts``: artifact_id, kind, evidence_id. ``checks``: artifact_id, check (one of
    CHECK_ORDER), ok, reason, access. An artifact without any span check is unverified.
    """
    place = F.array_position(F.array(*[F.lit(c) for c in CHECK_ORDER]), F.col("check"))
    own = checks.groupBy("artifact_id").agg(
        F.min_by("reason", F.when(~F.col("ok"), F.struct(place.alias("p"), F.col("reason").alias("r")))).alias("reason"),
        F.count_if(F.col("check") == "span").alias("spans"),
        F.count_if(~F.col("ok")).alias("failed"),
        weakest_access(F.col("access")).alias("access"),
    )
    j = artifacts.join(own, "artifact_id", "left")
    verdict = F.when(F.coalesce("spans", F.lit(0)) == 0, "unverified").when(F.col("failed") > 0, "rejected").otherwise("accepted")
    reason = F.when(verdict == "unverified", "NO_SPANS").when(verdict == "rejected", F.col("reason"))
    return j.withColumn("verdict", verdict).withColumn("reason", reason).drop("spans", "failed")


def assembler_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def store_stats(snapshots: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of snapshots (one row), and of events by type, empty types too."""
    one = integrity(snapshots).agg(
        F.count(F.lit(1)).alias("snapshots"), F.count_if("intact").alias("intact"), F.count_if(~F.col("intact")).alias("tampered"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"),
    )
    spark = events.sparkSession
    kinds = spark.createDataFrame([(t,) for t in EVENT_TYPES], "type string")
    counts = events.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("fresh"), F.col("source_id"))).alias("fresh_sources"))
    return one, kinds.join(counts, "type", "left").na.fill(0)


def appraisal_problems(appraisals: DataFrame) -> DataFrame:
    """Appraisals that break the rules of their tool: ``evidence_id, problems``.

    ``appraisals``: evidence_id, tool, tool_variant, target_type, overall_judgement,
    evidence_basis, domains array<struct<domain, domain_group, judgement>>.
    """
    spark = appraisals.sparkSession
    rows = [(t, list(j), o, list(g), n, target) for t, j, o, g, n, target in APPRAISAL_TOOLS]
    specs = spark.createDataFrame(rows, "tool string, words array<string>, overall string, kinds array<string>, number int, target string")
    j = appraisals.join(F.broadcast(specs), "tool", "left")  # nine rows
    known = F.col("words").isNotNull()
    bad_word = F.exists("domains", lambda d: ~F.array_contains(F.col("words"), d["judgement"]))
    bad_kind = (F.size("kinds") > 0) & F.exists("domains", lambda d: ~F.coalesce(F.array_contains(F.col("kinds"), d["domain_group"]), F.lit(False)))
    free = (F.col("tool") == "RoB2") & F.col("tool_variant").isNotNull()
    problems = F.array_compact(
        F.array(
            F.when(~known, "unknown tool"),
            F.when(known & bad_word, "judgement outside the tool's words"),
            F.when(known & bad_kind, "domain group missing or unknown"),
            F.when(known & F.col("number").isNotNull() & ~F.coalesce(free, F.lit(False)) & (F.size("domains") != F.col("number")), "number of domains"),
            F.when(known & ~F.coalesce(F.expr("overall_judgement rlike overall"), F.lit(False)), "overall judgement"),
            F.when(known & (F.col("target") != "") & (F.coalesce("target_type", F.lit("")) != F.col("target")), "target missing"),
            F.when((F.col("evidence_basis") == "abstract_only") & (F.col("overall_judgement") == "low"), "low risk from an abstract"),
        )
    )
    return j.withColumn("problems", problems).filter(F.size("problems") > 0).select("evidence_id", "tool", "problems")


def check_status(name: str, bad: DataFrame, level: str = "fail") -> DataFrame:
    """A check as one row ``check_id, status, detail`` from its violations."""
    n = bad.agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.lit(name).alias("check_id"), F.when(F.col("n") == 0, "pass").otherwise(level).alias("status"), F.concat(F.col("n").cast("string"), F.lit(" violations")).alias("detail"))


def kernel_checks(snapshots: DataFrame, spans: DataFrame, fresh: DataFrame, verdicts: DataFrame, *, gate: bool = True) -> DataFrame:
    """The four checks on evidence; with the gate off all but tampering only warn."""
    soft = "fail" if gate else "warn"
    out = check_status("C-SNAPSHOT", integrity(snapshots).filter("not intact"))
    bad = spans.filter("not ok")
    out = out.unionByName(check_status("C-SPAN", bad, soft))
    out = out.unionByName(check_status("C-FRESH-FETCH", stale_sources(spans, fresh), soft))
    return out.unionByName(check_status("C-ASSEMBLER", verdicts.filter("verdict <> 'accepted'"), soft))


def span_debt(records: DataFrame) -> DataFrame:
    """Outcomes with numbers but without spans: ``evidence_id, owed``.

    ``records``: evidence_id, outcomes array<struct<..., effect, ci_low, ci_high, p_value, spans>>.
    """
    owed = F.filter("outcomes", lambda o: (F.size(o["spans"]) < 1) & (o["effect"].isNotNull() | o["ci_low"].isNotNull() | o["ci_high"].isNotNull() | o["p_value"].isNotNull()))
    return records.withColumn("owed", F.size(owed)).filter("owed > 0").select("evidence_id", "owed")


def corpus_problems(records: DataFrame, derived: Column) -> DataFrame:
    """Records that break an invariant: ``evidence_id, problems``."""
    p = F.array_compact(
        F.array(
            F.when((F.col("ft_status") == "missing") & F.col("access_route").isNotNull() & (F.coalesce("source_tier", F.lit(-1)) != 8), "attempted but missing needs tier 8"),
            F.when(F.col("truncation_detected") & (F.col("ft_status") != "abstract_only"), "truncation needs abstract_only"),
            F.when(F.col("evidence_id") != derived, "identity violates precedence"),
        )
    )
    return records.withColumn("problems", p).filter(F.size("problems") > 0).select("evidence_id", "problems")


def provisional_triggers(run: DataFrame) -> DataFrame:
    """Why a report is provisional, from one row of run facts."""
    t = F.array_compact(
        F.array(
            F.when(F.col("not_attempted") > 0, "records not yet attempted"), F.when(F.col("pending_adjudication") > 0, "adjudication pending"),
            F.when(F.col("failed_checks") > 0, "failed checks"), F.when(F.col("no_progress"), "no progress"), F.when(F.col("budget_reached"), "budget reached"),
        )
    )
    return run.withColumn("triggers", t).withColumn("provisional", F.size("triggers") > 0)


def resolve_keys(notes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Footnote keys to evidence: the first writer of an alias wins, case doesn't count.

    ``aliases``: evidence_id, alias (array), position.
    """
    each = aliases.select("evidence_id", "position", F.explode("alias").alias("_a")).withColumn("_k", F.lower(F.trim("_a")))
    first = each.groupBy("_k").agg(F.min_by("evidence_id", F.struct("position", "evidence_id")).alias("evidence_id"))
    return notes.withColumn("_k", F.lower(F.trim("key"))).join(first, "_k", "left").drop("_k")


def inherited_claims(notes: DataFrame, accepted: DataFrame) -> DataFrame:
    """Accepted claims of the evidence that a report's footnotes name, once per place."""
    return notes.join(accepted, "evidence_id").dropDuplicates(["note_id", "source_id", "start", "end"])


def merged_snapshots(*folders: DataFrame) -> DataFrame:
    """Snapshots of several folders; of one source the first folder's stays."""
    all_rows = None
    for k, f in enumerate(folders):
        own = f.withColumn("_p", F.lit(k))
        all_rows = own if all_rows is None else all_rows.unionByName(own)
    w = Window.partitionBy("source_id").orderBy("_p")
    return all_rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_p", "_n")


def new_snapshots(incoming: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write-once store: rows to append, and rows that contradict a stored snapshot."""
    same = stored.select("source_id", F.struct("content_hash", "url", "access").alias("_old"))
    j = incoming.join(same, "source_id", "left")
    fresh = j.filter("_old is null").drop("_old").dropDuplicates(["source_id"])
    clash = j.filter("_old is not null").filter(F.struct("content_hash", "url", "access") != F.col("_old")).drop("_old")
    return fresh, clash
