"""What is new: alerts, ledgers, guards, patches, reuse and promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import normalize as N


def new_hits(hits: DataFrame, known: DataFrame) -> DataFrame:
    """Search hits that no record has, each under the first search of the run that found it.

    ``hits``: search_order, search_id, pmid. Searches of one run register as they go, so a hit of an
    earlier one is known to the later ones. ``known``: evidence_id, pmid.
    """
    own = known.select(F.explode(F.array_compact(F.array("pmid", F.nullif(F.regexp_extract("evidence_id", "^pmid:(.+)$", 1), F.lit(""))))).alias("pmid")).distinct()
    w = Window.partitionBy("pmid").orderBy("search_order")
    first = hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return first.join(own, "pmid", "left_anti")


def ledger_diff(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Candidates with ``changed``: unchanged only against a published entry with both digests equal."""
    prior = ledger.select("destination_identity", "evidence_id", F.col("status").alias("_s"), F.col("metadata_hash").alias("_m"), F.col("attachment_fingerprint").alias("_a"))
    j = candidates.join(prior, ["destination_identity", "evidence_id"], "left")
    same = (F.col("_s") == "published") & F.col("metadata_hash").eqNullSafe(F.col("_m")) & F.col("attachment_fingerprint").eqNullSafe(F.col("_a"))
    return j.withColumn("changed", ~F.coalesce(same, F.lit(False))).drop("_s", "_m", "_a")


def ledger_update(ledger: DataFrame, results: DataFrame) -> DataFrame:
    """Ledger after a batch: one entry per destination and record, the batch's where it has one."""
    key = ["destination_identity", "evidence_id"]
    return ledger.join(results.select(*key), key, "left_anti").unionByName(results.select(*ledger.columns))


def repeated_queries(asked: DataFrame, logged: DataFrame) -> DataFrame:
    """Queries that equal a logged one of another id in normal form."""
    a = asked.withColumn("_h", N.query_hash(F.col("query_string")))
    b = logged.select(F.col("query_id").alias("existing"), N.query_hash(F.col("query_string")).alias("_h"))
    return a.join(b, "_h").filter(F.col("existing") != F.col("query_id")).drop("_h")


def to_process(assets: DataFrame, state: DataFrame) -> DataFrame:
    """Assets without a complete run of the same content, extractor and options; zero results are complete."""
    done = state.filter("status = 'complete' and n_results is not null").select("attachment_id", "asset_sha256", "extractor", "options_json")
    return assets.join(done, ["attachment_id", "asset_sha256", "extractor", "options_json"], "left_anti")


IDENTITY = ("evidence_id", "pmid", "doi", "pmcid")


def patch(records: DataFrame, patches: DataFrame) -> DataFrame:
    """Records with patched fields: structs are merged field by field, others replaced where given.

    Patches never create records and may not touch identity.
    """
    bad = set(patches.columns) & set(IDENTITY[1:])
    if bad:
        raise ValueError(f"identity fields can't be patched: {sorted(bad)}")
    own = patches.select("evidence_id", *[F.col(c).alias(f"_{c}") for c in patches.columns if c != "evidence_id"])
    out = records.join(own, "evidence_id", "left")
    for c in patches.columns:
        if c == "evidence_id":
            continue
        kind = records.schema[c].dataType
        if hasattr(kind, "fields"):
            out = out.withColumn(c, F.struct(*[F.coalesce(F.col(f"_{c}.{f.name}"), F.col(f"{c}.{f.name}")).alias(f.name) for f in kind.fields]))
        else:
            out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.select(*records.columns)


def upsert_notes(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """Annotations after edits: tags added and removed as a sorted set, rating and note set or cleared.

    ``edits``: evidence_id, add_tags, remove_tags, rating, clear_rating, note, clear_note, at. Ratings
    outside 1 to 5 raise.
    """
    none = F.array().cast("array<string>")
    e = edits.withColumn("rating", F.when(F.col("rating").isNull() | F.col("rating").between(1, 5), F.col("rating")).otherwise(F.raise_error(F.lit("rating must be 1 to 5")).cast("int")))
    e = e.select("evidence_id", "add_tags", "remove_tags", F.col("rating").alias("_r"), "clear_rating", F.col("note").alias("_n"), "clear_note", "at")
    j = notes.join(e, "evidence_id", "full_outer")
    tags = F.array_sort(F.array_except(F.array_union(F.coalesce("tags", none), F.coalesce("add_tags", none)), F.coalesce("remove_tags", none)))
    return j.select(
        "evidence_id", tags.alias("tags"),
        F.when(F.coalesce("clear_rating", F.lit(False)), None).otherwise(F.coalesce("_r", "rating")).alias("rating"),
        F.when(F.coalesce("clear_note", F.lit(False)), None).otherwise(F.coalesce("_n", "note")).alias("note"),
        F.coalesce("at", "updated_at").alias("updated_at"),
    )


def promotable(extractions: DataFrame, spans: DataFrame, *, verify: bool = True) -> DataFrame:
    """Extractions with ``accepted`` and a reason: the file exists, names its record, and all spans hold.

    ``extractions``: evidence_id, file_exists, file_evidence_id. ``spans``: evidence_id, ok.
    """
    held = spans.groupBy("evidence_id").agg(F.bool_and("ok").alias("_ok"), F.count(F.lit(1)).alias("_n"))
    j = extractions.join(held, "evidence_id", "left")
    reason = F.when(~F.col("file_exists"), "no file").when(F.coalesce("file_evidence_id", "evidence_id") != F.col("evidence_id"), "other record")
    if verify:
        reason = reason.when(~F.coalesce("_ok", F.lit(True)), "span fails")
    return j.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()).drop("_ok", "_n")


def reusable_work(wanted: DataFrame, pool: DataFrame) -> DataFrame:
    """What a new run can take over from pooled records: extraction, appraisal, freshest snapshot."""
    own = pool.select("evidence_id", F.col("extraction_path").alias("pooled_extraction"), F.col("appraisal_path").alias("pooled_appraisal"), "source_id", "synced_at")
    best = own.groupBy("evidence_id").agg(
        F.max_by("pooled_extraction", F.when(F.col("pooled_extraction").isNotNull(), F.col("synced_at"))).alias("pooled_extraction"),
        F.max_by("pooled_appraisal", F.when(F.col("pooled_appraisal").isNotNull(), F.col("synced_at"))).alias("pooled_appraisal"),
        F.max_by("source_id", F.when(F.col("source_id").isNotNull(), F.col("synced_at"))).alias("source_id"),
    )
    return wanted.join(best, "evidence_id").filter("pooled_extraction is not null or pooled_appraisal is not null or source_id is not null")


def freshest_source(pointers: DataFrame, existing: DataFrame) -> DataFrame:
    """Latest source of each record that still exists."""
    held = pointers.join(existing.select("source_id"), "source_id", "left_semi")
    return held.groupBy("evidence_id").agg(F.max_by("source_id", F.struct("synced_at", "source_id")).alias("source_id"))


def collectable_runs(runs: DataFrame, saved: DataFrame, referenced: DataFrame) -> DataFrame:
    """Runs by whether they may go: blocking (referenced), unsaved (work not in the pool), safe."""
    r = runs.join(referenced.select("run_id").distinct().withColumn("_r", F.lit(True)), "run_id", "left")
    r = r.join(saved.select("run_id").distinct().withColumn("_s", F.lit(True)), "run_id", "left")
    tier = F.when(F.coalesce("_r", F.lit(False)), "blocking").when(~F.coalesce("_s", F.lit(False)) & F.col("has_work"), "unsaved").otherwise("safe")
    return r.withColumn("tier", tier).drop("_r", "_s")


def lifecycle(records: DataFrame, events: DataFrame) -> DataFrame:
    """Registry records after events (evidence_id, field, project, value, seq): last value per field."""
    last = events.filter("project is null").groupBy("evidence_id", "field").agg(F.max_by("value", "seq").alias("v"))
    wide = last.groupBy("evidence_id").pivot("field", ["asset_status", "extraction_status", "appraisal_status", "metadata_status"]).agg(F.first("v"))
    wide = wide.select("evidence_id", *[F.col(c).alias(f"_{c}") for c in ("asset_status", "extraction_status", "appraisal_status", "metadata_status")])
    perp = events.filter("project is not null").groupBy("evidence_id", "project").agg(F.max_by("value", "seq").alias("v"))
    maps = perp.groupBy("evidence_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("project", "v")))).alias("_maps"))
    j = records.join(wide, "evidence_id", "left").join(maps, "evidence_id", "left")
    none = F.expr("cast(map() as map<string,string>)")
    old = F.map_filter(F.coalesce("appraisals", none), lambda k, v: ~F.array_contains(F.map_keys(F.coalesce("_maps", none)), k))
    out = j.withColumn("appraisals", F.map_concat(old, F.coalesce("_maps", none)))
    for c in ("asset_status", "extraction_status", "appraisal_status", "metadata_status"):
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.select(*records.columns)


def missing_fulltext(records: DataFrame, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Records without an available file, with the addresses to try; null counts as missing."""
    out = records.filter(~F.col("asset_status").eqNullSafe(F.lit("available")))
    if status is not None:
        out = out.filter(F.col("status") == status)
    out = out.select("evidence_id", "title", F.concat(F.lit("https://doi.org/"), N.norm_doi(F.col("doi"))).alias("doi_url"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid").alias("pubmed_url")).orderBy("evidence_id")
    return out if limit is None else out.limit(limit)


def acquisition_candidates(records: DataFrame) -> DataFrame:
    """Records to acquire: not excluded (unscreened ones qualify), and without full text so far."""
    return records.filter(~F.col("decision").eqNullSafe(F.lit("exclude"))).filter(~F.col("ft_status").eqNullSafe(F.lit("fulltext")))


def acquired(attempts: DataFrame) -> DataFrame:
    """Outcome of each record's ladder: the first full success, else the first cut one, else quarantine.

    ``attempts``: evidence_id, tier, status, truncated, access_route.
    """
    ok = F.col("status") == "success"
    full = F.when(ok & ~F.col("truncated") & (F.col("tier") < 8), F.col("tier"))
    cut = F.when(ok & F.col("truncated"), F.col("tier"))
    row = F.struct("tier", "access_route")
    own = attempts.groupBy("evidence_id").agg(F.min_by(row, full).alias("full"), F.min_by(row, cut).alias("cut"))
    best = F.coalesce("full", "cut")
    return own.select(
        "evidence_id", F.when(F.col("full").isNotNull(), "fulltext").when(F.col("cut").isNotNull(), "abstract_only").otherwise("missing").alias("status"),
        F.coalesce(best["tier"], F.lit(8)).alias("source_tier"), F.coalesce(best["access_route"], F.lit("quarantine")).alias("access_route"),
        F.col("full").isNull().alias("needs_upgrade"),
    )


def handoff_queue(queue: DataFrame, updates: DataFrame) -> DataFrame:
    """Hand-off tasks after updates: replaced by task id, new ones appended."""
    w = Window.partitionBy("task_id").orderBy(F.desc("seq"))
    return queue.unionByName(updates).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def access_of(route: Column, truncated: Column) -> Column:
    """Access of acquired text: preprints and web pages are their own kinds, cut texts are abstracts."""
    return F.when(truncated, "abstract").when(route == "preprint", "preprint").when(route == "guideline", "guideline").when(route.isin("browser", "web"), "web").otherwise("full_text")


def origin_of(route: Column) -> Column:
    return F.when(route.isin("pmc", "pmc-pdf"), "pmc").when(route == "europepmc", "europepmc").when(route == "unpaywall", "unpaywall").when(route == "oa", "oa-pdf").when(route == "library", "user-supplied-pdf").otherwise("web")
