"""Checks of a written report against the records, and status snapshots of a run."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import screening, tasks
from quillspark.operators.provenance import check_status

# Names of the checks in the order in which they run.
CHECKS = (
    "C-CITATION-EXISTS", "C-CITATION-INCLUDED", "C-UNCITED", "C-RETRACTED", "C-QUOTE", "C-PRISMA", "C-SEARCH-LOG", "C-MISSING", "C-ABSTRACT-ONLY",
    "C-EXTRACTION", "C-APPRAISAL", "C-PREPRINT", "C-PROVISIONAL",
)


def verify_report(lines: DataFrame, notes: DataFrame, records: DataFrame, counts: DataFrame, said: DataFrame, searches: DataFrame, quotes: DataFrame, missing_ids: DataFrame, appraisal_bad: DataFrame) -> DataFrame:
    """All checks as ``check_id, status, detail``.

    ``lines``: scanned report lines; ``notes``: key, evidence_id (null if unresolved); ``records``: evidence_id,
    decision, ft_status, access_route, retraction_status, is_preprint, extraction_path, appraisal_path, noted
    (whether the report says so); ``counts`` and ``said``: name, n; ``quotes``: ok; ``missing_ids``: evidence_id.
    """
    used = lines.filter("kind = 'prose'").select(F.explode("keys").alias("key")).distinct()
    cited = used.join(notes, "key", "left")
    held = cited.filter("evidence_id is not null").join(records, "evidence_id", "left")
    included = records.filter("decision = 'include' and ft_status <> 'missing'")
    quarantined = records.filter("decision = 'include' and ft_status = 'missing' and access_route is not null").select("evidence_id")
    listed = missing_ids.select("evidence_id").distinct()
    off = quarantined.join(listed, "evidence_id", "left_anti").unionByName(listed.join(quarantined, "evidence_id", "left_anti"))
    wrong = counts.join(said.select("name", F.col("n").alias("_said")), "name").filter("n <> _said")
    unsaid = lambda cond: held.filter(cond).filter(~F.coalesce("noted", F.lit(False)))
    out = [
        check_status(CHECKS[0], cited.filter("evidence_id is null")),
        check_status(CHECKS[1], held.filter("decision is null or decision <> 'include'")),
        check_status(CHECKS[2], included.join(held.select("evidence_id"), "evidence_id", "left_anti"), "warn"),
        check_status(CHECKS[3], unsaid("retraction_status <> 'none'")),
        check_status(CHECKS[4], quotes.filter("not ok")),
        check_status(CHECKS[5], wrong),
        check_status(CHECKS[6], searches.filter("not coalesce(hit_count_logged, false)")),
        check_status(CHECKS[7], off),
        check_status(CHECKS[8], unsaid("ft_status = 'abstract_only'")),
        check_status(CHECKS[9], included.filter("extraction_path is null"), "warn"),
        check_status(CHECKS[10], appraisal_bad),
        check_status(CHECKS[11], unsaid("is_preprint"), "warn"),
    ]
    done = out[0]
    for c in out[1:]:
        done = done.unionByName(c)
    # The last check depends on the others: a failure makes the report provisional, which it must say.
    failed = done.filter("status = 'fail'")
    says = lines.filter(F.contains(F.lower("text"), F.lit("provisional"))).limit(1).agg(F.count(F.lit(1)).alias("k"))
    last = failed.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(says)).select(  # one row each
        F.lit(CHECKS[12]).alias("check_id"), F.when((F.col("n") > 0) & (F.col("k") == 0), "fail").otherwise("pass").alias("status"), F.concat(F.col("n").cast("string"), F.lit(" failed checks")).alias("detail")
    )
    return done.unionByName(last)


def summary_problems(summaries: DataFrame, spans: DataFrame, headings: list[str]) -> DataFrame:
    """Summaries that lack a heading or quote a span that fails: ``evidence_id, problems``."""
    bad = spans.filter("not ok").groupBy("evidence_id").agg(F.count(F.lit(1)).alias("_bad"))
    j = summaries.join(bad, "evidence_id", "left")
    lacks = [F.when(~F.coalesce(F.col("text").rlike(rf"(?m)^#+\s+\Q{h}\E\s*$"), F.lit(False)), f"no heading: {h}") for h in headings]
    p = F.array_compact(F.array(*lacks, F.when(F.col("_bad") > 0, "quoted span fails")))
    return j.withColumn("problems", p).filter(F.size("problems") > 0).select("evidence_id", "problems")


def status_snapshot(log: DataFrame, records: DataFrame, now: Column, *, caps: dict[str, float], stall_s: float) -> dict[str, DataFrame]:
    """What a monitor shows: funnel, tiers, stages, current stage, stalls and budgets."""
    t = tasks.current(log)
    funnel = screening.funnel(records)
    return {
        "funnel": funnel, "tiers": screening.tier_histogram(records), "stages": tasks.stage_rollup(t), "current_stage": tasks.current_stage(t),
        "stalls": tasks.stalls(t, now, stall_s), "budgets": tasks.budget_usage(t, funnel, now, caps),
    }


def biblio_block(records: DataFrame) -> DataFrame:
    """Bibliographic line of each record: authors, year, title, journal, identifiers, blanks skipped."""
    authors = F.when(F.size("authors") > 6, F.concat(F.array_join(F.slice("authors", 1, 6), ", "), F.lit(", et al."))).otherwise(F.array_join("authors", ", "))
    year = F.concat(F.lit("("), F.nullif(F.regexp_extract("publication_date", r"^(\d{4})", 1), F.lit("")), F.lit(")"))
    ids = F.concat_ws(", ", F.concat(F.lit("doi:"), "doi"), F.concat(F.lit("pmid:"), "pmid"), F.concat(F.lit("pmcid:"), "pmcid"))
    return records.select("evidence_id", F.concat_ws(" ", *[F.nullif(F.trim(x), F.lit("")) for x in (authors, year, F.col("title"), F.col("journal"), ids)]).alias("line"))


def concept_problems(notes: DataFrame) -> DataFrame:
    """Concept notes whose front matter breaks a rule: ``slug, problems``. ``notes``: type, slug, front (map), body, links (array)."""
    known = notes.select(F.col("slug").alias("_l")).distinct()
    broken = notes.select("slug", F.explode("links").alias("_l")).join(known, "_l", "left_anti").groupBy("slug").agg(F.array_sort(F.collect_set("_l")).alias("_broken"))
    twice = notes.groupBy("slug").agg(F.count(F.lit(1)).alias("_n"))
    j = notes.join(broken, "slug", "left").join(twice, "slug")
    has = lambda k: F.coalesce(F.try_element_at("front", F.lit(k)), F.lit("")) != ""
    p = F.array_compact(
        F.array(
            F.when(~has("title"), "title missing"), F.when(~F.col("slug").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), "slug form"), F.when(F.col("_n") > 1, "slug twice"),
            F.when(F.coalesce(F.trim("body"), F.lit("")) == "", "empty body"), F.when(F.col("_broken").isNotNull(), "link to nothing"), F.when((F.col("type") == "study") & ~has("evidence_id"), "study without evidence_id"),
        )
    )
    return j.withColumn("problems", p).filter(F.size("problems") > 0).select("slug", "problems").distinct()


# Folders by type of note, words for states, types with duties of their own, and fields that every note has.
FOLDERS = {
    "Review": "reviews", "Protocol": "protocols", "Search Strategy": "searches", "Study": "studies", "Evidence Claim": "claims", "Outcome": "outcomes", "Population": "populations",
    "Intervention": "interventions", "Comparator": "comparators", "Appraisal": "appraisals", "Evidence Gap": "gaps", "Hypothesis": "hypotheses", "Source Document": "source-documents",
}
STATES = ("draft", "stable", "provisional", "superseded")
RETRACTION_STATES = ("none", "retracted", "expression_of_concern", "corrected")
DATED = ("Review", "Search Strategy", "Evidence Claim")
RETRACTABLE = ("Study", "Source Document")
REQUIRED = ("type", "title", "description", "resource", "status")


def bundle_problems(notes: DataFrame, records: DataFrame, tag: str) -> DataFrame:
    """Rules that the notes of a concept bundle, all with its ``tag``, break: ``folder, slug, rule``, a row for each.

    ``notes``: folder, slug, body, and the front matter as columns: type, title, description, resource, tags (array), generated and
    verified (by, at), status, sources (array of id, resource, title), stale_after, pmid, doi, pmcid, journal, retraction_status,
    evidence_id, evidence_ids (array), evidence_basis, timestamp. ``records``: evidence_id, pmid, doi, pmcid, journal, ft_status.
    Rules on files and their places on a disk, and on types of values in a file, have no counterpart in rows with a schema.
    """
    c, key = F.col, ["folder", "slug"]
    strings = F.expr("cast(array() as array<string>)")
    blank = lambda x: F.coalesce(F.trim(x.cast("string")), F.lit("")) == ""
    ids = F.transform(F.filter("sources", lambda s: F.coalesce(s["id"].rlike("^[a-z0-9][a-z0-9-]*$"), F.lit(False))), lambda s: s["id"])
    ids = F.coalesce(ids, strings)
    used = F.regexp_extract_all("body", F.lit(r"(?<!\])\[\^([^\]\s]+)\]"), F.lit(1))
    defined = F.regexp_extract_all("body", F.lit(r"(?m)^\[\^([^\]]+)\]:"), F.lit(1))
    links = F.regexp_extract_all("body", F.lit(r"(?<!!)\[[^\]\n]*\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)"), F.lit(1))
    stems = F.transform(links, lambda x: F.regexp_replace(F.regexp_replace(F.substring_index(x, "#", 1), "^.*/", ""), r"\.[^.]*$", ""))
    wiki = F.transform(F.regexp_extract_all("body", F.lit(r"(?<!!)\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1)), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), "^.*/", ""), r"\.[^.]*$", ""))
    folder_of = F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv])[c("type")]
    doi_name = F.lower(F.regexp_replace("doi", "[^A-Za-z0-9]+", "-"))
    study = c("type") == "Study"
    pubmed = study | F.coalesce(c("resource").startswith("https://pubmed.ncbi.nlm.nih.gov/"), F.lit(False))
    moment = lambda x: blank(c(f"{x}.by")) | ~F.coalesce(c(f"{x}.at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), F.lit(False))
    forms = [c("pmid").rlike(r"^\d+$"), c("pmcid").rlike(r"^PMC\d+$"), c("doi").rlike(r"^10\.\d{4,}/\S+$"), c("doi") == F.lower("doi")]  # absent ones hold
    some_sources = F.coalesce(F.size("sources") > 0, F.lit(False))
    rules = {
        "V1": blank(c("type")),
        "V2": some_sources & ((F.size(ids) < F.size("sources")) | (F.size(F.array_distinct(ids)) < F.size(ids))),
        "V3": F.size(F.array_except(F.array_union(used, defined), ids)) > 0,
        "V6": functools.reduce(lambda a, b: a | b, [blank(c(x)) for x in REQUIRED]) | ~some_sources | ~F.coalesce(F.size("tags") > 0, F.lit(False)) | c("generated").isNull() | c("verified").isNull()
        | F.exists("sources", lambda s: blank(s["resource"]) | blank(s["title"])),
        "V7": (c("generated").isNotNull() & moment("generated")) | (c("verified").isNotNull() & moment("verified")),
        "V8": c("status").isNotNull() & ~c("status").isin(*STATES),
        "V9": c("type").isin(*DATED) & ~F.coalesce(c("stale_after").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)),
        "V10": ~blank(c("type")) & (folder_of.isNull() | (folder_of != c("folder"))),
        "V11": study & folder_of.isNotNull() & (c("slug") != F.coalesce(F.concat(F.lit("pmid-"), F.nullif("pmid", F.lit(""))), F.concat(F.lit("doi-"), F.nullif(doi_name, F.lit(""))), F.lit(""))),
        "V14": pubmed & ~functools.reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(True)) for p in forms]),
        "V15": c("type").isin(*RETRACTABLE) & ~F.coalesce(c("retraction_status").isin(*RETRACTION_STATES), F.lit(False)),
        "V16": ~F.coalesce(F.array_contains("tags", tag), F.lit(False)),
        "V18": F.size(F.array_except(wiki, stems)) > 0,
        "V19": some_sources & (F.size(used) == 0),
        "V22": ~F.regexp_replace("slug", "^(pmid-|doi-)", "").rlike("^[a-z0-9][a-z0-9-]{0,79}$"),
        "V23": c("timestamp").isNotNull(),
    }
    own = notes.select(*key, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), rule) for rule, cond in rules.items()]))).alias("rule"))
    declared = (c("evidence_basis") == "abstract_only") | F.contains("body", F.lit("(abstract only)"))
    cited = notes.select(
        *key, F.coalesce(declared, F.lit(False)).alias("declared"), F.explode(F.array_distinct(F.array_compact(F.concat(F.array("evidence_id"), F.coalesce("evidence_ids", strings))))).alias("evidence_id")
    )
    met = cited.join(records.select("evidence_id", "ft_status", F.lit(True).alias("known")), "evidence_id", "left")
    lost = met.filter("known is null").select(*key, F.lit("V24").alias("rule"))
    thin = met.filter("ft_status = 'abstract_only' and not declared").select(*key, F.lit("V25").alias("rule"))
    fields = ("pmid", "doi", "pmcid", "journal")
    said = notes.filter(study).select(*key, "evidence_id", *[c(f).alias(f"_{f}") for f in fields]).join(records, "evidence_id")
    omitted = functools.reduce(lambda a, b: a | b, [~blank(c(f)) & blank(c(f"_{f}")) for f in fields])
    return own.unionByName(lost).unionByName(thin).unionByName(said.filter(omitted).select(*key, F.lit("V12").alias("rule"))).distinct()
