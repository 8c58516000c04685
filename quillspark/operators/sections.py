"""Reports as lines and nested sections, and findings of the report checks with the line that each is on.

A report's text is one row, so its lines are numbered where they are read. What a line is depends on the lines before it
(open comments, fences, footnotes) and a section's end on those after it; both are windows over one report's lines, so a
table of reports moves once, by report. ``report_id`` is unique.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import Scratch

HEADING = r"^(#{1,6})\s+(.*?)\s*#*$"
NOTE = r"^\[\^([^\]\s]+)\]:\s*(.*)$"
REF = r"\[\^([^\]\s]+)\](?!:)"
TAIL = r"(?i)^\s*(#*\s*)?(references|appendix|bibliography)"

# Sections that a report has (name, heading, whether it must), words that records of a state need at every point
# of use, and wording that is forbidden on a side of the hypothesis section, with its reason.
SECTIONS = (
    ("question / protocol", "question|protocol", True),
    ("methods — search", "search|quer(y|ies)|selection|methods", True),
    ("PRISMA flow / screening log", "prisma|selection|screening|flow", True),
    ("characteristics of included studies", "evidence table|characteristics|included studies", True),
    ("results by outcome", "synthesis|results|outcome|findings", True),
    ("certainty of evidence", "certainty|grade", True),
    ("conflicts and inconsistencies", "conflict|inconsisten|agreement|disagree", True),
    ("evidence gaps", "gap", True),
    ("new insights / hypotheses", "new insight|hypothes", True),
    ("limitations / unobtainable evidence", "limitation|missing|quarantin|unobtainable|uncertain", True),
    ("references", "reference|bibliograph", True),
    ("plain-language summary", "summary|short answer|plain[- ]language|bottom line", False),
    ("risk of bias / quality", r"risk of bias|\brob\b|quality|appraisal", False),
    ("provenance", "provenance|generated by|run metadata", False),
)
MARKERS = {
    "retracted": r"\bretract(ed|ion)\b",
    "expression_of_concern": r"expression of concern|\beoc\b",
    "corrected": r"\bcorrect(ion|ed)\b|\berratum\b",
}
PREPRINT = r"preprint|not peer[\s\-]?reviewed|biorxiv|medrxiv|research square"
ABSTRACT_ONLY = r"abstract[\s\-–—]?only|only the abstract|rests? on the abstract|based on the abstract|from the abstract alone|abstract[\s\-–—]?based"
IN_EVIDENCE = (
    (r"\bprove[sd]?\b|\bproof that\b", "asserts proof"),
    (r"\bconfirms that\b|\bconfirmed that\b", "asserts confirmation"),
    (r"\bestablishe[sd] that\b", "asserts establishment"),
    (r"\bclearly (shows|demonstrates)\b", "unhedged assertion"),
    (r"\bit is well[\s\-]known\b", "uncited common-knowledge claim"),
    (r"\bdefinitively (shows|demonstrates|establishes)\b|\bbeyond doubt\b", "asserts certainty"),
)
IN_HYPOTHESES = (
    (r"\bstudies show\b|\bthe evidence (shows|indicates|demonstrates)\b|\bevidence indicates\b|\bdata (support|show|demonstrate)\b", "evidence-side verb form"),
    (r"\b(demonstrates|proves|confirms|establishes) that\b", "asserted finding"),
    (r"\bprobably (reduces|increases|improves)\b|\bthe evidence is very uncertain\b", "graded wording"),
    (r"\bis associated with\b", "asserted association"),
)
SPECULATION = (
    r"\b(we hypothesi[sz]e|presumably|it stands to reason|plausible mechanism|likely because|probably because|may be explained by|which likely means|mechanistically,)(?!\w)"
)
STATISTIC = r"\b(95%\s*CI|SMD|\bMD\b|\bRR\b|\bOR\b|\bHR\b|risk ratio|odds ratio|hazard ratio|p\s*[=<>]\s*0?\.\d+|effect size)\b"


def lines(reports: DataFrame) -> DataFrame:
    """Lines of reports (``report_id, text``): ``report_id, line_no`` (from 1), ``raw, line`` (trimmed), ``kind, level, title, note_line, note_key, para, shown, seen``.

    Kinds: front, comment, code, table, heading, note, blank, prose. ``level`` and ``title`` are a heading's; ``note_line`` and
    ``note_key`` are of the footnote whose definition the line begins or goes on with (indented lines go on); ``para`` numbers
    paragraphs, which blank lines and headings end; ``shown`` is whether anything of the line is outside comments, and ``seen`` counts such lines up to this one. A null or
    empty text is one blank line. Any line break of CR, LF or both counts; other columns are ignored.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n")
    x = reports.select("report_id", F.posexplode(F.split(text, "\n")).alias("line_no", "raw"))
    x = x.select("report_id", (F.col("line_no") + 1).alias("line_no"), "raw", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("line"))
    whole = Window.partitionBy("report_id")
    upto = whole.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = whole.orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda cond, w: F.coalesce(F.sum(cond.cast("int")).over(w), F.lit(0))
    line, rule = F.col("line"), F.col("line") == "---"
    x = x.withColumn("_rules", count(rule, upto)).withColumn("_all", F.sum(rule.cast("int")).over(whole)).withColumn("_first", F.first("line").over(upto))
    x = x.withColumn("_front", (F.col("_first") == "---") & (F.col("_all") > 1) & ((F.col("_rules") == 1) | ((F.col("_rules") == 2) & rule)))
    # A comment is open after a line that starts one, until a line has its end.
    event = F.when(~F.col("_front"), F.when(F.contains(line, F.lit("-->")), 0).when(F.startswith(line, F.lit("<!--")), 1))
    fence = line.rlike("^(```|~~~)")
    x = x.withColumn("_open", F.coalesce(F.last(event, ignorenulls=True).over(before), F.lit(0)) == 1)
    x = x.withColumn("_comment", ~F.col("_front") & (F.col("_open") | F.startswith(line, F.lit("<!--"))))
    x = x.withColumn("_fenced", fence | (count(fence & ~F.col("_comment") & ~F.col("_front"), before) % 2 == 1))
    like = line.rlike(HEADING)
    is_heading = like & ~F.col("_front") & ~fence & (count(fence, before) % 2 == 0)
    x = x.withColumn("level", F.when(is_heading, F.length(F.regexp_extract("line", HEADING, 1))))
    x = x.withColumn("title", F.when(F.col("level").isNotNull(), F.trim(F.regexp_extract("line", HEADING, 2))))
    kind = (
        F.when(F.col("_front"), "front").when(F.col("_comment"), "comment").when(F.col("_fenced"), "code").when(F.startswith(line, F.lit("|")), "table")
        .when(like, "heading").when(F.col("raw").rlike(NOTE), "note").when(line == "", "blank").otherwise("prose")
    )
    goes_on = F.col("raw").rlike(r"^( {4}|\t)") & (line != "")
    starts = F.struct("line_no", F.regexp_extract("raw", NOTE, 1).alias("key"))
    x = x.withColumn("kind", kind).withColumn("_note", F.last(F.when(~goes_on, starts), ignorenulls=True).over(upto))
    x = x.withColumn("note_key", F.nullif("_note.key", F.lit(""))).withColumn("note_line", F.when(F.col("note_key").isNotNull(), F.col("_note.line_no")))
    ends = (line == "") | like | F.coalesce(F.lag(like).over(whole.orderBy("line_no")), F.lit(False))
    shown = F.when(F.col("_open") & (F.col("kind") == "comment"), F.when(F.contains(line, F.lit("-->")), F.regexp_replace("line", r"^.*?-->", ""))).otherwise(
        F.regexp_replace("line", r"<!--.*?(-->|$)", "")
    )
    x = x.withColumn("para", count(ends, upto)).withColumn("shown", F.coalesce(F.trim(shown), F.lit("")) != "").withColumn("seen", count(F.col("shown"), upto))
    return x.select("report_id", "line_no", "raw", "line", "kind", "level", "title", "note_line", "note_key", "para", "shown", "seen")


def sections(lines: DataFrame) -> DataFrame:
    """Sections as nested intervals: ``report_id, line_no`` (of the heading), ``level, title, parent`` (line of the heading that it is
    under), ``end_line`` (behind its last line), ``own_end`` (where its first sub-section starts), ``n_seen, n_own`` (lines that show
    something in the whole section and before its first sub-section).

    A section ends at the next heading of its level or above, at references or an appendix, or with the report.
    """
    whole = Window.partitionBy("report_id")
    x = lines.withColumn("_end", F.max(F.struct("line_no", "seen")).over(whole)).filter("level is not null")
    after = whole.orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    before = whole.orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    here = F.struct("line_no", (F.col("seen") - F.col("shown").cast("int")).alias("seen"))

    def by_level(of) -> Column:  # noqa: ANN001
        return F.coalesce(*[F.when(F.col("level") == n, of(n)) for n in range(1, 7)])

    close = by_level(lambda n: F.last(F.when((F.col("level") <= n) | F.col("title").rlike(TAIL), here), ignorenulls=True).over(after))
    parent = by_level(lambda n: F.last(F.when(F.col("level") < n, F.col("line_no")), ignorenulls=True).over(before))
    behind = F.struct((F.col("_end.line_no") + 1).alias("line_no"), F.col("_end.seen").alias("seen"))
    x = x.withColumn("_close", F.coalesce(close, behind)).withColumn("_next", F.coalesce(F.last(here).over(after), behind)).withColumn("parent", parent)
    return x.select(
        "report_id", "line_no", "level", "title", "parent", F.col("_close.line_no").alias("end_line"), F.col("_next.line_no").alias("own_end"),
        (F.col("_close.seen") - F.col("seen")).alias("n_seen"), (F.col("_next.seen") - F.col("seen")).alias("n_own"),
    )


def _beside(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the reports. Lines are so alike that their files are small however many they are, and
    by the size of a file such a side would be sent whole through the driver."""
    return df.hint("merge")


def _finding(df: DataFrame, check: str, status: str, line_no: Column, detail: Column) -> DataFrame:
    return df.select("report_id", F.lit(check).alias("check_id"), F.lit(status).alias("status"), line_no.cast("int").alias("line_no"), detail.alias("detail"))


def section_findings(lines: DataFrame, tree: DataFrame, rules: Sequence[tuple[str, str, bool]] = SECTIONS) -> DataFrame:
    """Sections that are missing (failures where they are required) or say nothing, at the first heading that each rule's pattern finds."""
    first = lambda p: F.min(F.when(F.col("title").rlike(f"(?i){p}"), F.struct("line_no", "n_seen")))
    found = tree.groupBy("report_id").agg(F.max((F.col("level") == 1).cast("int")).alias("top"), *[first(p).alias(f"r{k}") for k, (_, p, _) in enumerate(rules)])
    bold = F.max(F.col("raw").rlike(r"(?i)\*\*(short answer|plain[- ]language summary|bottom line)").cast("int"))
    each = lines.groupBy("report_id").agg(F.max((F.col("kind") == "front").cast("int")).alias("front"), bold.alias("bold")).join(_beside(found), "report_id", "left")
    none = F.struct(F.lit("fail").alias("status"), F.lit(None).cast("int").alias("line_no"), F.lit("no title block").alias("detail"))
    out = [F.when((F.col("front") == 0) & (F.coalesce("top", F.lit(0)) == 0), none)]
    for k, (name, _, required) in enumerate(rules):
        hit, excused = F.col(f"r{k}"), (F.col("bold") == 1) if name == "plain-language summary" else F.lit(False)
        missing = F.struct(F.lit("fail" if required else "warn").alias("status"), F.lit(None).cast("int").alias("line_no"), F.lit(f"no section: {name}").alias("detail"))
        empty = F.struct(F.lit("warn").alias("status"), hit["line_no"].alias("line_no"), F.lit(f"empty section: {name}").alias("detail"))
        out.append(F.when(hit.isNull() & ~excused, missing).when(hit["n_seen"] == 0, empty))
    found = each.select("report_id", F.explode(F.array_compact(F.array(*out))).alias("f"))
    return found.select("report_id", F.lit("C-SECTIONS").alias("check_id"), "f.status", "f.line_no", "f.detail")


def references(lines: DataFrame) -> DataFrame:
    """Points of use of footnotes: ``report_id, line_no, key, said`` (the paragraph), a row each; prose, tables and headings have them."""
    use = (F.col("kind") == "prose") | F.startswith("line", F.lit("|")) | F.col("line").rlike(HEADING)
    at = lines.filter(use & ~F.col("raw").rlike(NOTE)).select("report_id", "para", "line_no", F.explode(F.regexp_extract_all("raw", F.lit(REF), F.lit(1))).alias("key"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line") != "", F.struct("line_no", "raw")))), lambda s: s["raw"]), " ")
    return at.join(_beside(lines.groupBy("report_id", "para").agg(told.alias("said"))), ["report_id", "para"]).select("report_id", "line_no", "key", "said")


def definitions(lines: DataFrame) -> DataFrame:
    """Footnotes: ``report_id, key, line_no, said`` with their indented lines; of equal keys the first counts."""
    body = F.when(F.col("line_no") == F.col("note_line"), F.regexp_extract("raw", NOTE, 2)).otherwise(F.col("line"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", body.alias("b")))), lambda s: s["b"]), " ")
    each = lines.filter("note_line is not null").groupBy("report_id", F.col("note_key").alias("key"), "note_line").agg(told.alias("said"))
    first = each.groupBy("report_id", "key").agg(F.min(F.struct(F.col("note_line").alias("line_no"), "said")).alias("d"))
    return first.select("report_id", "key", "d.line_no", "d.said")


def citation_findings(lines: DataFrame, notes: DataFrame, records: DataFrame) -> DataFrame:
    """Footnotes that resolve to nothing, miss their definition or use, and records used without the words that their state asks for.

    ``notes``: report_id, key, evidence_id (null if it resolves to nothing), a row a key; ``records``: evidence_id,
    retraction_status, is_preprint, ft_status, decision, a row each. States are asked for at each use and in the definition.
    """
    known = notes.filter("evidence_id is not null").select("report_id", "key", "evidence_id")
    state = records.select(
        "evidence_id", F.nullif(F.coalesce("retraction_status", F.lit("none")), F.lit("none")).alias("retraction"), F.coalesce("is_preprint", F.lit(False)).alias("preprint"),
        F.coalesce((F.col("ft_status") == "abstract_only") & (F.col("decision") == "include"), F.lit(False)).alias("thin"),
    )
    refs, defs = references(lines), definitions(lines)
    used = refs.join(_beside(defs.select("report_id", "key", F.lit(True).alias("_defined"))), ["report_id", "key"], "left").join(_beside(known), ["report_id", "key"], "left")
    defined = defs.join(_beside(refs.groupBy("report_id", "key").agg(F.lit(True).alias("_used"))), ["report_id", "key"], "left").join(_beside(known), ["report_id", "key"], "left")
    both = used.select("report_id", "line_no", "key", "said", "evidence_id", F.lit("citation").alias("what"), F.col("_defined").isNull().alias("alone")).unionByName(
        defined.select("report_id", "line_no", "key", "said", "evidence_id", F.lit("footnote").alias("what"), F.col("_used").isNull().alias("alone"))
    )
    both = both.join(_beside(state), "evidence_id", "left")
    lacks = lambda p: ~F.col("said").rlike(f"(?i){p}")
    marked = functools.reduce(lambda a, kv: a.when((F.col("retraction") == kv[0]) & lacks(kv[1]), True), MARKERS.items(), F.when(F.lit(False), True))
    problem = lambda cond, check, status, detail: F.when(
        F.coalesce(cond, F.lit(False)), F.struct(F.lit(check).alias("check_id"), F.lit(status).alias("status"), detail.alias("detail"))
    )
    key, citation = F.concat(F.lit("[^"), F.col("key"), F.lit("]")), F.col("what") == "citation"
    of = lambda text: F.concat(F.col("evidence_id"), F.lit(" "), F.col("what"), F.lit(text))
    found = F.array_compact(
        F.array(
            problem(F.col("evidence_id").isNull(), "C-CITE-RESOLVE", "fail", F.concat(F.col("what"), F.lit(" resolves to nothing: "), key)),
            problem(citation & F.col("alone"), "C-CITE-RESOLVE", "fail", F.concat(F.lit("no definition: "), key)),
            problem(~citation & F.col("alone"), "C-CITE-RESOLVE", "warn", F.concat(F.lit("never referenced: "), key)),
            problem(marked, "C-RETRACTION", "fail", F.concat(of(" without a marker: "), F.col("retraction"))),
            problem(F.col("preprint") & lacks(PREPRINT), "C-PREPRINT", "fail", of(" without a preprint tag")),
            problem(F.col("thin") & lacks(ABSTRACT_ONLY), "C-FULLTEXT", "fail", of(" does not say that only the abstract was read")),
        )
    )
    out = both.select("report_id", "line_no", F.explode(found).alias("f")).select("report_id", "f.check_id", "f.status", "line_no", "f.detail")
    silent = lines.select("report_id").distinct().join(_beside(refs), "report_id", "left_anti")
    return out.unionByName(_finding(silent, "C-CITE-RESOLVE", "fail", F.lit(None), F.lit("no footnote citations at all")))


def wording_findings(lines: DataFrame, tree: DataFrame) -> DataFrame:
    """Wording that belongs on the other side of the hypothesis section, and effect estimates without a footnote in their paragraph."""
    span = lambda p: F.min(F.when(F.col("title").rlike(f"(?i){p}"), F.struct("line_no", "end_line")))
    at = tree.groupBy("report_id").agg(span("new insight|hypothes").alias("h"), span(r"^\s*(#*\s*)?(references|bibliography)").alias("refs"))
    cited = Window.partitionBy("report_id", "para")
    # The line of a paragraph that is cited anywhere is attributed; paragraphs lie within a report, so nothing moves again.
    x = lines.withColumn("_cited", F.max(F.contains("raw", F.lit("[^")).cast("int")).over(cited)).filter("kind = 'prose'").join(_beside(at), "report_id", "left")
    after = F.col("line_no") >= F.col("h.line_no")
    inside, ahead = after & (F.col("line_no") < F.col("h.end_line")), F.col("h").isNotNull() & ~after
    first = lambda s, rules: F.coalesce(*[F.when(s.rlike(f"(?i){p}"), F.lit(why)) for p, why in rules])
    each = F.filter(F.split("raw", r"""(?<=[.!?])["')\]]*\s+"""), lambda s: F.trim(s) != "")
    f = lambda check, status, detail: F.struct(F.lit(check).alias("check_id"), F.lit(status).alias("status"), detail.alias("detail"))

    def of(s: Column) -> Column:
        wrong = F.when(inside, first(s, IN_HYPOTHESES)).when(ahead, first(s, IN_EVIDENCE))
        guess = F.when(ahead & s.rlike(f"(?i){SPECULATION}"), f("C-HYPOTHESIS-WALL", "warn", F.lit("speculation outside the hypothesis section")))
        return F.array_compact(F.array(F.when(wrong.isNotNull(), f("C-HYPOTHESIS-WALL", "fail", wrong)), guess))

    loose = (F.col("_cited") == 0) & F.col("raw").rlike(STATISTIC) & F.coalesce(F.col("line_no") < F.col("refs.line_no"), F.lit(True))
    found = F.concat(F.flatten(F.transform(each, of)), F.array_compact(F.array(F.when(loose, f("C-ATTRIBUTION", "fail", F.lit("effect estimate without a footnote"))))))
    out = x.select("report_id", "line_no", F.explode(found).alias("f")).select("report_id", "f.check_id", "f.status", "line_no", "f.detail")
    tests = x.groupBy("report_id").agg(F.max((inside & F.col("raw").rlike(r"(?i)\btest|falsif|predict")).cast("int")).alias("tests"))
    untested = at.filter("h is not null").join(_beside(tests), "report_id", "left").filter("coalesce(tests, 0) = 0")
    out = out.unionByName(_finding(untested, "C-HYPOTHESIS-WALL", "warn", F.col("h.line_no"), F.lit("no test or falsifier is stated")))
    open_ = lines.select("report_id").distinct().join(_beside(at.filter("h is not null")), "report_id", "left_anti")
    return out.unionByName(_finding(open_, "C-HYPOTHESIS-WALL", "warn", F.lit(None), F.lit("no hypothesis section")))


def findings(reports: DataFrame, notes: DataFrame, records: DataFrame, scratch: Scratch) -> DataFrame:
    """All of them: ``report_id, check_id, status, line_no`` (null where something is missing), ``detail``. An empty table gives no rows.

    Lines and sections are written once, as every check reads them.
    """
    x = scratch.table(lines(reports), "lines")
    tree = scratch.table(sections(x), "sections")
    return section_findings(x, tree).unionByName(citation_findings(x, notes, records)).unionByName(wording_findings(x, tree))


CHECKS = ("C-CITE-RESOLVE", "C-RETRACTION", "C-FULLTEXT", "C-HYPOTHESIS-WALL", "C-PREPRINT", "C-ATTRIBUTION", "C-SECTIONS")


def report_status(reports: DataFrame, found: DataFrame) -> DataFrame:
    """Each check of each report: ``report_id, check_id, status`` (the worst), ``n`` (findings), ``first_line``."""
    every = reports.select("report_id", F.explode(F.array(*map(F.lit, CHECKS))).alias("check_id"))
    fails = F.max((F.col("status") == "fail").cast("int"))
    some = found.groupBy("report_id", "check_id").agg(F.when(fails == 1, "fail").otherwise("warn").alias("status"), F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))
    return every.join(_beside(some), ["report_id", "check_id"], "left").select("report_id", "check_id", F.coalesce("status", F.lit("pass")).alias("status"), F.coalesce("n", F.lit(0)).alias("n"), "first_line")


# Parts of a summary of one paper, what it may be for, and wording that is kept for reviews of many papers.
SUMMARY_PARTS = (
    "bottom_line", "why_summarized", "study_design_and_basis", "population_setting_sample", "intervention_exposure_index_test_model", "comparator_or_reference_standard",
    "outcomes_and_results", "methods_quality_and_rob", "limitations", "practical_takeaways", "what_not_to_conclude", "provenance",
)
PURPOSES = ("clinical", "methods", "journal-club", "peer-review", "background")
AUDIENCES = ("researcher", "clinician", "student", "grant-writer", "general")
SOURCE_BASES = ("fulltext", "abstract_only")
SKIP_REASONS = ("no_appraise_flag", "abstract_only", "no_supported_tool")
CROSS_STUDY = (
    "pooled", "meta-analys", "meta analys", "across studies", "the literature", "the evidence base", "consensus", "high certainty", "moderate certainty", "low certainty",
    "very low certainty", "forest plot", "i2", "i²",
)
SPAN_REF = r"^(extraction|appraisal):(spans|outcomes|domains):(\d+)(?::spans:(\d+))?$"


def _phrase(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in CROSS_STUDY])


def summary_findings(summaries: DataFrame, extractions: DataFrame, appraisals: DataFrame) -> DataFrame:
    """Checks of summaries of one paper: ``summary_id, check_id, status, part`` (of the summary; null for the whole), ``detail``.

    ``summaries``: summary_id, schema_version, evidence_id, purpose, audience, source_basis, extraction_path, appraisal_path,
    appraisal_skipped_reason, sections (array of name, claims (array of text, evidence_id, span_refs)). ``extractions`` and ``appraisals``:
    path (unique), evidence_id, and spans, outcomes, domains as the numbers of spans of each entry (``spans`` of the record's own list).
    A null list has no entries.
    """
    need = lambda c, values: ~F.coalesce(F.col(c).isin(*values), F.lit(False))
    parts = F.coalesce(F.transform("sections", lambda s: s["name"]), F.expr("cast(array() as array<string>)"))
    row = lambda check, status, part, detail: F.struct(F.lit(check).alias("check_id"), F.lit(status).alias("status"), part.cast("string").alias("part"), detail.alias("detail"))
    null = F.lit(None)
    whole = lambda cond, check, detail: F.when(F.coalesce(cond, F.lit(False)), row(check, "fail", null, F.lit(detail)))
    lists = [F.coalesce(c, F.expr("cast(array() as array<int>)")).alias(c) for c in ("spans", "outcomes", "domains")]
    record = lambda df, name: df.select(F.col("path").alias(f"{name}_path"), F.struct("evidence_id", *lists).alias(name))
    j = summaries.join(record(extractions, "extraction"), "extraction_path", "left").join(record(appraisals, "appraisal"), "appraisal_path", "left")
    missing = F.transform(F.array_except(F.array(*map(F.lit, SUMMARY_PARTS)), parts), lambda p: row("C-SPS-SCHEMA", "fail", p, F.lit("section missing")))
    unlinked = F.col("appraisal").isNull() & (F.col("appraisal_path").isNotNull() | need("appraisal_skipped_reason", SKIP_REASONS))
    own = [
        whole(F.col("schema_version").isNull() | (F.col("schema_version") != 1), "C-SPS-SCHEMA", "schema_version must be 1"),
        *[whole(need(c, v), "C-SPS-SCHEMA", f"{c} not allowed") for c, v in (("purpose", PURPOSES), ("audience", AUDIENCES), ("source_basis", SOURCE_BASES))],
        whole(F.col("appraisal_path").isNull() & need("appraisal_skipped_reason", SKIP_REASONS), "C-SPS-SCHEMA", "neither an appraisal nor a reason for none"),
        whole(F.col("appraisal_path").isNotNull() & F.col("appraisal_skipped_reason").isNotNull(), "C-SPS-SCHEMA", "an appraisal and a reason for none"),
        whole(F.col("extraction").isNull(), "C-SPS-EXTRACTION-LINK", "extraction_path leads nowhere"),
        whole(F.col("extraction").isNotNull() & ~F.col("extraction.evidence_id").eqNullSafe(F.col("evidence_id")), "C-SPS-EXTRACTION-LINK", "extraction of another paper"),
        whole(unlinked, "C-SPS-APPRAISAL", "no appraisal and no reason for none"),
    ]

    def refers(ref: Column) -> Column:
        """Why a pointer leads nowhere, null if it does not."""
        record, field = F.regexp_extract(ref, SPAN_REF, 1), F.regexp_extract(ref, SPAN_REF, 2)
        at, inner = [F.regexp_extract(ref, SPAN_REF, k).cast("decimal(38,0)") for k in (3, 4)]
        pick = lambda f: F.when(record == "extraction", F.col("extraction")[f]).otherwise(F.col("appraisal")[f])
        held = F.when(field == "spans", pick("spans")).when(field == "outcomes", pick("outcomes")).otherwise(pick("domains"))
        size = F.get(held, F.when(at < F.size(held), at).cast("int"))
        return (
            F.when(~F.coalesce(ref.rlike(SPAN_REF), F.lit(False)), "malformed").when(held.isNull(), "no record").when(at >= F.size(held), "out of range")
            .when((field != "spans") & inner.isNotNull() & (inner >= F.coalesce(size, F.lit(0))), "inner span out of range")
        )

    def of_claim(part: Column, c: Column) -> Column:
        bad = F.transform(F.filter(F.coalesce(c["span_refs"], F.expr("cast(array() as array<string>)")), lambda r: refers(r).isNotNull()),
                          lambda r: row("C-SPS-SPAN-REFS", "fail", part, F.concat(F.coalesce(r, F.lit("null")), F.lit(": "), refers(r))))
        other = c["evidence_id"].isNotNull() & ~c["evidence_id"].eqNullSafe(F.col("evidence_id"))
        said = _phrase(c["text"])
        more = F.array(
            F.when(other, row("C-SPS-SINGLE-PAPER", "fail", part, F.concat(F.lit("claim of "), c["evidence_id"]))),
            F.when(said.isNotNull() & ~part.eqNullSafe(F.lit("provenance")), row("C-SPS-NO-CROSS-STUDY", "fail", part, said)),
        )
        return F.concat(bad, F.array_compact(more))

    claims = lambda s: F.coalesce(s["claims"], F.expr("cast(array() as array<struct<text:string,evidence_id:string,span_refs:array<string>>>)"))
    listed = F.flatten(F.transform("sections", lambda s: F.flatten(F.transform(claims(s), lambda c: of_claim(s["name"], c)))))
    design = F.exists("sections", lambda s: s["name"].eqNullSafe(F.lit("study_design_and_basis")) & F.exists(claims(s), lambda c: F.coalesce(F.contains(F.lower(c["text"]), F.lit("abstract")), F.lit(False))))
    label = F.when((F.col("source_basis") == "abstract_only") & ~F.coalesce(design, F.lit(False)), row("C-SPS-ABSTRACT-LABEL", "warn", F.lit("study_design_and_basis"), F.lit("basis not labelled")))
    none = F.expr("cast(array() as array<struct<check_id:string,status:string,part:string,detail:string>>)")
    every = F.concat(F.array_compact(F.array(*own, label)), missing, F.coalesce(listed, none))
    return j.select("summary_id", F.explode(every).alias("f")).select("summary_id", "f.*")
