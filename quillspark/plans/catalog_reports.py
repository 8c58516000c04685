"""Queries of reports: their section trees, findings by line, and checks of summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import sections
from quillspark.plans.catalog import query
from quillspark.session import Scratch, table


@query(
    r"""with s as (select doc_id, string_split(regexp_replace(coalesce(text, ''), '[\n\r]', ' ', 'g'), '. ') as parts from documents),
    l as (select doc_id, unnest(range(1, len(parts) + 1)) as line_no, unnest(parts) as x, len(parts) as n from s),
    h as (select doc_id, line_no, n, length(x) % 6 as level, trim(regexp_replace(regexp_replace(case when length(x) % 6 = 4 then 'Appendix ' else 'h ' end || x, '[ \t\f\v]+$', ''), '\s*#*$', '')) as title from l where length(x) % 6 between 1 and 4),
    w as (select *, min(case when level in (1, 4) then line_no end) over a as c1, min(case when level <= 2 or level = 4 then line_no end) over a as c2, min(line_no) over a as c3,
      max(case when level < 2 then line_no end) over b as p2, max(case when level < 3 then line_no end) over b as p3, max(case when level < 4 then line_no end) over b as p4
      from h window a as (partition by doc_id order by line_no rows between 1 following and unbounded following), b as (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding))
    select doc_id, line_no::int as line_no, level::int as level, title, (case level when 2 then p2 when 3 then p3 when 4 then p4 end)::int as parent, coalesce(case level when 1 then c1 when 2 then c2 else c3 end, n + 1)::int as end_line,
      coalesce(c3, n + 1)::int as own_end, coalesce(case level when 1 then c1 when 2 then c2 else c3 end, n + 1) - line_no - 1 as n_seen, coalesce(c3, n + 1) - line_no - 1 as n_own from w"""
)
def v_report_tree(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every text as lines, those of some lengths as headings of four levels: sections as nested intervals."""
    parts = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\n\r]", " "), r"\. ", -1)
    level = lambda x: F.length(x) % 6
    line = lambda x: F.when(level(x) == 4, F.concat(F.lit("#### Appendix "), x)).when(level(x).isin(1, 2, 3), F.concat(F.repeat(F.lit("#"), level(x)), F.lit(" h "), x)).otherwise(F.concat(F.lit(": "), x))
    reports = table(spark, d, "documents").select(F.col("doc_id").alias("report_id"), F.array_join(F.transform(parts, line), "\n").alias("text"))
    return sections.sections(sections.lines(reports)).withColumnRenamed("report_id", "doc_id")


_FOUND = """with d as (select doc_id as k from documents),
    r as (select k, 'C-CITE-RESOLVE' as check_id, 'fail' as status, 5 as line_no, 'citation resolves to nothing: [^b]' as detail from d where k % 4 = 0
    union all select k, 'C-CITE-RESOLVE', 'fail', 18, 'footnote resolves to nothing: [^b]' from d where k % 4 = 0
    union all select k, 'C-CITE-RESOLVE', 'fail', 14, unnest(['citation resolves to nothing: [^z]', 'no definition: [^z]']) from d where k % 7 <> 0
    union all select k, 'C-RETRACTION', 'fail', case when k % 2 = 1 then 5 else 16 end, 'e' || k || case when k % 2 = 1 then ' citation' else ' footnote' end || ' without a marker: retracted' from d where k % 3 = 1
    union all select k, 'C-PREPRINT', 'fail', unnest([5, 8, 16]), unnest(['e' || k || ' citation without a preprint tag', 'e' || k || ' citation without a preprint tag', 'e' || k || ' footnote without a preprint tag']) from d where k % 5 = 1
    union all select k, 'C-FULLTEXT', 'fail', unnest([5, 8, 16]), unnest(['e' || k || ' citation does not say that only the abstract was read', 'e' || k || ' citation does not say that only the abstract was read', 'e' || k || ' footnote does not say that only the abstract was read']) from d where k % 5 = 2
    union all select k, 'C-ATTRIBUTION', 'fail', 8, 'effect estimate without a footnote' from d where k % 3 <> 0
    union all select k, 'C-HYPOTHESIS-WALL', 'fail', 11, 'asserted association' from d where k % 5 = 0
    union all select k, 'C-HYPOTHESIS-WALL', 'warn', 10, 'no test or falsifier is stated' from d where k % 5 = 0
    union all select k, 'C-SECTIONS', 'warn', null, unnest(['no section: plain-language summary', 'no section: risk of bias / quality', 'no section: provenance']) from d
    union all select k, 'C-SECTIONS', 'warn', 13, 'empty section: limitations / unobtainable evidence' from d where k % 7 = 0),
    f as (select * from r where not (line_no = 8 and check_id in ('C-PREPRINT', 'C-FULLTEXT') and k % 3 <> 0) and not (line_no = 16 and check_id = 'C-PREPRINT' and k % 2 = 1) and not (line_no = 16 and check_id = 'C-FULLTEXT' and k % 2 = 0))"""


def _reports(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A report for each document, the records that its footnotes name, and their states."""
    k, cat, lit = F.col("doc_id"), F.concat, F.lit
    x = table(spark, d, "documents").select("doc_id", F.coalesce("lang", lit("none")).alias("lang"))
    rows = [
        lit("---"), lit("title: R"), lit("---"), lit("# Question"), cat(lit("Prose of "), F.col("lang"), lit(" [^a][^b]"), F.when(k % 2 == 0, " retraction").otherwise("")), lit(""),
        lit("## Methods, screening, included studies, results, certainty, conflicts, gaps"), cat(lit("RR 0.5 was seen."), F.when(k % 3 == 0, " [^a]").otherwise("")), lit(""),
        lit("## New insights"), F.when(k % 5 == 0, "It is associated with it.").otherwise("We may test it."), lit(""), lit("## Limitations"), F.when(k % 7 == 0, "<!-- [^z] -->").otherwise("Some [^z]."),
        lit("# References"), cat(lit("[^a]: "), F.col("lang")), F.when(k % 2 == 1, "    retracted preprint").otherwise("    abstract only"), lit("[^b]: none"),
    ]
    reports = x.select(k.alias("report_id"), F.concat_ws("\n", *rows).alias("text"))
    own = cat(lit("e"), k.cast("string"))
    key = F.explode(F.array(F.struct(lit("a").alias("key"), own.alias("evidence_id")), F.struct(lit("b").alias("key"), F.when(k % 4 != 0, cat(lit("n"), k.cast("string"))).alias("evidence_id"))))
    notes = x.select(k.alias("report_id"), key.alias("n")).select("report_id", "n.*")
    records = x.select(
        own.alias("evidence_id"), F.when(k % 3 == 1, "retracted").otherwise("none").alias("retraction_status"), (k % 5 == 1).alias("is_preprint"), F.when(k % 5 == 2, "abstract_only").otherwise("fulltext").alias("ft_status"), lit("include").alias("decision")
    )
    return reports, notes, records


@query(f"{_FOUND} select k as doc_id, check_id, status, line_no, detail from f")
def v_report_findings(spark: SparkSession, d: str) -> DataFrame:
    """A report for each document with citations, comments, footnotes and sections: findings by line."""
    return sections.findings(*_reports(spark, d), Scratch(spark, "report-findings")).withColumnRenamed("report_id", "doc_id")


@query(
    f"""{_FOUND}, c as (select unnest(['C-CITE-RESOLVE', 'C-RETRACTION', 'C-FULLTEXT', 'C-HYPOTHESIS-WALL', 'C-PREPRINT', 'C-ATTRIBUTION', 'C-SECTIONS']) as check_id)
    select k as doc_id, check_id, case when count(f.status) = 0 then 'pass' when bool_or(f.status = 'fail') then 'fail' else 'warn' end as status, count(f.status) as n, min(line_no) as first_line from d cross join c left join f using (k, check_id) group by k, check_id"""
)
def v_report_status(spark: SparkSession, d: str) -> DataFrame:
    """The same reports: each check's worst state with the first line that it names."""
    reports, notes, records = _reports(spark, d)
    scratch = Scratch(spark, "report-status")
    found = scratch.table(sections.findings(reports, notes, records, scratch), "found")
    return sections.report_status(reports, found).withColumnRenamed("report_id", "doc_id")


_PHRASES = ", ".join(f"'{p}'" for p in sections.CROSS_STUDY)


@query(
    f"""with d as (select doc_id as k, text, 'e' || doc_id as e, coalesce(lang, 'none') as lang, list_filter([{_PHRASES}], lambda p: contains(lower(coalesce(text, '')), p))[1] as phrase from documents)
    select k as summary_id, 'C-SPS-SCHEMA' as check_id, 'fail' as status, 'limitations' as part, 'section missing' as detail from d where k % 3 = 0
    union all select k, unnest(['C-SPS-SCHEMA', 'C-SPS-APPRAISAL']), 'fail', null, unnest(['neither an appraisal nor a reason for none', 'no appraisal and no reason for none']) from d where k % 4 = 3
    union all select k, 'C-SPS-EXTRACTION-LINK', 'fail', null, 'extraction of another paper' from d where k % 6 = 0
    union all select k, 'C-SPS-SPAN-REFS', 'fail', 'bottom_line', 'extraction:spans:' || k % 4 || ': out of range' from d where k % 4 >= 2
    union all select k, 'C-SPS-SPAN-REFS', 'fail', 'bottom_line', 'appraisal:domains:0:spans:' || k % 3 || case when k % 2 = 1 then ': no record' else ': inner span out of range' end from d where k % 2 = 1 or k % 3 = 2
    union all select k, 'C-SPS-SPAN-REFS', 'fail', 'bottom_line', 'x: malformed' from d
    union all select k, 'C-SPS-SINGLE-PAPER', 'fail', 'bottom_line', 'claim of other' from d where k % 5 = 0
    union all select k, 'C-SPS-NO-CROSS-STUDY', 'fail', 'bottom_line', phrase from d where phrase is not null
    union all select k, 'C-SPS-ABSTRACT-LABEL', 'warn', 'study_design_and_basis', 'basis not labelled' from d where lang <> 'en' and k % 2 = 1"""
)
def v_summary_checks(spark: SparkSession, d: str) -> DataFrame:
    """A summary of one paper for each document, its text the first claim, against extractions and appraisals."""
    k, cat, lit = F.col("doc_id"), F.concat, F.lit
    x = table(spark, d, "documents").select("doc_id", "text", F.coalesce("lang", lit("none")).alias("lang"), cat(lit("e"), k.cast("string")).alias("e"))
    refs = F.array(cat(lit("extraction:spans:"), (k % 4).cast("string")), cat(lit("appraisal:domains:0:spans:"), (k % 3).cast("string")), lit("x"))
    claim = lambda text, e, refs: F.struct(text.cast("string").alias("text"), e.alias("evidence_id"), refs.cast("array<string>").alias("span_refs"))
    first = claim(F.col("text"), F.when(k % 5 == 0, "other").otherwise(F.col("e")), refs)
    basis = claim(F.when(k % 2 == 0, "Abstract only").otherwise("As said"), F.col("e"), F.lit(None))
    part = lambda p: F.struct(lit(p).alias("name"), F.array(first if p == "bottom_line" else basis).alias("claims"))
    parts = F.array_compact(F.array(*[F.when(k % 3 != 0, part(p)) if p == "limitations" else part(p) for p in sections.SUMMARY_PARTS]))
    name = lambda p: cat(lit(p), k.cast("string"))
    summaries = x.select(
        k.alias("summary_id"), lit(1).alias("schema_version"), F.col("e").alias("evidence_id"), lit("clinical").alias("purpose"), lit("student").alias("audience"),
        F.when(F.col("lang") == "en", "fulltext").otherwise("abstract_only").alias("source_basis"), name("x").alias("extraction_path"), F.when(k % 2 == 0, name("a")).alias("appraisal_path"),
        F.when(k % 4 == 1, "abstract_only").when(k % 4 == 3, "why").alias("appraisal_skipped_reason"), parts.alias("sections"),
    )
    lists = [F.array(lit(0), lit(0)).alias("spans"), F.expr("cast(null as array<int>)").alias("outcomes"), F.array(lit(2)).alias("domains")]
    extractions = x.select(name("x").alias("path"), F.when(k % 6 == 0, "other").otherwise(F.col("e")).alias("evidence_id"), *lists)
    appraisals = x.filter(k % 2 == 0).select(name("a").alias("path"), F.col("e").alias("evidence_id"), *lists)
    return sections.summary_findings(summaries, extractions, appraisals)
