"""Readers of record files: JSON lines, directories of records, BibTeX, PubMed XML, reports."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import normalize as N
from quillspark.sources import schemas as S

BAD = "_bad_line"


def read_jsonl(spark: SparkSession, path: str, schema: str, *, strict: bool = False) -> DataFrame:
    """JSON lines: bad lines are skipped, or with ``strict`` fail the job."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    parsed = F.from_json("value", f"{schema}, {BAD} string", {"columnNameOfCorruptRecord": BAD})
    rows = spark.read.text(path).filter(F.trim("value") != "").select(parsed.alias("r")).select("r.*")
    return rows.filter(F.col(BAD).isNull()).drop(BAD)


def read_strict(spark: SparkSession, path: str, schema: str, version: int = 1) -> DataFrame:
    """JSON lines where a malformed line, another version or a missing identity is fatal; ``//`` lines are comments."""
    # Comments become nulls inside the expression: the order of filters is the optimiser's.
    line = F.when(~F.col("value").startswith("//") & (F.trim("value") != ""), F.col("value"))
    rows = spark.read.text(path).select(F.from_json(line, schema, {"mode": "FAILFAST"}).alias("r")).filter("r is not null").select("r.*")
    ok = (F.col("schema_version") == version) & F.col("evidence_id").isNotNull()
    return rows.filter(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit("bad version or missing evidence_id")).isNull())


def read_keyed(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Last line of each key in file order; bad lines never block."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_seq"))
    rows = lines.select(F.from_json("value", schema).alias("r"), "_seq").filter(F.col(f"r.{key}").isNotNull())
    fields = rows.groupBy(F.col(f"r.{key}").alias("_k")).agg(F.max_by("r", "_seq").alias("r"))
    return fields.select("r.*")


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Verdict files, one record each, under a folder per screener; adjudications and bad ones are skipped."""
    rows = spark.read.schema(f"{S.VERDICT}, {BAD} string").option("multiLine", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("pathGlobFilter", "*.json").json(path)
    rows = rows.withColumn("_folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    good = rows.filter(F.col(BAD).isNull() & (F.col("_folder") != "adjudication") & F.col("decision").isin(*S.DECISIONS))
    return good.withColumn("screener_id", F.coalesce("screener_id", "_folder")).withColumn("evidence_id", N.verdict_key(F.col("pmid"))).drop(BAD, "_folder")


def read_input_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records given as one JSON array, one object, or JSON lines."""
    whole = spark.read.text(path, wholetext=True)
    array = F.from_json("value", f"array<struct<{_struct(schema)}>>")
    is_array = F.col("value").rlike(r"^\s*\[")
    listed = whole.filter(is_array).select(F.inline(array))
    lines = whole.filter(~is_array).select(F.explode(F.split("value", r"\n(?=\s*\{)")).alias("value")).select(F.from_json("value", schema).alias("r")).filter("r is not null").select("r.*")
    return listed.unionByName(lines)


def _struct(schema: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).simpleString()[len("struct<") : -1]


def normalize_records(raw: DataFrame) -> DataFrame:
    """Schema-complete records with defaults, and ``errors``: every rule that a record breaks."""
    ids = {k: f(F.col(k)) for k, f in (("pmid", N.norm_pmid), ("doi", N.norm_doi), ("pmcid", N.norm_pmcid))}
    none = F.array().cast("array<string>")
    ft = F.col("fulltext")
    status = F.coalesce(ft["status"], F.lit("missing"))
    tier = F.when((status == "missing") & ft["access_route"].isNotNull(), F.coalesce(ft["source_tier"], F.lit(8))).otherwise(ft["source_tier"])
    out = raw.withColumns(ids)
    out = out.withColumn("evidence_id", F.coalesce("evidence_id", N.evidence_id(F.col("pmid"), F.col("doi"), F.col("pmcid"), F.coalesce("url", "title"))))
    seen = F.array_union(F.coalesce("seen_in_queries", none), F.array_compact(F.array("first_seen_query")))
    out = (
        out.withColumn("retraction_status", F.coalesce("retraction_status", F.lit("none"))).withColumn("source", F.coalesce("source", F.lit("pubmed")))
        .withColumn("is_preprint", F.coalesce("is_preprint", F.lit(False))).withColumns({c: F.coalesce(c, none) for c in ("authors", "article_types", "mesh_terms", "keywords")})
        .withColumn("fulltext", F.struct(status.alias("status"), tier.alias("source_tier"), *[ft[c].alias(c) for c in ("access_route", "local_path", "sha256")], F.coalesce(ft["truncation_detected"], F.lit(False)).alias("truncation_detected")))
        .withColumn("seen_in_queries", F.array_sort(seen)).withColumns({c: F.array_sort(F.array_distinct(F.coalesce(c, none))) for c in ("merged_from", "source_ids")})
    )
    bad = F.array_compact(
        F.array(
            F.when(F.col("evidence_id").isNull(), "no identity"), F.when(F.coalesce("title", F.lit("")) == "", "title missing"),
            F.when(~F.col("retraction_status").isin(*S.RETRACTION), "retraction_status"), F.when(~F.col("source").isin(*S.SOURCES), "source"),
            F.when(F.col("screening").isNotNull() & ~F.coalesce(F.col("screening.decision").isin(*S.DECISIONS), F.lit(False)), "screening.decision"),
            F.when(~status.isin(*S.FULLTEXT_STATUS), "fulltext.status"), F.when(F.col("fulltext.truncation_detected") & (status == "fulltext"), "truncated full text"),
            F.when(~F.col("fulltext.source_tier").between(0, 8), "fulltext.source_tier"),
        )
    )
    return out.withColumn("errors", bad)


def strict_view(records: DataFrame) -> DataFrame:
    """The core fields only, for export."""
    from pyspark.sql.types import StructType

    extras = {"seen_in_queries", "merged_from", "source_ids", "url"}
    return records.select(*[f.name for f in StructType.fromDDL(S.CORPUS).fields if f.name not in extras and f.name in records.columns])


# ---------------------------------------------------------------- BibTeX


def parse_bibtex(text: str) -> list[dict]:
    """Entries of a BibTeX text as ``type, key, fields``; comments, strings and preambles are skipped."""
    out, at = [], 0
    for m in re.finditer(r"@(\w+)\s*\{", text or ""):
        if m.start() < at:
            continue
        depth, k = 1, m.end()
        while k < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[k], 0)
            k += 1
        at = k
        kind, body = m[1].lower(), text[m.end() : k - 1]
        if kind in ("comment", "string", "preamble") or "," not in body:
            continue
        key, _, rest = body.partition(",")
        out.append({"type": kind, "key": key.strip(), "fields": dict(_bib_fields(rest))})
    return out


def _bib_fields(body: str) -> list[tuple[str, str]]:
    out, k = [], 0
    while m := re.compile(r"\s*,?\s*([\w-]+)\s*=\s*").match(body, k):
        k = m.end()
        if k < len(body) and body[k] == "{":
            depth, to = 1, k + 1
            while to < len(body) and depth:
                depth += {"{": 1, "}": -1}.get(body[to], 0)
                to += 1
            value, k = body[k + 1 : to - 1], to
        elif k < len(body) and body[k] == '"':
            to = body.find('"', k + 1)
            to = len(body) if to < 0 else to
            value, k = body[k + 1 : to], to + 1
        else:
            to = body.find(",", k)
            to = len(body) if to < 0 else to
            value, k = body[k:to], to
        out.append((m[1].lower(), re.sub(r"\s+", " ", re.sub(r"[{}]", "", value)).strip()))
    return out


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """Raw records of BibTeX files, one row per entry."""

    @F.pandas_udf("array<struct<type:string,key:string,fields:map<string,string>>>")
    def entries(values: pd.Series) -> pd.Series:
        return values.map(parse_bibtex)

    e = spark.read.text(path, wholetext=True).select(F.explode(entries("value")).alias("e")).select("e.*")
    f = F.col("fields")
    month = F.lpad(F.nullif(F.regexp_extract(f["month"], r"^(\d{1,2})$", 1), F.lit("")), 2, "0")
    return e.select(
        "key", "type", f["title"].alias("title"), F.coalesce(f["journal"], f["booktitle"]).alias("journal"), F.concat_ws("-", f["year"], month).alias("publication_date"),
        F.filter(F.split(F.coalesce(f["author"], F.lit("")), r"\s+and\s+"), lambda a: a != "").alias("authors"), N.norm_doi(f["doi"]).alias("doi"),
        F.coalesce(f["pmid"], F.nullif(F.regexp_extract(F.coalesce(f["note"], F.lit("")), r"(?i)pmid:?\s*(\d+)", 1), F.lit(""))).alias("pmid"), N.norm_pmcid(f["pmcid"]).alias("pmcid"),
        f["volume"].alias("volume"), f["number"].alias("issue"), f["pages"].alias("pages"), f["issn"].alias("issn"), f["abstract"].alias("abstract"), f["url"].alias("url"),
    )


# ---------------------------------------------------------------- PubMed XML

PUBMED = (
    "MedlineCitation struct<PMID:struct<_VALUE:string>,Article:struct<ArticleTitle:string,Journal:struct<Title:string,ISSN:struct<_VALUE:string>,JournalIssue:struct<Volume:string,Issue:string,"
    "PubDate:struct<Year:string,Month:string,Day:string,MedlineDate:string>>>,Abstract:struct<AbstractText:array<struct<_Label:string,_VALUE:string>>>,"
    "AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,Initials:string,CollectiveName:string>>>,PublicationTypeList:struct<PublicationType:array<struct<_VALUE:string>>>>,"
    "MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:struct<_VALUE:string>>>>,CommentsCorrectionsList:struct<CommentsCorrections:array<struct<_RefType:string>>>>, "
    "PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>"
)
# Months by name, and retraction marks from the weakest on.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
CORRECTION_RANK = {"ErratumIn": 1, "ExpressionOfConcernIn": 2, "RetractionIn": 3}
TYPE_RANK = {"Expression of Concern": 2, "Retracted Publication": 3}


def read_pubmed(spark: SparkSession, path: str) -> DataFrame:
    """Records of PubMed article sets. Dates keep the precision they have."""
    c, p = F.col("MedlineCitation"), F.col("PubmedData")
    x = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(PUBMED).load(path)
    art = c["Article"]
    d = art["Journal"]["JournalIssue"]["PubDate"]
    name = F.lower(F.substring(d["Month"], 1, 3))
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name)
    month = F.when(d["Month"].rlike(r"^\d+$"), F.lpad(d["Month"], 2, "0")).when(number > 0, F.lpad(number.cast("string"), 2, "0"))
    year = F.coalesce(d["Year"], F.nullif(F.regexp_extract(d["MedlineDate"], r"(\d{4})", 1), F.lit("")))
    date = F.concat_ws("-", year, F.when(year.isNotNull(), month), F.when(month.isNotNull(), F.lpad(d["Day"], 2, "0")))

    def ident(kind: str):  # noqa: ANN202
        return F.filter(p["ArticleIdList"]["ArticleId"], lambda i: i["_IdType"] == kind)[0]["_VALUE"]

    ranks = F.create_map(*[F.lit(v) for kv in CORRECTION_RANK.items() for v in kv])
    kinds = F.create_map(*[F.lit(v) for kv in TYPE_RANK.items() for v in kv])
    none = F.array().cast("array<int>")
    rank = F.greatest(
        F.array_max(F.coalesce(F.transform(c["CommentsCorrectionsList"]["CommentsCorrections"], lambda r: F.coalesce(ranks[r["_RefType"]], F.lit(0))), none)),
        F.array_max(F.coalesce(F.transform(art["PublicationTypeList"]["PublicationType"], lambda t: F.coalesce(kinds[t["_VALUE"]], F.lit(0))), none)), F.lit(0),
    )
    author = lambda a: F.coalesce(a["CollectiveName"], F.concat_ws(" ", a["LastName"], a["Initials"]))
    return x.select(
        c["PMID"]["_VALUE"].alias("pmid"), N.norm_doi(ident("doi")).alias("doi"), N.norm_pmcid(ident("pmc")).alias("pmcid"), art["ArticleTitle"].alias("title"), art["Journal"]["Title"].alias("journal"),
        date.alias("publication_date"), F.transform(art["AuthorList"]["Author"], author).alias("authors"), F.transform(art["PublicationTypeList"]["PublicationType"], lambda t: t["_VALUE"]).alias("article_types"),
        F.transform(c["MeshHeadingList"]["MeshHeading"], lambda m: m["DescriptorName"]["_VALUE"]).alias("mesh_terms"),
        F.array_join(F.transform(art["Abstract"]["AbstractText"], lambda t: F.concat_ws(": ", t["_Label"], t["_VALUE"])), "\n").alias("abstract"),
        F.element_at(F.array(*[F.lit(s) for s in ("none", "corrected", "expression_of_concern", "retracted")]), rank + 1).alias("retraction_status"),
        F.exists(F.coalesce(F.transform(art["PublicationTypeList"]["PublicationType"], lambda t: t["_VALUE"]), F.array().cast("array<string>")), lambda t: t == "Preprint").alias("is_preprint"),
        art["Journal"]["JournalIssue"]["Volume"].alias("volume"), art["Journal"]["JournalIssue"]["Issue"].alias("issue"), art["Journal"]["ISSN"]["_VALUE"].alias("issn"),
    )


# ---------------------------------------------------------------- reports


def scan_report(reports: DataFrame) -> DataFrame:
    """Lines of Markdown reports: ``report_id, line_no, kind, section, text, keys``.

    Kinds: front, heading, code, quote, table, list, note (a footnote's definition), blank, prose. Keys
    are the footnotes that a line of prose refers to, or the one that it defines.
    """
    lines = reports.select("report_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    w = Window.partitionBy("report_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rule = (F.col("text").rlike(r"^---\s*$")).cast("int")
    fence = F.col("text").rlike(r"^\s*(```|~~~)").cast("int")
    lines = lines.withColumn("_rules", F.sum(rule).over(w)).withColumn("_fences", F.sum(fence).over(w)).withColumn("_first", F.first("text").over(w))
    front = F.col("_first").rlike(r"^---\s*$") & ((F.col("_rules") == 1) | ((F.col("_rules") == 2) & (rule == 1)))
    code = (F.col("_fences") % 2 == 1) | (fence == 1)
    kind = (
        F.when(front, "front").when(code, "code").when(F.col("text").rlike(r"^#{1,6}\s"), "heading").when(F.col("text").rlike(r"^\[\^[^\]]+\]:"), "note")
        .when(F.col("text").rlike(r"^\s*>"), "quote").when(F.col("text").rlike(r"^\s*\|"), "table").when(F.col("text").rlike(r"^\s*([-*+]|\d+\.)\s"), "list").when(F.trim("text") == "", "blank").otherwise("prose")
    )
    lines = lines.withColumn("kind", kind)
    head = F.when(F.col("kind") == "heading", F.trim(F.regexp_replace("text", r"^#{1,6}\s+", "")))
    keys = F.when(F.col("kind").isin("front", "code"), F.array().cast("array<string>")).otherwise(F.regexp_extract_all("text", F.lit(r"\[\^([^\]]+)\]"), F.lit(1)))
    return lines.withColumn("section", F.last(head, ignorenulls=True).over(w)).withColumn("keys", keys).drop("_rules", "_fences", "_first")


def urls_in(records: DataFrame, *columns: str):  # noqa: ANN201
    """Addresses anywhere in nested values."""
    return F.array_distinct(F.regexp_extract_all(F.to_json(F.struct(*columns)), F.lit(r"""https?://[^\s"\\<>]+"""), F.lit(0)))


def lint(lines: DataFrame, phrases: list[str]) -> DataFrame:
    """Lines of prose with a forbidden phrase."""
    found = F.array_compact(F.array(*[F.when(F.contains(F.lower("text"), F.lit(p.lower())), p) for p in phrases]))
    return lines.filter("kind = 'prose'").withColumn("phrases", found).filter(F.size("phrases") > 0)
