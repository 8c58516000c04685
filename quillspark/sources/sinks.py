"""Sinks: versioned tables, content-addressed files, bibliographies, export bundles, manifests."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions import normalize as N
from quillspark.session import put_if_absent

# Tiers of full text as notes name them, and the escapes of TeX.
TIERS = ("local library", "PMC full text", "PMC PDF", "Europe PMC full-text XML", "Unpaywall location", "open-access fetch", "preprint twin", "browser search/fetch", "quarantined; full text not obtained")
TEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
# Notes by retraction status, and preprint servers by what names them.
RETRACTION_NOTES = {"retracted": "RETRACTED.", "expression_of_concern": "Expression of Concern.", "corrected": "A correction to this article exists."}
SERVERS = {"biorxiv": "bioRxiv", "medrxiv": "medRxiv", "researchsquare": "Research Square", "research-square": "Research Square", "arxiv": "arXiv", "10.1101": "bioRxiv / medRxiv", "10.21203": "Research Square"}


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write a table's next version to a folder of its own, then its pointer beside those before it.

    A pointer is put whole and never replaced, so readers find the last whole version at any moment; a version that has
    a pointer already is an error.
    """
    path = f"{root}/v{version:06d}"
    df.write.mode("errorifexists").parquet(path)
    if not put_if_absent(df.sparkSession, f"{root}/current/{version:06d}.json", json.dumps({"version": version, "path": path}) + "\n"):
        raise ValueError(f"version {version} is taken")
    return path


def read_current(spark: SparkSession, root: str) -> DataFrame:
    row = spark.read.schema("version int, path string").json(f"{root}/current").orderBy(F.desc("version")).first()
    return spark.read.parquet(row["path"])


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; null fields are left out, so absent and null are one."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def content_addressed(files: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, content) by digest: contents to store, once each, and the assets of all paths."""
    named = files.withColumn("sha256", F.sha2("content", 256)).withColumn("size", F.length("content"))
    fresh = named.dropDuplicates(["sha256"]).join(stored.select("sha256"), "sha256", "left_anti")
    return fresh.select("sha256", "size", "content"), named.select("path", "sha256", "size")


# ---------------------------------------------------------------- bibliographies


def _has_type(*kinds: str) -> Column:
    return F.exists("article_types", lambda t: F.lower(t).isin(*kinds))


def entry_type() -> Column:
    journal = F.coalesce("journal", F.lit("")) != ""
    return (
        F.when(F.col("is_preprint"), "misc").when(_has_type("book chapter", "chapter"), "incollection").when(_has_type("book") | (F.col("source") == "book"), "book")
        .when(F.col("source").isin("guideline", "web"), "misc").when(journal, "article").otherwise("misc")
    )


def ris_type() -> Column:
    names = {"article": "JOUR", "incollection": "CHAP", "book": "BOOK"}
    return F.when(F.col("is_preprint"), "UNPB").otherwise(F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[entry_type()], F.lit("GEN")))


def author_name(c: Column) -> Column:
    """``Family, G. I.`` where the name ends in initials, else the name as it is."""
    shape = r"^(.+)\s+([A-Z][A-Z-]{0,4})$"
    name = F.trim(F.regexp_replace(c, r"\s+", " "))
    initials = F.regexp_replace(F.regexp_replace(F.regexp_extract(name, shape, 2), "-", ""), "([A-Z])(?=.)", "$1. ")
    return F.when(name.rlike(shape), F.concat(F.regexp_extract(name, shape, 1), F.lit(", "), initials, F.lit("."))).otherwise(name)


def notes() -> Column:
    """What a bibliography must say of a record, as an array."""
    status, tier = F.col("fulltext.status"), F.col("fulltext.source_tier")
    label = F.try_element_at(F.array(*[F.lit(t) for t in TIERS]), tier + 1)
    return F.array_compact(
        F.array(
            F.create_map(*[F.lit(x) for kv in RETRACTION_NOTES.items() for x in kv])[F.col("retraction_status")], F.when(F.col("is_preprint"), "Preprint. Not peer reviewed."),
            F.when(status == "abstract_only", "Abstract only; full text not obtained.").when(status == "missing", "Full text not obtained (quarantined)."),
            F.when(status == "fulltext", F.concat(F.lit("Full text via "), label, F.lit(" (source tier "), tier.cast("string"), F.lit(")."))),
        )
    )


def canonical_url() -> Column:
    return F.coalesce(F.concat(F.lit("https://doi.org/"), "doi"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid", F.lit("/")), F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), "pmcid", F.lit("/")), F.col("url"))


def preprint_server() -> Column:
    where = F.lower(F.concat_ws(" ", "doi", "url"))
    return F.coalesce("journal", *[F.when(F.contains(where, F.lit(k)), v) for k, v in SERVERS.items()])


def tex(c: Column) -> Column:
    """TeX-escaped text, character by character."""
    known = F.create_map(*[F.lit(x) for kv in TEX.items() for x in kv])
    return F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(known[ch], ch)), "")


@F.pandas_udf(StringType())
def tex_title(values: pd.Series) -> pd.Series:
    """Escaped title with capitals that styles must keep in braces."""
    import re

    def word(w: str, first: bool) -> str:
        lead, core, tail = re.match(r"^(\W*)(.*?)(\W*)$", w, re.S).groups()
        keep = any(c.isupper() for c in (core[1:] if first else core))
        lead, core, tail = ("".join(TEX.get(c, c) for c in x) for x in (lead, core, tail))
        return lead + ("{" + core + "}" if keep else core) + tail

    return values.map(lambda t: None if t is None else " ".join(word(w, k == 0) for k, w in enumerate(t.split())))


def select_for_bibliography(records: DataFrame, mode: str = "default") -> DataFrame:
    """Included records and all with a retraction mark; or everything; or by state of work."""
    if mode == "all":
        return records
    if mode == "extracted":
        return records.filter("extraction_path is not null")
    if mode == "appraised":
        return records.filter("appraisal_path is not null")
    return records.filter((F.col("screening.decision") == "include") | (F.col("retraction_status") != "none"))


def bibtex(records: DataFrame) -> DataFrame:
    """``key, entry`` of each record, one per key; absent values have no field."""
    kind = entry_type()
    year, month = N.year_of(F.col("publication_date")).cast("string"), F.nullif(F.regexp_extract("publication_date", r"^\d{4}-(\d{2})", 1), F.lit(""))
    where = F.when(kind == "article", "journal").when(kind == "incollection", "booktitle").when(kind == "book", "publisher").otherwise("howpublished")
    venue = F.when(F.col("is_preprint"), preprint_server()).otherwise(F.col("journal"))
    fields = [
        (F.lit("author"), F.array_join(F.transform("authors", lambda a: F.when(F.contains(author_name(a), F.lit(",")), tex(author_name(a))).otherwise(F.concat(F.lit("{"), tex(a), F.lit("}")))), " and ")),
        (F.lit("title"), tex_title("title")), (where, tex(venue)), (F.lit("year"), year), (F.lit("month"), month), (F.lit("volume"), F.col("volume")), (F.lit("number"), F.col("issue")),
        (F.lit("pages"), F.regexp_replace("pages", "[-–—]+", "--")), (F.lit("doi"), tex(F.col("doi"))), (F.lit("pmid"), F.col("pmid")), (F.lit("pmcid"), F.col("pmcid")), (F.lit("issn"), F.col("issn")),
        (F.lit("url"), tex(canonical_url())), (F.lit("keywords"), tex(F.array_join("keywords", ", "))), (F.lit("note"), tex(F.array_join(notes(), " "))),
    ]
    said = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(v), F.lit("")) != "", F.concat(F.lit("  "), F.rpad(n, 12, " "), F.lit(" = {"), v, F.lit("}"))) for n, v in fields]))
    key = F.regexp_replace("evidence_id", "[^A-Za-z0-9]", "")
    out = records.select(key.alias("key"), F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(said, ",\n"), F.lit("\n}\n")).alias("entry"))
    return out.groupBy("key").agg(F.min("entry").alias("entry"))


def ris(records: DataFrame) -> DataFrame:
    """``evidence_id, entry`` in RIS."""
    date = r"^(\d{4})-(\d{2})-(\d{2})$"
    day = F.when(F.col("publication_date").rlike(date), F.regexp_replace("publication_date", "-", "/")).otherwise(N.year_of(F.col("publication_date")).cast("string"))
    sides = F.split(F.trim("pages"), r"\s*[-–—]+\s*", 2)
    ranged = (F.size(sides) == 2) & (sides[0] != "") & (sides[1] != "") & (sides[0] != sides[1])

    def one(tag: str, value: Column) -> Column:
        v = F.trim(F.regexp_replace(value, "\r\n|\r|\n", " "))
        return F.when(F.coalesce(v, F.lit("")) != "", F.array(F.concat(F.lit(f"{tag}  - "), v))).otherwise(F.array().cast("array<string>"))

    def many(tag: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(f"{tag}  - "), v))

    all_notes = F.concat(notes(), F.array_compact(F.array(F.concat(F.lit("PMCID: "), "pmcid"))))
    lines = F.concat(
        one("TY", ris_type()), many("AU", F.transform("authors", author_name)), one("TI", F.col("title")), one("T2", F.col("journal")), one("PY", N.year_of(F.col("publication_date")).cast("string")), one("DA", day),
        one("VL", F.col("volume")), one("IS", F.col("issue")), one("SP", F.when(ranged, sides[0]).otherwise(F.col("pages"))), one("EP", F.when(ranged, sides[1])), one("DO", F.col("doi")), one("UR", canonical_url()),
        one("AB", F.col("abstract")), one("AN", F.col("pmid")), many("N1", all_notes), F.array(F.lit("ER  - ")),
    )
    return records.select("evidence_id", F.array_join(lines, "\n").alias("entry"))


def write_text(entries: DataFrame, path: str, order: str) -> None:
    entries.orderBy(order).select("entry").write.mode("overwrite").option("lineSep", "\n\n").text(path)


# ---------------------------------------------------------------- export and backup


def export_bundle(records: DataFrame, attachments: DataFrame) -> dict[str, DataFrame]:
    """Manifest, bibliography and files of an export; equal files once, with all their uses."""
    files = attachments.groupBy("sha256").agg(F.min("path").alias("path"), F.array_sort(F.collect_list(F.struct("evidence_id", "role"))).alias("uses"))
    held = attachments.groupBy("evidence_id").agg(F.array_sort(F.collect_set("sha256")).alias("files"))
    manifest = records.join(held, "evidence_id", "left").select("evidence_id", "title", "doi", "pmid", F.coalesce("files", F.array().cast("array<string>")).alias("files"))
    return {"manifest": manifest, "ris": ris(records), "files": files}


def export_counts(manifest: DataFrame, attachments: DataFrame) -> DataFrame:
    """One row: records, with a primary file, metadata only, supplements."""
    own = attachments.groupBy("evidence_id").agg(F.count_if(F.col("role") == "primary").alias("p"), F.count_if(F.col("role") == "supplement").alias("s"))
    j = manifest.join(own, "evidence_id", "left")
    return j.agg(F.count(F.lit(1)).alias("selected"), F.count_if(F.coalesce("p", F.lit(0)) > 0).alias("with_primary"), F.count_if(F.coalesce("p", F.lit(0)) == 0).alias("metadata_only"), F.coalesce(F.sum("s"), F.lit(0)).alias("supplements"))


def select_export(records: DataFrame, ids: DataFrame | None = None, included: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Chosen records, and the asked ids that none has, all of them at once."""
    if ids is None and included is None:
        return records, records.select("evidence_id").limit(0)
    asked = (ids if ids is not None else included).select("evidence_id").distinct()
    return records.join(asked, "evidence_id", "left_semi"), asked.join(records, "evidence_id", "left_anti")


def unique_names(rows: DataFrame) -> DataFrame:
    """File names of (label, sha256): a digest prefix, longer where labels share shorter ones."""
    lengths = F.array(*[F.lit(n) for n in (8, 12, 16, 24, 32, 64)])
    each = rows.select("label", "sha256", F.explode(lengths).alias("n")).withColumn("prefix", F.expr("substring(sha256, 1, n)"))
    clash = each.groupBy("label", "prefix").agg(F.count_distinct("sha256").alias("k"))
    fits = each.join(clash, ["label", "prefix"]).filter("k = 1").groupBy("label", "sha256").agg(F.min_by("prefix", "n").alias("prefix"))
    return fits.select("label", "sha256", F.concat_ws("-", "label", "prefix").alias("name"))


def manifest(files: DataFrame) -> DataFrame:
    """``path, size, sha256`` of binary files."""
    return files.select("path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def rename_files(spark: SparkSession, source: str, target: str, suffix: str) -> None:
    """Give every file of a folder another suffix, in another folder; a rename each, whatever the file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(target))
    for status in fs.listStatus(path(source)):
        name = status.getPath().getName()
        if status.isFile() and not name.startswith(("_", ".")):
            fs.rename(status.getPath(), path(f"{target}/{name.rpartition('.')[0]}{suffix}"))
