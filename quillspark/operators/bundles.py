"""Rules of a concept bundle that need its files: links and their places, types in front matter, logs, and index files."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import Scratch

# Roots that notes may point into, roots that need not exist, types with bibliographic texts, and those texts.
INSIDE = ("research", "assets/papers")
LOOSE = ("wiki", "outputs")
PUBMED_TYPES = ("Study", "Source Document")
PUBMED_PAGES = "https://pubmed.ncbi.nlm.nih.gov/"
TEXTS = ("pmid", "doi", "pmcid", "volume", "issue", "pages")
#: A place that at least one of so many links leads to is hot.
HOT = 1000
MD_LINK = r"(?<!!)\[[^\]\n]*\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)"


def resolve(base: Column, link: Column) -> Column:
    """Place of a relative link from a folder, both below the bundle's root, with ``.`` and ``..`` folded; null where it leaves the root.

    Segments go through a stack: ``..`` takes the last one off, and more of them than there are segments lead out.
    """
    parts = F.when(link.startswith("/"), F.array(F.lit(".."))).otherwise(F.split(F.concat(base, F.lit("/"), link), "/"))
    none = F.expr("cast(array() as array<string>)")
    start = F.struct(none.alias("at"), F.lit(False).alias("out"))

    def step(s: Column, p: Column) -> Column:
        up = F.struct(F.slice(s["at"], F.lit(1), F.greatest(F.size(s["at"]) - 1, F.lit(0))).alias("at"), (s["out"] | (F.size(s["at"]) == 0)).alias("out"))
        return F.when(p.isin("", "."), s).when(p == "..", up).otherwise(F.struct(F.array_append(s["at"], p).alias("at"), s["out"].alias("out")))

    return F.aggregate(parts, start, step, lambda s: F.when(~s["out"], F.array_join(s["at"], "/")))


def _below(path: Column, roots: tuple[str, ...], itself: bool = True) -> Column:
    return functools.reduce(lambda a, b: a | b, [path.startswith(r + "/") | ((path == r) if itself else F.lit(False)) for r in roots])


def links(notes: DataFrame) -> DataFrame:
    """Links of notes (path, front as JSON, body) that name a place: ``path, kind, dest, resolved``; resources of sources and markdown links.

    Web and mail addresses and places inside the note are none; what follows ``#`` or ``?`` is no part of a place.
    """
    sources = F.coalesce(F.expr("transform(cast(try_variant_get(try_parse_json(front), '$.sources', 'array<variant>') as array<variant>), s -> try_variant_get(s, '$.resource', 'string'))"), F.expr("cast(array() as array<string>)"))
    one = lambda kind, a: F.transform(a, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("dest")))
    found = F.concat(one("resource", F.array_compact(sources)), one("link", F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(MD_LINK), F.lit(1))))
    rows = notes.select("path", F.explode(found).alias("x")).select("path", "x.kind", "x.dest").distinct()
    rows = rows.filter(~F.col("dest").rlike(r"^(?:https?|mailto):") & ~F.col("dest").startswith("#"))
    clean = F.substring_index(F.substring_index("dest", "#", 1), "?", 1)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    return rows.withColumn("_c", clean).filter("_c <> ''").select("path", "kind", "dest", resolve(folder, F.col("_c")).alias("resolved"))


def places(paths: DataFrame) -> DataFrame:
    """``resolved`` of all files (path) and of the folders that they lie in."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return paths.select(F.explode(up).alias("resolved")).distinct()


def dangling(notes: DataFrame, paths: DataFrame, scratch: Scratch) -> DataFrame:
    """V17, a row for each link that breaks it: ``path, kind, dest, problem``.

    ``dangling``: nothing is there, unless the place belongs to the wiki or to the runs, which need not exist; ``outside``: it exists,
    but in no part of the bundle. A link that leaves the root is dangling, since nothing is known of what is there.

    Each place is looked up once, however many links lead to it. Places of a thousandth of all links or more, of which there are a
    thousand at most, go back to the links by broadcast, the others by a join.
    """
    found = scratch.table(links(notes), "links")
    counted = found.filter("resolved is not null").groupBy("resolved").agg(F.count(F.lit(1)).alias("_n"))
    known = scratch.table(counted.join(places(paths).withColumn("_there", F.lit(True)), "resolved", "left"), "places")
    total = found.count()
    hot = F.broadcast(known.filter(F.col("_n") * HOT >= total).drop("_n"))
    rest = known.filter(F.col("_n") * HOT < total).drop("_n")
    met = found.join(hot, "resolved").unionByName(found.join(hot.select("resolved"), "resolved", "left_anti").join(rest, "resolved", "left"))
    loose = F.coalesce(_below(F.col("resolved"), ("wiki",)) | _below(F.col("resolved"), ("outputs",), itself=False), F.lit(False))
    inside = F.coalesce(_below(F.col("resolved"), INSIDE), F.lit(False))
    problem = F.when(F.col("_there").isNull() & ~loose, "dangling").when(F.col("_there").isNotNull() & ~inside & ~loose, "outside")
    return met.select("path", "kind", "dest", problem.alias("problem")).filter("problem is not null")


def untyped(notes: DataFrame) -> DataFrame:
    """V13: bibliographic texts of studies that their files state as numbers, truth values or dates: ``path, field, said``."""
    record = F.try_parse_json("front")
    get = lambda f: F.try_variant_get(record, f"$.{f}", "string")
    pubmed = F.coalesce(get("type").isin(*PUBMED_TYPES), F.lit(False)) | F.coalesce(get("resource").startswith(PUBMED_PAGES), F.lit(False))

    def one(f: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(record, f"$.{f}", "variant"))
        number = kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.isin("DOUBLE", "BOOLEAN")
        return F.when(F.coalesce(number, F.lit(False)), F.struct(F.lit(f).alias("field"), get(f).alias("said")))

    return notes.filter(pubmed).select("path", F.explode(F.array_compact(F.array(*[one(f) for f in TEXTS]))).alias("x")).select("path", "x.field", "x.said")


def log_problems(files: DataFrame) -> DataFrame:
    """V20: headings of logs (path, text) that are no dates, come twice, or come before an earlier one: ``path, line_no, heading, problem``.

    Lines count from 1. A heading twice that also goes back in time has both rows.
    """
    logs = files.filter(F.col("path").rlike(r"^research/(?:.*/)?log\.md$"))
    lines = logs.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    heads = lines.filter(F.col("line").rlike(r"^##\s+")).select("path", (F.col("line_no") + 1).alias("line_no"), F.trim(F.regexp_replace("line", r"^##\s+", "")).alias("heading"))
    dated = F.col("heading").rlike(r"^\d{4}-\d{2}-\d{2}$")
    bad = heads.filter(~dated).select("path", "line_no", "heading", F.lit("no date").alias("problem"))
    order = Window.partitionBy("path").orderBy("line_no")
    kept = heads.filter(dated).withColumn("_before", F.lag("heading").over(order)).withColumn("_n", F.row_number().over(Window.partitionBy("path", "heading").orderBy("line_no")))
    again = kept.filter("_n > 1").select("path", "line_no", "heading", F.lit("twice").alias("problem"))
    back = kept.filter("heading < _before").select("path", "line_no", "heading", F.lit("out of order").alias("problem"))
    return bad.unionByName(again).unionByName(back)


def without_index(paths: DataFrame) -> DataFrame:
    """V21: folders of the bundle that hold notes but no index: ``folder, notes``."""
    own = paths.filter(F.col("path").rlike(r"^research/[^/]+/[^/]+\.md$")).select(F.split_part(F.col("path"), F.lit("/"), F.lit(2)).alias("folder"), F.substring_index("path", "/", -1).alias("name")).distinct()
    counted = own.groupBy("folder").agg(F.count_if(F.col("name") != "index.md").alias("notes"), F.bool_or(F.col("name") == "index.md").alias("_index"))
    return counted.filter("notes > 0 and not _index").drop("_index")


# ---------------------------------------------------------------- bibliographic front matter


def author_parts(name: Column) -> Column:
    """``Smith JA`` as family and initials, a struct of family, given, initials, affiliation and collective; nothing is invented, so a name without
    initials of one to four capitals at its end is all family, and an empty one all null."""
    flat = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s+", " "))
    shape, none = r"^(.+?)\s+([A-Z]{1,4})$", F.lit(None).cast("string")
    has = flat.rlike(shape)
    family = F.when(has, F.regexp_extract(flat, shape, 1)).otherwise(F.nullif(flat, F.lit("")))
    return F.struct(family.alias("family"), none.alias("given"), F.when(has, F.regexp_extract(flat, shape, 2)).alias("initials"), none.alias("affiliation"), none.alias("collective"))


def biblio_front(records: DataFrame) -> DataFrame:
    """Bibliographic part of a note's front matter: ``evidence_id, biblio`` (a struct in the order of the format; what is unknown is null and so left out).

    ``records``: evidence_id, pmid, pmcid, doi, authors (array of texts), journal, publication_date, volume, issue, pages, abstract, article_types,
    retraction_status, is_preprint. Another retraction status than the four is an error, a missing one is ``none``.
    """
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")).alias(c)
    journal = F.when(F.coalesce("journal", F.lit("")) != "", F.struct(F.lit(None).cast("string").alias("title"), F.col("journal").alias("iso_abbrev"), F.lit(None).cast("string").alias("issn")))
    status = F.coalesce(F.nullif("retraction_status", F.lit("")), F.lit("none"))
    known = F.when(status.isin("none", "retracted", "expression_of_concern", "corrected"), status).otherwise(F.raise_error(F.concat(F.lit("invalid retraction_status: "), status)))
    authors = F.when(F.size("authors") > 0, F.transform("authors", author_parts))
    biblio = F.struct(
        text("pmid"), text("pmcid"), F.nullif(F.lower(F.trim("doi")), F.lit("")).alias("doi"), authors.alias("authors"), journal.alias("journal"), text("publication_date"), text("volume"), text("issue"), text("pages"), text("abstract"),
        F.col("article_types"), known.alias("retraction_status"), F.col("is_preprint"),
    )
    return records.select("evidence_id", biblio.alias("biblio"))
