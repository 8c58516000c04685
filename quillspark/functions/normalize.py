"""Normalisers of titles, identifiers, urls, queries and dates, as column functions.

Three DOI normalisers exist on purpose: the corpus form, the library form and the strict
relational form differ in prefixes and in the marks they strip.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
CORPUS_DOI_PREFIXES = (
    "https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi.org/", "dx.doi.org/", "doi:",
)
LIBRARY_DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "doi:", "https://dx.doi.org/")
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "does", "for", "from", "has", "have", "how", "in", "into", "is", "it", "its", "of", "on", "or", "that", "the",
    "their", "to", "vs", "with", "without", "what", "which", "who", "why",
]
STRAIGHT = {"“": '"', "”": '"', "‘": "'", "’": "'", "«": '"', "»": '"', "′": "'", "″": '"'}


def _each(values: pd.Series, rule) -> pd.Series:  # noqa: ANN001
    return values.map(lambda v: None if v is None else rule(v))


@F.pandas_udf(StringType())
def _plain_fold(values: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, case-folded."""
    return _each(values, lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold())


@F.pandas_udf(StringType())
def _compat_fold(values: pd.Series) -> pd.Series:
    return _each(values, lambda t: unicodedata.normalize("NFKC", t).casefold())


def _is_ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7f]*$")


def fold_plain(c: Column) -> Column:
    """Case-folded text without diacritics; ASCII values stay in the JVM."""
    return F.when(_is_ascii(c), F.lower(c)).otherwise(_plain_fold(F.when(~_is_ascii(c), c)))


def fold_compat(c: Column) -> Column:
    return F.when(_is_ascii(c), F.lower(c)).otherwise(_compat_fold(F.when(~_is_ascii(c), c)))


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def norm_title(c: Column) -> Column:
    """Title for comparison: folded, everything but word characters and spaces is a space; null is empty."""
    return F.coalesce(_squeeze(F.regexp_replace(fold_plain(c), r"(?U)[^\w\s]", " ")), F.lit(""))


def normalize_title(c: Column) -> Column:
    """Library form: only ASCII letters and digits remain."""
    return F.coalesce(F.trim(F.regexp_replace(fold_plain(c), "[^a-z0-9]+", " ")), F.lit(""))


def _without_prefixes(c: Column, prefixes: tuple[str, ...]) -> Column:
    """Each prefix dropped once, in order; every step names its input once, so plans stay small."""
    for p in prefixes:
        c = F.regexp_replace(c, rf"^\Q{p}\E", "")
    return c


def norm_doi(c: Column) -> Column:
    """Corpus form: each known prefix is dropped once, in order; trailing marks go; empty is null."""
    bare = _without_prefixes(F.regexp_replace(fold_compat(c), r"(?U)^\s+|\s+$", ""), CORPUS_DOI_PREFIXES)
    return F.nullif(F.regexp_replace(F.regexp_replace(bare, r"(?U)^\s+|\s+$", ""), r"[.,;)]+$", ""), F.lit(""))


def library_doi(c: Column) -> Column:
    bare = _without_prefixes(F.lower(F.trim(c)), LIBRARY_DOI_PREFIXES)
    return F.nullif(F.regexp_replace(bare, r"""[).,;\]>'"]+$""", ""), F.lit(""))


def strict_doi(c: Column, on_error: str = "raise") -> Column:
    """Relational form: one prefix, lower case; what is no DOI raises, or is null with ``on_error='null'``."""
    bare = F.lower(F.trim(F.regexp_replace(F.trim(c), r"(?i)^\s*(?:https?://(?:dx\.)?doi\.org/|doi:)\s*", "")))
    bad = F.raise_error(F.concat(F.lit("not a valid DOI: "), c)).cast("string") if on_error == "raise" else F.lit(None).cast("string")
    return F.when(c.isNull(), None).when(bare.rlike(r"^10\.\d{4,9}/\S+$"), bare).otherwise(bad)


def norm_pmid(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.trim(c), "(?i)^pmid:", ""), F.lit(""))


def strict_pmid(c: Column) -> Column:
    """Digits only, else null."""
    bare = F.trim(F.regexp_replace(c, r"(?i)^\s*pmid:\s*", ""))
    return F.when(bare.rlike(r"^\d+$"), bare)


def norm_pmcid(c: Column) -> Column:
    bare = F.regexp_replace(F.upper(F.trim(c)), "^PMC:", "")
    return F.nullif(F.when(bare.rlike(r"^\d+$"), F.concat(F.lit("PMC"), bare)).otherwise(bare), F.lit(""))


def strict_pmcid(c: Column) -> Column:
    digits = F.regexp_extract(F.trim(c), r"(?i)^\s*(?:pmc)?(\d+)\s*$", 1)
    return F.when(digits != "", F.concat(F.lit("PMC"), digits))


def normalize_url(c: Column) -> Column:
    """Scheme and host in lower case, one trailing slash of the path dropped; null without scheme or host."""
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"
    u = F.trim(c)
    path = F.regexp_extract(u, parts, 3)
    path = F.when((path != "/") & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    whole = F.concat(
        F.lower(F.regexp_extract(u, parts, 1)), F.lit("://"), F.lower(F.regexp_extract(u, parts, 2)), path,
        F.regexp_extract(u, parts, 4), F.regexp_extract(u, parts, 5),
    )
    return F.when(u.rlike(parts), whole)


def compare_url(c: Column) -> Column:
    """Form for comparisons only: all trailing slashes go."""
    return F.regexp_replace(normalize_url(c), "/+$", "")


def identifier_urls(pmid: Column, doi: Column, pmcid: Column) -> Column:
    """Addresses that an identifier triple stands for."""
    return F.array_compact(
        F.array(
            F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid),
            F.concat(F.lit("https://doi.org/"), doi),
            F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), pmcid),
        )
    )


def evidence_id(pmid: Column, doi: Column, pmcid: Column, url: Column) -> Column:
    """Identity by precedence: pmid, doi, pmcid, else a digest of the url (or what stands for it)."""
    return F.coalesce(
        F.concat(F.lit("pmid:"), norm_pmid(pmid)),
        F.concat(F.lit("doi:"), norm_doi(doi)),
        F.concat(F.lit("pmcid:"), norm_pmcid(pmcid)),
        F.concat(F.lit("url:"), F.substring(F.sha2(url, 256), 1, 16)),
    )


def id_precedence(eid: Column) -> Column:
    kind = F.substring_index(eid, ":", 1)
    return F.when(kind == "pmid", 0).when(kind == "doi", 1).when(kind == "pmcid", 2).when(kind == "url", 3).otherwise(4)


def record_stem(pmid: Column, doi: Column, pmcid: Column, eid: Column) -> Column:
    """File name stem of a record."""
    return F.coalesce(
        F.concat(F.lit("pmid-"), pmid),
        F.when(library_doi(doi).isNotNull(), F.concat(F.lit("doi-"), slugify(F.replace(library_doi(doi), F.lit("/"), F.lit("-"))))),
        F.concat(F.lit("pmcid-"), pmcid),
        slugify(F.replace(eid, F.lit(":"), F.lit("-"))),
    )


def year_of(c: Column) -> Column:
    """Leading four digits as an integer, else null; months and days are never invented."""
    return F.nullif(F.regexp_extract(c, r"^(\d{4})", 1), F.lit("")).cast("int")


def date_precision(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), "day").when(c.rlike(r"^\d{4}-\d{2}$"), "month").when(c.rlike(r"^\d{4}$"), "year")


def parse_year_range(text: str) -> tuple[int, int]:
    """``YYYY`` or ``YYYY-YYYY``; reversed bounds are swapped."""
    low, _, high = text.strip().partition("-")
    years = sorted((int(low), int(high or low)))
    return years[0], years[1]


def norm_query(c: Column) -> Column:
    """Form in which repeated queries are equal: straight quotes, folded case, upper-case operators, tight marks."""
    q = F.translate(fold_compat(F.translate(c, "".join(STRAIGHT), "".join(STRAIGHT.values()))), "".join(STRAIGHT), "".join(STRAIGHT.values()))
    for word in ("and", "or", "not"):
        q = F.regexp_replace(q, rf"(?U)\b{word}\b", word.upper())
    q = F.regexp_replace(F.regexp_replace(q, r"(?U)\s*([()])\s*", "$1"), r"(?U)\s*:\s*", ":")
    return _squeeze(q)


def query_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(norm_query(c), 256))


def query_sort_key(c: Column) -> Column:
    """Order of query ids: the pool's, then q1, q2, q10, then others by name, then none."""
    number = F.nullif(F.regexp_extract(F.trim(c), r"(?i)^q(\d+)$", 1), F.lit("")).cast("long")
    kind = F.when(c.isNull() | (c == ""), 2).when(c == "pool-seed", -1).when(number.isNotNull(), 0).otherwise(1)
    return F.struct(kind.alias("kind"), F.when(kind == 1, c).otherwise("").alias("name"), F.coalesce(number, F.lit(0)).alias("number"))


def slugify_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._~-]+", "-"), "^-+|-+$", "")


def slugify(c: Column, longest: int = 80) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.coalesce(F.trim(c), F.lit("")), "[^A-Za-z0-9._~-]+", "-"), "-{2,}", "-")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, longest), F.lit("")), F.lit("unknown"))


def doi_slug(c: Column) -> Column:
    return F.lower(slugify(F.replace(norm_doi(c), F.lit("/"), F.lit("-"))))


def norm_term(c: Column) -> Column:
    """Controlled term for comparison: single spaces, lower case."""
    return F.lower(_squeeze(c))


def tokens(c: Column) -> Column:
    """Words of three letters or digits or more, without stop words, in order."""
    found = F.regexp_extract_all(norm_title(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS))


def canonical_hash(**named: Column) -> Column:
    """Digest of a record: JSON of its fields in the order of their names, nulls included."""
    fields = F.struct(*[named[k].alias(k) for k in sorted(named)])
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def verdict_key(c: Column) -> Column:
    """Keys of screening verdicts: bare digits are PubMed ids."""
    return F.when(F.trim(c).rlike(r"^\d+$"), F.concat(F.lit("pmid:"), F.trim(c))).otherwise(F.trim(c))
