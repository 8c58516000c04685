"""Scalar rules of evidence tables, monitors and readers, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
RATIO_MEASURES = (
    "rr", "or", "hr", "irr", "rrr", "pr", "sir", "smr", "risk ratio", "odds ratio", "hazard ratio", "rate ratio",
    "incidence rate ratio", "prevalence ratio",
)
PRECISE_WIDTH = 2.0
PAYWALL_MARKERS = ("Access options", "Purchase", "Sign in to view", "Get access", "Subscribe")
TRUNCATION_WORDS = 1500
NOT_REPORTED = "not reported"
JUDGEMENT_CLASSES = {
    "low": "low", "low risk": "low", "some concerns": "some", "moderate": "some", "unclear": "some", "high": "high",
    "serious": "high", "critical": "high", "yes": "low", "no": "high", "can't tell": "some",
}
FORMATS = {"pdf": "PDF", "html": "HTML", "htm": "HTML", "txt": "Text", "md": "Text", "xml": "XML"}


def precision_class(effect: Column, low: Column, high: Column, measure: Column) -> Column:
    """Class of an estimate by its interval: width against size, on the log scale for ratios."""
    a, b = F.least(low, high), F.greatest(low, high)
    is_ratio = F.coalesce(F.lower(F.trim(measure)).isin(*RATIO_MEASURES), F.lit(False))
    null_value = F.when(is_ratio, 1.0).otherwise(0.0)
    positive = (a > 0) & (b > 0) & (effect > 0)
    width = F.when(~is_ratio, b - a).when(positive, F.ln(b) - F.ln(a))
    scale = F.when(~is_ratio, F.abs(effect)).when(positive, F.abs(F.ln(effect)))
    narrow = F.coalesce((scale > 0) & (width <= PRECISE_WIDTH * scale), F.lit(False))
    return (
        F.when(low.isNull() | high.isNull(), "unreported")
        .when((a <= null_value) & (null_value <= b), "null-compatible")
        .when(narrow, "precise")
        .otherwise("imprecise")
    )


def fmt_num(c: Column) -> Column:
    """Number with up to four decimals, without trailing zeros."""
    shown = F.when(c.isNotNull(), F.format_string("%.4f", c.cast("double")))  # a null number has no text
    return F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def effect_text(effect: Column, low: Column, high: Column, measure: Column) -> Column:
    head = F.when(effect.isNull(), NOT_REPORTED).otherwise(F.concat_ws(" ", measure, fmt_num(effect)))
    interval = F.concat(F.lit(" ["), fmt_num(low), F.lit(", "), fmt_num(high), F.lit("]"))
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(head, interval)).when(effect.isNull(), NOT_REPORTED).otherwise(
        F.concat(head, F.lit(f" (interval {NOT_REPORTED})"))
    )


def p_text(p: Column) -> Column:
    return F.coalesce(F.concat(F.lit("p = "), fmt_num(p)), F.lit(NOT_REPORTED))


def truncation_reasons(text: Column, html: Column) -> Column:
    """Why a fetched text may be cut: too few words, or signs of a paywall; empty if it looks whole."""
    body = F.coalesce(text, F.lit(""))
    words = F.size(F.filter(F.split(body, r"\s+"), lambda w: w != ""))
    whole = F.lower(F.concat(body, F.lit("\n"), F.coalesce(html, F.lit(""))))
    few = F.when(words < TRUNCATION_WORDS, F.concat(F.lit("body_words="), words.cast("string"), F.lit(f"<{TRUNCATION_WORDS}")))
    signs = [F.when(F.contains(whole, F.lit(m.lower())), F.lit(f"paywall_marker={m}")) for m in PAYWALL_MARKERS]
    return F.array_compact(F.array(few, *signs))


def infer_format(path: Column, route: Column, routes: dict[str, str] | None = None) -> Column:
    """Format by extension, else by the route that brought the file, else a dash."""
    by_name = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    known = routes or {"browser": "HTML", "pmc": "XML", "europepmc": "XML", "unpaywall": "PDF", "library": "PDF"}
    by_route = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(by_name[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))], by_route[route], F.lit("—"))


def parse_time(c: Column) -> Column:
    """ISO time with ``Z`` or an offset; null if it is none."""
    return F.try_to_timestamp(c)


def parse_duration(c: Column) -> Column:
    """Seconds of ``90s``, ``90m``, ``2h``, ``1d``, or bare seconds; null otherwise."""
    unit = F.create_map(*[F.lit(x) for kv in {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}.items() for x in kv])
    shape = r"(?i)^\s*(\d+(?:\.\d+)?)\s*([smhd]?)\s*$"
    return F.when(c.rlike(shape), F.regexp_extract(c, shape, 1).cast("double") * unit[F.lower(F.regexp_extract(c, shape, 2))])


def fmt_duration(seconds: Column) -> Column:
    s = F.floor(seconds)
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm", F.floor(s / 60)))
        .when(s < 86400, F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))
        .otherwise(F.format_string("%dd%02dh", F.floor(s / 86400), F.floor(s % 86400 / 3600)))
    )


def snippet(pieces: list[Column], terms: list[str], radius: int = 80) -> Column:
    """Context of the first term found, in the first piece (in order of preference) that has one."""

    def around(piece: Column) -> Column:
        low = F.lower(piece)
        places = [(F.locate(t.lower(), low), len(t)) for t in terms]
        start = F.coalesce(*[F.when(p > 0, p) for p, _ in places])
        length = F.coalesce(*[F.when(p > 0, F.lit(n)) for p, n in places])
        a = F.greatest(F.lit(1), start - radius)
        b = F.least(F.length(piece) + 1, start + length + radius)
        cut = F.trim(F.substring(piece, a, b - a))
        whole = F.concat(F.when(a > 1, "…").otherwise(""), cut, F.when(b <= F.length(piece), "…").otherwise(""))
        return F.when(start.isNotNull(), whole)

    return F.coalesce(*[around(p) for p in pieces])


def sentences(text: Column) -> Column:
    """Sentences with their places: array of ``start, end, text``; a stop and white space end one."""
    parts = F.split(text, r"(?<=[.!?])(?=\s)")
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        skip = F.length(part) - F.length(F.regexp_replace(part, r"^\s+", ""))
        end = acc["at"] + F.length(part)
        own = F.struct((acc["at"] + skip).alias("start"), end.alias("end"), F.regexp_replace(part, r"^\s+", "").alias("text"))
        return F.struct(end.alias("at"), F.when(F.length(own["text"]) > 0, F.array_append(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def first_sentence(text: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(F.trim(text), r"(?<=[.!?])\s"), 1), r"\s+$", "")


def clip(text: Column, longest: int) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest - 1), F.lit("…"))).otherwise(text)


def embedding_text(*parts: Column) -> Column:
    """Parts joined by spaces; blank ones are skipped."""
    return F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def judgement_class(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in JUDGEMENT_CLASSES.items() for x in kv])[F.lower(F.trim(c))], F.lit("none"))


# ---------------------------------------------------------------- boolean queries for bibliographic search

QUERY_FIELDS = {"keywords": "Title/Abstract", "mesh_terms": "MeSH Terms", "authors": "Author", "journals": "Journal", "article_types": "Publication Type", "languages": "Language"}


def _group(values: list[str] | str, tag: str) -> str:
    items = [values] if isinstance(values, str) else list(values)
    said = [f'"{re.sub(chr(34), "", v.strip())}"[{tag}]' for v in items if v.strip()]
    return said[0] if len(said) == 1 else f"({' OR '.join(said)})" if said else ""


def build_query(filters: dict) -> str:
    """Boolean search string of a closed set of filters; unknown keys raise."""
    unknown = set(filters) - set(QUERY_FIELDS) - {"year_from", "year_to"}
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    groups = [_group(filters[k], QUERY_FIELDS[k]) for k in QUERY_FIELDS if filters.get(k)]
    if filters.get("year_from") or filters.get("year_to"):
        low, high = filters.get("year_from") or 1800, filters.get("year_to") or 3000
        groups.append(f'("{min(low, high)}"[PDAT] : "{max(low, high)}"[PDAT])')
    return " AND ".join(g for g in groups if g)


def compile_filters(filters: dict, title: Column, abstract: Column, mesh: Column, journal: Column, year: Column) -> Column:
    """The same filters as a predicate over local records."""
    out = F.lit(True)
    text = F.lower(F.concat_ws(" ", title, abstract))
    if filters.get("keywords"):
        own = [filters["keywords"]] if isinstance(filters["keywords"], str) else filters["keywords"]
        some = F.lit(False)
        for w in own:
            some = some | F.contains(text, F.lit(w.lower()))
        out = out & some
    if filters.get("mesh_terms"):
        own = [filters["mesh_terms"]] if isinstance(filters["mesh_terms"], str) else filters["mesh_terms"]
        out = out & F.arrays_overlap(F.transform(mesh, F.lower), F.array(*[F.lit(m.lower()) for m in own]))
    if filters.get("journals"):
        own = [filters["journals"]] if isinstance(filters["journals"], str) else filters["journals"]
        out = out & F.lower(journal).isin(*[j.lower() for j in own])
    if filters.get("year_from"):
        out = out & (year >= filters["year_from"])
    if filters.get("year_to"):
        out = out & (year <= filters["year_to"])
    return out


def with_entry_date(query: str, since: str) -> str:
    """A search string restricted to records entered from a day on."""
    day = since[:10].replace("-", "/")
    return f'({query}) AND ("{day}"[EDAT] : "3000"[EDAT])'
