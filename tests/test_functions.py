import hashlib
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import measures as M
from quillspark.functions import normalize as N
from quillspark.functions import text as T


def one(spark, expr, **values):
    kinds = {str: "string", float: "double", int: "int", list: "array<string>", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "corpus", "library"),
    [
        ("https://doi.org/10.1/AbC.", "10.1/abc", "10.1/abc"),
        ("doi:10.1/x);", "10.1/x", "10.1/x"),
        ("http://dx.doi.org/10.1/x", "10.1/x", "http://dx.doi.org/10.1/x"),
        ("https://doi.org/doi:10.1/x", "10.1/x", "10.1/x"),
        ("", None, None),
        (None, None, None),
    ],
)
def test_dois(spark, raw, corpus, library):
    assert one(spark, N.norm_doi(F.col("v")), v=raw) == corpus
    assert one(spark, N.library_doi(F.col("v")), v=raw) == library


def test_strict_doi(spark):
    assert one(spark, N.strict_doi(F.col("v")), v="https://doi.org/10.1000/X") == "10.1000/x"
    assert one(spark, N.strict_doi(F.col("v"), "null"), v="no doi") is None
    with pytest.raises(Exception, match="not a valid DOI"):
        one(spark, N.strict_doi(F.col("v")), v="no doi")


def test_ids(spark):
    assert one(spark, N.norm_pmid(F.col("v")), v="PMID:12") == "12"
    assert one(spark, N.norm_pmcid(F.col("v")), v="pmc:77") == "PMC77"
    assert one(spark, N.strict_pmcid(F.col("v")), v="x77") is None
    assert one(spark, N.evidence_id(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=None, b="10.1/X", c="PMC1", d="u") == "doi:10.1/x"
    assert one(spark, N.evidence_id(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=None, b=None, c=None, d="u") == "url:" + hashlib.sha256(b"u").hexdigest()[:16]


def test_titles_and_queries(spark):
    assert one(spark, N.norm_title(F.col("v")), v="  Über: die ÉCOLE—Straße! ") == "uber die ecole strasse"
    assert one(spark, N.normalize_title(F.col("v")), v="Naïve β-blockers") == "naive blockers"
    assert one(spark, N.norm_query(F.col("v")), v="“A”  and ( b : C )") == '"a" AND(b:c)'
    ids = ["z", "q10", None, "q2", "pool-seed", "q1"]
    df = spark.createDataFrame([(x,) for x in ids], "q string")
    assert [r.q for r in df.orderBy(N.query_sort_key(F.col("q"))).collect()] == ["pool-seed", "q1", "q2", "q10", "z", None]
    assert N.parse_year_range("2020-2010") == (2010, 2020)
    assert N.parse_year_range("2011") == (2011, 2011)


def test_urls(spark):
    assert one(spark, N.normalize_url(F.col("v")), v="HTTPS://Ex.Org/A/?q=1#f") == "https://ex.org/A?q=1#f"
    assert one(spark, N.normalize_url(F.col("v")), v="https://ex.org/") == "https://ex.org/"
    assert one(spark, N.normalize_url(F.col("v")), v="nothing") is None


def test_stems():
    want = {"caresses": "caress", "ponies": "poni", "running": "run", "hopping": "hop", "relational": "relat", "generalization": "gener", "happy": "happi", "sky": "sky", "agreed": "agre", "adoption": "adopt", "hopeful": "hope"}
    assert {w: T._Porter.stem(w) for w in want} == want
    assert T.analyze_text("Cafés RUNNING, x_y") == ["cafe", "run", "x", "y"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n", max_size=3000))
def test_chunks_cover(text):
    got = T.chunk_ranges(text, 100, 15, 30)
    assert all(b - a <= 130 and text[a:b].strip() for a, b in got)
    covered = set().union(*[range(a, b) for a, b in got]) if got else set()
    assert all(text[k].isspace() for k in range(len(text)) if k not in covered)


def test_spans():
    text = "First line.\nThe  Quick brown fox. It jumps!\nEnd."
    s = T.spans_of(text, "quick BROWN")[0]
    assert text[s["match_start"] : s["match_end"]] == "Quick brown"
    assert s["method"] == "exact"
    assert T.spans_of(text, " ") == []
    assert T.spans_of("alpha beta gamma " * 50, "gamma delta omega")[0]["method"] == "fuzzy"


def test_precision(spark):
    c = [F.col(x) for x in ("e", "a", "b", "m")]
    rule = lambda **v: one(spark, M.precision_class(*c), **v)
    assert rule(e=2.0, a=1.5, b=2.6, m="OR") == "precise"
    assert rule(e=2.0, a=2.6, b=1.5, m="OR") == "precise"
    assert rule(e=2.0, a=0.5, b=2.6, m="OR") == "null-compatible"
    assert rule(e=0.1, a=0.05, b=0.9, m="MD") == "imprecise"
    df = spark.createDataFrame([(1.0, None, 2.0, "MD")], "e double, a double, b double, m string")
    assert df.select(M.precision_class(*c)).first()[0] == "unreported"


def test_text_rules(spark):
    assert one(spark, M.truncation_reasons(F.col("t"), F.col("h")), t="short text", h="Get Access now") == ["body_words=2<1500", "paywall_marker=Get access"]
    assert one(spark, M.snippet([F.col("t")], ["zeta"], 3), t="alpha zeta omega") == "…ha zeta om…"
    assert one(spark, M.parse_duration(F.col("t")), t="2h") == 7200.0
    assert [r["text"] for r in one(spark, M.sentences(F.col("t")), t="One. Two!  Three")] == ["One.", "Two!", "Three"]
    assert one(spark, M.fmt_num(F.col("e")), e=1.5) == "1.5"
    assert M.build_query({"keywords": ["a b", "c"], "year_from": 2001}) == '("a b"[Title/Abstract] OR "c"[Title/Abstract]) AND ("2001"[PDAT] : "3000"[PDAT])'
    with pytest.raises(ValueError, match="unknown"):
        M.build_query({"x": 1})


def test_markup():
    html = "<html><head><title>x</title></head><body><nav>menu</nav><p>A &amp; B</p><script>no</script><div>C</div></body></html>"
    assert T.html_to_text(html).split() == ["A", "&", "B", "C"]
    assert T.jats_to_text("<article><body><p>One</p><ref-list><p>no</p></ref-list></body></article>") == "One"
    assert T.jats_to_text("<broken") is None


def test_offsets_are_code_points(spark):
    text = "a😀bé"
    assert unicodedata.normalize("NFC", text) == text
    assert one(spark, F.substring(F.col("t"), 3, 1), t=text) == "b"
