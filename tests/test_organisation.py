"""Organisation, figures, reports and status snapshots on small rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.operators import figures, organisation, reports, screening
from quillspark.plans.composites import library_search
from quillspark.sources import readers, sinks


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_fetch_policy(spark):
    urls = {"https://ex.org/a": True, "http://u:p@ex.org/": False, "file:///etc/passwd": False, "ftp://ex.org": False, "https://": False, None: False}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r.ok for r in df.select(organisation.fetchable(F.col("u")).alias("ok")).collect()] == list(urls.values())


def test_paper_history(spark):
    ev = spark.createDataFrame(
        [("a", 1, "create", {"t": "x", "j": "y"}, "k", "d1"), ("a", 2, "update", {"t": "z"}, None, "d2"), ("a", 3, "delete", None, None, "d3"), ("b", 1, "create", {"t": "q"}, "k", "d1"), ("b", 2, "delete", None, None, "d2"), ("b", 3, "restore", None, None, "d3"), ("c", 1, "create", {}, "k", "d1")],
        "paper_id string, seq int, action string, metadata map<string,string>, citation_key string, at string",
    )
    got = {r.paper_id: r for r in organisation.fold_papers(ev).collect()}
    assert got["a"].metadata == {"t": "z", "j": "y"} and got["a"].deleted_at == "d3" and got["b"].deleted_at is None
    assert rows(organisation.citation_key_clashes(organisation.fold_papers(ev)), "citation_key", "papers") == [("k", ["b", "c"])]


def test_links_and_attachments(spark):
    links = spark.createDataFrame([(1, "x")], "paper_id int, tag string")
    more = spark.createDataFrame([(1, "x"), (2, "x")], "paper_id int, tag string")
    assert rows(organisation.add_links(links, more, "paper_id", "tag"), "paper_id") == [(1,), (2,)]
    assert organisation.remove_links(more, links, "paper_id", "tag").count() == 1
    a = spark.createDataFrame([(1, 10, True, 1), (1, 11, False, 2), (2, 12, False, 1)], "paper_id int, attachment_id int, is_preferred boolean, created_at int")
    out = organisation.set_preferred(a, spark.createDataFrame([(1, 11)], "paper_id int, attachment_id int"))
    assert rows(organisation.preferred(out).filter("rank = 1"), "attachment_id") == [(11,), (12,)]
    new = spark.createDataFrame([(1, bytearray(b"z"), "primary"), (2, bytearray(b"z"), "primary")], "paper_id int, content binary, role string")
    assets, attached = organisation.import_attachments(new, new.select(F.lit("").alias("sha256")))
    assert assets.count() == 1 and attached.count() == 2


def test_saved_searches_and_batches(spark):
    s = spark.createDataFrame([("a", "q1", 1)], "name string, query string, saved_at int")
    assert rows(organisation.save_search(s, spark.createDataFrame([("a", "q2", 2), ("b", "q3", 1)], s.schema)), "name", "query") == [("a", "q2"), ("b", "q3")]
    assert rows(organisation.batches(spark.range(5), 2, "id"), "id", "batch") == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)]


def test_synthetic_papers_are_deterministic(spark):
    a = organisation.synthetic_papers(spark, 50).repartition(7).orderBy("paper_id").collect()
    assert a == organisation.synthetic_papers(spark, 50).orderBy("paper_id").collect()


def test_figure_places():
    body = [("body", 20.0 + 50 * k, y, 60.0 + 50 * k, y + 10) for y in (10.0, 24.0, 38.0) for k in range(4)]
    cap = [("Figure", 20.0, 300.0, 60.0, 310.0), ("1.", 65.0, 301.0, 75.0, 311.0), ("Flow", 80.0, 300.0, 120.0, 310.0)]
    df = pd.DataFrame([("p", 600.0, *w) for w in body + cap], columns=["page_id", "page_width", "text", "x0", "y0", "x1", "y1"])
    got = figures.place_figures(df)
    assert got.caption.tolist() == ["Figure 1. Flow"] and got.y0.tolist() == [48.0] and got.y1.tolist() == [300.0]
    two = pd.concat([df, df.assign(x0=df.x0 + 300, x1=df.x1 + 300, text=df.text.where(df.text != "Figure", "Fig."))])
    assert sorted(figures.place_figures(two).column.tolist()) == [0, 1]


def test_report_checks(spark):
    text = "# R\nCited [^a] and [^x].\nRetracted one [^r].\n[^a]: note"
    lines = readers.scan_report(spark.createDataFrame([(1, text)], "report_id int, text string"))
    notes = spark.createDataFrame([("a", "e1"), ("r", "e2"), ("x", None)], "key string, evidence_id string")
    rec = spark.createDataFrame(
        [("e1", "include", "fulltext", "pmc", "none", False, "x", "a", False), ("e2", "exclude", "fulltext", "pmc", "retracted", False, "x", "a", False), ("e3", "include", "missing", "q", "none", False, None, None, False)],
        "evidence_id string, decision string, ft_status string, access_route string, retraction_status string, is_preprint boolean, extraction_path string, appraisal_path string, noted boolean",
    )
    counts = spark.createDataFrame([("sought", 2)], "name string, n int")
    said = spark.createDataFrame([("sought", 3)], "name string, n int")
    yes = spark.createDataFrame([(True,)], "hit_count_logged boolean")
    got = {r.check_id: r.status for r in reports.verify_report(lines, notes, rec, counts, said, yes, yes.select(F.col("hit_count_logged").alias("ok")), spark.createDataFrame([], "evidence_id string"), spark.createDataFrame([], "evidence_id string")).collect()}
    bad = {k for k, v in got.items() if v == "fail"}
    assert bad == {"C-CITATION-EXISTS", "C-CITATION-INCLUDED", "C-RETRACTED", "C-PRISMA", "C-MISSING", "C-PROVISIONAL"} and len(got) == 13


def test_status_and_concepts(spark):
    log = spark.createDataFrame([("search", "search", "active", 1, "w1", "2024-01-01", "2024-01-01", 1), ("screen", "screen", "pending", 0, "w2", "2024-01-02", "2024-01-02", 2)], "task_id string, stage string, status string, attempts int, worker string, created_at string, updated_at string, seq int")
    log = log.withColumn("created_at", F.to_timestamp("created_at")).withColumn("updated_at", F.to_timestamp("updated_at"))
    rec = spark.createDataFrame([(["x"], "include", "missing", None, None, None, "none", False, None)], "merged_from array<string>, decision string, ft_status string, access_route string, extraction_path string, appraisal_path string, retraction_status string, is_preprint boolean, source_tier int")
    s = reports.status_snapshot(log, rec, F.lit("2024-01-03").cast("timestamp"), caps={"articles": 1, "wall": 86400}, stall_s=86400)
    assert s["current_stage"].first().stage == "search" and s["stalls"].first().level == "red" and s["funnel"].first().not_attempted == 1
    assert rows(s["budgets"].filter("fraction >= 1"), "name") == [("articles",), ("wall",)]
    notes = spark.createDataFrame([("study", "ok-one", {"title": "t", "evidence_id": "e"}, "b", ["gone"]), ("topic", "Bad Slug", {}, "", [])], "type string, slug string, front map<string,string>, body string, links array<string>")
    assert {r.slug: r.problems for r in reports.concept_problems(notes).collect()} == {"ok-one": ["link to nothing"], "Bad Slug": ["title missing", "slug form", "empty body"]}
    assert screening.screening_views(rec)["not_attempted"].count() == 1


def test_summaries(spark):
    s = spark.createDataFrame([("a", "# Methods\nx"), ("b", "# Methods\n# Results\n")], "evidence_id string, text string")
    spans = spark.createDataFrame([("b", False)], "evidence_id string, ok boolean")
    got = {r.evidence_id: r.problems for r in reports.summary_problems(s, spans, ["Methods", "Results"]).collect()}
    assert got == {"a": ["no heading: Results"], "b": ["quoted span fails"]}


def test_library_search_composes(spark):
    p = spark.createDataFrame([(1, "Sepsis now", "J A", "2001", "septic shock text", None), (2, "Other", "J B", "2001", "shock", None), (3, "Gone", "J A", "2001", "septic shock", 1), (4, "Old", "J A", None, "septic shock", None)], "paper_id int, title string, journal string, publication_date string, text string, deleted_at int")
    notes = spark.createDataFrame([(1, ["t"], 4)], "paper_id int, tags array<string>, rating int")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (9, [1.0, 0.0])], "evidence_id int, vector array<float>")
    got = library_search(p, notes, v, years=(2000, 2002), terms=["shock"], similar_to=9).collect()
    assert [r.paper_id for r in got] == [1, 2] and "shock" in got[0].snippet
    assert [r.paper_id for r in library_search(p, notes, v, min_rating=4).collect()] == [1]
    assert {r.paper_id for r in library_search(p, notes, v, min_rating=0).collect()} == {1, 2, 4}


def test_exports(spark):
    r = spark.createDataFrame([("a",), ("b",)], "evidence_id string")
    found, lost = sinks.select_export(r, spark.createDataFrame([("a",), ("x",), ("y",)], "evidence_id string"))
    assert rows(found, "evidence_id") == [("a",)] and rows(lost, "evidence_id") == [("x",), ("y",)]
    m = sinks.manifest(spark.createDataFrame([("p", bytearray(b"abc"))], "path string, content binary")).first()
    assert m["size"] == 3 and m.sha256.startswith("ba7816bf")


def test_deleted_papers_never_show_in_captions(spark):
    f = spark.createDataFrame([(1, 1, 1, "heart flow"), (2, 2, 1, "heart flow")], "figure_id int, paper_id int, page int, caption string")
    papers = spark.createDataFrame([(1, None), (2, 5)], "paper_id int, deleted_at int")
    q = spark.createDataFrame([(1, "Heart OR x")], "query_id int, q string")
    assert rows(organisation.figure_search(f, q, papers), "doc") == [(1,)]


@pytest.mark.parametrize("text", ["", "no front matter", "---\nunclosed: x"])
def test_odd_reports(spark, text):
    assert readers.scan_report(spark.createDataFrame([(1, text)], "report_id int, text string")).count() == text.count("\n") + 1
