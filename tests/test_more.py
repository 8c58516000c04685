"""Merges and their inverse, tails, bundles, numbering, and rules that nulls once broke, on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from quillspark import session
from quillspark.functions import measures, normalize
from quillspark.functions import text as T
from quillspark.operators import entities, organisation, reports, search
from quillspark.operators.numbering import numbered
from quillspark.streaming import monitor


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_merge_and_revert(spark):
    t = spark.createDataFrame([(1, 10), (2, 11), (3, 12), (4, 10)], "row_id long, paper_id long")
    u = spark.createDataFrame([(1, 11), (2, 13)], "row_id long, paper_id long")
    aliases = spark.createDataFrame([(10, 13), (11, 13)], "absorbed long, survivor long")
    after, moves = entities.merge_papers({"t": t, "u": u}, aliases)
    assert rows(after["t"], "row_id", "paper_id") == [(1, 13), (2, 13), (3, 12), (4, 13)] and rows(after["u"], "row_id", "paper_id") == [(1, 13), (2, 13)]
    assert rows(moves, "table", "row_id", "absorbed", "survivor") == [("t", 1, 10, 13), ("t", 2, 11, 13), ("t", 4, 10, 13), ("u", 1, 11, 13)]
    back = entities.revert_merges(after, moves)
    assert rows(back["t"], "row_id", "paper_id") == rows(t, "row_id", "paper_id") and rows(back["u"], "row_id", "paper_id") == rows(u, "row_id", "paper_id")
    moved_on = {"t": after["t"].withColumn("paper_id", F.when(F.col("row_id") == 4, 99).otherwise(F.col("paper_id"))), "u": after["u"]}
    back = entities.revert_merges(moved_on, moves)  # 10 lost a row, so it stays merged; 11 comes back in both tables
    assert rows(back["t"], "row_id", "paper_id") == [(1, 13), (2, 11), (3, 12), (4, 99)] and rows(back["u"], "row_id", "paper_id") == [(1, 11), (2, 13)]


def test_tail_buffers_torn_lines(spark):
    none = spark.createDataFrame([], "path string, upto long")
    file = lambda text: spark.createDataFrame([("log", text)], "path string, text string")
    lines, seen = monitor.tail(file('{"a":1}\n{"a":'), none)
    assert rows(lines, "line") == [('{"a":1}',)] and rows(seen, "upto") == [(8,)]
    lines, later = monitor.tail(file('{"a":1}\n{"a":2}\n\n'), seen)
    assert rows(lines, "line_no", "line") == [(0, '{"a":2}'), (1, "")] and rows(later, "upto") == [(17,)]
    lines, again = monitor.tail(file("x\n"), later)
    assert rows(lines, "line") == [("x",)] and rows(again, "upto") == [(2,)]
    assert monitor.tail(file(""), none)[0].count() == 0


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_numbers_are_dense(spark, n):
    df = spark.range(n).select((F.col("id") * 7919 % 1009).alias("k"), F.lit("x").alias("x")).repartition(5)
    got = numbered(df, "place", "k").collect()
    assert [r.place for r in sorted(got, key=lambda r: r.k)] == list(range(1, n + 1))


def test_files_fill_ids_and_raise_the_preprint_flag(spark):
    schema = "sha256 string, position long, title string, pmid string, doi string, pmcid string, is_preprint boolean"
    have = spark.createDataFrame([("a", 1, "t", None, "10.1/x", None, False), ("b", 2, "u", None, None, None, True)], schema)
    new = spark.createDataFrame([("a", 3, "other", "7", "10.1/y", None, True), ("b", 4, None, None, None, None, False), ("c", 5, None, None, None, None, None)], schema)
    got = rows(entities.add_files(have, new), "sha256", "position", "title", "pmid", "doi", "is_preprint")
    assert got == [("a", 1, "t", "7", "10.1/x", True), ("b", 2, "u", None, None, True), ("c", 5, None, None, None, False)]


def test_semantic_leg_says_why_it_is_empty(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.1])], "query long, vector array<float>")
    found, why = search.semantic_leg(v, q, 1)
    assert why is None and rows(found, "query", "doc") == [(9, 1)]
    assert search.semantic_leg(None, q, 1) == (None, "no vector index") and search.semantic_leg(v, q.limit(0), 1) == (None, "no question vectors")
    assert search.semantic_leg(v, spark.createDataFrame([(9, [1.0])], "query long, vector array<float>"), 1)[1] == "no vectors of the questions' length"


def test_deleting_searches(spark):
    saved = spark.createDataFrame([("a",), ("b",)], "name string")
    assert rows(organisation.delete_search(saved, "a", "z"), "name") == [("b",)] and organisation.delete_search(saved).count() == 2


NOTE = "folder string, slug string, body string, type string, title string, description string, resource string, tags array<string>, generated struct<by:string,at:string>, verified struct<by:string,at:string>, status string, sources array<struct<id:string,resource:string,title:string>>, stale_after string, pmid string, doi string, pmcid string, journal string, retraction_status string, evidence_id string, evidence_ids array<string>, evidence_basis string, timestamp string"  # noqa: E501


def test_bundle_rules(spark):
    at = ("me", "2024-01-01T00:00:00Z")
    good = ("studies", "pmid-7", "said [^one]\n\n[^one]: a study (abstract only)", "Study", "t", "d", "r", ["own-bundle"], at, at, "stable", [("one", "r", "t")], None, "7", "10.1000/x", "PMC1", "j", "none", "pmid:7", None, None, None)
    bad = ("claims", "pmid-8", "no notes, ![^x] [[lost|Lost]]", "Study", "t", "d", "r", ["other"], ("", "now"), None, "new", [("One", "r", " "), ("one", "", "t"), ("one", "r", "t")], None, "x8", "10.1000/X", "1", None, None, "pmid:8", ["pmid:9", "pmid:7"], None, "t")
    records = spark.createDataFrame([("pmid:7", "7", "10.1000/x", None, "j", "abstract_only"), ("pmid:8", "8", None, None, "j", "fulltext")], "evidence_id string, pmid string, doi string, pmcid string, journal string, ft_status string")
    got = rows(reports.bundle_problems(spark.createDataFrame([good, bad], NOTE), records, "own-bundle"), "slug", "rule")
    want = ["V2", "V3", "V6", "V7", "V8", "V10", "V11", "V12", "V14", "V15", "V16", "V18", "V23", "V24", "V25"]
    assert [r for s, r in got if s == "pmid-7"] == [] and sorted(r for s, r in got if s == "pmid-8") == sorted(want)
    assert reports.bundle_problems(spark.createDataFrame([], NOTE), records, "own-bundle").count() == 0


def test_nulls_have_no_text(spark):
    df = spark.createDataFrame([(None, None), (0.5, "10.1/a")], "p double, doi string")
    stem = normalize.record_stem(F.lit(None).cast("string"), F.col("doi"), F.lit(None).cast("string"), F.lit("url:1"))
    assert rows(df.select(measures.p_text(F.col("p")).alias("p"), stem.alias("stem")), "p", "stem") == [("not reported", "url-1"), ("p = 0.5", "doi-10.1-a")]


def test_spans_keep_their_places(spark):
    text = "First line\nThe  QUICK\n brown fox. It runs. The end"
    got = T.spans_of(text, "the quick brown")
    assert [(text[s["match_start"] : s["match_end"]], text[s["start"] : s["end"]]) for s in got] == [("The  QUICK\n brown", "The  QUICK\n brown fox.")]
    assert T.spans_of("İstanbul is far", "istanbul") == [] and T.spans_of("", "x") == []


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())
