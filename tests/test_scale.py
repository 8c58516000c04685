"""What a query writes, moves or holds does not grow faster than its input, and results stay those of the plain ways."""

import itertools
import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import entities, figures, organisation, search, sections
from quillspark.session import Scratch


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_bm25_of_each_moves_no_pairs(spark):
    """The scores of all pairs, without postings or pairs in any shuffle: copies, ties, empty and null texts, a query of unknown words."""
    words = ["alpha", "beta", "gamma", "delta", "rho"]
    texts = [" ".join(words[(k * j) % 5] for j in range(1, 2 + k % 7)) for k in range(60)] + ["", None, "alpha beta", "Alpha, beta!"]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    q = search.query_terms(spark.createDataFrame([(1, "alpha beta"), (2, "rho"), (3, "nothing"), (4, "delta gamma alpha")], "query_id long, q string"), F.col("q"))
    post, ids = search.postings(d, F.col("text")), d.select(F.col("doc_id").alias("doc"))
    near = lambda df: rows(df.select("query", "doc", F.round("score", 9).alias("score")), "query", "doc", "score")
    assert near(search.bm25_of_each(d, F.col("text"), q)) == near(search.bm25(post, q, ids, require_all=True)) != []
    rounded = lambda df: df.withColumn("score", F.round("score", 9))
    got = search.bm25_of_each(d, F.col("text"), q, k=3)
    assert near(search.top(rounded(got), 3)) == near(search.top(rounded(search.bm25(post, q, ids, require_all=False)), 3))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert search.bm25_of_each(d, F.col("text"), q.filter("query = 9"), k=3).count() == 0


def test_bm25_of_each_in_slices(spark, monkeypatch):
    """Rows taken a few at a time give what they give at once."""
    batch = pa.record_batch({"doc": list(range(9)), "terms": [["a"] * (k % 3) + ["b"] * (k % 2) + ["c"] for k in range(9)]})
    asked = pa.table({"query": [1, 1, 2], "term": ["a", "b", "a"]})
    run = lambda: [r for b in search._scored(iter([batch]), asked, pa.array(["a", "b"]), np.array([1.0, 2.0]), 2.0, None) for r in b.to_pylist()]
    whole = run()
    monkeypatch.setattr(search, "CELLS", 4)
    monkeypatch.setattr(search, "MET", 2)
    assert run() == whole and {(r["query"], r["doc"]) for r in whole} == {(1, 1), (1, 5), (1, 7), (2, 1), (2, 2), (2, 4), (2, 5), (2, 7), (2, 8)}


def test_semantic_scores_in_tiles(monkeypatch):
    """However many questions there are, a task holds CELLS scores: the best of each are the same."""
    r = np.random.default_rng(1)
    vectors = pa.array(r.normal(size=(50, 4)).tolist(), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), vectors], names=["id", "vector"])
    asked = pa.table({"query": list(range(30)), "vector": vectors[:30]})
    run = lambda: list(search._best_of_batch(iter([batch]), asked, 3, False))
    whole = pa.Table.from_batches(run()).to_pylist()
    monkeypatch.setattr(search, "CELLS", 100)
    tiled = run()
    assert len(tiled) == 15 and pa.Table.from_batches(tiled).to_pylist() == whole


def test_stemmed_terms_leave_in_small_batches(monkeypatch):
    texts = ["running dogs run"] * 40 + [None, "", "é x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(43)), pa.array(texts)], names=["doc", "text"])
    whole = pa.Table.from_batches(list(T.counted(iter([batch])))).to_pylist()
    monkeypatch.setattr(T._some_rows, "__defaults__", (64,))
    cut = list(T.counted(iter([batch])))
    assert pa.Table.from_batches(cut).to_pylist() == whole and len(cut) > 5 and max(b.num_rows for b in cut) <= 12


@pytest.mark.parametrize("ratio", [0.93, 0.9])
def test_similar_candidates_lose_no_pair(spark, ratio):
    r = random.Random(5)
    base = ["".join(r.choice("abcde ") for _ in range(r.randrange(1, 60))) for _ in range(60)]
    near = []
    for s in base:
        for _ in range(3):
            c = list(s)
            for _ in range(r.randrange(5)):
                c[r.randrange(len(c)) : r.randrange(len(c) + 1)] = r.choice(["", "x", "ab"]) if r.random() < 0.3 else c[:0] or ["y"]
                c = c or ["z"]
            near.append("".join(c))
            k = r.randrange(len(s))
            near += [s[:k] + s[k + 1 :] or "q", s[:k] + "w" + s[k:]]
    names = sorted(set(base + near))
    df = spark.createDataFrame([(s,) for s in names], "t string")
    want = {(p, q) for p, q in itertools.permutations(names, 2) if SequenceMatcher(None, p, q, autojunk=False).ratio() >= ratio}
    got = entities.similar_candidates(df, df.withColumnRenamed("t", "u"), "t", "u", ratio)
    assert len(want) > 100 and want <= {(x.t, x.u) for x in got.collect()}
    kept = got.filter(T.ratio_from(F.col("t"), F.col("u"), ratio, autojunk=False) >= ratio)
    assert {(x.t, x.u) for x in kept.collect()} == want


def test_inbox_with_words_that_all_titles_have(spark):
    """Against every pair that shares a long word; titles that share words with all pages meet only the pages that have them."""
    r = random.Random(2)
    name = lambda: "".join(r.choice("abcdefgh") for _ in range(14))
    titles = [f"observations {name()} revisited" for _ in range(40)] + [None, "short one", "a b c d e f g h i j k l m n o", "Observations"]
    pages = [f"Vol 3. {t.upper()}. By someone" for t in titles[:30]] + [t.replace("o", "0", 1) for t in titles[30:36]] + ["nothing here", None, "", titles[0], "a b c d e f g h i j k l m n o", f"{titles[1]} and {titles[2]}"]
    files = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "file_id long, page string")
    wanted = spark.createDataFrame([(f"e{k}", None, t) for k, t in enumerate([*titles, titles[3]])], "evidence_id string, doi string, title string")
    norm = lambda s: " ".join("".join(c if c.isalnum() else " " for c in (s or "").lower()).split())
    want = []
    for k, p in enumerate(pages):
        met = []
        for j, t in enumerate([*titles, titles[3]]):
            a, b = norm(t), norm(p)
            if len(a) >= entities.LEAST_TITLE and {w for w in a.split() if len(w) >= 6} & set(b.split()) and (score := T.title_on_page(a, b)) >= 0.85:
                met.append((score, f"e{j}"))
        want.append((k, "title" if met else "unmatched", max(met)[1] if met else None, max(met)[0] if met else None))
    got = entities.match_inbox(files, wanted)
    assert sorted((x.file_id, x.match, x.evidence_id, x.ratio) for x in got.collect()) == want


def test_primary_identifier_with_ties_and_unknown_times(spark):
    x = [(1, "doi", v, False, None if v == 2 else "2020", 7) for v in (9, 2, 5)] + [(2, "doi", 4, True, None, 1), (2, "doi", 3, False, "2000", 1)]
    df = spark.createDataFrame(x, "paper_id int, scheme string, value int, is_primary boolean, created_at string, id int")
    for part in (df, df.orderBy(F.desc("value")).coalesce(1)):
        assert rows(entities.primary_identifiers(part), "paper_id", "value") == [(1, 5), (2, 4)]


def test_lines_of_a_long_page(monkeypatch):
    """A word is compared with lines that it can still join, not with all above it."""
    n = 3000
    words = pd.DataFrame({"page_id": "p", "page_width": 600.0, "text": "w", "x0": 1.0, "y0": [12.0 * k for k in range(n)], "x1": 40.0, "y1": [12.0 * k + 10 for k in range(n)]})
    seen = itertools.count()
    monkeypatch.setattr(figures, "reversed", lambda x: (next(seen) and v for v in ()) if False else iter([(next(seen), v)[1] for v in x][::-1]), raising=False)
    assert len(figures.lines_of(words)) == n and next(seen) < 3 * n


def test_report_checks_send_no_side_whole(spark):
    reports = spark.createDataFrame([(k, "# Question\n\nA [^a].\n\n[^a]: x") for k in range(50)], "report_id long, text string")
    notes = spark.createDataFrame([(k, "a", f"e{k}") for k in range(50)], "report_id long, key string, evidence_id string")
    records = spark.createDataFrame([(f"e{k}", "none", False, "fulltext", "include") for k in range(50)], "evidence_id string, retraction_status string, is_preprint boolean, ft_status string, decision string")
    scratch = Scratch(spark, "test-reports")
    found = sections.findings(reports, notes, records, scratch)
    for df in (found, sections.report_status(reports, found)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    scratch.close()


def test_replaced_rows_are_dealt_out_by_their_number(spark, monkeypatch):
    stored = spark.range(1000).select((F.col("id") % 100).alias("k"), F.col("id").alias("v"))
    new = spark.createDataFrame([(3, -1), (3, -2), (500, -3)], "k long, v long")
    want = sorted([(r.k, r.v) for r in stored.collect() if r.k != 3] + [(3, -1), (3, -2), (500, -3)])
    assert rows(organisation.replace_rows(stored, new, "k"), "k", "v") == want
    monkeypatch.setattr(organisation, "ROWS_A_TASK", 50)
    out = organisation.delete_rows(stored, new, "k")
    assert out.rdd.getNumPartitions() == 20 and out.count() == 990


def test_dedupe_links_near_copies_without_their_pairs(spark, tmp_path):
    """The groups of all accepted pairs, for titles with and without guards; near copies have a link each, not a square of pairs."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9)))
    base = [" ".join(word() for _ in range(r.randrange(2, 11))) for _ in range(25)] + ["ab", "x" * 90, "é" * 70]
    titles = list(base)
    for t in base:
        for _ in range(4):
            c = list(t)
            for _ in range(r.randrange(4)):
                c[r.randrange(len(c))] = r.choice(["", "q", "zz", "\U0001d4d0"])
            titles.append("".join(c))
    near = ["a study of near copies and what they are called " + x + y for x in "abcdefgh" for y in "abcdefgh"]
    rows_ = [(f"url:{k}", k, None, r.choice([None, None, "10.1/a", "10.1/b"]), t, r.choice([None, "2000", "2001"]), r.random() < 0.2) for k, t in enumerate(titles)]
    rows_ += [(f"url:{k + 1000}", k + 1000, None, None, t, None, False) for k, t in enumerate(near)]
    df = spark.createDataFrame(rows_, "evidence_id string, position long, pmid string, doi string, title string, publication_date string, is_preprint boolean")
    scratch = Scratch(spark, "test-links")
    own, classes = entities._titled(df, scratch)

    def groups(links):
        group = {x[1]: x[1] for x in rows_}
        for a, b in links:
            group = {k: group[a] if g == group[b] else g for k, g in group.items()}
        return {frozenset(k for k in group if group[k] == g) for g in set(group.values())}

    pairs = entities._pairs(own, classes, entities.TITLE_MATCH).filter("refused is null").select("x.position", "y.position").collect()
    links = entities.duplicate_links(own, classes, scratch).collect()
    assert groups(links) == groups(pairs) and max(map(len, groups(pairs))) >= 64
    assert len({tuple(x) for x in links if min(x) >= 1000}) < 3 * 64 < len([x for x in pairs if min(x) >= 1000])
    scratch.close()


def test_titles_that_the_library_has_whole_are_compared_with_no_other(spark, monkeypatch):
    known = ["a first title of some length", "a first title of some lengths", "another title that is long enough", "short"]
    none = F.lit(None).cast("string")
    ids = [none.alias(c) for c in ("sha256", "doi", "pmid", "pmcid")]
    library = spark.createDataFrame([(k, 9 - k, t) for k, t in enumerate([*known, known[0]])], "entry_id int, position int, title string").select("*", *ids)
    ask = lambda *titles: spark.createDataFrame(list(enumerate(titles)), "probe_id int, title string").select("*", *ids)
    near = entities.fuzzy_lookup(ask(known[0].upper(), "a first title of some lengthz", "short"), library)
    assert rows(near, "probe_id", "entry_id", "prec") == [(0, 4, 4), (1, 4, 4)]
    monkeypatch.setattr(entities, "similar_candidates", None)
    whole = entities.fuzzy_lookup(ask(known[0].upper(), known[2], "short"), library)
    assert rows(whole, "probe_id", "entry_id", "ratio") == [(0, 4, 1.0), (1, 2, 1.0)]


def test_inbox_sends_no_side_whole(spark):
    """Neither as planned from the sizes of files nor as run."""
    files = spark.createDataFrame([(k, f"10.1000/x{k}." if k % 2 else f"a certain title on page {k}") for k in range(20)], "file_id long, page string")
    wanted = spark.createDataFrame([(f"e{k}", f"10.1000/x{k}", f"a certain title on page {k}") for k in range(20)], "evidence_id string, doi string, title string")
    got = entities.match_inbox(files, wanted)
    assert {(x.file_id, x.evidence_id) for x in got.collect()} == {(k, f"e{k}") for k in range(20)}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
