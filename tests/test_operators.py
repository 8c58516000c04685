"""Rules of the operators on small hand-made rows."""

import itertools
import json
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillspark.operators import audit, entities, evidence, graph, incremental, provenance, screening, search, tasks
from quillspark.session import Scratch
from quillspark.sources import readers, schemas, sinks
from quillspark.streaming import monitor


@pytest.fixture
def scratch(spark):
    s = Scratch(spark, "test")
    yield s
    s.close()


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ---------------------------------------------------------------- graph


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (4, 5)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 40)] + [(50, 51)]])
def test_components(spark, scratch, edges):
    parent = {k: k for e in edges for k in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), scratch)
    linked = {k for a, b in edges if a != b for k in (a, b)}
    assert rows(got, "node", "component") == sorted((k, find(k)) for k in linked)


# ---------------------------------------------------------------- search


def test_spans_in_every_document_with_a_passage(spark, tmp_path):
    from quillspark.plans import catalog

    passage = "seven green boats sailed slowly past the old harbour wall"
    rows = [(k, f"intro {k} words. {passage} and more " + "filler text here " * 40 * k) for k in range(9)] + [(9, "nothing shared"), (10, "tiny item at last"), (11, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage), (2, "Tiny item"), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = catalog.QUERIES["x_find_spans"](spark, str(tmp_path)).filter("method = 'exact'").collect()
    assert {(r.query, r.doc) for r in got} == {(1, k) for k in range(9)} | {(2, 10)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat"), (2, "a dog and a cat"), (3, "nothing here"), (4, None), (5, "cat cat cat")], "doc_id int, text string")


def test_bm25_order_and_modes(spark, docs):
    post = search.postings(docs, F.col("text"))
    q = search.query_terms(spark.createDataFrame([(1, "Cat OR dog"), (2, ""), (3, "cat mat")], "query_id int, q string"), F.col("q"))
    ids = docs.select(F.col("doc_id").alias("doc"))
    every = search.bm25(post, q, ids, require_all=False)
    assert {r.query for r in every.collect()} == {1, 3}  # a blank query finds nothing
    best = search.top(every.filter("query = 1"), 3).collect()
    assert best[0].doc == 2 and all(r.score > 0 for r in best)
    assert rows(search.bm25(post, q, ids, require_all=True), "query", "doc") == [(3, 1)]
    assert rows(search.matching_all(post, ["cat", "mat"]), "doc") == [(1,)] and search.matching_all(post, []).count() == 0
    hits = every.filter("query = 1")
    assert search.restrict(hits, []).count() == 0 and search.restrict(hits, None).count() == 3 and search.restrict(hits, [5]).count() == 1


def test_snippets_mark_words(spark):
    df = spark.createDataFrame([("one two Cat three (x) four",)], "t string")
    assert df.select(search.marked_snippet(F.col("t"), ["cat", "(x)"], 3)).first()[0] == "**Cat** three (x)"


def test_paging_walks_all(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(25)], "id int, s int")
    seen, after = [], None
    while True:
        got = search.page(df, [("s", True), ("id", False)], 10, after).collect()
        seen += [r.id for r in got[:10]]
        if len(got) <= 10:
            break
        after = search.decode_cursor(search.encode_cursor(s=got[9].s, id=got[9].id))
    assert seen == [r.id for r in df.orderBy(F.desc("s"), "id").collect()]


def test_coverage_and_keywords(spark):
    rec = spark.createDataFrame([(1, ["a"], "alpha beta"), (2, ["a", "b"], "alpha"), (3, [], "x")], "paper_id int, cited array<string>, text string")
    idx = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (2, "b", 0)], "paper_id int, source_id string, chunker_version int")
    assert rows(search.covered(rec, F.col("cited"), idx, 1), "paper_id", "is_covered") == [(1, True), (2, False), (3, False)]
    hits = spark.createDataFrame([(2, "beta")], "paper_id int, term string")
    assert rows(search.keyword_filter(rec, F.col("text"), ["alpha", "beta"], indexed_hits=hits), "paper_id") == [(1,), (2,)]
    assert rows(search.keyword_filter(rec, F.col("text"), ["alpha", "beta"]), "paper_id") == [(1,)]


def test_term_filters_agree(spark):
    p = spark.createDataFrame([(1, ["Heart  Failure", "heart failure"]), (2, ["100% Oxygen"]), (3, [])], "paper_id int, mesh array<string>")
    idx = search.term_index(p, {"mesh": "mesh"})
    assert rows(idx.filter("paper_id = 1"), "value_norm", "value") == [("heart failure", "Heart  Failure")]
    for needle in ("HEART", "0%", "_", "zzz"):
        a = rows(search.filter_terms(p, idx, {"mesh": needle}), "paper_id")
        assert a == rows(search.filter_terms_inline(p, {"mesh": needle}), "paper_id")


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "m"), (2, [1.0, 1.0], "m"), (3, [0.0, 0.0], "m"), (4, [1.0], "m")], "evidence_id int, vector array<float>, model string")
    got = search.similar(v, 1, 5).collect()
    assert [r.evidence_id for r in got] == [2, 3] and got[1].score == 0.0
    with pytest.raises(ValueError, match="several models"):
        search.nearest(v.unionByName(v.withColumn("model", F.lit("n"))), [1.0, 0.0], 1)


def test_fusion_is_stable_and_rewards_agreement(spark):
    a = spark.createDataFrame([(1, "x", 1, "lex"), (1, "y", 2, "lex")], "query int, id string, rank int, leg string")
    b = spark.createDataFrame([(1, "y", 1, "sem"), (1, "z", 2, "sem")], "query int, id string, rank int, leg string")
    want = None
    for legs in itertools.permutations([a, b]):
        got = [(r.id, round(r.score, 9), r.found_by) for r in search.fuse(*legs).orderBy(F.desc("score"), "id").collect()]
        assert want in (None, got)
        want = got
    assert want[0][0] == "y" and want[0][2] == ["lex", "sem"]


def test_pool_score(spark):
    e = spark.createDataFrame([("a", "Heart failure therapy", None, "J", [], [], [], "2001"), ("b", "Other thing", "heart", "J", [], [], [], "2000")], "evidence_id string, title string, abstract string, journal string, mesh_terms array<string>, keywords array<string>, article_types array<string>, publication_date string")
    got = {r.evidence_id: r for r in search.pool_scores(e, "the heart failure").collect()}
    ratio = SequenceMatcher(None, "the heart failure", "heart failure therapy").ratio()
    assert got["a"].score == round(min(1.0, 0.7 + 0.2 + 0.1 * ratio), 4) and got["b"].overlap == ["heart"]
    assert [r.evidence_id for r in search.pool_seed(search.pool_scores(e, "heart failure")).collect()] == ["a", "b"]


# ---------------------------------------------------------------- screening


def test_kappa_is_null_when_chance_is_certain(spark):
    same = spark.createDataFrame([("include", "include")] * 3, "a string, b string")
    r = screening.agreement(same).first()
    assert (r.n, r.raw_agreement, r.kappa) == (3, 1.0, None)
    assert screening.agreement(same.limit(0)).first().kappa is None
    mixed = spark.createDataFrame([("i", "i"), ("i", "e"), ("e", "e"), ("e", "e")], "a string, b string")
    assert screening.agreement(mixed).first().kappa == 0.5


def test_verdicts(spark):
    v = spark.createDataFrame([("1", "a", "include", "r1", None, "none"), ("1", "b", "exclude", "r2", "c", "retracted"), ("2", "b", "include", "r3", None, "none"), ("3", "a", "exclude", "x", "k", "none"), ("3", "b", "include", "y", None, "none")], "evidence_id string, screener_id string, decision string, reason string, criterion_failed string, retraction_flag string")
    adj = spark.createDataFrame([("1", "unclear", "why")], "evidence_id string, final_decision string, rationale string")
    assert rows(screening.resolve_verdicts(v, adj).na.fill("-"), "evidence_id", "decision", "reason", "retraction_flag") == [("1", "unclear", "why", "retracted"), ("2", "include", "r3", "none"), ("3", "-", "-", "none")]
    assert rows(screening.disagreements(screening.dual_screening(v, "a", "b"), adj, pending_only=True), "evidence_id") == [("3",)]


# ---------------------------------------------------------------- tasks


def test_state_machine(spark):
    log = spark.createDataFrame([("search:query:1", "pending", "h", 1), ("search:query:1", "active", "h", 2), ("search:query:1", "completed", "h", 3), ("search:query:1", "active", "h", 4), ("screen", "active", "h", 5)], "task_id string, status string, inputs_hash string, seq int")
    assert rows(tasks.violations(log), "task_id", "seq") == [("screen", 5), ("search:query:1", 4)]
    assert rows(tasks.violations(log.withColumn("inputs_hash", F.col("seq").cast("string"))), "seq") == [(5,)]
    assert tasks.split_task_id("extract:pmid:12") == ("extract", "pmid", "12")
    with pytest.raises(ValueError, match="no task id"):
        tasks.split_task_id("nope:pmid:1")


def test_commands(spark):
    log = spark.createDataFrame([("search", "pending", 0, "h", 1), ("screen", "completed", 1, "h", 2)], "task_id string, status string, attempts int, inputs_hash string, seq int")
    cmd = spark.createDataFrame([("search", "active", None), ("screen", "active", "h"), ("verify", "active", "n"), ("bad id", "pending", "n")], "task_id string, status string, inputs_hash string")
    ok, refused = tasks.append(log, cmd)
    assert rows(ok, "task_id", "attempts") == [("search", 1), ("verify", 1)] and rows(refused, "task_id") == [("bad id",), ("screen",)]


def test_guard_alerts_and_ids(spark):
    p = spark.createDataFrame([(1, k, "f", 5 + k, 9 + k, 1, 1) for k in range(4)] + [(2, k, "f", 5, 9, 0, 0) for k in range(4)] + [(3, k, "f", 5, 9, 0, 1) for k in range(4)], "run_id int, seq int, fingerprint string, attempts_total int, records_total int, active int, waiting int")
    got = {(r.run_id, r.seq): r.no_progress for r in tasks.progress_guard(p, 3).collect()}
    assert got[1, 3] and not got[1, 1] and not got[2, 3] and got[3, 3]
    ev = spark.createDataFrame([("ev-0007",), ("odd",)], "event_id string")
    new = spark.createDataFrame([("x", 1), ("y", 2)], "event_id string, k int")
    assert rows(tasks.next_event_ids(ev, new, "k"), "event_id") == [("ev-0008",), ("ev-0009",)]


def test_stream_equals_batch_in_pieces(spark, scratch, tmp_path):
    base = [("a", "s", st, 1, "w", None, None, k) for k, st in enumerate(["pending", "active", "completed", "completed", "failed"])]
    path = str(tmp_path / "log")
    for k in range(0, 5, 2):
        spark.createDataFrame(base[k : k + 2], monitor.LOG).coalesce(1).write.mode("append").json(path)
    q = monitor.run_to_folder(monitor.change_feed(monitor.read_log(spark, path, files_per_batch=1)), "t" + scratch.root[-12:], str(tmp_path / "out"))
    q.awaitTermination()
    got = spark.read.schema(monitor.CHANGES).parquet(str(tmp_path / "out"))
    assert {r.status for r in got.collect()} <= {"completed", "failed"} and got.count() >= 1


# ---------------------------------------------------------------- provenance

TEXT = "a😀bé and some more text to cite, long enough."


def snapshot(spark, *, tamper=False):
    s = spark.createDataFrame([("u", TEXT, "abstract")], "url string, text string, access string")
    s = s.select(provenance.source_id(F.col("url"), F.col("text")).alias("source_id"), provenance.content_hash(F.col("text")).alias("content_hash"), "url", "access", "text")
    return s.withColumn("text", F.concat("text", F.lit("!"))) if tamper else s


def spans(spark, sid, *each):
    return spark.createDataFrame([(sid if e[0] else "src-x", *e[1:]) for e in each], "source_id string, start int, end int, access string, excerpt string")


def test_span_reasons(spark):
    snap = snapshot(spark)
    sid = snap.first().source_id
    s = spans(spark, sid, (1, 1, 4, None, "😀bé"), (0, 0, 1, None, None), (1, 0, 999, None, None), (1, 3, 3, None, None), (1, 0, 1, None, "z"), (1, 0, 1, "full_text", "a"))
    got = [(r.start, r.end, r.reason_code) for r in provenance.verify_spans(s, snap).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 4, None), (0, 1, "UNKNOWN_SOURCE"), (0, 999, "SPAN_OUT_OF_RANGE"), (3, 3, "SPAN_OUT_OF_RANGE"), (0, 1, "EXCERPT_MISMATCH"), (0, 1, None)]))
    assert provenance.verify_spans(s, snap).filter("warning is not null").count() == 1
    assert provenance.verify_spans(s, snap, strict_access=True).filter("reason_code = 'SCHEMA_ERROR'").count() == 1
    bad = provenance.verify_spans(s, snapshot(spark, tamper=True).withColumn("source_id", F.lit(sid)))
    assert {r.reason_code for r in bad.collect()} == {"SNAPSHOT_HASH_MISMATCH", "UNKNOWN_SOURCE"}


def test_freshness_needs_all_conditions(spark):
    snap = snapshot(spark)
    sid, digest = snap.first().source_id, snap.first().content_hash[7:]
    ev = spark.createDataFrame([("e1", "read", sid, True, "2024-02-01", digest, 1), ("e2", "fetch", sid, False, "2024-02-01", digest, 2), ("e3", "fetch", sid, True, "2023-02-01", digest, 3), ("e4", "fetch", sid, True, "2024-02-01", "0", 4), ("e5", "fetch", sid, True, "2024-02-01", digest, 5), ("e6", "fetch", sid, True, "2024-02-02", digest, 6)], "event_id string, type string, source_id string, fresh boolean, at string, sha256 string, seq int").withColumn("at", F.to_timestamp("at"))
    start = F.lit("2024-01-01").cast("timestamp")
    assert rows(provenance.fresh_events(ev, snap, start), "event_id") == [("e5",)]
    assert provenance.fresh_events(ev, snap, F.lit(None).cast("timestamp")).count() == 0
    assert provenance.fresh_events(ev.filter("seq < 5"), snap, start).count() == 0


def test_appraisal_rules(spark):
    d = [("d", None, "low")] * 5
    a = spark.createDataFrame([("ok", "RoB2", None, None, "low", "fulltext", d), ("few", "RoB2", None, None, "low", "fulltext", d[:3]), ("variant", "RoB2", "cluster", None, "low", "fulltext", d[:3]), ("word", "RoB2", None, None, "low", "fulltext", [("d", None, "yes")] * 5), ("abs", "RoB2", None, None, "low", "abstract_only", d), ("tool", "Nope", None, None, "low", "fulltext", d), ("stars", "Newcastle-Ottawa", None, None, "7/9", "fulltext", [("d", None, "yes")])], "evidence_id string, tool string, tool_variant string, target_type string, overall_judgement string, evidence_basis string, domains array<struct<domain:string,domain_group:string,judgement:string>>")
    got = {r.evidence_id: r.problems for r in provenance.appraisal_problems(a).collect()}
    assert got.keys() == {"few", "word", "abs", "tool"}


def test_kernel_checks(spark):
    snap = snapshot(spark)
    s = provenance.verify_spans(spans(spark, snap.first().source_id, (1, 0, 1, None, "z")), snap)
    verdicts = spark.createDataFrame([("x", "accepted")], "artifact_id string, verdict string")
    none = snap.limit(0).select("source_id", F.lit("e").alias("event_id"))
    soft = {r.check_id: r.status for r in provenance.kernel_checks(snapshot(spark, tamper=True), s, none, verdicts, gate=False).collect()}
    assert soft == {"C-SNAPSHOT": "fail", "C-SPAN": "warn", "C-FRESH-FETCH": "warn", "C-ASSEMBLER": "pass"}


def test_write_once_store(spark):
    snap = snapshot(spark)
    again = snap.withColumn("access", F.lit("web"))
    new, clash = provenance.new_snapshots(again, snap)
    assert new.count() == 0 and clash.count() == 1
    new, clash = provenance.new_snapshots(snap, snap.limit(0))
    assert new.count() == 1 and clash.count() == 0


# ---------------------------------------------------------------- entities

REC = "evidence_id string, position long, pmid string, doi string, pmcid string, title string, journal string, publication_date string, extraction_path string, appraisal_path string, retraction_status string, source string, is_preprint boolean, seen_in_queries array<string>"


def records(spark, *each):
    full = [dict(zip([c.split()[0] for c in REC.split(", ")], e, strict=True)) for e in each]
    df = spark.createDataFrame(full, REC)
    none = F.array().cast("array<string>")
    ft = F.expr("named_struct('status','missing','source_tier',cast(null as int),'access_route',cast(null as string),'local_path',cast(null as string),'sha256',cast(null as string),'truncation_detected',false)")
    return df.withColumns({c: none for c in (*entities.LISTS, "source_ids", "merged_from")}).withColumn("fulltext", ft)


def rec(k, pmid=None, doi=None, title="A title of a study", date=None, pre=False, ret="none", src="pubmed", q="q1"):
    eid = f"pmid:{pmid}" if pmid else f"doi:{doi}" if doi else f"url:{k}"
    return (eid, k, pmid, doi, None, title, None, date, None, None, ret, src, pre, [q])


def test_dedupe_rules(spark, scratch):
    df = records(
        spark, rec(1, pmid="1", doi="10.1/a", q="q10"), rec(2, doi="10.1/a", ret="retracted", q="q2"), rec(3, title="A title of a study!", date="2020"), rec(4, title="A titles of a study", date="2021"),
        rec(5, pmid="5", doi="10.1/a", title="Something else here"), rec(6, title="Preprint of the work", pre=True), rec(7, title="Preprint of the work"),
    )
    merged, pairs = entities.dedupe(df, scratch)
    got = {r.evidence_id: r for r in merged.collect()}
    first = got["pmid:1"]
    assert first.retraction_status == "retracted" and first.first_seen_query == "q1" and "doi:10.1/a" in first.merged_from
    assert "pmid:5" in got  # distinct pmids are never one study
    refused = {r.refused for r in pairs.collect()}
    assert {"distinct pmids", "different years", "preprint and published"} <= refused
    assert sum(len(r.merged_from) for r in got.values()) >= 2


def test_classes_of_one_title_join_as_all_pairs_would(spark, scratch):
    random = __import__("random").Random(4)
    known = [(random.choice([None, "1", "2"]), random.choice([None, "10.1/a"]), random.choice([None, "2000", "2001"]), random.random() < 0.3) for _ in range(14)]
    for given in ([("7", None, "2000", False), ("2", None, "2001", False), (None, None, "2001", False)], known):
        df = records(spark, *[rec(k, pmid=p, doi=d, title="Editorial", date=y, pre=pre) for k, (p, d, y, pre) in enumerate(given)])
        got = {(r.x.position, r.y.position) for r in entities.duplicate_pairs(df, scratch).filter("refused is null and match = 'title'").collect()}
        clash = lambda a, b: any(u and v and u != v for u, v in zip(a[:3], b[:3], strict=True)) or a[3] != b[3]
        want = {(a, b) for a in range(len(given)) for b in range(a + 1, len(given)) if not clash(given[a], given[b])}
        assert got <= want
        group = list(range(len(given)))
        for a, b in got:
            group = [group[a] if g == group[b] else g for g in group]
        assert all(group[a] == group[b] for a, b in want)


def test_similar_candidates_lose_nothing(spark):
    import random

    random.seed(2)
    base = ["".join(random.choice("abcdefg hij") for _ in range(random.randint(3, 70))) for _ in range(120)]
    titles = set(base)
    for t in base:
        u = list(t)
        for _ in range(random.randint(1, 3)):
            u[random.randrange(len(u))] = random.choice("xyz ")
        titles.add("".join(u))
    titles = sorted(titles)
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    got = {(r.t, r.u) for r in entities.similar_candidates(df, df.withColumnRenamed("t", "u"), "t", "u", 0.93).collect()}
    assert {(a, b) for a in titles for b in titles if a != b and SequenceMatcher(None, a, b).ratio() >= 0.93} <= got


def test_alias_chains_and_reverts(spark, scratch):
    m = spark.createDataFrame([(1, 2, None), (2, 3, None), (3, 4, None), (9, 8, 1)], "absorbed long, survivor long, reverted_at int")
    assert rows(entities.alias_map(m, scratch), "absorbed", "survivor") == [(1, 4), (2, 4), (3, 4)]
    moves = spark.createDataFrame([(1, 10, 4), (1, 11, 4), (2, 12, 5)], "merge_id int, row_id int, survivor int")
    owned = spark.createDataFrame([(10, 4), (11, 7), (12, 5)], "row_id int, paper_id int")
    assert rows(entities.revertible(moves, owned), "merge_id", "can_revert") == [(1, False), (2, True)]
    with pytest.raises(ValueError, match="cycle"):
        entities.alias_map(spark.createDataFrame([(1, 2, None), (2, 1, None)], "absorbed long, survivor long, reverted_at int"), scratch)


def test_conflicts_reject_whole_batches(spark):
    owned = spark.createDataFrame([("doi", "a", 1), ("pmid", "b", 2)], "scheme string, value string, paper_id int")
    new = spark.createDataFrame([(1, "doi", "a"), (1, "pmid", "b"), (1, "doi", "n"), (2, "doi", "a"), (2, "doi", "m")], "batch_id int, scheme string, value string")
    assert rows(entities.identifier_conflicts(new, owned), "batch_id") == [(1,)]
    assert rows(entities.reconcile_identifiers(new, owned), "batch_id", "value") == [(2, "m")]


# ---------------------------------------------------------------- incremental, evidence, audits


def test_patch_and_notes(spark):
    r = spark.createDataFrame([("a", "t", ("missing", 1))], "evidence_id string, title string, fulltext struct<status:string,tier:int>")
    p = spark.createDataFrame([("a", ("fulltext", None)), ("zz", ("x", 1))], "evidence_id string, fulltext struct<status:string,tier:int>")
    out = incremental.patch(r, p).collect()
    assert len(out) == 1 and out[0].fulltext.status == "fulltext" and out[0].fulltext.tier == 1 and out[0].title == "t"
    with pytest.raises(ValueError, match="identity"):
        incremental.patch(r, p.withColumn("pmid", F.lit("1")))
    notes = spark.createDataFrame([("a", ["x"], 3, "n", "t0")], "evidence_id string, tags array<string>, rating int, note string, updated_at string")
    kind = "evidence_id string, add_tags array<string>, remove_tags array<string>, rating int, clear_rating boolean, note string, clear_note boolean, at string"
    got = {x.evidence_id: x for x in incremental.upsert_notes(notes, spark.createDataFrame([("a", ["b"], ["x"], None, True, None, False, "t1"), ("c", ["z", "y"], None, 5, False, "hi", False, "t1")], kind)).collect()}
    assert got["a"].tags == ["b"] and got["a"].rating is None and got["a"].note == "n" and got["c"].tags == ["y", "z"]
    with pytest.raises(Exception, match="rating"):
        incremental.upsert_notes(notes, spark.createDataFrame([("a", None, None, 9, False, None, False, "t")], kind)).collect()


def test_ledger_and_lifecycle(spark):
    led = spark.createDataFrame([("d", "a", "m", None, "published"), ("d", "b", "m", None, "failed")], "destination_identity string, evidence_id string, metadata_hash string, attachment_fingerprint string, status string")
    cand = spark.createDataFrame([("d", "a", "m", None), ("d", "b", "m", None), ("d", "c", "m", None)], "destination_identity string, evidence_id string, metadata_hash string, attachment_fingerprint string")
    assert rows(incremental.ledger_diff(cand, led), "evidence_id", "changed") == [("a", False), ("b", True), ("c", True)]
    r = spark.createDataFrame([("a", "pending", None, None, None, {"p": "old", "q": "keep"})], "evidence_id string, asset_status string, extraction_status string, appraisal_status string, metadata_status string, appraisals map<string,string>")
    ev = spark.createDataFrame([("a", "asset_status", None, "available", 1), ("a", "asset_status", None, "missing", 2), ("a", "appraisal", "p", "new", 3)], "evidence_id string, field string, project string, value string, seq int")
    out = incremental.lifecycle(r, ev).first()
    assert out.asset_status == "missing" and out.appraisals == {"p": "new", "q": "keep"}


def test_ladder(spark):
    a = spark.createDataFrame([("a", 1, "success", True, "pmc"), ("a", 5, "success", False, "oa"), ("b", 1, "success", True, "pmc"), ("b", 8, "success", False, "quarantine"), ("c", 8, "success", False, "quarantine")], "evidence_id string, tier int, status string, truncated boolean, access_route string")
    assert rows(incremental.acquired(a), "evidence_id", "status", "source_tier", "access_route") == [("a", "fulltext", 5, "oa"), ("b", "abstract_only", 1, "pmc"), ("c", "missing", 8, "quarantine")]


def test_doctor_reports_each_kind(spark):
    papers = spark.createDataFrame([(1, None), (2, 1)], "paper_id int, deleted_at int")
    t = {
        "papers": papers, "assets": spark.createDataFrame([(1,), (2,)], "asset_id int"), "attachments": spark.createDataFrame([(5, 1, 1), (6, 9, 1)], "attachment_id int, paper_id int, asset_id int"),
        "identifiers": spark.createDataFrame([(1, "doi", "a", True), (1, "doi", "b", True), (2, "doi", "a", False)], "paper_id int, scheme string, value string, is_primary boolean"),
        "chunks": spark.createDataFrame([(1, 0), (7, 1)], "paper_id int, chunker_version int"), "terms": papers.select("paper_id"), "figures": spark.createDataFrame([(1, 6)], "paper_id int, attachment_id int"), "index_rows": papers.select("paper_id").limit(0),
    }
    got = {r.finding: r.n for r in audit.doctor(t, 1).collect()}
    assert got == {"orphan_assets": 1, "orphan_attachments": 1, "orphan_chunks": 1, "orphan_terms": 0, "orphan_figures": 0, "orphan_index_rows": 0, "unindexed_papers": 1, "figure_owner_mismatch": 1, "duplicate_primaries": 1, "duplicate_identifiers": 1, "identifiers_on_deleted": 1, "stale_chunks": 1}


def test_risk_rank_defaults(spark):
    df = spark.createDataFrame([("Low",), ("odd",), (None,)], "j string")
    assert [r[0] for r in df.select(evidence.risk_rank(F.col("j"))).collect()] == [0, 7, 7]


# ---------------------------------------------------------------- readers and sinks


def test_json_readers(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"evidence_id":"a","rating":1}\nnot json\n{"evidence_id":"b","rating":2}\n{"evidence_id":"a","rating":3}\n')
    assert readers.read_jsonl(spark, str(p), schemas.ANNOTATION).count() == 3
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, str(p), schemas.ANNOTATION, strict=True).collect()
    assert rows(readers.read_keyed(spark, str(p), schemas.ANNOTATION, "evidence_id"), "evidence_id", "rating") == [("a", 3), ("b", 2)]
    q = tmp_path / "s.jsonl"
    q.write_text('// comment\n{"schema_version":1,"evidence_id":"a"}\n')
    assert readers.read_strict(spark, str(q), "schema_version int, evidence_id string").count() == 1
    q.write_text('{"schema_version":2,"evidence_id":"a"}\n')
    with pytest.raises(Exception, match="bad version"):
        readers.read_strict(spark, str(q), "schema_version int, evidence_id string").collect()
    arr = tmp_path / "a.json"
    arr.write_text('[{"evidence_id":"a"},{"evidence_id":"b"}]')
    assert readers.read_input_list(spark, str(arr), "evidence_id string").count() == 2


def test_verdict_folders(spark, tmp_path):
    for who, name, body in (("screener-a", "1", {"pmid": "1", "decision": "include"}), ("screener-b", "1", {"pmid": "1", "decision": "exclude"}), ("adjudication", "1", {"pmid": "1", "decision": "include"}), ("screener-a", "2", {"pmid": "2", "decision": "maybe"})):
        (tmp_path / who).mkdir(exist_ok=True)
        (tmp_path / who / f"{name}.json").write_text(json.dumps(body))
    assert rows(readers.read_verdicts(spark, str(tmp_path)), "evidence_id", "screener_id", "decision") == [("pmid:1", "screener-a", "include"), ("pmid:1", "screener-b", "exclude")]


def test_normalised_records(spark):
    raw = spark.createDataFrame([{"pmid": "PMID:5", "title": "T", "fulltext": {"status": "missing", "access_route": "q"}}, {"title": "", "source": "odd"}, {"title": "x", "fulltext": {"status": "fulltext", "truncation_detected": True}}], schemas.CORPUS)
    got = readers.normalize_records(raw).collect()
    assert got[0].evidence_id == "pmid:5" and got[0].fulltext.source_tier == 8 and got[0].errors == [] and got[0].source == "pubmed"
    assert {"title missing", "source"} <= set(got[1].errors) and "truncated full text" in got[2].errors


def test_bibtex_round(spark, tmp_path):
    p = tmp_path / "x.bib"
    p.write_text('@comment{no}\n@article{k1, title = {The {RNA} of mice}, author = "Doe J and Roe, Ann", year=2020, month = 3, doi = {https://doi.org/10.1/X}, note={PMID: 77}}\n@book{k2,title="B"}')
    got = readers.read_bibtex(spark, str(p)).orderBy("key").collect()
    assert got[0].title == "The RNA of mice" and got[0].authors == ["Doe J", "Roe, Ann"] and got[0].pmid == "77" and got[0].doi == "10.1/x" and got[0].publication_date == "2020-03" and got[1].type == "book"
    raw = spark.createDataFrame([{"evidence_id": "pmid:1", "pmid": "1", "title": "The mRNA & 5% of Mice", "authors": ["Doe JA", "WHO Group"], "journal": "J", "publication_date": "2020-03-04", "pages": "1-9", "retraction_status": "retracted", "fulltext": {"status": "fulltext", "source_tier": 1}, "article_types": [], "keywords": [], "source": "pubmed", "is_preprint": False}], schemas.CORPUS)
    entry = sinks.bibtex(raw).first().entry
    assert entry.startswith("@article{pmid1,") and "{mRNA} \\& 5\\% of {Mice}" in entry and "Doe, J. A. and {WHO Group}" in entry and "RETRACTED. Full text via PMC full text (source tier 1)." in entry and "1--9" in entry
    lines = sinks.ris(raw).first().entry.split("\n")
    assert lines[0] == "TY  - JOUR" and "AU  - Doe, J. A." in lines and "DA  - 2020/03/04" in lines and "SP  - 1" in lines and "EP  - 9" in lines and lines[-1] == "ER  - "


def test_pubmed_xml(spark, tmp_path):
    p = tmp_path / "x.xml"
    p.write_text("""<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">12</PMID><Article><Journal><ISSN IssnType="Print">1</ISSN><JournalIssue><Volume>3</Volume><PubDate><Year>2020</Year><Month>Feb</Month></PubDate></JournalIssue><Title>J</Title></Journal>
<ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label="AIM">x</AbstractText><AbstractText Label="END">y</AbstractText></Abstract><AuthorList><Author><LastName>Doe</LastName><Initials>J</Initials></Author><Author><CollectiveName>G</CollectiveName></Author></AuthorList>
<PublicationTypeList><PublicationType UI="D1">Journal Article</PublicationType><PublicationType UI="D2">Retracted Publication</PublicationType></PublicationTypeList></Article></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/A</ArticleId><ArticleId IdType="pmc">PMC9</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>""")
    r = readers.read_pubmed(spark, str(p)).first()
    assert (r.pmid, r.doi, r.pmcid, r.title, r.publication_date, r.authors, r.retraction_status, r.abstract) == ("12", "10.1/a", "PMC9", "T", "2020-02", ["Doe J", "G"], "retracted", "AIM: x\nEND: y")


def test_reports_and_names(spark):
    text = "---\nt: x\n---\n# Head\nA claim.[^a]\n```\n[^no]\n```\n[^a]: note\n| t |\n"
    got = [(r.kind, r.section, r["keys"]) for r in readers.scan_report(spark.createDataFrame([(1, text)], "report_id int, text string")).orderBy("line_no").collect()]
    assert [g[0] for g in got] == ["front", "front", "front", "heading", "prose", "code", "code", "code", "note", "table", "blank"]
    assert got[4] == ("prose", "Head", ["a"]) and got[6][2] == []
    names = sinks.unique_names(spark.createDataFrame([("x", "a" * 64), ("x", "a" * 10 + "b" * 54), ("y", "c" * 64)], "label string, sha256 string"))
    assert rows(names, "name") == [("x-" + "a" * 12,), ("x-" + "a" * 10 + "bb",), ("y-cccccccc",)]


def test_versions_and_blobs(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    sinks.write_version(spark.range(2), root, 1)
    sinks.write_version(spark.range(5), root, 2)
    assert sinks.read_current(spark, root).count() == 5
    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"x")), ("c", bytearray(b"y"))], "path string, content binary")
    fresh, named = sinks.content_addressed(files, files.limit(0).select(F.lit("").alias("sha256")))
    assert fresh.count() == 2 and named.count() == 3
