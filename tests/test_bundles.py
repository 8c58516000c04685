"""Bundle rules over files, author strings, and per-paper plans."""

import itertools
import posixpath
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import bundles, paper_plan
from quillspark.session import Scratch, ship_package
from quillspark.sources import notes


@pytest.fixture
def scratch(spark):
    ship_package(spark)
    s = Scratch(spark, "test-bundles")
    yield s
    s.close()


def test_links_resolve_like_paths(spark):
    bases = ["research/studies", "research", "a/b/c", ""]
    dests = ["x.md", "./x.md", "../x.md", "../../x.md", "../../../../x.md", "a/../x.md", "a/./b//x.md", "..", ".", "/x.md", "a/..", "../studies/../studies/x.md", "a/../../x.md"]
    rows = list(itertools.product(bases, dests))
    got = {(r.b, r.d): r.r for r in spark.createDataFrame(rows, "b string, d string").withColumn("r", bundles.resolve(F.col("b"), F.col("d"))).collect()}
    for b, d in rows:
        want = posixpath.normpath(posixpath.join("/root/of/bundle", b, d)) if not d.startswith("/") else d
        inside = want == "/root/of/bundle" or want.startswith("/root/of/bundle/")
        # A path that leaves the root and comes back is outside as well: nothing is known of what lies there.
        left = d.startswith("/") or any(posixpath.normpath("/".join(["x", *(f"{b}/{d}".split("/"))[:n]])).split("/")[0] != "x" for n in range(1, len(f"{b}/{d}".split("/")) + 1))
        assert got[b, d] == (None if left or not inside else want.removeprefix("/root/of/bundle").lstrip("/")), (b, d)


@pytest.mark.parametrize("hot", [0, 1, 10**9])
def test_dangling_links(spark, scratch, monkeypatch, hot):
    monkeypatch.setattr(bundles, "HOT", hot)
    body = "[a](x.md) ![i](none.png) [b](none.md) [c](#x) [d](https://y) [e](../../wiki/none.md) [f](../../other/y.md) [g](../) [h](x.md#part) [i](../../outputs)"
    rows = [("research/s/n.md", f"---\nsources:\n  - resource: ../gone.md\n  - resource: mailto:x@y\n  - {{}}\n---\n{body}"), ("research/s/x.md", None), ("other/y.md", "no front [z](../research/s/x.md)"), ("broken.md", "---\n- x\n---\n[q](q.md)")]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {(r.path, r.kind, r.dest, r.problem) for r in bundles.dangling(notes.from_files(files), files, scratch).collect()}
    n = "research/s/n.md"
    assert got == {(n, "resource", "../gone.md", "dangling"), (n, "link", "none.md", "dangling"), (n, "link", "../../other/y.md", "outside"), (n, "link", "../../outputs", "dangling"), ("broken.md", "link", "q.md", "dangling")}


def test_types_in_front_matter(spark, scratch):
    said = {"a": "type: Study\npmid: 12\ndoi: \"10.1/x\"\nvolume: 2024-01-02\nissue: 1.5\npages: true\npmcid: null", "b": "type: Outcome\npmid: 12", "c": "resource: https://pubmed.ncbi.nlm.nih.gov/1\nissue: 3", "d": "type: Study\npmid: '12'"}
    files = spark.createDataFrame([(k, f"---\n{v}\n---\n") for k, v in said.items()], "path string, text string")
    assert {(r.path, r.field) for r in bundles.untyped(notes.from_files(files)).collect()} == {("a", "pmid"), ("a", "issue"), ("a", "pages"), ("c", "issue")}


def test_logs_and_indexes(spark):
    log = "# L\n## 2024-01-02\n##  2024-01-02 \ntext ## 1\n## soon\n## 2023-12-31\n##2024\n## 2024-01-02"
    rows = [("research/log.md", log), ("research/a/log.md", None), ("other/log.md", "## x"), ("research/a/n.md", ""), ("research/b/n.md", ""), ("research/b/index.md", ""), ("research/c/index.md", ""), ("research/d/e/n.md", "")]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {(r.path, r.line_no, r.problem) for r in bundles.log_problems(files).collect()}
    p = "research/log.md"
    assert got == {(p, 3, "twice"), (p, 5, "no date"), (p, 6, "out of order"), (p, 8, "twice")}
    assert {(r.folder, r.notes) for r in bundles.without_index(files).collect()} == {("a", 2)}


def test_author_strings(spark):
    names = {"Smith JA": ("Smith", "JA"), " van  der Berg\tK ": ("van der Berg", "K"), "WHO": ("WHO", None), "Lee ABCDE": ("Lee ABCDE", None), "Smith ja": ("Smith ja", None), "": (None, None), None: (None, None), "A B": ("A", "B"), "Group of Ten X Y": ("Group of Ten X", "Y")}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", bundles.author_parts(F.col("n")).alias("a")).collect()
    assert {r.n: (r.a.family, r.a.initials) for r in got} == names
    bad = spark.createDataFrame([("e", "gone")], "evidence_id string, retraction_status string")
    for c in ("pmid", "pmcid", "doi", "journal", "publication_date", "volume", "issue", "pages", "abstract"):
        bad = bad.withColumn(c, F.lit(None).cast("string"))
    bad = bad.withColumn("authors", F.expr("cast(null as array<string>)")).withColumn("article_types", F.expr("cast(null as array<string>)")).withColumn("is_preprint", F.lit(None).cast("boolean"))
    with pytest.raises(Exception, match="invalid retraction_status"):
        bundles.biblio_front(bad).collect()


def make_facts(spark, world):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "papers": frame([(e, w["ft"], w["reuse"], w["force"], w["appraise"], w["only"]) for e, w in world.items()], "evidence_id string, ft_status string, reuse boolean, force boolean, appraise boolean, extract_only boolean"),
        **{name: frame([(e, x["exists"], x["names"], x["basis"]) for e, w in world.items() if (x := w[key])], "evidence_id string, file_exists boolean, file_evidence_id string, basis string") for name, key in (("extractions", "own"), ("pooled_extractions", "pooled"))},
        "spans": frame([(e, ok) for e, w in world.items() for ok in w["spans"]], "evidence_id string, ok boolean"), "appraisals": frame([(e,) for e, w in world.items() if w["appraised"] == "own"], "evidence_id string"),
        "pooled_appraisals": frame([(e,) for e, w in world.items() if w["appraised"] == "pool"], "evidence_id string"), "summaries": frame([(e, w["summary"]) for e, w in world.items() if w["summary"] is not None], "evidence_id string, problems int"),
        "refs": frame([(e, ok) for e, w in world.items() for ok in w["refs"]], "evidence_id string, ok boolean"), "board": frame([(f"{stage}:{e}", s) for e, w in world.items() for stage, s in w["board"].items()], "task_id string, status string"),
    }


def slow_plan(e, w):
    """One paper after another, as the rules are told."""
    x = w["pooled"] if w["reuse"] and not w["force"] and w["pooled"] else w["own"]
    good = bool(x) and x["exists"] and x["names"] in (e, None) and all(w["spans"]) and not w["force"]
    if not good:
        status = "pending_retrieval" if (w["ft"] or "missing") == "missing" else "pending_extraction"
    elif w["only"]:
        status = "completed"
    else:
        skip = x["basis"] == "abstract_only" or not w["appraise"]
        have = w["appraised"] == "own" or (w["appraised"] == "pool" and w["reuse"] and not w["force"])
        bad = (w["summary"] or 0) + sum(not ok for ok in w["refs"])
        status = "pending_appraisal" if not skip and not have else "pending_summary" if w["summary"] is None else "verification_failed" if bad else "completed"
    stage = paper_plan.STAGE_OF.get(status)
    return status, bool(stage) and w["board"].get(stage) in (None, "cancelled")


def make_world(seed, n=120):
    r = random.Random(seed)

    def extraction(e):
        return {"exists": r.random() < 0.9, "names": r.choice([e, e, e, None, "other"]), "basis": r.choice(["fulltext", "fulltext", "abstract_only", None])} if r.random() < 0.6 else None

    world = {}
    for k in range(n):
        e = f"pmid:{k}"
        world[e] = {
            "ft": r.choice(["missing", "fulltext", "abstract_only", None]), "reuse": r.random() < 0.5, "force": r.random() < 0.15, "appraise": r.random() < 0.7, "only": r.random() < 0.1, "own": extraction(e), "pooled": extraction(e), "spans": [r.random() < 0.95 for _ in range(r.randrange(4))],
            "appraised": r.choice(["own", "pool", None]), "summary": r.choice([None, 0, 0, 1]), "refs": [r.random() < 0.9 for _ in range(r.randrange(3))], "board": {s: r.choice(["pending", "cancelled", "completed"]) for s in ("retrieve", "extract", "appraise") if r.random() < 0.5},
        }
    return world


def test_plan_equals_one_paper_after_another(spark, scratch):
    world = make_world(5)
    got = {r.evidence_id: (r.status, r.queue) for r in paper_plan.plan(make_facts(spark, world)).collect()}
    assert got == {e: slow_plan(e, w) for e, w in world.items()}
    assert len({s for s, _ in got.values()}) == 6


def test_work_runs_to_its_end(spark, scratch):
    """Workers do what a plan asks for; the states at the end are those of a loop over papers, and nothing runs for ever."""
    world = make_world(6, 60)

    def do(e, w):
        status = slow_plan(e, w)[0]
        if status == "pending_retrieval" and int(e[5:]) % 10:  # some texts cannot be had
            w["ft"] = "fulltext"
        elif status == "pending_extraction" and not w["force"]:
            w["own"], w["pooled"], w["spans"] = {"exists": True, "names": e, "basis": "fulltext"}, None, [True]
        elif status == "pending_appraisal":
            w["appraised"] = "own"
        elif status == "pending_summary":
            w["summary"] = 0

    def work(plan, facts):
        for e in [r.evidence_id for r in plan.filter("status like 'pending%'").collect()]:
            do(e, world[e])
        return make_facts(spark, world)

    last, moved = paper_plan.run_to_end(make_facts(spark, world), work, scratch)
    alone = make_world(6, 60)
    for e, w in alone.items():
        for _ in range(9):
            do(e, w)
    assert {r.evidence_id: r.status for r in last.collect()} == {e: slow_plan(e, w)[0] for e, w in alone.items()}
    assert moved[-1] == 0 and len(moved) <= 6
    _, idle = paper_plan.run_to_end(make_facts(spark, world), lambda plan, facts: facts, scratch)
    assert idle == [0]
