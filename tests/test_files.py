"""Note files, migrations, folder imports and the monitor's side inputs."""

import hashlib
import json
import os
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.session import Scratch, put_if_absent, ship_package
from quillspark.sources import files, folders, migrations, notes, sinks
from quillspark.streaming import monitor, side_inputs


@pytest.fixture
def scratch(spark):
    ship_package(spark)
    s = Scratch(spark, "test-files")
    yield s
    s.close()


# ---------------------------------------------------------------- notes

HARD = [
    "plain", "", " ", " lead", "tail ", "null", "~", "yes", "True", "12", "-1.5e3", ".5", "2024-01-02", "a: b", "a:", "a #b", "#b", "a#b", "- x", "-", "[x]", "{x}", "a, b", 'say "x"', "it's", "'q'", '"', "\\", "\\n", "a\nb", "a\tb",
    "a\rb", "\x01", "@x", "%x", "`x", "? x", "| x", "> x", "Größe: ß", "x" * 5000, "---", "...", "a\n---\nb", "\u2028x", "trail:\u00a0", "https://x.example/a?b=1#c", "0123", "1_000", "*a", "&a", "!a", "key: 'v'",
]
FRONT = "type string, title string, pmid string, at string, n long, ok boolean, w double, tags array<string>, generated struct<by string, at string>, deep struct<a string, b struct<c string, d array<string>>>, sources array<struct<id string, title string, more array<struct<k string>>>>, links map<string, string>"


def test_parse_of_emit_is_the_row(spark, scratch):
    rows = []
    for k, x in enumerate(HARD):
        y = HARD[(k * 7 + 3) % len(HARD)]
        sources = [{"id": x, "title": y, "more": [{"k": y}, {"k": x}]}, {"id": None, "title": None, "more": None}, {"id": None, "title": x, "more": []}]
        front = {"type": x, "title": y, "pmid": x, "at": y, "n": k - 5, "ok": k % 2 == 0, "w": k / 4, "tags": [x, y, None], "generated": {"by": x, "at": y}, "deep": {"a": None, "b": {"c": y, "d": [x]}}, "sources": sources, "links": {"k": y, "a: b": x}}
        rows.append(("f", f"s{k}", front if k % 9 else {**front, "tags": [], "deep": None, "sources": None, "links": None}, f"body {x}\n---\nmore"))
    df = spark.createDataFrame(rows, f"folder string, slug string, front struct<{FRONT.replace(' ', ':', 0)}>, body string")
    kind = df.schema["front"].dataType
    written = notes.to_files(df).cache()
    got = {r.slug: r for r in notes.typed(notes.from_files(written), kind).collect()}
    for r in df.collect():
        g = got[r.slug]
        assert g.error is None and g.folder == "f" and g.body == r.body.strip("\n")
        assert {c: g[c] for c in kind.names} == {c: r.front[c] for c in kind.names}
    text = next(r.text for r in written.collect() if r.path == "f/s0.md")
    assert text.startswith('---\ntype: plain\ntitle: " lead"\npmid: "plain"\nat: " lead"\nn: -5\nok: true\nw: 0.0\n')


VALUE = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.text(st.characters(exclude_categories=("Cs",), exclude_characters="\b\f"), max_size=12), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abc: #'\"-", min_size=1, max_size=4), x, max_size=3), max_leaves=8)


def blocks(x, indent=0):
    """Another writer: quoted texts, every collection in block form."""
    out = []
    for k, v in x.items():
        if isinstance(v, (dict, list)) and v:
            out += [f"{' ' * indent}{json.dumps(k)}:", *items(v, indent + 2)]
        else:
            out.append(f"{' ' * indent}{json.dumps(k)}: {json.dumps(v)}  # {k}")
    return out


def items(x, indent):
    if isinstance(x, dict):
        return blocks(x, indent)
    out = []
    for v in x:
        if isinstance(v, (dict, list)) and v:
            out += [f"{' ' * indent}-", *items(v, indent + 3)]
        else:
            out.append(f"{' ' * indent}- {json.dumps(v)}")
    return out


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), VALUE, max_size=4))
def test_grammar_reads_any_tree(x):
    assert notes.parse_front("\n".join(blocks(x))) == x


def test_forms_of_hand_written_front_matter():
    text = """# comment
a: it's  # said
b: "x # y"   # z
c:
- one
- two: 2
  three: 'it''s'
-
  deep:
    - x
d: [1, "a, b", null, [x, y], {k: v}]
e: { by: me, at: 2024-01-01 }
f: |
  line one

    line two
g: >-
  folded
  words

  new
h:
i: http://x.example/#a
"j: k": yes
"""
    assert notes.parse_front(text) == {
        "a": "it's  # said", "b": "x # y", "c": ["one", {"two": 2, "three": "it's"}, {"deep": ["x"]}], "d": [1, "a, b", None, ["x", "y"], {"k": "v"}], "e": {"by": "me", "at": "2024-01-01"},
        "f": "line one\n\n  line two\n", "g": "folded words\n\nnew", "h": None, "i": "http://x.example/#a", "j: k": "yes",
    }
    for bad in ("a: 1\n    b: 2", "- x\n", "a: [x", 'a: "x" y', "words", "a:\n  - x\n  b: 1", 'a: "open'):
        with pytest.raises(ValueError):
            notes.parse_front(bad)


def test_files_without_or_with_broken_front_matter(spark, scratch):
    rows = [("a/n.md", "no front\n"), ("b/n.md", "---\nx: [1\n---\nbody\n\n"), ("c.md", None), ("d/e/n.md", "---\n---\n\n---\n"), ("e/n.md", "---\nx: 1\nno end"), ("f/n.md", "--- \nx: 1\n...\nbody")]
    got = {r.path: (r.folder, r.slug, r.front, r.body, r.error is not None) for r in notes.from_files(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {
        "a/n.md": ("a", "n", None, "no front", False), "b/n.md": ("b", "n", None, "body", True), "c.md": ("", "c", None, "", False), "d/e/n.md": ("e", "n", "{}", "---", False),
        "e/n.md": ("e", "n", None, "---\nx: 1\nno end", False), "f/n.md": ("f", "n", '{"x": 1}', "body", False),
    }


def test_real_files_and_the_fence(spark, scratch):
    df = spark.createDataFrame([("a", f"n{k}", {"title": f"t: {k}"}, f"words {k}") for k in range(20)], "folder string, slug string, front struct<title:string>, body string")
    written = files.write_files(notes.to_files(df).select("path", F.col("text").alias("content")), scratch.path("bundle"))
    manifest = {r.path: r.sha256 for r in written.collect()}
    root = scratch.path("bundle").removeprefix("file://").removeprefix("file:")
    assert {f"a/{x}" for x in os.listdir(f"{root}/a")} == set(manifest)
    assert all(hashlib.sha256(open(f"{root}/{p}", "rb").read()).hexdigest() == h for p, h in manifest.items())
    read = spark.read.text(scratch.path("bundle") + "/a", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    assert {(r.slug, r.title, r.body) for r in notes.typed(notes.from_files(read), "title string").collect()} == {(f"n{k}", f"t: {k}", f"words {k}") for k in range(20)}
    for bad in ("../x", "/etc/x", "a/../../x", "", ".."):
        with pytest.raises(Exception, match="not below the folder"):
            files.write_files(spark.createDataFrame([(bad, "x")], "path string, content string"), scratch.path("bundle")).collect()


# ---------------------------------------------------------------- migrations


def step(name, value):
    return migrations.Migration(name, lambda t: t.withColumn(f"c{name}", F.lit(value)))


def base(spark):
    return migrations.Migration("01", lambda _: spark.range(5).toDF("id"))


def test_migrations_in_order_and_again(spark, scratch):
    t = migrations.VersionedTable(spark, scratch.path("t"))
    assert t.read() is None
    assert migrations.migrate(t, [step("03", 3), base(spark), step("02", 2)]) == ["01", "02", "03"]
    assert t.read().columns == ["id", "c02", "c03"] and [e.version for e in t.entries()] == [1, 2, 3]
    assert migrations.migrate(t, [step("03", 3), base(spark), step("02", 2)]) == [] and len(t.entries()) == 3
    assert migrations.migrate(t, [base(spark), step("015", 9), step("02", 2)]) == ["015"]  # a late one with an early id still applies
    assert t.read(2).columns == ["id", "c02"] and t.read().count() == 5
    t.vacuum()
    assert t.read().columns == ["id", "c02", "c03", "c015"] and len(t.entries()) == 4
    with pytest.raises(ValueError):
        migrations.migrate(t, [step("02", 1), step("02", 2)])
    with pytest.raises(ValueError):
        t.read(9)


def test_a_failing_step_leaves_what_came_before(spark, scratch):
    def broken(t):
        return t.select(F.raise_error(F.lit("no")).alias("x"))

    steps = [base(spark), step("02", 2), migrations.Migration("03", broken)]
    t = migrations.VersionedTable(spark, scratch.path("t"))
    with pytest.raises(Exception, match="no"):
        migrations.migrate(t, steps)
    assert t.read().columns == ["id", "c02"]
    root = scratch.path("t").removeprefix("file://").removeprefix("file:")
    assert len(os.listdir(f"{root}/data")) == 2  # nothing of the failed one is left
    whole = migrations.VersionedTable(spark, scratch.path("u"))
    with pytest.raises(Exception, match="no"):
        migrations.migrate(whole, steps, together=True)
    assert whole.read() is None
    assert migrations.migrate(whole, steps[:2], together=True) == ["01", "02"] and len(whole.entries()) == 1


def test_two_writers_of_one_version(spark, scratch):
    t = migrations.VersionedTable(spark, scratch.path("t"))
    migrations.migrate(t, [base(spark)])
    assert t.commit(spark.range(1), ["a"], 1) and not t.commit(spark.range(2), ["b"], 1)
    assert t.read().count() == 1 and [list(e.ids) for e in t.entries()] == [["01"], ["a"]]
    applied, wait = [], threading.Barrier(2)

    def run():
        wait.wait()
        applied.append(migrations.migrate(migrations.VersionedTable(spark, scratch.path("race")), [base(spark), step("02", 2), step("03", 3)]))

    both = [threading.Thread(target=run) for _ in range(2)]
    [x.start() for x in both]
    [x.join() for x in both]
    assert sorted(applied[0] + applied[1]) == ["01", "02", "03"]
    assert migrations.VersionedTable(spark, scratch.path("race")).read().columns == ["id", "c02", "c03"]


def test_pointers_are_put_once(spark, scratch):
    path = scratch.path("p/1.json")
    wins = []
    threads = [threading.Thread(target=lambda k=k: wins.append(put_if_absent(spark, path, f"{k}"))) for k in range(8)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert sorted(wins) == [False] * 7 + [True]
    sinks.write_version(spark.range(3), scratch.path("v"), 1)
    with pytest.raises(Exception):
        sinks.write_version(spark.range(4), scratch.path("v"), 1)
    spark.range(9).write.parquet(scratch.path("v/v000002"))  # whole, but no pointer yet
    assert sinks.read_current(spark, scratch.path("v")).count() == 3


# ---------------------------------------------------------------- folders


def states(found):
    return {r.path.rpartition("/")[2]: (r.state, r.copy_of and r.copy_of.rpartition("/")[2]) for r in found.collect()}


def test_only_what_changed_is_read(spark, scratch, tmp_path):
    nothing = spark.createDataFrame([], folders.REMEMBERED)
    for name, said in {"a.pdf": b"one", "b.pdf": b"two", "c d[1].pdf": b"one", "x.txt": b"other"}.items():
        (tmp_path / name).write_bytes(said)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e%20f.pdf").write_bytes(b"three")
    first = folders.import_folder(spark, str(tmp_path), nothing, glob="*.pdf")
    assert states(first) == {"a.pdf": ("new", None), "b.pdf": ("new", None), "c d[1].pdf": ("new", "a.pdf"), "e%20f.pdf": ("new", None)}
    seen = scratch.table(folders.remember(first), "seen")
    assert {(r.path.rpartition("/")[2], r.sha256) for r in seen.collect() if "e%" in r.path} == {("e%20f.pdf", hashlib.sha256(b"three").hexdigest())}

    # A file whose time and length are as they were keeps its remembered hash, so it was not opened.
    before = os.stat(tmp_path / "a.pdf")
    (tmp_path / "a.pdf").write_bytes(b"ONE")
    os.utime(tmp_path / "a.pdf", ns=(before.st_atime_ns, before.st_mtime_ns))
    (tmp_path / "b.pdf").write_bytes(b"three")
    (tmp_path / "c d[1].pdf").unlink()
    (tmp_path / "new.pdf").write_bytes(b"4")
    (tmp_path / "void.pdf").write_bytes(b"")  # no byte, no document
    second = folders.import_folder(spark, str(tmp_path), seen, glob="*.pdf")
    assert states(second) == {"a.pdf": ("same", None), "b.pdf": ("changed", None), "c d[1].pdf": ("gone", None), "new.pdf": ("new", None), "e%20f.pdf": ("same", "b.pdf")}
    assert {r.path.rpartition("/")[2]: r.sha256 for r in second.collect()}["a.pdf"] == hashlib.sha256(b"one").hexdigest()
    assert {r.title for r in folders.entries(second).collect()} == {"b", "new"}
    third = folders.import_folder(spark, str(tmp_path), scratch.table(folders.remember(second), "seen2"), glob="*.pdf")
    assert {s for s, _ in states(third).values()} == {"same"} and len(states(third)) == 4
    assert set(states(folders.import_folder(spark, str(tmp_path), nothing, glob="*.pdf", recursive=False))) == {"a.pdf", "b.pdf", "new.pdf"}


def test_empty_folder(spark, scratch, tmp_path):
    seen = spark.createDataFrame([(f"file:{tmp_path}/x.pdf", None, 3, "h")], folders.REMEMBERED)
    assert states(folders.import_folder(spark, str(tmp_path), seen, glob="*.pdf")) == {"x.pdf": ("gone", None)}


# ---------------------------------------------------------------- side inputs


def slow_receipt(obj):
    """The receipt rules, one record after another."""
    if not isinstance(obj, dict):
        return None
    if isinstance(obj.get("summary"), str):
        return obj["summary"][:200]
    thin = " [abstract-only]" if obj.get("evidence_basis") == "abstract_only" else ""
    if {"decision", "reason"} <= obj.keys():
        failed = f" ({obj['criterion_failed']})" if obj.get("criterion_failed") else ""
        return f"screen {obj['decision']}{failed}: {obj['reason'] or ''}"[:200]
    if "final_decision" in obj:
        return f"adjudicated {obj['final_decision']}: {obj.get('rationale') or ''}"[:200]
    if {"outcomes", "design"} <= obj.keys():
        outs = obj["outcomes"] or []
        one = f"; {outs[0].get('name') or '?'} {outs[0].get('direction') or ''}" if outs and isinstance(outs[0], dict) else ""
        return f"{obj['design'] or 'design?'}, n={obj.get('n_total')}, {len(outs)} outcome(s){one}{thin}"[:200]
    if "overall_judgement" in obj:
        grade = (obj.get("grade") or {}).get("certainty")
        return f"{obj.get('tool') or '?'} -> {obj['overall_judgement']}{f'; GRADE {grade}' if grade else ''}{thin}"[:200]
    if "checks" in obj:
        checks = obj["checks"] or []
        return f"verifier: {len(checks)} check(s), {sum(isinstance(c, dict) and c.get('status') == 'fail' for c in checks)} fail"
    return f"query {obj.get('query_id')}: {obj.get('count')} hits" if "query_string" in obj else None


RECORDS = [
    {"summary": "done"}, {"summary": "x" * 300}, {"summary": ""}, {"summary": None, "decision": "include", "reason": None}, {"summary": 7, "checks": []}, {"decision": "exclude", "reason": "r", "criterion_failed": "age"}, {"decision": None, "reason": "y" * 250},
    {"decision": "only"}, {"final_decision": None}, {"final_decision": "include", "rationale": "since"}, {"outcomes": [], "design": ""}, {"outcomes": None, "design": "rct", "n_total": 12}, {"outcomes": [{"name": "pain"}], "design": "rct", "n_total": 1.5},
    {"outcomes": ["text"], "design": "rct", "n_total": True, "evidence_basis": "abstract_only"}, {"outcomes": [{}], "design": None}, {"overall_judgement": "low"}, {"overall_judgement": None, "grade": None, "tool": "rob2", "evidence_basis": "abstract_only"},
    {"overall_judgement": "high", "grade": {"certainty": "low"}}, {"checks": None}, {"checks": [{"status": "fail"}, 3, {"status": "fail"}, {"x": 1}]}, {"query_string": "q"}, {"query_string": None, "query_id": "q1", "count": 0}, {"unknown": 1}, {},
]


def test_receipts_of_every_shape(spark):
    rows = [(k, json.dumps(x)) for k, x in enumerate(RECORDS)] + [(100, "[1]"), (101, "{torn"), (102, None), (103, "7")]
    df = spark.createDataFrame(rows, "k int, _r string")
    got = {r.k: r.line for r in df.select("k", side_inputs.record_receipt(F.col("_r")).alias("line")).collect()}
    assert got == {**{k: slow_receipt(x) for k, x in enumerate(RECORDS)}, 100: None, 101: None, 102: None, 103: None}


def test_receipt_of_a_log_record(spark):
    rows = [("completed", " s \n", "e", "p"), ("failed", "", "\n two\nthree", "p"), ("blocked", None, " ", "p"), ("completed", None, "e", "p"), ("completed", None, None, "q"), ("completed", None, None, "none"), ("active", None, None, ""), (None, None, None, None)]
    log = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, status string, summary string, error string, output_path string")
    results = spark.createDataFrame([("p", '{"final_decision": "include"}'), ("q", '{"x": 1}')], "output_path string, record string")
    got = [r.receipt for r in side_inputs.receipts(log, results).orderBy("k").collect()]
    assert got == ["s", "two", "(no diagnostic recorded)", "adjudicated include: ", "-> q", "-> none", "(no output_path)", "(no output_path)"]


def test_results_are_read_again_for_each_batch(spark, scratch):
    """The result of a task changes between two runs of the stream; the later batch shows it as it is then."""
    log, results = scratch.path("log"), scratch.path("results")
    for turn in ("first", "second"):
        spark.createDataFrame([(json.dumps({"output_path": "o", "record": {"summary": turn}}),)], "value string").write.mode("overwrite").text(results)
        spark.createDataFrame([(json.dumps({"task_id": turn, "seq": 1, "status": "completed", "output_path": "o"}),), ("not json",), ("[]",)], "value string").write.mode("append").text(log)
        out = side_inputs.receipts(side_inputs.read_task_stream(spark, log), side_inputs.read_results(spark, results)).select("task_id", "receipt")
        monitor.run_to_folder(out, scratch.root.rpartition("/")[2] + "-r", scratch.path("out")).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(scratch.path("out")).collect()} == {("first", "first"), ("second", "second")}


def test_missing_blocks_and_rungs(spark):
    texts = {"a": "## One\n- evidence_id: x\n- PMID: 1\n## Two\n- PMID: 2\n", "b": "## Only\r\n- PMID: 3", "c": "no block", "d": None, "e": "## \n- evidence_id:\n##not\n## Last"}
    got = {(r.path, r.block, r.title, r.evidence_id, r.pmid) for r in side_inputs.missing_blocks(spark.createDataFrame(list(texts.items()), "path string, text string")).collect()}
    assert got == {("a", 1, "One", "x", "1"), ("b", 1, "Only", None, "3"), ("e", 1, "", "", None), ("e", 2, "Last", None, None)}
    rungs = {"r/a.json": '{"rungs": {"3": {"status": "s", "detail": "d", "at": "t"}, "12": "no map", "x": {}}}', "r/b.json": '{"evidence_id": "e", "rungs": null}', "r/c.json": "[1]", "r/d.json": "{torn", "r/e.json": None}
    got = {tuple(r[c] if c != "attempted" else tuple(r[c]) for c in r.__fields__) for r in side_inputs.best_rungs(spark.createDataFrame(list(rungs.items()), "path string, text string")).collect()}
    assert got == {("a", 3, "s", "d", "t", (3, 12)), ("e", None, None, None, None, ())}


def test_engine_log(spark):
    lines = [("p", 1, "2024-01-02T03:04:05Z started  "), ("p", 2, "no time here"), ("p", 3, "  "), ("p", 4, "2024-01-02T03:04:05Z")]
    got = [(r.line_no, r.ts is not None, r.text) for r in side_inputs.engine_log(spark.createDataFrame(lines, "path string, line_no int, line string")).orderBy("line_no").collect()]
    assert got == [(1, True, "started"), (2, False, "no time here"), (4, True, "")]


def test_guarded_streams_have_their_own_checkpoints(spark, scratch):
    """A torn batch is not published, a later whole one is, and a second stream of another name starts from its own beginning."""
    published = {}
    for name in ("one", "two"):
        for turn, lines in enumerate((['{"evidence_id": "a"}'], ['{"evidence_id": "b"}', '{"evid'], ["{}"], ['{"evidence_id": "c"}', " "])):
            spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(scratch.path(f"in-{name}"))
            stream = spark.readStream.schema("value string").text(scratch.path(f"in-{name}"))
            monitor.guarded(stream, scratch.root.rpartition("/")[2] + name, monitor.whole_snapshot, lambda b, n, name=name: published.setdefault(name, []).append((n, b.filter("trim(value) <> ''").first().value))).awaitTermination()
    assert published == {name: [(0, '{"evidence_id": "a"}'), (3, '{"evidence_id": "c"}')] for name in ("one", "two")}
