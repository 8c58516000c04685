"""Lines, sections and findings of reports against plain loops over random reports; checks of summaries by hand-made rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import sections as S
from quillspark.session import Scratch

H = re.compile(r"^(#{1,6})\s+(.*?)\s*#*$")
NOTE = re.compile(r"^\[\^([^\]\s]+)\]:\s*(.*)$")
PIECES = [
    "# Question", "## Results ##", "### Hypotheses to test", "## References", "#### Appendix B", "###### Deep", "#nothing", "---", "", "", "```", "~~~ x", "<!-- one -->", "<!-- open", "closed --> rest", "closed -->",
    "| cell [^a] |", "Text [^a] and [^b]. It proves that.", "It is associated with [^c]: no.", "[^a]: first", "[^b]: retracted", "[^a]: second", "    goes on [^d]", "\tgoes on too", "RR 0.5 was seen", "retracted [^r]", "Presumably so.",
]


def slow(text):
    """Lines (kind, level), sections and uses by loops."""
    rows = text.split("\n")
    end = next((i for i in range(1, len(rows)) if rows[i].strip() == "---"), -1) if rows[0].strip() == "---" else -1
    kinds, heads, fenced, comment, fenced2, defs, uses = [], [], False, False, False, {}, []
    for i, raw in enumerate(rows):
        s = raw.strip()
        fence = s.startswith(("```", "~~~"))
        if i <= end:
            kind = "front"
        elif comment:
            kind, comment = "comment", "-->" not in s
        elif s.startswith("<!--"):
            kind, comment = "comment", "-->" not in s
        elif fence:
            kind, fenced = "code", not fenced
        elif fenced:
            kind = "code"
        else:
            kind = "table" if s.startswith("|") else "heading" if H.match(s) else "note" if NOTE.match(raw) else "prose" if s else "blank"
        kinds.append(kind)
        if fence:
            fenced2 = not fenced2
        elif not fenced2 and i > end and H.match(s):
            heads.append((i + 1, len(H.match(s)[1]), H.match(s)[2].strip()))
        if NOTE.match(raw):
            body, j = [NOTE.match(raw)[2]], i + 1
            while j < len(rows) and rows[j].startswith(("    ", "\t")) and rows[j].strip():
                body.append(rows[j].strip())
                j += 1
            defs.setdefault(NOTE.match(raw)[1], (i + 1, " ".join(body)))
        elif kind == "prose" or s.startswith("|") or H.match(s):
            a = b = i
            if not H.match(s):
                while a > 0 and rows[a - 1].strip() and not H.match(rows[a - 1].strip()):
                    a -= 1
                while b + 1 < len(rows) and rows[b + 1].strip() and not H.match(rows[b + 1].strip()):
                    b += 1
            uses += [(i + 1, m[1], " ".join(rows[a : b + 1])) for m in re.finditer(r"\[\^([^\]\s]+)\](?!:)", raw)]
    tree = []
    for n, (i, level, title) in enumerate(heads):
        close = next((j for j, lv, t in heads[n + 1 :] if lv <= level or re.search(S.TAIL, t)), len(rows) + 1)
        above = [j for j, lv, _ in heads[:n] if lv < level]
        tree.append((i, level, title, above[-1] if above else None, close, heads[n + 1][0] if n + 1 < len(heads) else len(rows) + 1))
    return kinds, tree, defs, uses


@pytest.fixture
def scratch(spark):
    s = Scratch(spark, "test-sections")
    yield s
    s.close()


@pytest.fixture(scope="module")
def reports():
    rng = random.Random(5)
    return {k: "\n".join((["---"] if k % 4 == 0 else []) + [rng.choice(PIECES) for _ in range(rng.randrange(0, 40))]) for k in range(150)}


def test_lines_sections_notes_and_uses_equal_loops(spark, reports):
    x = S.lines(spark.createDataFrame(list(reports.items()), "report_id int, text string")).cache()
    got = {k: {} for k in reports}
    for r in x.collect():
        got[r.report_id][r.line_no] = r.kind
    tree = {k: [] for k in reports}
    for r in S.sections(x).collect():
        tree[r.report_id].append((r.line_no, r.level, r.title, r.parent, r.end_line, r.own_end))
        assert r.n_seen >= r.n_own >= 0
    defs = {(r.report_id, r.key): (r.line_no, r.said) for r in S.definitions(x).collect()}
    uses = sorted((r.report_id, r.line_no, r.key, r.said) for r in S.references(x).collect())
    want = {k: slow(t) for k, t in reports.items()}
    for k in reports:
        assert [got[k][n + 1] for n in range(len(want[k][0]))] == want[k][0], reports[k]
        assert sorted(tree[k]) == want[k][1], reports[k]
    assert defs == {(k, key): v for k in reports for key, v in want[k][2].items()}
    assert uses == sorted((k, *u) for k in reports for u in want[k][3])


def test_empty_sections_and_bodies(spark):
    text = "# Question\n<!-- nothing\nhere -->\n## Results\n### Outcome\n\n# Methods\n<!-- a --> b\n# Gap"
    x = S.lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "report_id int, text string"))
    tree = {r.title: (r.n_seen, r.n_own) for r in S.sections(x).collect()}
    assert tree == {"Question": (2, 0), "Results": (1, 0), "Outcome": (0, 0), "Methods": (1, 1), "Gap": (0, 0)}
    rules = [("question", "question", True), ("outcome", "outcome", True), ("gap", "gap", False), ("certainty", "certainty", True), ("summary", "summary", False)]
    out = [(r.report_id, r.status, r.line_no, r.detail) for r in S.section_findings(x, S.sections(x), rules).filter("report_id = 1").collect()]
    assert [o[1:] for o in sorted(out, key=repr)] == [("fail", None, "no section: certainty"), ("warn", 5, "empty section: outcome"), ("warn", 9, "empty section: gap"), ("warn", None, "no section: summary")]
    assert S.section_findings(x, S.sections(x), rules).filter("report_id = 2 and detail = 'no title block'").count() == 1


def test_no_reports_no_findings(spark, scratch):
    none = spark.createDataFrame([], "report_id int, text string")
    notes = spark.createDataFrame([], "report_id int, key string, evidence_id string")
    records = spark.createDataFrame([], "evidence_id string, retraction_status string, is_preprint boolean, ft_status string, decision string")
    assert S.findings(none, notes, records, scratch).count() == 0
    one = S.findings(spark.createDataFrame([(None, None, "x")], "report_id int, text string, key string").drop("key"), notes, records, scratch)
    assert one.count() > 0


def test_wording_and_markers(spark, scratch):
    text = (
        "# Question\nIt clearly shows. Probably because. RR 0.5 [^a]\n\nHR 2 was seen\n# Hypotheses\nThe evidence shows it. We test it.\n# Other\nIt proves it.\n# References\nOR 3\n"
        "[^a]: x\n    abstract only\n[^b]: y"
    )
    reports = spark.createDataFrame([(1, text)], "report_id int, text string")
    notes = spark.createDataFrame([(1, "a", "e1"), (1, "b", None)], "report_id int, key string, evidence_id string")
    records = spark.createDataFrame([("e1", "corrected", True, "abstract_only", "include")], "evidence_id string, retraction_status string, is_preprint boolean, ft_status string, decision string")
    found = S.findings(reports, notes, records, scratch)
    got = sorted((r.check_id, r.status, r.line_no, r.detail) for r in found.filter("check_id <> 'C-SECTIONS'").collect())
    assert got == [
        ("C-ATTRIBUTION", "fail", 4, "effect estimate without a footnote"), ("C-CITE-RESOLVE", "fail", 13, "footnote resolves to nothing: [^b]"), ("C-CITE-RESOLVE", "warn", 13, "never referenced: [^b]"),
        ("C-FULLTEXT", "fail", 2, "e1 citation does not say that only the abstract was read"), ("C-HYPOTHESIS-WALL", "fail", 2, "unhedged assertion"), ("C-HYPOTHESIS-WALL", "fail", 6, "evidence-side verb form"),
        ("C-HYPOTHESIS-WALL", "warn", 2, "speculation outside the hypothesis section"), ("C-PREPRINT", "fail", 2, "e1 citation without a preprint tag"), ("C-PREPRINT", "fail", 11, "e1 footnote without a preprint tag"),
        ("C-RETRACTION", "fail", 2, "e1 citation without a marker: corrected"), ("C-RETRACTION", "fail", 11, "e1 footnote without a marker: corrected"),
    ]
    states = {r.check_id: (r.status, r.n, r.first_line) for r in S.report_status(reports, found).collect()}
    assert states["C-ATTRIBUTION"] == ("fail", 1, 4) and states["C-FULLTEXT"] == ("fail", 1, 2) and set(states) == set(S.CHECKS)


def test_summaries(spark):
    claim = "array<struct<text:string,evidence_id:string,span_refs:array<string>>>"
    schema = f"summary_id int, schema_version int, evidence_id string, purpose string, audience string, source_basis string, extraction_path string, appraisal_path string, appraisal_skipped_reason string, sections array<struct<name:string,claims:{claim}>>"
    good = [(p, [("fine", "e", ["extraction:spans:1", "appraisal:domains:0:spans:1"])]) for p in S.SUMMARY_PARTS]
    bad = [*good[1:], ("bottom_line", [("Pooled here", "x", ["extraction:spans:2", "extraction:outcomes:0:spans:3", "nonsense", None, f"appraisal:spans:{10**30}"])]), ("provenance", None), (None, [("i2", None, None)])]
    rows = [(1, 1, "e", "clinical", "student", "fulltext", "x", "a", None, good), (2, 2, "f", "clinical", None, "abstract_only", "x", None, "why", bad), (3, 1, "e", "clinical", "general", "fulltext", "none", "gone", "abstract_only", None)]
    record = "path string, evidence_id string, spans array<int>, outcomes array<int>, domains array<int>"
    out = S.summary_findings(spark.createDataFrame(rows, schema), spark.createDataFrame([("x", "e", [0, 0], [3], None)], record), spark.createDataFrame([("a", "e", None, None, [2])], record))
    got = [(r.summary_id, r.check_id, r.part, r.detail) for r in out.filter("detail <> 'section missing' and check_id <> 'C-SPS-SINGLE-PAPER'").collect()]
    assert sorted(got, key=repr) == sorted(
        [
            (2, "C-SPS-SCHEMA", None, "schema_version must be 1"), (2, "C-SPS-SCHEMA", None, "audience not allowed"), (2, "C-SPS-SCHEMA", None, "neither an appraisal nor a reason for none"),
            (2, "C-SPS-EXTRACTION-LINK", None, "extraction of another paper"), (2, "C-SPS-APPRAISAL", None, "no appraisal and no reason for none"), (2, "C-SPS-ABSTRACT-LABEL", "study_design_and_basis", "basis not labelled"),
            (2, "C-SPS-NO-CROSS-STUDY", "bottom_line", "pooled"), (2, "C-SPS-NO-CROSS-STUDY", None, "i2"),
            (2, "C-SPS-SPAN-REFS", "bottom_line", "extraction:spans:2: out of range"), (2, "C-SPS-SPAN-REFS", "bottom_line", "extraction:outcomes:0:spans:3: inner span out of range"), (2, "C-SPS-SPAN-REFS", "bottom_line", "nonsense: malformed"),
            (2, "C-SPS-SPAN-REFS", "bottom_line", "null: malformed"), (2, "C-SPS-SPAN-REFS", "bottom_line", f"appraisal:spans:{10**30}: no record"),
            *[(2, "C-SPS-SPAN-REFS", p, "appraisal:domains:0:spans:1: no record") for p in S.SUMMARY_PARTS[1:]],
            (3, "C-SPS-SCHEMA", None, "an appraisal and a reason for none"), (3, "C-SPS-EXTRACTION-LINK", None, "extraction_path leads nowhere"), (3, "C-SPS-APPRAISAL", None, "no appraisal and no reason for none"),
        ],
        key=repr,
    )
    assert out.filter("summary_id = 3 and detail = 'section missing'").count() == len(S.SUMMARY_PARTS)
    assert out.filter("check_id = 'C-SPS-SINGLE-PAPER' and detail = 'claim of x'").count() == 1
    assert out.filter(F.col("summary_id") == 1).count() == 0
