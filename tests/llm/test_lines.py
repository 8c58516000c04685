import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import lines
from tests.llm.conftest import edge_rows

WS = " \t\n\u000b\u000c\r"
LONG = "all rights reserved by the publisher"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))


def slow(rows, length=20, least=3):
    """Rows (doc_id, text), each a document; None is less than every id."""
    held = defaultdict(list)
    for n, (doc, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= length:
                held[k].append(n)
    owner = {k: max((rows[n][0] for n in v if rows[n][0] is not None), default=None) for k, v in held.items() if len(v) >= least}
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        stay = [x for x in own if key(x) not in owner or owner[key(x)] == doc]
        out.append((doc, len(own), len(own) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(df, scratch, **kw):
    got = lines.drop_shared_lines(df, scratch, **kw).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))
    return sorted((tuple(r) for r in got.collect()), key=repr)


def shared_rows():
    rows = [(n, f"title of document {n}\n  {LONG.upper()} \t\nsome words of its own {n}\n") for n in range(40)]
    rows += [(100 + n, "\n".join([f"line number {k % 7} that comes again"] * 3 + ["short", LONG, LONG])) for k, n in enumerate(range(9))]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, LONG + "\n"), (None, LONG), (None, "no id but a line like others"), (300, "no id but a line like others"), (301, "No id but a line like others ")]
    rows += [(400, "Größe und Länge der Straße\nx"), (401, "größe und länge der straße"), (402, "Größe und Länge der Straße"), (403, " Größe und Länge der Straße"), (404, f"{LONG}\n" * 3000), (404, f"{LONG}\n" * 3000)]
    return rows


@pytest.mark.parametrize("batches", [1, 3, 9])
def test_equals_brute_force(spark, scratch, batches):
    rows = shared_rows()
    df = spark.createDataFrame([(d, t, "x", "y", 0, 1) for d, t in rows], "doc_id long, text string, h1 string, gone string, pos int, batch int").repartition(5)
    assert run(df, scratch, batches=batches) == slow(rows)


def test_no_switch_at_hot_keys(spark, scratch, monkeypatch):
    rows = shared_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (1, 10**9):
        monkeypatch.setattr(lines, "HOT", hot)
        assert run(df, scratch, batches=2, least=2) == slow(rows, least=2)


def test_edges(edges, scratch):
    assert run(edges, scratch) == slow([r[:2] for r in edge_rows()])


def test_nothing(nothing, scratch):
    assert run(nothing, scratch) == []


def test_levels_compact(spark, scratch):
    """Twenty batches in any order: runs are few, every key is counted, settled keys leave later batches."""
    runs = lines.LineRuns(spark, scratch, least=3, fanout=2)
    for n in (3, 19, 0, 7, *[k for k in range(20) if k not in (3, 19, 0, 7)]):
        docs = spark.createDataFrame([(n, f"{LONG}\nonly in batch number {n} of all")], "doc_id long, text string")
        runs.add(lines.keyed_lines(docs))
        assert all(len(level) < 2 for level in runs.levels)
    assert len(runs.runs()) <= 5
    assert [(r.docs >= 3, r.owner) for r in runs.settled().collect()] == [(True, 19)]
    assert sum(spark.table(name).filter("docs = 1").count() for name in runs.runs()) >= 20
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quillspark_lines")]


def test_settled_keys_are_not_written_again(spark, scratch):
    runs = lines.LineRuns(spark, scratch)
    runs.add(lines.keyed_lines(spark.createDataFrame([(k, LONG) for k in (7, 8, 9)], "doc_id long, text string")))
    runs.add(lines.keyed_lines(spark.createDataFrame([(k, LONG) for k in (1, 2)], "doc_id long, text string")))
    assert [spark.table(name).count() for name in runs.runs()] == [1, 0]
    runs.add(lines.keyed_lines(spark.createDataFrame([(10, LONG)], "doc_id long, text string")))  # a larger id must be known
    assert [r.owner for r in runs.settled().collect()] == [10]
    runs.close()
