import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, a string, cells string, score string"


def slow(rows, every=50):
    held = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = (label, [math.floor(256 * x) for x in v])
        if sum(x * x for x in q[1]) < 9e18:
            held[i] = min(held.get(i, q), q)
    out = []
    for a, (la, va) in held.items():
        if a % every:
            continue
        score = {b: sum(x * y for x, y in zip(va, vb)) for b, (_, vb) in held.items() if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if held[b][0] == la][:5]:
            ok = [b for b in order if held[b][0] != la and 50 * score[p] <= 100 * score[b] <= 95 * score[p]]
            out += [(a, p, k + 1, b, score[p], score[b]) for k, b in enumerate(ok[:3])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "c", "s") for r in rows], SCHEMA).repartition(4)


def run(df, scratch, **kw):
    return sorted(tuple(r) for r in negatives.mine(df, scratch, **kw).collect())


@pytest.mark.parametrize(("anchor_block", "row_block", "chunk"), [(128, 1024, 32), (3, 7, 4), (2, 5, 1)])
def test_equals_brute_force(spark, scratch, anchor_block, row_block, chunk):
    rng = np.random.default_rng(chunk)
    centres = rng.normal(size=(4, 11))
    rows = [(i, [float(x) for x in 0.5 + centres[i // 2 % 4] + rng.normal(size=11)], i // 2 % 4 if i % 3 else i % 5) for i in range(0, 900, 2)]
    rows += [(i, None, 1) for i in (1, 3)] + [(5, [float("nan")] * 11, 1), (7, [float("inf")] * 11, 1), (9, [None] * 11, 1), (11, [0.0] * 11, None), (None, [1.0] * 11, 1), (13, [], 2)]
    got = run(frame(spark, rows), scratch, anchor_block=anchor_block, row_block=row_block, chunk=chunk)
    assert got == slow(rows) and len(got) > 40


def test_ties_copies_and_a_hot_label(spark, scratch):
    random.seed(4)
    rows = [(i, [1.0, 0.5, float(i % 3)], 1) for i in range(300)] + [(1000 + i, [0.75, 0.5, float(i % 2)], 2 + i % 2) for i in range(60)]
    rows += [(150, [9.0, 9.0, 9.0], 3), (150, [1.0, 0.5, 0.0], 1), (2000, [1.0], 1), (2050, [-1.0, -0.5, 0.0], 5), (2101, [-1.0, -0.5, 0.25], 5), (2150, [3.0, 1.0, 1.0], 9)]
    assert run(frame(spark, rows), scratch, anchor_block=4, row_block=16, chunk=2) == slow(rows)


def test_large_values_are_exact(spark, scratch):
    """Products beyond 2**53 are summed in whole numbers; rows whose scores could leave 64 bits take no part."""
    rows = [(50 * i, [2.0**22 + i / 256, 1.0 + i], i % 2) for i in range(12)] + [(7, [1e300, 0.0], 0), (9, [2.0**24, 0.0], 1)]
    got = run(frame(spark, rows), scratch, low=1, high=200)
    assert got and all(p > 2**53 for *_, p, _ in got)
    held = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows}
    assert all(p == sum(x * y for x, y in zip(held[a], held[b])) for a, b, _, _, p, _ in got)
    assert not {7, 9} & {x for r in got for x in (r[1], r[3])}


def test_nothing_and_one(spark, scratch):
    assert run(frame(spark, []), scratch) == []
    assert run(frame(spark, [(50, [1.0, 2.0], 1)]), scratch) == []
    assert run(frame(spark, [(50, [1.0, 2.0], 1), (51, [1.0, 2.0], 2)]), scratch) == []


def test_anchor_rule(spark, scratch):
    rows = [(i, [1.0, i / 10], i % 3) for i in range(30)]
    assert run(frame(spark, rows), scratch, is_anchor=F.col("id") % 4 == 0) == slow(rows, every=4)
