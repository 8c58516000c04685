import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import neighbours, repeats, simhash
from tests.llm.conftest import edge_rows


def union(pairs, items):
    parent = {k: k for k in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in items}


def slow_fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    own = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_of_edge_cases(edges, scratch):
    got = simhash.near_duplicates(edges, scratch).collect()
    fp = {(r[0], r[1]): slow_fingerprint(r[1]) for r in edge_rows()}
    by_id = {k: f for (k, _), f in fp.items() if k is not None}
    near = [(a, b) for a in by_id for b in by_id if a < b and (by_id[a] ^ by_id[b]).bit_count() <= 2]
    comp = union(near, by_id)
    assert len(got) == len(edge_rows())
    for r in got:
        if r.doc_id is not None:
            assert (r.fp % (1 << 64), r.component_id) == (by_id[r.doc_id], comp[r.doc_id])


@pytest.mark.parametrize("crowd", [1, 4, 48])
def test_simhash_links_equal_all_pairs(spark, scratch, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "PAIRWISE", crowd)
    random.seed(crowd)
    centres = [random.getrandbits(64) for _ in range(8)]
    fps = {c ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) ^ (random.getrandbits(1) << 63) for c in centres for _ in range(40)} | {random.getrandbits(64) for _ in range(50)}
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps))]
    links = simhash._links(spark.createDataFrame(rows, "rep long, fp long")).collect()
    unsigned = {i: f % (1 << 64) for i, f in rows}
    want = [(a, b) for a in unsigned for b in unsigned if a < b and (unsigned[a] ^ unsigned[b]).bit_count() <= 2]
    assert all((unsigned[r.a] ^ unsigned[r.b]).bit_count() <= 2 for r in links)
    assert union([(r.a, r.b) for r in links], unsigned) == union(want, unsigned)


def test_simhash_keeps_one(edges, scratch):
    kept = simhash.keep_one(edges, scratch)
    assert kept.columns == edges.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and ids.count(None) == 1 and ids.count(7) + ids.count(15) == 1


def test_simhash_of_nothing(nothing, scratch):
    assert simhash.near_duplicates(nothing, scratch).count() == 0


def slow_repeats(docs, size):
    seen, out = set(), []
    for key, text in docs:
        b = (text or "").encode()
        cut = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if b[i : i + size] in seen:
                cut[i : i + size] = b"\1" * size
            seen.add(b[i : i + size])
        kept = bytes(c for c, x in zip(b, cut, strict=True) if not x)
        out.append((key, len(b), sum(cut), len(re.findall(b"\1+", bytes(cut))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [1, 8000])
def test_repeats_of_edge_cases(edges, scratch, crowd):
    got = repeats.remove_repeats(edges, scratch, crowd=crowd).collect()
    rows = sorted(((r[0], r[1]) for r in edge_rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted(map(repr, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got))) == sorted(map(repr, slow_repeats(rows, 100)))


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_random_passages(spark, scratch, seed):
    random.seed(seed)
    words = ["".join(random.choice("abcdé") for _ in range(random.randint(1, 8))) for _ in range(400)]
    passages = [" ".join(random.choice(words) for _ in range(random.randint(10, 60))) for _ in range(12)]
    docs = []
    for k in range(150):
        parts = [random.choice(passages) if random.random() < 0.4 else " ".join(random.choice(words) for _ in range(random.randint(1, 40))) for _ in range(random.randint(1, 6))]
        docs.append((k, random.choice(["", " "]).join(parts)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = repeats.remove_repeats(df, scratch, with_text=True).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == slow_repeats(docs, 100)


def test_repeats_in_long_texts_across_slices(spark, scratch, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 5000)
    random.seed(9)
    long = "".join(random.choice("abcdefgh ") for _ in range(17_000))
    docs = [(1, long), (2, "start " + long[4000:9000] + " end"), (3, long[100:])]
    got = [r for r in repeats._long_contexts(long.encode(), 100)]
    starts = np.sort(np.concatenate([np.arange(a, a + s + 1) for a, s in zip(got[1], got[2], strict=True)]))
    assert (starts == np.arange(len(long) - 99)).all()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = repeats.remove_repeats(df, scratch).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == slow_repeats(docs, 100)


def test_repeats_of_nothing(nothing, scratch):
    assert repeats.remove_repeats(nothing, scratch).count() == 0


def test_maximal_repeats():
    got = {(length, tuple(sorted(zip(p.tolist(), s.tolist(), strict=True)))) for length, p, s in repeats.maximal_repeats([b"xabcdey", b"zabcdew", b"qabcdfv"], 3)}
    assert (5, ((0, 1), (1, 1))) in got and (4, ((0, 1), (1, 1), (2, 1))) in got
    assert not any(length == 3 for length, _ in got)  # bcd has one left neighbour only


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = [v for v in rng.normal(size=(300, 16))]
    x += [c + rng.normal(size=16) * 0.02 for c in rng.normal(size=(20, 16)) for _ in range(3)]
    hub = rng.normal(size=16)
    x += [hub + rng.normal(size=16) * 0.03 for _ in range(250)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, None), (1003, [0.0] * 16), (1004, [1.0, None] * 8), (1005, [float("nan")] * 16), (1006, [float("inf")] * 16), (1007, []), (1008, [1.0, 2.0]), (1009, [1.0, 2.0])]
    return rows


def test_vectors_equal_brute_force(spark, scratch, vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "KEEP", 40)
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("node", F.lit("x"))
    got = {r.vec_id: r for r in neighbours.near_duplicates(df, scratch).collect()}
    good = {k: np.array(v) for k, v in vectors if v and None not in v and np.isfinite(v).all() and any(v)}
    near = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.9]
    comp = union(near, [k for k, _ in vectors])
    links = dict.fromkeys(comp, 0)
    for a, b in near:
        links[a] += 1
        links[b] += 1
    assert all(got[k].n_links <= links[k] for k in links)
    assert sum(got[k].n_links for k in links) >= 0.99 * sum(links.values())
    assert sum(got[k].component_id != comp[k] for k in comp) <= 3
    assert all(got[k].n_links == 0 and got[k].kept for k in range(1002, 1008))
    assert got[1001].component_id == 0 and not got[1001].kept and got[1009].component_id == 1008


def test_crowded_groups_that_spread_are_counted_exactly(spark, scratch, monkeypatch):
    """An arc of vectors, each linked with those beside it, a tight group at one end, and a sphere around a centre."""
    monkeypatch.setattr(neighbours, "KEEP", 20)
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    rng = np.random.default_rng(11)
    arc = [np.array([np.cos(a), np.sin(a), 0.0, 0.0, 0.0, 0.0]) for a in np.radians(np.arange(0, 150, 0.7))]
    tight = [arc[0] + rng.normal(size=6) * 0.01 for _ in range(80)]
    ball = [np.array([0.0, 0.0, 0.0, 0.0, 0.0, 1.0]) + rng.normal(size=6) * 0.17 for _ in range(120)]
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate([*arc, *tight, *ball, *tight[:9]])]
    got = {r.vec_id: r for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5), scratch).collect()}
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= 0.9
    comp = union([(a, b) for a, b in zip(*np.nonzero(hit), strict=True) if a < b], range(len(rows)))
    assert {k: r.component_id for k, r in got.items()} == comp
    assert {k: r.n_links for k, r in got.items()} == dict(enumerate(hit.sum(axis=1) - 1))


def test_audit_sees_ordinary_nodes_beside_a_crowd(spark):
    rng = np.random.default_rng(5)
    crowd, pairs = [rng.normal(size=16)] * 120, [c for c in rng.normal(size=(40, 16)) for _ in range(2)]
    x = [(v + rng.normal(size=16) * 0.01).astype("<f4") for v in [*crowd, *pairs]]
    nodes = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in enumerate(x)], "node long, vec binary")
    inside = [(a, b, 0.99) for a in range(120) for b in range(120) if a != b]
    assert neighbours._audit(nodes, spark.createDataFrame(inside, neighbours.EDGES)) == 0.0
    beside = [(a, a ^ 1, 0.99) for a in range(120, 200)]
    assert neighbours._audit(nodes, spark.createDataFrame([*inside, *beside], neighbours.EDGES)) == 1.0
    assert abs(neighbours._audit(nodes, spark.createDataFrame([*inside, *beside[:40]], neighbours.EDGES)) - 0.5) < 1e-9


def test_vectors_of_nothing(spark, scratch):
    assert neighbours.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"), scratch).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_cosines_of_exactly_the_threshold_link(spark, scratch, kind):
    """Small whole vectors at a cosine of exactly 0.9, each pair in dimensions of its own, and some that are just below."""
    found = []
    for a in np.ndindex(4, 4, 4, 4):
        for b in np.ndindex(4, 4, 4, 10):
            dot, aa, bb = (int(np.dot(x, y)) for x, y in ((a, b), (a, a), (b, b)))
            if aa and 100 * dot * dot == 81 * aa * bb and a < b:
                found.append((a, b))
    random.seed(3)
    pairs = random.sample(found, 60)
    rows = []
    for k, (a, b) in enumerate(pairs):
        for side, v in enumerate((a, b)):
            x = [0.0] * (4 * len(pairs) + 4)
            x[4 * k : 4 * k + 4] = [float(c) for c in v]
            rows.append((2 * k + side, x))
    x = [0.0] * (4 * len(pairs))
    rows += [(1000, [*x, 1.0, 0.0, 0.0, 0.0]), (1001, [*x, 0.8999, 0.4361, 0.0, 0.0])]
    got = {r.vec_id: r for r in neighbours.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(4), scratch).collect()}
    for k in range(len(pairs)):
        assert [(got[2 * k + side].n_links, got[2 * k + side].component_id) for side in (0, 1)] == [(1, 2 * k)] * 2, pairs[k]
    assert got[1000].n_links == got[1001].n_links == 0


def test_cosines_do_not_depend_on_the_matrix():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, size=(300, 4)).astype(float)
    x = x[np.abs(x).max(axis=1) > 0]
    whole = neighbours._cosines(x, x) >= neighbours.THRESHOLD
    parts = np.block([[neighbours._cosines(x[a : a + 7], x[b : b + 11]) >= neighbours.THRESHOLD for b in range(0, len(x), 11)] for a in range(0, len(x), 7)])
    assert (whole == parts).all() and (whole == whole.T).all()
    exact = 100 * (x @ x.T) ** 2 >= 81 * np.outer((x * x).sum(axis=1), (x * x).sum(axis=1))
    assert (whole == exact).all()


def test_very_large_and_very_small_doubles(spark, scratch):
    rows = [(1, [1e39, 0.0]), (2, [1e39, 0.0]), (3, [1e-50, 1e-50]), (4, [2e-50, 2e-50]), (5, [1e300, 1e300]), (6, [1.0, -1.0]), (7, [5e-324, 0.0]), (8, [0.0, 0.0]), (9, [float("inf"), 0.0]), (10, [None, 1.0]), (11, None)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scratch).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 7: (2, 1), 3: (2, 3), 4: (2, 3), 5: (2, 3), 6: (0, 6), 8: (0, 8), 9: (0, 9), 10: (0, 10), 11: (0, 11)}


def test_an_audit_that_cannot_be_satisfied_ends(spark, scratch, monkeypatch, caplog):
    monkeypatch.setattr(neighbours, "_audit", lambda *a: 0.0)
    rows = [(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(60)]
    got = neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), scratch)
    assert got.count() == 60
    assert any("no new link" in r.message for r in caplog.records)
