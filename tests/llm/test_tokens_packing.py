import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm import packing, tokens
from tests.llm.conftest import edge_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_encoder_equals_library(library):
    random.seed(5)
    letters = "abzZ'sdtrelvm.,!0 19\n\t\x1c\x85\xa0éÉßſİÅ×÷²ŉΣσ́½😀ÿŸ<|startoftext|>"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(5000)] + ["<|startoftext|> a", "it's IT'S they'll '' 'S x'd"]
    enc = tokens.encoder(PATH)
    assert enc.plain
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)] == want


def test_cache_is_bounded(monkeypatch, library):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    enc = tokens.WordEncoder(PATH)
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa alpha"
    assert np.frombuffer(enc.encode([text])[0], enc.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(enc) <= 7


def test_files_round_trip(spark, edges, scratch, library):
    uri = scratch.path("files")
    manifest = scratch.table(tokens.write_token_files(edges, uri, PATH, 2), "manifest")
    got = tokens.read_token_files(spark, manifest, uri).collect()
    rows = sorted(edge_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for r in rows:
        ids = np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda x: x[1]) == want


def test_files_of_nothing(spark, nothing, scratch):
    uri = scratch.path("files")
    manifest = scratch.table(tokens.write_token_files(nothing, uri, PATH, 2), "manifest")
    assert tokens.read_token_files(spark, manifest, uri).count() == 0


def check_packed(rows, size):
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(seqs)


@pytest.mark.parametrize("size", [64, 4096])
def test_packing(edges, scratch, library, size):
    rows = packing.pack(edges, PATH, scratch, end_id=1, size=size).collect()
    n = check_packed(rows, size)
    want = Counter()
    for r in edge_rows():
        ids = np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        for k, s in enumerate(range(0, len(ids), size)):
            want[r[0], k, s, len(ids[s : s + size]), zlib.crc32(ids[s : s + size].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert n <= 1.1 * -(-sum(r.length for r in rows) // size) + 1


def test_packing_of_nothing(nothing, scratch):
    assert packing.pack(nothing, PATH, scratch).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_sweeps_equal_best_fit_decreasing(seed):
    random.seed(seed)
    sizes = [min(100, 1 + int(random.expovariate(1 / random.choice([5, 30, 60])))) for _ in range(2000)]
    runs = packing.sweeps(sorted(Counter(sizes).items()), 100)
    assert sum(r[2] for r in runs) == len(sizes)
    gaps: list[int] = []
    for s in sorted(sizes, reverse=True):  # best-fit decreasing, one by one
        best = min((g for g in gaps if g >= s), default=None)
        if best is not None:
            gaps.remove(best)
        gaps.append((best or 100) - s)
    assert max(r[4] + r[5] for r in runs) <= len(gaps)


def test_sweeps_do_not_grow_with_documents():
    few, many = {k: 3 for k in range(1, 101)}, {k: 3_000_000 for k in range(1, 101)}
    assert len(packing.sweeps(sorted(many.items()), 100)) <= 3 * len(packing.sweeps(sorted(few.items()), 100)) + 100


def slow_match(pieces, gaps):
    """Best fit with each gap used once, one piece after another from the longest: item to gap size."""
    free, out = sorted(gaps), {}
    for item, length in sorted(pieces.items(), key=lambda x: -x[1]):
        best = next((g for g in free if g >= length), None)
        out[item] = best
        if best is not None:
            free.remove(best)
    return out


@pytest.mark.parametrize("ranges", ["1", "3", "8"])
def test_sweeps_over_runs_equal_best_fit(spark, ranges):
    random.seed(int(ranges))
    pieces = {k: random.choice([30, 30, 30, random.randint(11, 40)]) for k in range(400)}
    gaps = {1000 + k: random.choice([30, 35, random.randint(1, 60)]) for k in range(350)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = packing.match(
            spark.createDataFrame(list(pieces.items()), "item long, length long").repartition(4), spark.createDataFrame(list(gaps.items()), "seq long, gap long"), 60, 11
        ).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 400 and all(r.seq is None or gaps[r.seq] == r.gap >= r.length for r in got)
    assert len({r.seq for r in got if r.seq is not None}) == sum(r.seq is not None for r in got)
    want = slow_match(pieces, gaps.values())
    assert Counter((r.length, r.gap) for r in got) == Counter((pieces[k], g) for k, g in want.items())


@pytest.mark.parametrize("ranges", ["1", "5"])
@pytest.mark.parametrize("mean", [3, 40, 400])
def test_rounds_open_as_few_sequences_as_best_fit_decreasing(spark, scratch, ranges, mean):
    random.seed(mean)
    sizes = {k: min(512, 1 + int(random.expovariate(1 / mean))) for k in range(1500)}
    sizes |= {k: 100 for k in range(1500, 2200)}  # a third has one length
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        rows = packing.place(spark.createDataFrame(list(sizes.items()), "item long, length long").repartition(6), 512, scratch).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.item: r.length for r in rows} == sizes and len(rows) == len(sizes)
    full = Counter()
    for r in rows:
        full[r.seq] += r.length
    assert max(full.values()) <= 512
    best = max(r[4] + r[5] for r in packing.sweeps(sorted(Counter(sizes.values()).items()), 512))
    assert len(full) <= best * 1.01 + 1
