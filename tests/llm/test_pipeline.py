"""The pipeline, stage by stage, against brute force on the smallest tables."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import langid, mixing
from quillspark.llm.queries import public_tokenizer
from quillspark.session import Scratch
from tests.llm.test_duplicates import slow_fingerprint, union
from tests.llm.test_tokens_packing import check_packed

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, D).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def test_stages_keep_the_columns(stages):
    for name, df in stages.items():
        if name != "best_fit_packing":
            assert df.columns == stages["documents"].columns


def test_languages(stages):
    want = {r.doc_id for r in stages["documents"].collect() if r.text and any(c.isalpha() for c in r.text)}
    assert {r.doc_id for r in stages["language_id"].collect()} == want


def test_one_of_each_group_stays(stages):
    fp = {r.doc_id: slow_fingerprint(r.text) for r in stages["language_id"].collect()}
    comp = union([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2], fp)
    assert sorted(r.doc_id for r in stages["simhash_near_dedup"].collect()) == sorted({k for k in fp if comp[k] == k})


def test_secrets_are_masked_and_clean_texts_stay(stages):
    before = {r.doc_id: r.text for r in stages["simhash_near_dedup"].collect()}
    after = {r.doc_id: r for r in stages["secret_scan"].collect()}
    assert before.keys() == after.keys()
    looks = re.compile(r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_-]{24}")
    for k, r in after.items():
        assert r.n_chars == len(r.text)
        if not looks.search(before[k]):
            assert r.text == before[k]
        else:
            assert re.split(r"\[secret\]", r.text)[0] == before[k][: len(re.split(r"\[secret\]", r.text)[0])]


def test_mixing_takes_whole_documents(stages):
    before = {r.doc_id: r.text for r in stages["secret_scan"].collect()}
    took = Counter(r.doc_id for r in stages["source_mixing"].collect())
    assert max(took.values()) <= 2
    assert all(r.text == before[r.doc_id] for r in stages["source_mixing"].collect())
    words = {k: len(re.findall(r"[ \t\n\v\f\r]", t)) + 1 for k, t in before.items()}
    total = sum(words.values())
    assert 0.8 * total <= sum(words[k] * n for k, n in took.items()) <= 1.2 * total


def test_packing_holds_every_document(stages):
    rows = stages["best_fit_packing"].collect()
    check_packed(rows, 4096)
    took = Counter(r.doc_id for r in stages["source_mixing"].collect())
    assert Counter(r.doc_id for r in rows if r.piece == 0) == took


def test_run_equals_the_stages(spark, stages):
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, corpus_pipeline.run(spark, D).collect())) == Counter(map(key, stages["best_fit_packing"].collect()))


def test_the_prediction_decides_what_has_no_language(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    gone = docs.withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    before = {r.doc_id: r.lang for r in gone.collect()}
    model = langid.train(gone, langid.public_pieces(public_tokenizer("piece_bpe_32k.model")))
    said = {r.doc_id: r.lang_pred for r in langid.predict(gone, model).collect()}
    after = corpus_pipeline.language_id(spark, gone, D)
    got = {r.doc_id: r.lang for r in after.collect()}
    assert any(before[k] is None for k in got) and all(lang == (before[k] or said[k]) for k, lang in got.items())
    leaves = lambda df, name: {(r.domain, r.lang, r.source) for r in mixing.mix(df, Scratch(spark, name)).collect()}
    assert {x[1] for x in leaves(gone, "gone")} - {x[1] for x in leaves(after, "after")} == {""}
    assert corpus_pipeline.language_id(spark, gone.limit(0), D).count() == 0
