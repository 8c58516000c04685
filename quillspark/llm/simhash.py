"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.columns import free_names
from quillspark.operators.graph import components
from quillspark.session import Scratch

#: Bits in which linked fingerprints may differ.
MAX_BITS = 2
#: Members of a block bucket that are compared pair by pair; larger buckets go by midpoints.
PAIRWISE = 48
_QUARTERS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text, as an unsigned integer.

    A-Z is lower-cased; words are runs without ASCII white space; repeats count. A text of
    fewer words than a shingle is one shingle; a text without words, or null, has 0.
    """
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(1)
        got = [fingerprint(t.as_py(), words, seed) for t in column]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.array(got, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"]
        )


def fingerprints(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42
) -> DataFrame:
    """``doc_id, fp`` of every row; no shuffle."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(
        lambda it: _fingerprints(it, words, seed), "doc_id long, fp long"
    )


def _links(classes: DataFrame) -> DataFrame:
    """Links between distinct fingerprints at most two bits apart, as pairs of ``rep``.

    A fingerprint is four blocks of 16 bits; two that differ in two bits agree in two whole
    blocks, so one of six keys of 32 bits brings them together. In a bucket of up to
    ``PAIRWISE`` members all pairs are verified. Members of a larger one are linked through
    midpoints instead: two fingerprints are within two bits exactly if some value is within
    one bit of both, so each emits itself and its 64 one-bit neighbours, and everything that
    meets at a value is linked to the least there. That is exact, and linear in the members.
    """
    quarter = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    keys = [F.lit(k << 32) + F.shiftleft(quarter[i], 16) + quarter[j] for k, (i, j) in enumerate(_QUARTERS)]
    blocks = classes.select("rep", "fp", F.explode(F.array(*keys)).alias("key"))
    sizes = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = blocks.join(sizes, "key")
    pairs = (
        met.filter(F.col("members") <= PAIRWISE)
        .groupBy("key")
        .agg(F.collect_list(F.struct("fp", "rep")).alias("m"))
        .select(
            F.explode(
                F.expr(
                    "flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), "
                    f"y -> bit_count(x.fp ^ y.fp) <= {MAX_BITS}), y -> struct(x.rep as a, y.rep as b))))"
                )
            ).alias("p")
        )
        .select("p.a", "p.b")
    )
    crowded = met.filter(F.col("members") > PAIRWISE).select("rep", "fp").distinct()
    around = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b)) for b in range(64)]
    mids = crowded.select("rep", F.explode(F.array(*around)).alias("mid"))
    least = mids.groupBy("mid").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    hubs = mids.join(least, "mid").filter("rep <> b").select(F.col("rep").alias("a"), "b")
    return pairs.unionByName(hubs).distinct()


def near_duplicates(
    docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42
) -> DataFrame:
    """Fingerprint and component of every row: ``doc_id, fp, component_id``.

    Equal fingerprints form a class first, so exact copies cost one row. A null text counts
    as empty; empty texts share fingerprint 0, which is linked like any other. A row with a
    null key gets the component of its fingerprint's class, null where no key is in it. Rows
    that repeat are returned as often. An empty table gives no rows.
    """
    marked = scratch.table(fingerprints(docs, id_col=id_col, text_col=text_col, words=words, seed=seed), "fingerprints")
    classes = scratch.table(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    linked = components(_links(classes.filter("rep is not null")), scratch)
    labels = classes.join(linked, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each component the one with the least key.

    Rows with a null key can't be told apart and stay; of equal rows of one key and text one stays, and
    different texts of one key all do. An empty table gives no rows; columns of any name are kept as they are.
    """
    own, row = free_names(docs, 2)
    found = near_duplicates(docs, scratch, id_col=id_col, text_col=text_col)
    keep = found.filter("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    one = Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(F.lit(0))
    kept = docs.join(keep, F.col(id_col) == F.col(own), "left_semi").withColumn(row, F.row_number().over(one)).filter(F.col(row) == 1)
    return kept.select(*docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))
