"""Token ids as flat binary files: encode, write, memory-map, read back.

Files of one output folder, one set per range partition of the document key:

* ``part-00007.bin``  token ids, little-endian unsigned integers, no header;
* ``part-00007.idx``  n + 1 little-endian signed 64-bit offsets into that file, in tokens;
* ``part-00007.key``  n little-endian signed 64-bit document keys (a null key is -2**63).

The manifest, one row per partition, has the number of tokens of each; the place of a
document in the whole corpus is its offset plus the prefix sum of the partitions before it.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.files import commit

#: Words a worker remembers; at about 200 bytes each this bounds the memory of the cache.
CACHE_WORDS = 400_000
NULL_KEY = -(2**63)

_ENCODERS: dict[str, WordEncoder] = {}


#: Letters of the words that go to the model without the library's normalizer: their lower case
#: is one letter of the same range, and none combines with another one.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")
#: Fixed value: the pre-token pattern of the word-level files, for lower-case words of that range.
_PRE_TOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-zß-öø-ſ0-9]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder(dict):
    """Ids of words as little-endian bytes; a word is encoded when it is first asked for.

    It is for tokenizers whose pre-tokenizer never joins characters across a space and whose
    normalizer treats words alone, as the word-level BPE files do, so encoding word by word
    equals encoding whole texts. Words are split at spaces and line feeds only; any other
    white space stays inside a word for the library. Words of plain letters, digits and marks
    go straight to the library's BPE model, others through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.whole.model
        self.kind = "H" if self.whole.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.kind == "H" else "<u4")
        self.bytes_as = _byte_letters()
        spec = json.loads(Path(path).read_text())
        self.plain = (
            [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and "'s|'t|'re|'ve|'m|'ll|'d|" in json.dumps(spec["pre_tokenizer"])
        )
        self[""] = b""

    def _piece(self, pre: str) -> bytes:
        if not pre.isascii():
            pre = pre.encode().decode("latin-1").translate(self.bytes_as)
        return array(self.kind, [t.id for t in self.model.tokenize(pre)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
            self[""] = b""
        if not self.plain or not _PLAIN.fullmatch(word):
            ids = array(self.kind, self.whole.encode(word, add_special_tokens=False).ids).tobytes()
        else:
            low = word.lower()
            if low != word and low in self:
                ids = self[low]
            elif low.isalpha():
                ids = self._piece(low)
            else:
                ids = b"".join([self.get(pre) or self._piece(pre) for pre in _PRE_TOKENS.findall(low)])
        self[word] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        of = self.__getitem__
        return [b"".join(map(of, t.replace("\n", " ").split(" "))) if t else b"" for t in texts]


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _write_part(batches: Iterator[pa.RecordBatch], uri: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs as pafs
    from pyspark import TaskContext

    ctx = TaskContext.get()
    part, attempt = ctx.partitionId(), ctx.taskAttemptId()
    enc = encoder(tokenizer)
    end = np.array([end_id], dtype=enc.dtype).tobytes()
    fs, root = pafs.FileSystem.from_uri(uri)
    fs.create_dir(root, recursive=True)
    temp = f"{root}/.part-{part:05d}-{attempt}"
    offsets, keys, total = array("q", [0]), array("q"), 0
    with fs.open_output_stream(f"{temp}.bin") as out:
        for batch in batches:
            keys.extend(NULL_KEY if k is None else k for k in batch.column(0).to_pylist())
            column = batch.column(1)
            for at in range(0, len(column), 512):
                for ids in enc.encode(column.slice(at, 512).to_pylist()):
                    out.write(ids)
                    out.write(end)
                    total += len(ids) // enc.dtype.itemsize + 1
                    offsets.append(total)
    for data, suffix in ((offsets, "idx"), (keys, "key")):
        with fs.open_output_stream(f"{temp}.{suffix}") as out:
            out.write(data.tobytes())
    for suffix in ("bin", "idx", "key"):  # a repeated attempt writes the same bytes again
        commit(fs, f"{temp}.{suffix}", f"{root}/part-{part:05d}.{suffix}")
    yield pa.RecordBatch.from_pydict(
        {"part": [part], "n_docs": [len(keys)], "n_tokens": [total], "width": [enc.dtype.itemsize]},
        schema=pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]),
    )


def write_token_files(
    docs: DataFrame, uri: str, tokenizer: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the ids of all texts in ascending order of the key; returns the manifest.

    Texts move once, in a range exchange on the key; each partition streams its ids to its
    own file. Null texts count as empty; null keys come first; equal keys are ordered by
    text; an empty table gives an empty manifest. Other columns are ignored. A file gets its
    name only when it is whole, and a task that is run again writes the same bytes. The
    returned frame is lazy: write it once, since computing it writes the files.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("k").asc_nulls_first(), F.col("t").asc_nulls_first()]
    ranged = (
        docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
        .repartitionByRange(n, F.col("k").asc_nulls_first())
        .sortWithinPartitions(*order)
    )
    return ranged.mapInArrow(
        lambda it: _write_part(it, uri, tokenizer, end_id), "part int, n_docs long, n_tokens long, width int"
    )


def _open(fs, path: str, dtype: str) -> np.ndarray:  # noqa: ANN001
    """Memory-mapped where the file is on a local disk, read whole elsewhere."""
    from pyarrow import fs as pafs

    if fs.get_file_info(path).size == 0:
        return np.empty(0, dtype=dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def _read_parts(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs as pafs

    fs, root = pafs.FileSystem.from_uri(uri)
    for batch in batches:
        for row in batch.to_pylist():
            name = f"{root}/part-{row['part']:05d}"
            ids = _open(fs, f"{name}.bin", f"<u{row['width']}")
            offsets, keys = _open(fs, f"{name}.idx", "<i8"), _open(fs, f"{name}.key", "<i8")
            for at in range(0, len(keys), 4096):
                off = np.asarray(offsets[at : at + 4097])
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
                key = np.asarray(keys[at : at + 4096])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key, mask=key == NULL_KEY),
                        pa.array(off[:-1] + row["base"]),
                        pa.array(np.diff(off)),
                        pa.array(crc, type=pa.int64()),
                        pa.array(np.full(len(key), row["part"], dtype=np.int32)),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "part"],
                )


def read_token_files(spark: SparkSession, manifest: DataFrame, uri: str) -> DataFrame:
    """One row per document, read from the files: place in the corpus, length and checksum."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))  # a row per partition
    return placed.repartition(n, "part").mapInArrow(
        lambda it: _read_parts(it, uri), "doc_id long, start long, n_tokens long, ids_crc32 long, part int"
    )
