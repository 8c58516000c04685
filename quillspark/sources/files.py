"""Rows as files of a shared folder."""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fenced(path: str) -> str:
    """A relative path below the folder; anything that would leave it is an error."""
    flat = posixpath.normpath(path)
    if not path or path.startswith("/") or flat in (".", "..") or flat.startswith("../"):
        raise ValueError(f"not below the folder: {path!r}")
    return flat


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write each row (path, content) as a file below ``root``; returns ``path, length, sha256`` as the files are written.

    A file gets its name when it is whole, by a rename over what was there, so a lost or doubled task leaves whole files only. Paths that
    leave the folder are refused. Of rows with one path any may win; null contents are empty files.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{base}/{_fenced(path)}"
                folder, _, name = target.rpartition("/")
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                temp = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(temp) as f:
                    f.write(content or b"")
                fs.move(temp, target)
                out.append((path, len(content or b""), hashlib.sha256(content or b"").hexdigest()))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["path", "length", "sha256"])

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(step, "path string, length long, sha256 string")
