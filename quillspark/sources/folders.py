"""Import of a folder of files: what changed since the last time is read, and nothing else."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is remembered of a folder.
REMEMBERED = "path string, modified timestamp, length long, sha256 string"
#: Files that one scan reads.
BLOCK = 10_000


def listing(spark: SparkSession, folder: str, *, glob: str = "*", recursive: bool = True) -> DataFrame:
    """``path, modified, length`` of the files of a folder. No content is read: the source opens a file for that column only.
    Files without a byte are no documents, and the source leaves them out."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).select("path", F.col("modificationTime").alias("modified"), "length")


def gate(now: DataFrame, remembered: DataFrame) -> DataFrame:
    """All paths, listed or remembered, with their state: ``new``, ``changed``, ``same`` or ``gone``. A file is the same
    if its time and its length are; both tables have a path once."""
    was = remembered.select("path", F.col("modified").alias("_modified"), F.col("length").alias("_length"), "sha256")
    met = now.join(was, "path", "full")
    same = F.col("modified").eqNullSafe(F.col("_modified")) & F.col("length").eqNullSafe(F.col("_length"))
    state = F.when(F.col("length").isNull(), "gone").when(F.col("_length").isNull(), "new").when(same, "same").otherwise("changed")
    return met.select("path", F.coalesce("modified", "_modified").alias("modified"), F.coalesce("length", "_length").alias("length"), "sha256", state.alias("state"))


def digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, sha256`` of some files; only these are opened."""
    if not paths:
        return spark.createDataFrame([], "path string, sha256 string")
    # A path given to the reader is a pattern, so what would be a sign of one is escaped.
    plain = ["".join("\\" + c if c in "*?[]{}\\" else c for c in p) for p in paths]
    parts = [spark.read.format("binaryFile").load(plain[k : k + BLOCK]) for k in range(0, len(plain), BLOCK)]
    return functools.reduce(DataFrame.unionByName, [p.select("path", F.sha2("content", 256).alias("sha256")) for p in parts])


def import_folder(spark: SparkSession, folder: str, remembered: DataFrame, *, glob: str = "*", recursive: bool = True) -> DataFrame:
    """The folder against what is remembered of it: ``path, modified, length, sha256, state, copy_of``.

    Time and length of every file come with the listing; only new and changed files are opened and hashed, others
    keep the remembered hash. ``copy_of`` is the least path with the same bytes, null for that path itself, so
    equal files become one asset. A file that is gone has the state ``gone``, its remembered hash, and is no asset. Empty
    folders give no rows but those that are gone. What is to be remembered next is ``remember`` of the result.

    Spark lists a folder on the driver, so the paths of changed files that go through it here are no more than it holds already.
    """
    states = gate(listing(spark, folder, glob=glob, recursive=recursive), remembered).cache()
    try:
        paths = [r.path for r in states.filter(F.col("state").isin("new", "changed")).select("path").collect()]
    finally:
        states.unpersist()
    fresh = digests(spark, paths).withColumnRenamed("sha256", "_fresh")
    known = states.join(fresh, "path", "left").withColumn("sha256", F.coalesce("_fresh", "sha256")).drop("_fresh")
    first = known.filter("state <> 'gone'").groupBy("sha256").agg(F.min("path").alias("_first"))
    met = known.join(first, "sha256", "left")
    copy = F.when((F.col("state") != "gone") & (F.col("path") != F.col("_first")), F.col("_first"))
    return met.select("path", "modified", "length", "sha256", "state", copy.alias("copy_of"))


def remember(found: DataFrame) -> DataFrame:
    """What an import leaves to be remembered."""
    return found.filter("state <> 'gone'").select("path", "modified", "length", "sha256")


def entries(found: DataFrame) -> DataFrame:
    """New and changed files as incoming library entries (``entities.add_files``): the title is the file's name, ids are unknown yet."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*\z", "")
    none = F.lit(None).cast("string")
    return found.filter(F.col("state").isin("new", "changed")).select(
        "sha256", F.xxhash64("path").alias("position"), name.alias("title"), none.alias("pmid"), none.alias("doi"), none.alias("pmcid"), F.lit(False).alias("is_preprint")
    )
