"""Session helpers: shared scratch space, shipping the package to workers, table access."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_OWN_ROOT: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset on a local master, as in
    tests, a temporary folder of this process is used instead; a cluster without the setting is an
    error, since executors would write to disks of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOT:
        _OWN_ROOT[app] = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    return _OWN_ROOT[app]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, by the file system that Spark resolves for the path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a path with the file system that Spark resolves for it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, unless there is one already; False if there is.

    The file is written beside its place and then linked (on a local disk) or renamed without overwriting, which the
    name node decides for one writer; stores without such a rename need a log that has one.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    temp = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(temp, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if fs.getScheme() == "file":
            os.link(temp.toUri().getPath(), target.toUri().getPath())
        else:
            kinds = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
            kinds[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(temp, target, kinds)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError:
        if fs.exists(target):
            return False
        raise
    finally:
        fs.delete(temp, False)


class Scratch:
    """Tables written to the shared folder, to cut lineage without depending on any executor.

    ``table`` writes Parquet and reads it back; ``drop`` removes a table that nothing
    needs any more. What is left is removed when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/quillspark-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def path(self, label: str) -> str:
        return f"{self.root}/{label}"

    def table(self, df: DataFrame, label: str, *partition_by: str) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(label))
        return self.spark.read.schema(df.schema).parquet(self.path(label))

    def drop(self, label: str) -> None:
        delete_path(self.spark, self.path(label))

    def close(self) -> None:
        try:
            delete_path(self.spark, self.root)
        except Exception:  # the JVM may have ended before Python; nothing is left to do then
            return


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_quillspark_shipped", False):
        return
    here = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="quillspark-zip-"), "quillspark_pkg.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(p.relative_to(here.parent)))
    sc.addPyFile(out)
    sc._quillspark_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
