"""Dropping lines that many documents share, by levelled sorted runs of line hashes; DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import Scratch

#: Code points of a key, and documents with it, from which its lines go.
LENGTH, LEAST = 20, 3
#: Runs of a level that are compacted into one of the next.
FANOUT = 4
#: Batches that a whole table is taken in, of about as many documents each.
BATCHES = 8
#: A key that at least one of so many counted (document, key) rows has is hot; there are at most so many hot keys.
HOT = 1000
_SPACE = " \t\n\u000b\u000c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "h1 long, h2 long, docs long, owner long"


class LineRuns:
    """Which line keys are known, in how many documents, and the largest id among them.

    A run is a table of ``h1, h2, docs, owner``, a row for each 128-bit key, bucketed and sorted by the key, so a
    batch is merge-anti-joined with the runs bucket by bucket and only the batch is shuffled. ``add`` takes the keys of a
    batch, leaves out those that a run settles (enough documents, and an owner that the batch cannot exceed),
    and writes the others as a run of level 0. Where a level has ``fanout`` runs they are compacted into one of
    the next level, so a key is rewritten at most once a level, and levels grow with the logarithm of the batches.
    Batches may come in any order, but each document in one batch only.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch, *, least: int = LEAST, fanout: int = FANOUT) -> None:
        self.spark, self.scratch, self.least, self.fanout = spark, scratch, least, fanout
        self.levels: list[list[str]] = []
        self._own, self._made = uuid.uuid4().hex[:12], 0

    def _write(self, keys: DataFrame, level: int) -> None:
        name = f"quillspark_lines_{self._own}_{self._made}"
        self._made += 1
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        writer = keys.repartition(n, "h1", "h2").write.bucketBy(n, "h1", "h2").sortBy("h1", "h2")
        writer.option("path", self.scratch.path(name)).option("compression", "zstd").format("parquet").mode("overwrite").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _merged(self, names: list[str]) -> DataFrame:
        """Keys of some runs, each once.

        The runs are read by path: a union of bucketed tables would be taken as dealt by key already (seen in 4.1.2,
        ``spark.sql.unionOutputPartitioning``), and a key of two runs would stay two rows.
        """
        runs = self.spark.read.schema(RUN).parquet(*[self.scratch.path(name) for name in names])
        return runs.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("owner").alias("owner"))

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Lines of a batch, as ``keyed_lines`` gives them."""
        own = lines.groupBy("h1", "h2").agg(F.sum(F.col("first").cast("long")).alias("docs"), F.max("doc_id").alias("owner"))
        for name in self.runs():
            run = self.spark.table(name).filter(F.col("docs") >= self.least).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("owner").alias("_owner"))
            same = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
            own = own.join(run, same & (F.col("owner").isNull() | (F.col("_owner") >= F.col("owner"))), "left_anti")
        self._write(own, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            full = self.levels[level]
            self._write(self._merged(full), level + 1)
            self.levels[level] = []
            for name in full:
                self._forget(name)
            level += 1

    def settled(self) -> DataFrame:
        """``h1, h2, docs, owner`` of the keys in enough documents. Counts of keys that were settled early stop there."""
        names = self.runs()
        if not names:
            return self.spark.createDataFrame([], RUN)
        return self._merged(names).filter(F.col("docs") >= self.least)

    def _forget(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        self.scratch.drop(name)

    def close(self) -> None:
        for name in self.runs():
            self._forget(name)
        self.levels = []


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keyed_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, th, pos, h1, h2, first`` of all lines whose key is long enough; ``th`` is the text's hash, ``first``
    tells whether the row is the only one of its key in its document that counts."""
    keys = F.transform(_split(F.translate(F.col(text_col), _UPPER, _LOWER)), lambda x: F.btrim(x, F.lit(_SPACE)))
    hashed = F.transform(
        keys,
        lambda x, i: F.when(F.char_length(x) >= length, F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), i.alias("pos"))),
    )
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.sort_array(F.array_compact(hashed)).alias("own"))

    # Each entry looks at the one before it, so the sorted array stays a column of its own.
    def flagged(x: Column, i: Column) -> Column:
        before = F.get(F.col("own"), i - 1)
        again = (i > 0) & (before["h1"] == x["h1"]) & (before["h2"] == x["h2"])
        return F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"), (~again).alias("first"))

    return rows.select("doc_id", "th", F.explode(F.transform("own", flagged)).alias("x")).select("doc_id", "th", "x.pos", "x.h1", "x.h2", "x.first")


def _batch(docs: DataFrame, id_col: str, batches: int) -> Column:
    """Number of the batch of an id: ranges of about as many documents each, the largest ids first, nulls last."""
    parts = [k / batches for k in range(1, batches)]
    bounds = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), F.array(*map(F.lit, parts)), 1000)).first()[0] if parts else None
    before = F.lit(0)
    for x in sorted(set(bounds or [])):
        before = before + F.coalesce((F.col("doc_id") <= x).cast("int"), F.lit(1))
    return before


def drop_shared_lines(
    docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, least: int = LEAST, batches: int = BATCHES
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept``: each text without the lines that ``least`` documents or more have.

    Lines end at ``\\n``. A line's key is the line without white space at its ends, A-Z lower-cased; keys shorter than
    ``length`` code points never count. A key's lines stay in the document with the largest id that has it.

    A null text counts as empty, which is one empty line. A null id is less than every other. Each row is a document, so
    repeated rows count each, and rows that share the largest id all keep their lines. A text of which all lines go is
    empty; an empty table gives no rows; other columns, whatever their names, are ignored.

    The lines' hashes are written once, by batch; batches go through ``LineRuns`` from the largest ids to the
    least. Then lines meet the settled keys, hot ones by broadcast, and only the places of dropped lines meet the texts.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lines = keyed_lines(docs, length=length)
    lines = scratch.table(lines.withColumn("batch", _batch(docs, "doc_id", batches)), "lines", "batch")
    runs = LineRuns(spark, scratch, least=least)
    for k in range(batches):
        runs.add(lines.filter(F.col("batch") == k).drop("batch"))
    settled = scratch.table(runs.settled(), "settled")
    runs.close()
    total = lines.filter("first").count()
    hot = F.broadcast(settled.filter(F.col("docs") * HOT >= total).select("h1", "h2", "owner"))
    rest = settled.filter(F.col("docs") * HOT < total).select("h1", "h2", "owner")
    known = lines.drop("batch", "first")
    found = known.join(hot, ["h1", "h2"]).unionByName(known.join(hot, ["h1", "h2"], "left_anti").join(rest, ["h1", "h2"]))
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("owner"))).groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "gone")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
    met = texts.join(gone, texts["doc_id"].eqNullSafe(gone["_id"]) & (texts["_h"] == gone["_th"]), "left")
    # An array of whole numbers is subtracted in linear time.
    stay = F.array_except(F.sequence(F.lit(0), F.size(_split(F.col("text"))) - 1), F.col("gone"))
    met = met.select("doc_id", "text", "gone", stay.alias("stay")).select("doc_id", "text", "gone", "stay", _split(F.col("text")).alias("lines"))
    kept = F.array_join(F.transform("stay", lambda i: F.get(F.col("lines"), i)), "\n")
    return met.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone").cast("long"), F.lit(0)).alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept"),
    )
