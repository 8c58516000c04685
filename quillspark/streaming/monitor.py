"""Live monitor of task logs: a file stream of immutable JSON files, folded per task.

Files must be added whole; a log that is appended in place is no stream source. The batch twins are
``tasks.current`` and ``tasks.change_feed``; both give the same rows for the same records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.session import checkpoint_root

LOG = "task_id string, stage string, status string, attempts int, worker string, error string, updated_at timestamp, seq long"
CHANGES = "task_id string, previous string, status string, seq long"
TERMINAL = ("completed", "failed", "blocked", "cancelled")


def read_log(spark: SparkSession, path: str, schema: str = LOG, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, seq = state.get if state.exists else (None, -1)
    rows = pd.concat(list(frames)).sort_values("seq")
    out = []
    for r in rows.itertuples():
        if r.seq <= seq:
            continue  # an older record that came late: file order decides
        if r.status in TERMINAL and r.status != status:
            out.append((key[0], status, r.status, r.seq))
        status, seq = r.status, r.seq
    state.update((status, int(seq)))
    yield pd.DataFrame(out, columns=["task_id", "previous", "status", "seq"])


def change_feed(log: DataFrame) -> DataFrame:
    """Stream of changes to a terminal status; the state per task is one status and one number."""
    return log.groupBy("task_id").applyInPandasWithState(_fold, CHANGES, "status string, seq long", "append", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: counts per window and type with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Extension: sessions per user."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def run_to_folder(stream: DataFrame, name: str, path: str) -> StreamingQuery:
    """Run over what is there now, exactly once, into Parquet."""
    spark = stream.sparkSession
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{checkpoint_root(spark)}/{name}").outputMode("append").format("parquet").start(path)


def guarded(stream: DataFrame, name: str, valid: Callable[[DataFrame], bool], publish: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Publish a batch only if all of it is valid; otherwise what was published last stays.

    ``publish`` gets the number of the batch, which is the same when a lost batch comes again. ``name`` names the stream's checkpoint
    below the shared folder: a stream that goes on with another's work has its name, every other one a name of its own.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            if valid(batch):
                publish(batch, number)
        finally:
            batch.unpersist()

    spark = stream.sparkSession
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{checkpoint_root(spark)}/{name}").foreachBatch(step).start()


def whole_snapshot(lines: DataFrame) -> bool:
    """Whether the lines of a snapshot (``value``) are all JSON maps, and there are records with an evidence id; a torn file has neither."""
    text = lines.filter(F.trim("value") != "")
    record = F.try_parse_json(F.trim("value"))
    is_map = F.coalesce(F.schema_of_variant(record).startswith("OBJECT"), F.lit(False))
    named = is_map & (F.coalesce(F.try_variant_get(record, "$.evidence_id", "string"), F.lit("")) != "")
    found = text.agg(F.count_if(record.isNull()).alias("bad"), F.count_if(named).alias("named")).first()
    return found["bad"] == 0 and found["named"] > 0


def tail(files: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New whole lines of files that grow, and how far each is read: ``path, line_no, line`` and ``path, upto``.

    ``files``: path, text; ``seen``: path, upto (characters read). A last line without its end waits; a file that is shorter than what
    was read of it was replaced and is read anew.
    """
    j = files.join(seen.select("path", F.col("upto").alias("_upto")), "path", "left")
    start = F.when(F.coalesce("_upto", F.lit(0)) <= F.length("text"), F.coalesce("_upto", F.lit(0))).otherwise(0)
    fresh = F.expr("substring(text, _start + 1)")
    whole = F.when(F.contains("_fresh", F.lit("\n")), F.regexp_replace("_fresh", r"[^\n]*\z", "")).otherwise("")
    j = j.withColumn("_start", start.cast("int")).withColumn("_fresh", fresh).withColumn("_whole", whole)
    lines = j.filter("_whole <> ''").select("path", F.posexplode(F.split(F.expr("substring(_whole, 1, length(_whole) - 1)"), "\n")).alias("line_no", "line"))
    return lines, j.select("path", (F.col("_start") + F.length("_whole")).cast("long").alias("upto"))
