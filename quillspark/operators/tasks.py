"""Task log: folding, statistics, state machine, stalls, budgets, alerts and the no-progress guard."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.numbering import numbered

# Stages in their order, states, key kinds and the allowed changes of state.
STAGES = ("protocol", "search", "screen", "adjudicate", "retrieve", "extract", "appraise", "synthesize", "digest", "verify", "report", "okf")
STATES = ("pending", "active", "completed", "blocked", "failed", "cancelled")
KEY_KINDS = ("pmid", "doi", "pmcid", "query", "url", "slug", "batch")
CHANGES = {
    None: ("pending",),
    "pending": ("active", "cancelled"),
    "active": ("completed", "failed", "blocked", "cancelled"),
    "failed": ("pending", "active", "cancelled"),
    "blocked": ("pending", "active"),
    "completed": (),
    "cancelled": ("pending",),
}
PARENT_STAGE = {"adjudicate": "screen", "digest": "synthesize", "okf": "report"}
TASK_ID = rf"^({'|'.join(STAGES)})(:({'|'.join(KEY_KINDS)}):.+)?$"
BUDGET_WARN, FAILED_SHOWN, BLOCKED_SHOWN = 0.8, 8, 5


def current(log: DataFrame, key: str = "task_id", seq: str = "seq") -> DataFrame:
    """State of each task: its last record in file order, by a partial aggregation and no sort."""
    fields = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*fields), seq).alias("_r"))
    return last.select(key, *[F.col(f"_r.{c}").alias(c) for c in fields])


def change_feed(log: DataFrame, terminal: tuple[str, ...] = ("completed", "failed", "blocked", "cancelled"), key: str = "task_id", seq: str = "seq") -> DataFrame:
    """Records with a terminal status that differs from the task's record before."""
    w = Window.partitionBy(key).orderBy(seq)
    own = log.withColumn("previous", F.lag("status").over(w))
    return own.filter(F.col("status").isin(*terminal) & (F.col("previous").isNull() | (F.col("previous") != F.col("status"))))


def stage_stats(tasks: DataFrame, states: tuple[str, ...] = STATES, stage: str = "stage") -> DataFrame:
    """Tasks of each stage by status, and all."""
    return tasks.groupBy(stage).agg(*[F.count_if(F.col("status") == s).alias(s) for s in states], F.count(F.lit(1)).alias("total"))


def stage_rollup(tasks: DataFrame) -> DataFrame:
    """The same with side stages counted under their parents."""
    parents = F.create_map(*[F.lit(x) for kv in PARENT_STAGE.items() for x in kv])
    return stage_stats(tasks.withColumn("stage", F.coalesce(parents[F.col("stage")], F.col("stage"))))


def current_stage(tasks: DataFrame) -> DataFrame:
    """Furthest stage with a task that isn't merely pending: one row."""
    place = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    return tasks.filter("status <> 'pending'").agg(F.max_by("stage", place).alias("stage"))


def queue(tasks: DataFrame, n: int) -> DataFrame:
    """Next tasks to run: pending or failed, oldest first."""
    return tasks.filter(F.col("status").isin("pending", "failed")).orderBy("created_at", "task_id").limit(n)


def valid_task_id(c: Column) -> Column:
    return c.rlike(TASK_ID)


def violations(log: DataFrame, key: str = "task_id", seq: str = "seq") -> DataFrame:
    """Records that are no allowed change; a completed task may reopen only if its inputs changed."""
    w = Window.partitionBy(key).orderBy(seq)
    rows = log.withColumn("_s", F.lag("status").over(w)).withColumn("_h", F.lag("inputs_hash").over(w))
    ok = F.lit(False)
    for before, after in CHANGES.items():
        same = F.col("_s").isNull() if before is None else F.col("_s") == before
        ok = ok | (same & F.col("status").isin(*after))
    ok = ok | ((F.col("_s") == "completed") & (F.col("_h") != F.col("inputs_hash")))
    return rows.filter(~F.coalesce(ok, F.lit(False))).withColumnRenamed("_s", "previous").drop("_h")


def reusable(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted tasks (task_id, inputs_hash) that are completed with these inputs already."""
    done = tasks.filter("status = 'completed'").select("task_id", "inputs_hash")
    return wanted.join(done, ["task_id", "inputs_hash"], "left_semi")


def append(log: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New records for commands (task_id, status, at, worker, error, inputs_hash), and those refused.

    Claiming a task that doesn't exist creates it first. Attempts grow when a task becomes active.
    """
    now = current(log).select("task_id", F.col("status").alias("_s"), F.col("attempts").alias("_a"), F.col("inputs_hash").alias("_h"), F.col("seq").alias("_q"))
    j = commands.join(now, "task_id", "left")
    ok = F.lit(False)
    for before, after in CHANGES.items():
        same = F.col("_s").isNull() if before is None else F.col("_s") == before
        ok = ok | (same & F.col("status").isin(*(after if before is not None else ("pending", "active"))))
    ok = ok | ((F.col("_s") == "completed") & (F.coalesce("inputs_hash", F.col("_h")) != F.col("_h")))
    ok = F.coalesce(ok & valid_task_id(F.col("task_id")), F.lit(False))
    out = j.withColumn("attempts", F.coalesce("_a", F.lit(0)) + (F.col("status") == "active").cast("int")).withColumn("inputs_hash", F.coalesce("inputs_hash", "_h"))
    return out.filter(ok).drop("_s", "_a", "_h", "_q"), j.filter(~ok).select(*commands.columns, F.col("_s").alias("current"))


def stalls(tasks: DataFrame, now: Column, threshold_s: float) -> DataFrame:
    """Active tasks by idle time: amber from the threshold on, red from twice that."""
    idle = F.unix_timestamp(now) - F.unix_timestamp("updated_at")
    level = F.when(idle >= 2 * threshold_s, "red").when(idle >= threshold_s, "amber").otherwise("ok")
    return tasks.filter("status = 'active'").withColumn("idle_s", idle).withColumn("level", level)


def budget_usage(tasks: DataFrame, funnel: DataFrame, now: Column, caps: dict[str, float]) -> DataFrame:
    """Use of each budget against its cap: one row per budget; no cap, no fraction."""
    work = tasks.agg(
        F.count_distinct(F.when(F.col("worker") != "main", F.col("worker"))).cast("double").alias("subagents"),
        (F.unix_timestamp(now) - F.unix_timestamp(F.min("created_at"))).cast("double").alias("wall"),
    )
    # Two frames of one row each.
    both = work.join(F.broadcast(funnel.select(F.col("sought").cast("double").alias("articles"), F.col("unobtainable").cast("double").alias("ft-fail"))))
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias("used"), F.lit(caps.get(n)).cast("double").alias("cap")) for n in ("articles", "subagents", "wall", "ft-fail")])
    return both.select(F.inline(rows)).withColumn("fraction", F.when(F.col("cap") > 0, F.col("used") / F.col("cap")))


def alerts(tasks: DataFrame, stalled: DataFrame, budgets: DataFrame, checks: DataFrame, quarantined: DataFrame, handoffs: DataFrame) -> DataFrame:
    """What needs the operator: ``level, kind, text`` from all rules."""

    def first(status: str, n: int, level: str) -> DataFrame:
        own = tasks.filter(F.col("status") == status).orderBy("task_id").limit(n)
        return own.select(F.lit(level).alias("level"), F.lit("task").alias("kind"), F.concat_ws(" ", F.lit(status), F.concat("task_id", F.lit(":")), F.coalesce("error", F.lit("no diagnostic"))).alias("text"))

    def counted(rows: DataFrame, level: str, kind: str, text: str) -> DataFrame:
        n = rows.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
        return n.select(F.lit(level).alias("level"), F.lit(kind).alias("kind"), F.concat(F.col("n").cast("string"), F.lit(text)).alias("text"))

    out = counted(handoffs.filter("status = 'needs_mcp' and result_path is null"), "amber", "mcp", " hand-offs await the coordinator")
    out = out.unionByName(stalled.filter("level <> 'ok'").select("level", F.lit("stall").alias("kind"), F.concat_ws(" ", F.lit("idle"), "task_id", F.col("idle_s").cast("string")).alias("text")))
    out = out.unionByName(counted(quarantined, "amber", "quarantine", " full texts in quarantine"))
    share = F.when(F.col("fraction") >= 1.0, "red").when(F.col("fraction") >= BUDGET_WARN, "amber")
    out = out.unionByName(budgets.withColumn("level", share).filter("level is not null").select("level", F.lit("budget").alias("kind"), F.concat_ws(" ", F.lit("budget"), "name").alias("text")))
    out = out.unionByName(first("failed", FAILED_SHOWN, "red")).unionByName(first("blocked", BLOCKED_SHOWN, "amber"))
    level = F.when(F.col("status") == "fail", "red").when(F.col("status") == "warn", "amber")
    return out.unionByName(checks.withColumn("level", level).filter("level is not null").select("level", F.lit("verify").alias("kind"), F.concat_ws(" ", "check_id", "detail").alias("text")))


def fingerprint(tasks: DataFrame) -> DataFrame:
    """One row: a digest of finished work, its size, all attempts and the active tasks."""
    done = F.col("status").isin("completed", "blocked", "cancelled")
    pairs = F.array_sort(F.collect_list(F.when(done, F.concat_ws("=", "task_id", "status"))))
    return tasks.agg(
        F.substring(F.sha2(F.array_join(pairs, "\n"), 256), 1, 16).alias("fingerprint"), F.count_if(done).alias("done"),
        F.sum(F.coalesce("attempts", F.lit(0))).alias("attempts_total"), F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status").isin("pending", "failed")).alias("waiting"),
    )


def progress_guard(probes: DataFrame, window: int, seq: str = "seq") -> DataFrame:
    """For each probe whether the last ``window`` show no progress: stalled or frozen, unless idle."""
    w = Window.partitionBy("run_id").orderBy(seq).rowsBetween(1 - window, 0)
    full = F.count(F.lit(1)).over(w) >= window
    one = F.size(F.collect_set("fingerprint").over(w)) == 1
    still = F.size(F.collect_set(F.struct("fingerprint", "attempts_total", "records_total")).over(w)) == 1
    stalled = full & one & (F.last("attempts_total").over(w) > F.first("attempts_total").over(w))
    frozen = full & still & (F.col("active") == 0)
    idle = (F.col("waiting") == 0) & (F.col("active") == 0)
    return probes.withColumn("stalled", stalled).withColumn("frozen", frozen).withColumn("no_progress", (stalled | frozen) & ~idle)


def attempt_numbers(runs: DataFrame, key: list[str], config: str, seq: str = "seq") -> DataFrame:
    """Attempts counted anew whenever the configuration changes."""
    w = Window.partitionBy(*key).orderBy(seq)
    rows = runs.withColumn("_c", F.coalesce((F.lag(config).over(w) != F.col(config)).cast("int"), F.lit(0)))
    rows = rows.withColumn("_i", F.sum("_c").over(w))
    return rows.withColumn("attempt", F.row_number().over(Window.partitionBy(*key, "_i").orderBy(seq))).drop("_c", "_i")


def next_event_ids(events: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Ids for new events: past the highest number and the count so far, four digits at least.

    Ids are dense over the incoming events in their order.
    """
    number = F.regexp_extract("event_id", r"^ev-(\d{4,})$", 1)
    base = events.agg(F.greatest(F.coalesce(F.max(F.when(number != "", number.cast("long"))), F.lit(0)), F.count(F.lit(1))).alias("_base"))
    placed = numbered(incoming, "_n", order).join(F.broadcast(base))
    return placed.withColumn("event_id", F.format_string("ev-%04d", F.col("_base") + F.col("_n"))).drop("_n", "_base")


def split_task_id(task_id: str) -> tuple[str, str | None, str | None]:
    m = re.match(TASK_ID, task_id)
    if not m:
        raise ValueError(f"no task id: {task_id}")
    return m[1], m[3], task_id.split(":", 2)[2] if m[3] else None
