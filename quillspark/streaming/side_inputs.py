"""Side inputs of the monitor: result records of several shapes, hand-offs, lists of missing texts, rung files, settings, engine logs."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Longest receipt, and statuses whose receipt is the error.
LONGEST = 200
STOPPED = ("failed", "blocked", "cancelled")


def _said(record: Column, path: str) -> Column:
    """A value as a receipt shows it: texts plain, None where it is absent or null, True and False, numbers as written."""
    x = F.get_json_object(record, f"$.{path}")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(record), f"$.{path}", "variant"))
    return F.when(x.isNull(), "None").when((kind == "BOOLEAN") & (x == "true"), "True").when((kind == "BOOLEAN") & (x == "false"), "False").otherwise(x)


def _or(record: Column, path: str, other: str) -> Column:
    """A text, or another where it is absent, null or empty."""
    x = F.get_json_object(record, f"$.{path}")
    return F.when(F.coalesce(x, F.lit("")) == "", other).otherwise(x)


def _kind(record: Column, path: str) -> Column:
    """Type of a value as VARIANT names it: VOID for null, null where it is absent."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(record), f"$.{path}", "variant"))


def shape(record: Column) -> Column:
    """Which kind of result a JSON record is, by the keys that it has (null values count); null for what is no known record."""
    keys = F.json_object_keys(record)
    has = lambda *names: functools.reduce(lambda a, b: a & b, [F.array_contains(keys, n) for n in names])
    known = (
        F.when(F.coalesce(_kind(record, "summary") == "STRING", F.lit(False)), "summary").when(has("decision", "reason"), "screening").when(has("final_decision"), "adjudication").when(has("outcomes", "design"), "extraction")
        .when(has("overall_judgement"), "appraisal").when(has("checks"), "verification").when(has("query_string"), "search")
    )
    return F.when(keys.isNotNull() & F.try_parse_json(record).isNotNull(), known)


def record_receipt(record: Column) -> Column:
    """One line for a result record, by its shape, of 200 characters at most; null where the shape is unknown."""
    r, cat = record, F.concat
    thin = F.when(F.coalesce(F.get_json_object(r, "$.evidence_basis"), F.lit("")) == "abstract_only", " [abstract-only]").otherwise("")
    first_is_map = F.coalesce(_kind(r, "outcomes[0]").startswith("OBJECT"), F.lit(False))
    outcomes = F.coalesce(F.json_array_length(F.get_json_object(r, "$.outcomes")), F.lit(0)).cast("string")
    failed = F.coalesce(F.expr("size(filter(cast(try_variant_get(try_parse_json(_r), '$.checks', 'array<variant>') as array<variant>), x -> try_variant_get(x, '$.status', 'string') = 'fail'))"), F.lit(0))
    failed = F.greatest(failed, F.lit(0)).cast("string")
    lines = {
        "summary": F.get_json_object(r, "$.summary"),
        "screening": cat(
            F.lit("screen "), _said(r, "decision"), F.when(_or(r, "criterion_failed", "") != "", cat(F.lit(" ("), F.get_json_object(r, "$.criterion_failed"), F.lit(")"))).otherwise(""), F.lit(": "), _or(r, "reason", "")
        ),
        "adjudication": cat(F.lit("adjudicated "), _said(r, "final_decision"), F.lit(": "), _or(r, "rationale", "")),
        "extraction": cat(
            _or(r, "design", "design?"), F.lit(", n="), _said(r, "n_total"), F.lit(", "), outcomes, F.lit(" outcome(s)"),
            F.when(first_is_map, cat(F.lit("; "), _or(r, "outcomes[0].name", "?"), F.lit(" "), _or(r, "outcomes[0].direction", ""))).otherwise(""), thin,
        ),
        "appraisal": cat(
            _or(r, "tool", "?"), F.lit(" -> "), _said(r, "overall_judgement"), F.when(_or(r, "grade.certainty", "") != "", cat(F.lit("; GRADE "), F.get_json_object(r, "$.grade.certainty"))).otherwise(""), thin
        ),
        "verification": cat(F.lit("verifier: "), F.coalesce(F.json_array_length(F.get_json_object(r, "$.checks")), F.lit(0)).cast("string"), F.lit(" check(s), "), failed, F.lit(" fail")),
        "search": cat(F.lit("query "), _said(r, "query_id"), F.lit(": "), _said(r, "count"), F.lit(" hits")),
    }
    kind = shape(r)
    return functools.reduce(lambda acc, kv: acc.when(kind == kv[0], kv[1]), lines.items(), F.when(F.lit(False), F.lit(""))).substr(1, LONGEST)


def receipts(log: DataFrame, results: DataFrame) -> DataFrame:
    """Receipt of each log record: ``*log, receipt``.

    ``log``: at least status, summary, error, output_path; ``results``: output_path (once each), record (JSON). The record's own summary
    comes first, then the first line of the error where the task stopped, then the line of the result that it points to.
    A path without a result, or with one of no known shape, is shown itself. ``log`` may be a stream; ``results`` is then read
    anew for every batch, so a result that is rewritten shows in later batches.
    """
    said = lambda c: F.coalesce(F.regexp_replace(c, r"(?U)\A\s+|\s+\z", ""), F.lit(""))
    lines = results.select(F.col("output_path").alias("_path"), F.col("record").alias("_r")).withColumn("_line", record_receipt(F.col("_r"))).select("_path", "_line")
    met = log.join(lines, F.col("output_path") == F.col("_path"), "left")
    pointed = F.when(F.coalesce("output_path", F.lit("")) == "", "(no output_path)").otherwise(F.coalesce(F.nullif("_line", F.lit("")), F.concat(F.lit("-> "), F.col("output_path"))))
    stopped = F.when(said(F.col("error")) != "", F.split(said(F.col("error")), r"\r\n|[\n\r]")[0].substr(1, LONGEST)).otherwise("(no diagnostic recorded)")
    own = F.when(said(F.col("summary")) != "", said(F.col("summary")).substr(1, LONGEST)).when(F.col("status").isin(*STOPPED), stopped).otherwise(pointed)
    return met.withColumn("receipt", own).drop("_path", "_line")


def json_lines(lines: DataFrame) -> DataFrame:
    """Lines (``value``) that are JSON maps, as VARIANT: ``value, record``. Torn and other lines are left out, as the monitor does."""
    kept = lines.withColumn("record", F.try_parse_json(F.trim("value")))
    return kept.filter(F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False)))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result records as they are in their files now: ``output_path, record``, from JSON lines with both keys."""
    found = json_lines(spark.read.schema("value string").text(path))
    return found.select(F.try_variant_get("record", "$.output_path", "string").alias("output_path"), F.get_json_object("value", "$.record").alias("record")).filter("output_path is not null")


def read_task_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of task records of JSON lines: task_id, seq, status, summary, error, output_path. Lines of other shapes (results,
    notes, torn ones) are left out: a task record is a map with a task id."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(path)
    get = lambda name, kind="string": F.try_variant_get("record", f"$.{name}", kind).alias(name)
    return json_lines(lines).select(get("task_id"), get("seq", "long"), *[get(n) for n in ("status", "summary", "error", "output_path")]).filter("task_id is not null and task_id <> ''")


def missing_blocks(files: DataFrame) -> DataFrame:
    """Blocks of lists of missing full texts (path, text): ``path, block, title, evidence_id, pmid``.

    A block starts at a line ``## title``; of its lines ``- evidence_id:`` and ``- PMID:`` the last ones count. Where any block of a file has an
    evidence id, those without are left out.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n|\r", "\n")
    # Each block is cut out of the text in one row of its own, so a file's lines are never numbered across rows.
    blocks = files.select("path", F.posexplode(F.split(F.concat(F.lit("\n"), text), "\n## ")).alias("block", "said")).filter("block > 0")
    head = F.concat(F.lit("\n"), F.substring_index("said", "\n", 1))
    rest = F.concat(F.lit("\n"), F.substr("said", F.length(head) + 1), F.lit("\n"))
    last = lambda name: F.trim(F.element_at(F.regexp_extract_all(rest, F.lit(rf"\n- {name}:([^\n]*)(?=\n)"), F.lit(1)), -1))
    cut = blocks.select("path", "block", F.trim(F.substr(head, F.lit(2))).alias("title"), F.when(rest.rlike(r"\n- evidence_id:"), last("evidence_id")).alias("evidence_id"), F.when(rest.rlike(r"\n- PMID:"), last("PMID")).alias("pmid"))
    named = cut.groupBy("path").agg(F.max(F.coalesce("evidence_id", F.lit("")) != "").alias("_named"))
    return cut.join(named, "path").filter(~F.col("_named") | (F.coalesce("evidence_id", F.lit("")) != "")).drop("_named")


def best_rungs(files: DataFrame) -> DataFrame:
    """Rung files (path, text) as ``evidence_id, tier, status, detail, at, attempted``: the highest rung that was tried, and all of them.

    Files that are no JSON map are left out. Keys that are no whole numbers, and entries that are no maps, are no rungs, though
    such a key made of digits counts as tried. The file's name stands for a missing evidence id; of files of one id the last path counts.
    """
    text = F.trim("text")
    rungs = F.coalesce(F.from_json(F.get_json_object(text, "$.rungs"), "map<string, string>"), F.expr("cast(map() as map<string, string>)"))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*\z", "")
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))
    rows = files.filter(ok).select("path", F.coalesce(F.nullif(F.get_json_object(text, "$.evidence_id"), F.lit("")), name).alias("evidence_id"), rungs.alias("rungs"))
    rows = rows.groupBy("evidence_id").agg(F.max_by("rungs", "path").alias("rungs"))
    tier = lambda k: k.try_cast("int")
    whole = F.filter(F.map_entries("rungs"), lambda e: tier(e["key"]).isNotNull() & F.coalesce(F.schema_of_variant(F.try_parse_json(e["value"])).startswith("OBJECT"), F.lit(False)))
    best = F.array_max(F.transform(whole, lambda e: F.struct(tier(e["key"]).alias("tier"), e["value"].alias("said"))))
    tried = F.array_sort(F.array_compact(F.transform(F.filter(F.map_keys("rungs"), lambda k: k.rlike(r"\A\d+\z")), tier)))
    of = lambda n: F.get_json_object("best.said", f"$.{n}").alias(n)
    return rows.select("evidence_id", best.alias("best"), tried.alias("attempted")).select("evidence_id", F.col("best.tier").alias("tier"), of("status"), of("detail"), of("at"), "attempted")


def engine_log(lines: DataFrame) -> DataFrame:
    """Log lines (path, line_no, line) as feed entries: ``path, line_no, ts, text``; the text is without the time that a line starts with, and a line
    without one has a null time and all its text."""
    line = F.regexp_replace("line", r"(?U)\s+\z", "")
    ts = F.coalesce(*[F.try_to_timestamp(F.substring_index(line, " ", 1), F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSX")])
    rest = F.when(ts.isNull(), line).when(F.contains(line, F.lit(" ")), F.substr(line, F.length(F.substring_index(line, " ", 1)) + 2)).otherwise("")
    return lines.filter(line != "").select("path", "line_no", ts.alias("ts"), rest.alias("text"))
