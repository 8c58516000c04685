"""Queries of note files, schema migrations, folder imports and the monitor's side inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import bundles, paper_plan
from quillspark.plans.catalog import ORACLE_SQL, QUERIES, query
from quillspark.session import Scratch, path_exists, ship_package, table
from quillspark.sources import files, folders, migrations, notes
from quillspark.streaming import monitor, side_inputs

# ---------------------------------------------------------------- notes

_BODY = r"regexp_replace(coalesce(text, ''), '^\n+|\n+$', '', 'g')"
_QUOTED = "'\"' || replace(replace(replace(replace({x}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(9), '\\t') || '\"'"
_UNSAFE = r"""(^$|^\s|\s$|^(null|~|true|false|yes|no|on|off|True|False|Null|NULL|TRUE|FALSE)$|^[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?$|^\d{{4}}-\d{{2}}-\d{{2}}$|^[-?:,\[\]{{}}#&*!|>''"%@`]|[\n\t\x01-\x08\x0b-\x1f\x7f]|: | #|:$)"""


def _scalar_sql(x: str) -> str:
    return f"case when regexp_matches({x}, '{_UNSAFE.format()}') then {_QUOTED.format(x=x)} else {x} end"


@query(
    f"""with d as (select doc_id, coalesce(lang, 'none') as lang, coalesce(source, 'none') as source, {_BODY} as body, string_split({_BODY}, chr(10))[1] as title from documents),
    f as (select *, '---' || chr(10) || 'type: Source Document' || chr(10) || 'title: ' || {_scalar_sql('title')} || chr(10) || 'tags: [' || lang || ', ' || source || ']' || chr(10)
      || 'generated: {{ by: quillspark, at: 2024-05-06T07:08:09Z }}' || chr(10) || 'pmid: "' || doc_id || '"' || chr(10) || case when doc_id % 3 = 0 then '' else 'n_words: ' || doc_id % 11 || chr(10) end
      || 'checked: ' || case when doc_id % 2 = 0 then 'true' else 'false' end || chr(10) || 'weight: ' || cast(doc_id % 7 / 2.0 as double) || chr(10) || 'sources:' || chr(10)
      || '  - id: one' || chr(10) || '    resource: https://x.example/' || doc_id || chr(10) || '    title: ' || {_scalar_sql("(source || ': ' || lang)")} || chr(10)
      || case when doc_id % 5 = 0 then '  - {{}}' || chr(10) else '  - id: two' || chr(10) end
      || 'place:' || chr(10) || '  shelf: ' || lang || chr(10) || '  at: {{}}' || chr(10) || 'evidence_ids: []' || chr(10) || '---' || chr(10) || chr(10) || body || chr(10) as said from d)
    select doc_id, 'notes/n-' || doc_id || '.md' as path, sha256(said) as file_sha256, title, [lang, source] as tags, case when doc_id % 3 = 0 then null else doc_id % 11 end::int as n_words, doc_id % 2 = 0 as checked,
      cast(doc_id % 7 / 2.0 as double) as weight, source || ': ' || lang as source_title, case when doc_id % 5 = 0 then null else 'two' end as second_id, lang as shelf, sha256(body) as body_sha256, cast(null as varchar) as error from f"""
)
def s_concept_notes(spark: SparkSession, d: str) -> DataFrame:
    """A note per document, written as a file's text and read back; the digest of the text shows what was written."""
    ship_package(spark)
    x = table(spark, d, "documents").withColumn("body", F.regexp_replace(F.coalesce("text", F.lit("")), r"\A\n+|\n+\z", ""))
    x = x.select("doc_id", "body", *[F.coalesce(c, F.lit("none")).alias(c) for c in ("lang", "source")], F.split("body", "\n")[0].alias("title"))
    own, none = F.concat(F.col("source"), F.lit(": "), F.col("lang")), F.lit(None).cast("string")
    one = F.struct(F.lit("one").alias("id"), F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string")).alias("resource"), own.alias("title"))
    two = F.struct(F.when(F.col("doc_id") % 5 != 0, "two").alias("id"), none.alias("resource"), none.alias("title"))
    front = F.struct(
        F.lit("Source Document").alias("type"), "title", F.array("lang", "source").alias("tags"), F.struct(F.lit("quillspark").alias("by"), F.lit("2024-05-06T07:08:09Z").alias("at")).alias("generated"), F.col("doc_id").cast("string").alias("pmid"),
        F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 11).cast("int")).alias("n_words"), (F.col("doc_id") % 2 == 0).alias("checked"), (F.col("doc_id") % 7 / 2.0).alias("weight"), F.array(one, two).alias("sources"),
        F.struct(F.col("lang").alias("shelf"), F.struct(none.alias("z")).alias("at")).alias("place"), F.expr("cast(array() as array<string>)").alias("evidence_ids"), none.alias("absent"),
    )
    rows = x.select(F.lit("notes").alias("folder"), F.concat(F.lit("n-"), F.col("doc_id").cast("string")).alias("slug"), front.alias("front"), "body")
    kind = rows.schema["front"].dataType
    written = Scratch(spark, "notes").table(notes.to_files(rows), "files")
    read = notes.typed(notes.from_files(written), kind).join(written.select("path", F.sha2("text", 256).alias("file_sha256")), "path")
    return read.select(
        F.col("pmid").cast("long").alias("doc_id"), "path", "file_sha256", "title", "tags", "n_words", "checked", "weight", F.col("sources")[0]["title"].alias("source_title"), F.col("sources")[1]["id"].alias("second_id"), F.col("place.shelf").alias("shelf"),
        F.sha2("body", 256).alias("body_sha256"), "error",
    )


_LINKS = """[{'d': '../studies/s-' || doc_id || '.md', 'r': 'research/studies/s-' || doc_id || '.md', 'p': null}, {'d': './s-' || (doc_id + 1) || '.md#x', 'r': null, 'p': case when doc_id + 1 in (select doc_id from documents) then null else 'dangling' end},
      {'d': '../../../up/x.md', 'r': null, 'p': 'dangling'}, {'d': '../../outputs/run/none.md?q=1', 'r': null, 'p': null}, {'d': '../../notes/n.md', 'r': null, 'p': 'outside'}, {'d': 'gone-' || doc_id % 7 || '/../x.md', 'r': null, 'p': 'dangling'}, {'d': '/abs.md', 'r': null, 'p': 'dangling'}]"""


@query(
    f"""with d as (select doc_id, coalesce(lang, 'none') as lang from documents),
    l as (select doc_id, unnest({_LINKS}) as x from d)
    select 'V17' as rule, 'research/studies/s-' || doc_id || '.md' as path, case when x.d like './%' then 'resource' else 'link' end as what, x.d as said, x.p as problem from l where x.p is not null
    union all select 'V13', 'research/studies/s-' || doc_id || '.md', 'volume', cast(doc_id as varchar), 'not a text' from d where doc_id % 3 = 0
    union all select 'V13', 'research/studies/s-' || doc_id || '.md', 'issue', 'true', 'not a text' from d where doc_id % 4 = 1
    union all select 'V20', 'research/logs-' || doc_id % 50 || '/' || doc_id || '/log.md', '4', '2024-13', 'no date' from d where doc_id % 2 = 0
    union all select 'V20', 'research/logs-' || doc_id % 50 || '/' || doc_id || '/log.md', '5', '2024-01-02', 'out of order' from d where doc_id % 2 = 0
    union all select 'V20', 'research/logs-' || doc_id % 50 || '/' || doc_id || '/log.md', '5', '2024-01-02', 'twice' from d where doc_id % 6 = 0
    union all select 'V21', lang, cast(count(*) as varchar), '', 'no index' from d where lang <> 'en' group by lang"""
)
def v_bundle_files(spark: SparkSession, d: str) -> DataFrame:
    """A bundle of studies with links of all kinds, logs, and folders of notes by language of which one has an index."""
    ship_package(spark)
    x = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("s"), F.coalesce("lang", F.lit("none")).alias("lang"))
    k, cat, lit = F.col("doc_id"), F.concat, F.lit
    path = cat(lit("research/studies/s-"), F.col("s"), lit(".md"))
    body = cat(
        lit("[own](../studies/s-"), F.col("s"), lit('.md "title") ![pic](none.png) [web](https://x.example/) [in](#here) [up](../../../up/x.md) [run](../../outputs/run/none.md?q=1)\n[n](../../notes/n.md) [gone](gone-'),
        (k % 7).cast("string"), lit("/../x.md) [abs](/abs.md)"),
    )
    front = F.struct(lit("Study").alias("type"), F.when(k % 3 == 0, k).alias("volume"), F.when(k % 4 == 1, lit(True)).alias("issue"), lit("12").alias("pages"), F.array(F.struct(cat(lit("./s-"), (k + 1).cast("string"), lit(".md#x")).alias("resource"))).alias("sources"))
    studies = notes.to_files(x.select(lit("research/studies").alias("folder"), cat(lit("s-"), F.col("s")).alias("slug"), front.alias("front"), body.alias("body")))
    log = F.when(k % 2 == 0, cat(lit("# Log\n## "), F.when(k % 6 == 0, "2024-01-02").otherwise("2024-01-01"), lit("\n## 2024-02-01 \n## 2024-13\n## 2024-01-02"))).otherwise("## 2024-01-01\n## 2024-01-03")
    logs = x.select(cat(lit("research/logs-"), (k % 50).cast("string"), lit("/"), F.col("s"), lit("/log.md")).alias("path"), log.alias("text"))
    shelves = x.select(cat(lit("research/"), F.col("lang"), lit("/n-"), F.col("s"), lit(".md")).alias("path"), lit("").alias("text")).unionByName(x.select(cat(lit("research/"), F.when(F.col("lang") == "en", "en").otherwise("studies"), lit("/index.md")).alias("path"), lit("").alias("text")).distinct())
    other = x.select(lit("notes/n.md").alias("path"), lit("").alias("text")).distinct()
    scratch = Scratch(spark, "bundle-files")
    every = scratch.table(studies.unionByName(logs).unionByName(shelves).unionByName(other), "files")
    read = notes.from_files(every.filter(F.col("path").startswith("research/studies/s-")))
    row = lambda df, rule, path, what, said, problem: df.select(lit(rule).alias("rule"), path.alias("path"), what.cast("string").alias("what"), said.alias("said"), problem.alias("problem"))
    c = F.col
    out = row(bundles.dangling(read, every, scratch), "V17", c("path"), c("kind"), c("dest"), c("problem"))
    out = out.unionByName(row(bundles.untyped(read), "V13", c("path"), c("field"), c("said"), lit("not a text")))
    out = out.unionByName(row(bundles.log_problems(every), "V20", c("path"), c("line_no"), c("heading"), c("problem")))
    return out.unionByName(row(bundles.without_index(every), "V21", c("folder"), c("notes"), lit(""), lit("no index")))


@query(
    """select 'pmid:' || doc_id as evidence_id, case when doc_id % 4 = 3 then [source] when doc_id % 4 = 2 then ['Van ' || source, null] else [source, 'The ' || lang || ' Group'] end as families, case when doc_id % 4 = 3 then [null] when doc_id % 4 = 2 then ['JA', null] else ['B', null] end as initials,
      '10.1000/' || lower(source) as doi, case when doc_id % 5 = 0 then null else source end as journal, case when doc_id % 3 = 0 then 'none' else 'retracted' end as retraction_status
    from (select doc_id, coalesce(source, 'none') as source, coalesce(lang, 'none') as lang from documents)"""
)
def e_biblio_front(spark: SparkSession, d: str) -> DataFrame:
    """Authors of several forms and identifiers as the bibliographic front matter of notes."""
    k, s, cat, lit = F.col("doc_id"), F.col("source"), F.concat, F.lit
    none = lit(None).cast("string")
    x = table(spark, d, "documents").select("doc_id", F.coalesce("source", lit("none")).alias("source"), F.coalesce("lang", lit("none")).alias("lang"))
    authors = F.when(k % 4 == 3, F.array(cat(lit(" "), s, lit(" ")))).when(k % 4 == 2, F.array(cat(lit("Van  "), s, lit("\tJA")), lit(""))).otherwise(F.array(cat(s, lit(" B")), cat(lit("The "), F.col("lang"), lit(" Group"))))
    rows = x.select(
        cat(lit("pmid:"), k.cast("string")).alias("evidence_id"), k.cast("string").alias("pmid"), none.alias("pmcid"), cat(lit(" 10.1000/"), F.upper("source")).alias("doi"), authors.alias("authors"), F.when(k % 5 == 0, "").otherwise(s).alias("journal"),
        *[none.alias(c) for c in ("publication_date", "volume", "issue", "pages", "abstract")], F.expr("cast(null as array<string>)").alias("article_types"), F.when(k % 3 != 0, "retracted").alias("retraction_status"), lit(False).alias("is_preprint"),
    )
    b = bundles.biblio_front(rows)
    return b.select("evidence_id", F.col("biblio.authors.family").alias("families"), F.col("biblio.authors.initials").alias("initials"), F.col("biblio.doi").alias("doi"), F.col("biblio.journal.iso_abbrev").alias("journal"), F.col("biblio.retraction_status").alias("retraction_status"))


@query(
    """with p as (select 'pmid:' || d.doc_id as evidence_id, d.doc_id as k, l.quality as q, l.toxic as t from documents d left join labels l using (doc_id)),
    x as (select *, k % 7 = 0 as force, k % 2 = 0 as reuse, k % 3 <> 0 as appraise, k % 11 = 0 as extract_only, case when k % 4 = 0 then 'missing' else 'fulltext' end as ft, q is not null as own, k % 5 = 0 as pooled,
      case when k % 2 = 0 and k % 7 <> 0 and k % 5 = 0 then 'fulltext' when coalesce(q, 0) = 1 then 'fulltext' else 'abstract_only' end as basis from p),
    y as (select *, not force and ((reuse and pooled) or own) and not coalesce(t = 1, false) as extracted, k % 9 = 1 or (reuse and not force and k % 9 = 2) as appraised, case when basis = 'abstract_only' then 'abstract_only' when not appraise then 'no_appraise_flag' end as skip from x),
    z as (select *, case when not extracted and ft = 'missing' then 'pending_retrieval' when not extracted then 'pending_extraction' when extract_only then 'completed' when skip is null and not appraised then 'pending_appraisal' when k % 8 = 3 then 'pending_summary'
      when k % 6 = 5 then 'verification_failed' else 'completed' end as status from y)
    select evidence_id, status, case status when 'pending_retrieval' then 'retrieve:' when 'pending_extraction' then 'extract:' when 'pending_appraisal' then 'appraise:' end || evidence_id as task_id,
      status in ('pending_retrieval', 'pending_extraction', 'pending_appraisal') and not coalesce(status = 'pending_extraction' and k % 10 < 4, false) as queue, case when extracted and not extract_only then skip end as skipped, case when status = 'verification_failed' then 3 else 0 end as errors from z"""
)
def e_paper_plan(spark: SparkSession, d: str) -> DataFrame:
    """Next step of a paper for each document, from labels as extractions and rules on the number for the rest."""
    k = F.col("k")
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(F.concat(F.lit("pmid:"), F.col("doc_id").cast("string")).alias("evidence_id"), F.col("doc_id").alias("k"), "quality", "toxic")
    x = Scratch(spark, "plan").table(x, "papers")
    file = [F.lit(True).alias("file_exists"), F.col("evidence_id").alias("file_evidence_id")]
    facts = {
        "papers": x.select("evidence_id", F.when(k % 4 == 0, "missing").otherwise("fulltext").alias("ft_status"), (k % 2 == 0).alias("reuse"), (k % 7 == 0).alias("force"), (k % 3 != 0).alias("appraise"), (k % 11 == 0).alias("extract_only")),
        "extractions": x.filter("quality is not null").select("evidence_id", *file, F.when(F.col("quality") == 1, "fulltext").otherwise("abstract_only").alias("basis")),
        "pooled_extractions": x.filter(k % 5 == 0).select("evidence_id", *file, F.lit("fulltext").alias("basis")),
        "spans": x.filter("toxic is not null").select("evidence_id", (F.col("toxic") == 0).alias("ok")), "appraisals": x.filter(k % 9 == 1).select("evidence_id"), "pooled_appraisals": x.filter(k % 9 == 2).select("evidence_id"),
        "summaries": x.filter(k % 8 != 3).select("evidence_id", F.when(k % 6 == 5, 1).otherwise(0).alias("problems")), "refs": x.filter(k % 6 == 5).select("evidence_id", F.explode(F.array(F.lit(False), F.lit(None).cast("boolean"), F.lit(True))).alias("ok")),
        "board": x.filter(k % 10 < 5).select(F.concat(F.lit("extract:"), F.col("evidence_id")).alias("task_id"), F.when(k % 10 == 4, "cancelled").otherwise("pending").alias("status")),
    }
    return paper_plan.plan(facts).withColumn("errors", F.col("errors").cast("int"))


# ---------------------------------------------------------------- migrations


@query(
    """select o_orderkey, o_custkey, case o_orderstatus when 'F' then 'finished' when 'O' then 'open' else 'partly' end as status, o_totalprice, cast(split_part(o_orderpriority, '-', 1) as int) as priority_rank, split_part(o_orderpriority, '-', 2) as priority,
      o_orderkey = max(o_orderkey) over (partition by o_custkey) as is_last, 4 as version, true as lost, 0 as again from orders"""
)
def s_migrations(spark: SparkSession, d: str) -> DataFrame:
    """A table brought from nothing to its fourth schema, with a second writer of one version in between and a second run behind."""
    o = table(spark, d, "orders")
    word = F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "O", "open").otherwise("partly")
    part = lambda k: F.split_part(F.col("o_orderpriority"), F.lit("-"), F.lit(k))
    last = lambda t: t.groupBy("o_custkey").agg(F.max("o_orderkey").alias("_last"))
    steps = [
        migrations.Migration("0002_priority", lambda t: t.withColumn("priority_rank", part(1).cast("int")).withColumn("priority", part(2)).drop("o_orderpriority")),
        migrations.Migration("0001_orders", lambda _: o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")),
        migrations.Migration("0004_last_order", lambda t: t.join(last(t), "o_custkey").withColumn("is_last", F.col("o_orderkey") == F.col("_last")).drop("_last")),
        migrations.Migration("0003_status", lambda t: t.withColumn("status", word).drop("o_orderstatus")),
    ]
    held = migrations.VersionedTable(spark, Scratch(spark, "migrations").path("orders"))
    migrations.migrate(held, steps[:2])
    lost = not held.commit(o.limit(0), ["0002_other"], 1)
    migrations.migrate(held, steps)
    again = len(migrations.migrate(held, steps))
    return held.read().select(
        "o_orderkey", "o_custkey", "status", "o_totalprice", "priority_rank", "priority", "is_last", F.lit(held.entries()[-1].version).alias("version"), F.lit(lost).alias("lost"), F.lit(again).alias("again")
    )


# ---------------------------------------------------------------- folders

_PACKS = "select doc_id // 100 as p, string_agg(cast(doc_id as varchar) || ' ' || coalesce(text, ''), chr(10) order by doc_id) as c from documents group by doc_id // 100"


@query(
    f"""with x as ({_PACKS}), y as (select p, sha256(c) as h, octet_length(encode(c)) as n from x)
    select 'p-' || p || '.txt' as name, case p % 4 when 0 then 'same' when 1 then 'changed' when 2 then 'new' else 'same' end as state, n as length, h as sha256, cast(null as varchar) as copy_of from y
    union all select 'z-' || p || '.txt', 'new', n, h, 'p-' || p || '.txt' from y where p % 4 = 3
    union all select 'lost-' || p || '.txt', 'gone', n, h, null from y where p % 4 = 0"""
)
def s_import_folder(spark: SparkSession, d: str) -> DataFrame:
    """A folder imported twice: in between files change, come (some with bytes that are known) and go."""
    ship_package(spark)
    scratch = Scratch(spark, "inbox")
    k = F.floor(F.col("doc_id") / 100).cast("long")
    line = F.struct("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.coalesce("text", F.lit(""))).alias("said"))
    packs = table(spark, d, "documents").groupBy(k.alias("p")).agg(F.array_join(F.array_sort(F.collect_list(line))["said"], "\n").alias("content"))
    packs = scratch.table(packs.select("p", F.concat(F.lit("p-"), F.col("p").cast("string"), F.lit(".txt")).alias("path"), "content"), "packs")
    root, turn = scratch.path("inbox"), F.col("p") % 4
    first = packs.filter(turn != 2).select("path", F.when(turn == 1, F.concat(F.lit("old "), F.col("content"))).otherwise(F.col("content")).alias("content"))
    files.write_files(first, root).count()
    seen = scratch.table(folders.remember(folders.import_folder(spark, root, spark.createDataFrame([], folders.REMEMBERED), glob="*.txt")), "seen")
    gone = seen.filter(F.regexp_extract("path", r"p-(\d+)\.txt$", 1).cast("long") % 4 == 0).withColumn("path", F.replace("path", F.lit("/p-"), F.lit("/lost-")))
    then = packs.filter(turn.isin(1, 2)).select("path", "content").unionByName(packs.filter(turn == 3).select(F.replace("path", F.lit("p-"), F.lit("z-")).alias("path"), "content"))
    files.write_files(then, root).count()
    found = folders.import_folder(spark, root, seen.unionByName(gone), glob="*.txt")
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    return found.select(name("path").alias("name"), "state", "length", "sha256", name("copy_of").alias("copy_of"))


# ---------------------------------------------------------------- the monitor's side inputs

_TURN = "doc_id % 12"


@query(
    f"""select doc_id as task_id, doc_id as seq, case {_TURN}
      when 0 then 'own words ' || source when 1 then 'screen include (age): ' || source when 2 then 'adjudicated exclude: ' when 3 then 'rct, n=' || n_chars || ', 2 outcome(s); pain lower [abstract-only]' when 4 then 'design?, n=None, 0 outcome(s)'
      when 5 then 'rob2 -> low; GRADE high' when 6 then 'verifier: 3 check(s), 2 fail' when 7 then 'query q' || doc_id || ': None hits' when 8 then 'first line of ' || source when 9 then '(no diagnostic recorded)' when 10 then '-> r/' || doc_id || '.json' else '(no output_path)' end as receipt
    from (select doc_id, coalesce(source, 'none') as source, coalesce(n_chars, 0) as n_chars from documents)"""
)
def t_receipts(spark: SparkSession, d: str) -> DataFrame:
    """A stream of task records beside lines of other shapes, joined with the result files as they are when a batch runs."""
    scratch = Scratch(spark, "receipts")
    x = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"), (F.col("doc_id") % 12).alias("turn"))
    out = F.concat(F.lit("r/"), F.col("doc_id").cast("string"), F.lit(".json"))
    record = (
        F.when(F.col("turn") == 1, F.format_string('{"decision": "include", "reason": "%s", "criterion_failed": "age"}', "source")).when(F.col("turn") == 2, F.lit('{"final_decision": "exclude", "rationale": null}'))
        .when(F.col("turn") == 3, F.format_string('{"outcomes": [{"name": "pain", "direction": "lower"}, 7], "design": "rct", "n_total": %d, "evidence_basis": "abstract_only"}', "n_chars"))
        .when(F.col("turn") == 4, F.lit('{"design": null, "outcomes": null}')).when(F.col("turn") == 5, F.lit('{"overall_judgement": "low", "tool": "rob2", "grade": {"certainty": "high"}}'))
        .when(F.col("turn") == 6, F.lit('{"checks": [{"status": "fail"}, {"status": "pass"}, {"status": "fail"}]}')).when(F.col("turn") == 7, F.format_string('{"query_string": "x", "query_id": "q%d"}', "doc_id"))
        .when(F.col("turn") == 10, F.lit('{"unknown": 1}'))
    )
    results = x.select(F.format_string('{"output_path": "%s", "record": %s}', out, record).alias("value")).filter(record.isNotNull())
    results.write.text(scratch.path("results"))
    task = F.struct(
        F.col("doc_id").cast("string").alias("task_id"), F.col("doc_id").alias("seq"), F.when(F.col("turn").isin(8, 9), "failed").otherwise("completed").alias("status"),
        F.when(F.col("turn") == 0, F.concat(F.lit("  own words "), F.col("source"), F.lit("\n"))).alias("summary"), F.when(F.col("turn") == 8, F.concat(F.lit("\nfirst line of "), F.col("source"), F.lit("\nmore"))).alias("error"), F.when(F.col("turn") < 11, out).alias("output_path"),
    )
    lines = x.select(F.to_json(task).alias("value")).unionByName(results).unionByName(x.select(F.lit('{"task_id": "torn", "se').alias("value")))
    lines.repartition(6).write.text(scratch.path("log"))
    stream = side_inputs.read_task_stream(spark, scratch.path("log"), files_per_batch=2)
    said = side_inputs.receipts(stream, side_inputs.read_results(spark, scratch.path("results"))).select(F.col("task_id").cast("long").alias("task_id"), "seq", "receipt")
    monitor.run_to_folder(said, scratch.root.rpartition("/")[2] + "-log", scratch.path("said")).awaitTermination()
    return spark.read.schema("task_id long, seq long, receipt string").parquet(scratch.path("said"))


@query(
    """with x as (select doc_id, coalesce(source, 'none') as source, coalesce(lang, 'none') as lang from documents)
    select 'm-' || doc_id || '.md' as path, b as block, case b when 1 then 'First ' || source else 'Second ' || lang end as title, case b when 1 then 'pmid:' || doc_id else case when doc_id % 3 = 0 then 'doi:x' end end as evidence_id,
      case when b = 1 and doc_id % 2 = 0 then cast(doc_id as varchar) end as pmid, null::int as tier, null as status, null as attempted from x, unnest([1, 2]) as u(b) where b = 1 or doc_id % 3 = 0
    union all select 'm-' || doc_id || '.md', 1, 'No ids', null, null, null, null, null from x where doc_id % 4 = 9
    union all select null, null, null, 'pmid:' || doc_id, null, case doc_id % 3 when 0 then 5 when 1 then 10 else null end, case doc_id % 3 when 0 then source when 1 then lang end, case doc_id % 3 when 0 then '0,5' when 1 then '2,10,11' else '' end from x where doc_id % 5 <> 4"""
)
def e_side_inputs(spark: SparkSession, d: str) -> DataFrame:
    """A list of missing texts and a rung file for each document; some rung files are torn, some entries are no rungs."""
    x = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("lang", F.lit("none")).alias("lang"), F.col("doc_id").cast("string").alias("s"))
    k, cat, lit = F.col("doc_id"), F.concat, F.lit
    text = cat(
        lit("# Missing\nintro\n- PMID: 0\n## First "), F.col("source"), lit(" \n- evidence_id: pmid:"), F.col("s"), F.when(k % 2 == 0, cat(lit("\nwords\n- PMID: "), F.col("s"))).otherwise(""), lit("\r\n## Second "), F.col("lang"),
        F.when(k % 3 == 0, "\n- evidence_id: old\n- evidence_id: doi:x\n").otherwise("\n### not a block\n"),
    )
    blocks = side_inputs.missing_blocks(x.select(cat(lit("m-"), F.col("s"), lit(".md")).alias("path"), text.alias("text")))
    rungs = (
        F.when(k % 5 == 4, "{torn").when(k % 3 == 0, F.format_string('{"evidence_id": "pmid:%d", "rungs": {"0": {"status": "no"}, "5": {"status": "%s"}}}', "doc_id", "source"))
        .when(k % 3 == 1, F.format_string('{"evidence_id": "pmid:%d", "rungs": {"2": {"status": "no"}, "10": {"status": "%s"}, "11": "none", "x": {}}}', "doc_id", "lang")).otherwise(F.lit("{}"))
    )
    best = side_inputs.best_rungs(x.select(cat(lit("workspace/retrieve/pmid:"), F.col("s"), lit(".json")).alias("path"), rungs.alias("text")))
    left = blocks.select("path", "block", "title", "evidence_id", "pmid", lit(None).cast("int").alias("tier"), lit(None).cast("string").alias("status"), lit(None).cast("string").alias("attempted"))
    none = [lit(None).cast(t).alias(c) for c, t in (("path", "string"), ("block", "int"), ("title", "string"))]
    return left.unionByName(best.select(*none, "evidence_id", lit(None).cast("string").alias("pmid"), "tier", "status", F.array_join(F.col("attempted").cast("array<string>"), ",").alias("attempted")))


@query("select doc_id, 1 as batch from documents where doc_id % 3 = 1")
def t_guarded(spark: SparkSession, d: str) -> DataFrame:
    """Three snapshots of a corpus arrive one after another, the last one torn: the second stays published."""
    scratch = Scratch(spark, "guarded")
    x = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3).alias("turn"), F.to_json(F.struct(F.concat(F.lit("pmid:"), F.col("doc_id").cast("string")).alias("evidence_id"), "doc_id")).alias("value"))

    def publish(batch: DataFrame, number: int) -> None:
        records = batch.select(F.from_json("value", "doc_id long")["doc_id"].alias("doc_id"), F.lit(number).alias("batch"))
        records.write.mode("overwrite").parquet(scratch.path(f"published-{number}"))

    for turn in range(3):  # each run of the stream takes what is new as one batch
        line = F.when((F.lit(turn) == 2) & (F.col("doc_id") % 5 == 0), F.substr("value", F.lit(1), F.lit(9))).otherwise(F.col("value"))
        x.filter(F.col("turn") == turn).select(line.alias("value")).write.text(scratch.path(f"snapshots/{turn}"))
        stream = spark.readStream.schema("value string").option("recursiveFileLookup", "true").text(scratch.path("snapshots"))
        monitor.guarded(stream, scratch.root.rpartition("/")[2] + "-log", monitor.whole_snapshot, publish).awaitTermination()
    last = max(n for n in range(3) if path_exists(spark, scratch.path(f"published-{n}/_SUCCESS")))
    return spark.read.schema("doc_id long, batch int").parquet(scratch.path(f"published-{last}"))


__all__ = ["ORACLE_SQL", "QUERIES"]
