"""More queries of the catalog: organisation, sinks, incremental runs, monitor, report checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import measures as M
from quillspark.operators import figures, incremental, organisation, provenance, reports, screening, tasks
from quillspark.plans.adapters import entity
from quillspark.plans.catalog import _corpus, _records, _snapshots, query
from quillspark.session import table
from quillspark.sources import readers, sinks


@query(r"""select page_id, regexp_matches(lower(url), '^https?://[^/?#@]+([/?#]|$)') as ok from pages""")
def f_fetchable_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", organisation.fetchable(F.col("url")).alias("ok"))


@query(
    """, a as (select task_id as p, seq, case event_type when 'error' then 'delete' when 'signup' then 'restore' else 'update' end as act, ts, value from log)
    select p as paper_id, arg_max(value, seq) filter (where act = 'update') as last_value, case when arg_max(act, seq) filter (where act <> 'update') = 'delete' then true else false end as deleted from a group by p""",
    "log",
)
def d_fold_papers(spark: SparkSession, d: str) -> DataFrame:
    ev = entity(spark, d, "log").select(
        F.col("task_id").alias("paper_id"), "seq", F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "restore").otherwise("update").alias("action"),
        F.when(~F.col("event_type").isin("error", "signup"), F.create_map(F.lit("value"), F.col("value"))).alias("metadata"), F.lit(None).cast("string").alias("citation_key"), F.col("ts").alias("at"),
    )
    out = organisation.fold_papers(ev)
    return out.select("paper_id", F.try_element_at("metadata", F.lit("value")).alias("last_value"), F.col("deleted_at").isNotNull().alias("deleted"))


@query("select o_orderkey, case when o_orderkey % 7 = 0 then 'delete' when o_orderkey % 7 = 1 then 'create' else 'update' end as action from orders where o_orderkey % 7 < 2 or o_orderkey % 5 = 0")
def d_audit_trail(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderkey")
    after = o.filter(k % 7 != 0).withColumn("o_orderstatus", F.when(k % 5 == 0, "changed").otherwise(F.col("o_orderstatus")))
    return organisation.audit_trail(o.filter(k % 7 != 1), after, "o_orderkey", F.lit("t")).select("o_orderkey", "action")


@query("select distinct o_custkey, o_orderpriority from orders where o_orderstatus <> 'P'")
def d_tag_links(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    links = organisation.add_links(o.filter("o_orderstatus = 'O'").select("o_custkey", "o_orderpriority"), o.filter("o_orderstatus <> 'O'"), "o_custkey", "o_orderpriority")
    gone = o.filter("o_orderstatus = 'P'").join(o.filter("o_orderstatus <> 'P'").select("o_custkey", "o_orderpriority"), ["o_custkey", "o_orderpriority"], "left_anti")
    return organisation.remove_links(links, gone, "o_custkey", "o_orderpriority")


@query("select l_orderkey * 10 + l_linenumber as attachment_id, row_number() over (partition by l_orderkey order by l_returnflag = 'R' desc, l_shipdate, l_linenumber) as rank from lineitem")
def w_preferred_attachments(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("attachment_id"), (F.col("l_returnflag") == "R").alias("is_preferred"), F.col("l_shipdate").alias("created_at"))
    return organisation.preferred(a).select("attachment_id", F.col("rank").cast("long").alias("rank"))


@query("select l_orderkey, l_linenumber, case when l_orderkey % 3 = 0 then 0.0 else l_quantity end as q from lineitem where l_orderkey % 3 <> 0 or l_linenumber = 1")
def d_replace_rows(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"))
    new = li.filter("l_orderkey % 3 = 0 and l_linenumber = 1").withColumn("q", F.lit(0.0))
    gone = li.filter("l_orderkey % 3 = 0").join(new.select("l_orderkey"), "l_orderkey", "left_anti")
    return organisation.delete_rows(organisation.replace_rows(li, new, "l_orderkey"), gone, "l_orderkey")


@query()
def x_figure_search(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("figure_id"), (F.col("p_partkey") % 50).alias("paper_id"), F.col("p_size").alias("page"), F.col("p_name").alias("caption"))
    papers = p.select("paper_id", F.when(F.col("paper_id") % 5 == 0, 1).alias("deleted_at")).distinct()
    q = table(spark, d, "part").filter("p_partkey = 1").select(F.lit(1).alias("query_id"), F.col("p_name").alias("q"))
    return organisation.figure_search(p, q, papers).select("doc", F.round("score", 6).alias("score"), "rank")


@query()
def d_figure_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions over boxes made from the words of each document: a line of ten words, a gap before every twentieth line."""
    w = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("page_id"), F.posexplode(F.split("text", " ")).alias("k", "text"))
    line = F.floor(F.col("k") / 10)
    y = line * 12 + F.floor(line / 20) * 200
    word = F.when((F.col("k") % 200 == 0) & (F.col("k") > 0), F.concat(F.lit("Figure "), F.col("text"))).otherwise(F.col("text"))
    x = (F.col("k") % 10) * 50.0
    return figures.figure_regions(w.select("page_id", F.lit(600.0).alias("page_width"), word.alias("text"), x.alias("x0"), y.cast("double").alias("y0"), (x + 45).alias("x1"), (y + 10).cast("double").alias("y1")))


@query("select o_orderkey, cast(floor((row_number() over (order by o_orderkey) - 1) / 200) as int) as batch from orders")
def e_batches(spark: SparkSession, d: str) -> DataFrame:
    return organisation.batches(table(spark, d, "orders").select("o_orderkey"), 200, "o_orderkey")


@query()
def e_synthetic_papers(spark: SparkSession, d: str) -> DataFrame:
    return organisation.synthetic_papers(spark, table(spark, d, "documents").count())


@query("select sha256(text) as sha256, octet_length(encode(text)) as size, count(*) as uses from documents where text is not null group by text")
def s_content_addressed(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    fresh, named = sinks.content_addressed(f, f.select(F.lit("").alias("sha256")).limit(0))
    return fresh.drop("content").join(named.groupBy("sha256").agg(F.count(F.lit(1)).alias("uses")), "sha256")


@query()
def s_bibtex(spark: SparkSession, d: str) -> DataFrame:
    return sinks.bibtex(_bibliographic(spark, d))


@query()
def s_ris(spark: SparkSession, d: str) -> DataFrame:
    return sinks.ris(_bibliographic(spark, d))


def _bibliographic(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return _corpus(spark, d).withColumns({c: none for c in ("volume", "issue", "pages", "issn", "abstract", "url")}).withColumn("publication_date", F.lit("2020-05")).withColumn("authors", F.array(F.lit("Doe JA"), F.lit("Study Group")))


@query("select l_partkey as asset, count(*) as uses, min(l_orderkey) as first from lineitem group by l_partkey")
def s_export_files(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").select(F.col("l_partkey").alias("sha256"), F.col("l_orderkey").alias("path"), F.col("l_orderkey").alias("evidence_id"), F.when(F.col("l_linenumber") == 1, "primary").otherwise("supplement").alias("role"))
    files = sinks.export_bundle(_bibliographic(spark, d).limit(0), a)["files"]
    return files.select(F.col("sha256").alias("asset"), F.size("uses").cast("long").alias("uses"), F.col("path").alias("first"))


@query(
    """select count(*) as selected, count(*) filter (where p > 0) as with_primary, count(*) filter (where p = 0) as metadata_only, sum(s) as supplements from
      (select o_orderkey, count(*) filter (where l_linenumber = 1) as p, count(*) filter (where l_linenumber > 1) as s from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey)"""
)
def a_export_counts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("evidence_id"), F.when(F.col("l_linenumber") == 1, "primary").otherwise("supplement").alias("role"))
    return sinks.export_counts(table(spark, d, "orders").select(F.col("o_orderkey").alias("evidence_id")), a)


@query("select o_orderkey as evidence_id from orders where o_orderkey % 11 = 0 union all select -1 union all select -2")
def e_select_export(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("evidence_id"))
    ids = r.filter("evidence_id % 11 = 0").unionByName(spark.createDataFrame([(-1,), (-2,)], "evidence_id long"))
    found, unresolved = sinks.select_export(r, ids)
    return found.unionByName(unresolved)


@query("select doc_id, 'https://doi.org/10.1/' || cast(doc_id as varchar) as doi_url from documents where doc_id % 3 <> 0")
def f_missing_fulltext(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    r = table(spark, d, "documents").select(k.cast("string").alias("evidence_id"), F.lit("t").alias("title"), F.when(k % 3 == 0, "available").when(k % 3 == 1, "missing").alias("asset_status"), F.lit("s").alias("status"), F.concat(F.lit("10.1/"), k.cast("string")).alias("doi"), F.lit(None).cast("string").alias("pmid"))
    return incremental.missing_fulltext(r).select(F.col("evidence_id").cast("long").alias("doc_id"), "doi_url")


@query("select o_orderkey as attachment_id from orders where not (o_orderstatus = 'F' and o_orderkey % 4 <> 0)")
def i_to_process(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    a = o.select(F.col("o_orderkey").alias("attachment_id"), F.col("o_orderpriority").alias("asset_sha256"), F.lit("x").alias("extractor"), F.lit("{}").alias("options_json"), "o_orderstatus")
    state = a.withColumn("status", F.when(F.col("o_orderstatus") == "F", "complete").otherwise("running")).withColumn("n_results", F.when(F.col("attachment_id") % 4 != 0, 0))
    return incremental.to_process(a, state).select("attachment_id")


@query(""", c as (select task_id, arg_max(status, seq) as status, arg_max(inputs_hash, seq) as h from log group by task_id) select task_id from c where status = 'completed' and h = 'h1'""", "log")
def i_reusable_tasks(spark: SparkSession, d: str) -> DataFrame:
    now = tasks.current(entity(spark, d, "log"))
    return tasks.reusable(now, now.select("task_id", F.lit("h1").alias("inputs_hash"))).select("task_id")


@query("select item_id, item_id % 10 as existing from benchmark where item_id >= 10")
def i_repeated_queries(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select("item_id", F.concat(F.lit(" Sepsis  and ( Shock"), (F.col("item_id") % 10).cast("string"), F.lit(" )")).alias("query_string"))
    logged = b.filter("item_id < 10").select(F.col("item_id").alias("query_id"), F.upper("query_string").alias("query_string"))
    return incremental.repeated_queries(b.withColumn("query_id", F.col("item_id")), logged).select("item_id", F.col("existing"))


@query("select l_orderkey as evidence_id, arg_max(l_partkey, (l_shipdate, l_partkey)) as source_id from lineitem where l_partkey % 2 = 0 group by l_orderkey")
def w_freshest_source(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("evidence_id"), F.col("l_partkey").alias("source_id"), F.col("l_shipdate").alias("synced_at"))
    return incremental.freshest_source(p, table(spark, d, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("source_id")))


@query("""select count(*) as snapshots, count(*) filter (where doc_id % 19 <> 0) as intact, count(*) filter (where doc_id % 19 = 0) as tampered, sum(length(text)) + count(*) filter (where doc_id % 19 = 0) as chars from documents""")
def a_store_stats(spark: SparkSession, d: str) -> DataFrame:
    ev = spark.createDataFrame([], "type string, fresh boolean, source_id string")
    return provenance.store_stats(_snapshots(spark, d), ev)[0]


@query(
    """, c as (select task_id, arg_max(status, seq) as status, arg_max(ts, seq) as ts, arg_max(user, seq) as w from (select *, concat('w', cast(seq % 7 as varchar)) as user from log) group by task_id),
      f as (select count(*) filter (where decision = 'include') as a, count(*) filter (where decision = 'include' and ft_status = 'missing' and access_route is not null) as u from records)
    select 'articles' as name, cast((select a from f) as double) as used, 100.0::double as cap union all select 'subagents', cast((select count(distinct w) from c) as double), 5.0 union all
    select 'ft-fail', cast((select u from f) as double), null""",
    "log", "records",
)
def a_budget_usage(spark: SparkSession, d: str) -> DataFrame:
    t = tasks.current(entity(spark, d, "log").withColumn("worker", F.concat(F.lit("w"), (F.col("seq") % 7).cast("string")))).withColumn("created_at", F.col("ts"))
    got = tasks.budget_usage(t, screening.funnel(_records(spark, d)), F.lit("2024-03-01").cast("timestamp"), {"articles": 100, "subagents": 5, "wall": 3600})
    return got.filter("name <> 'wall'").select("name", "used", "cap")


@query()
def t_alerts(spark: SparkSession, d: str) -> DataFrame:
    t = tasks.current(entity(spark, d, "log")).withColumn("created_at", F.col("ts")).withColumn("updated_at", F.col("ts")).withColumn("worker", F.col("task_id")).withColumn("error", F.lit(None).cast("string"))
    now = F.lit("2024-03-01").cast("timestamp")
    r = _records(spark, d)
    budgets = tasks.budget_usage(t, screening.funnel(r), now, {"articles": 10, "wall": 60})
    checks = spark.createDataFrame([("C-SPAN", "fail", "2 violations"), ("C-UNCITED", "pass", "")], "check_id string, status string, detail string")
    handoffs = spark.createDataFrame([("needs_mcp", None)], "status string, result_path string")
    return tasks.alerts(t, tasks.stalls(t, now, 3600), budgets, checks, screening.screening_views(r)["quarantined"], handoffs)


@query()
def v_verify_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    text = F.concat(F.lit("# Findings\n"), F.regexp_replace("text", "\n", " "), F.lit(" [^"), F.col("doc_id").cast("string"), F.lit("]\n\nProvisional.\n"))
    lines = readers.scan_report(docs.select(F.col("doc_id").alias("report_id"), text.alias("text")))
    r = _records(spark, d).withColumn("noted", F.col("rid") % 2 == 0)
    notes = r.filter("rid % 13 <> 0").select(F.col("rid").cast("string").alias("key"), "evidence_id")
    counts = spark.createDataFrame([("sought", 3)], "name string, n int")
    searches = spark.createDataFrame([(True,)], "hit_count_logged boolean")
    quotes = spark.createDataFrame([(True,), (False,)], "ok boolean")
    bad = spark.createDataFrame([], "evidence_id string")
    return reports.verify_report(lines, notes, r, counts, counts, searches, quotes, screening.screening_views(r)["quarantined"].select("evidence_id"), bad)


@query("select doc_id, len(regexp_extract_all(text, 'https?://[^\\s\"\\\\<>]+')) > 0 as has_url, contains(lower(text), 'disgusting') as flagged from documents")
def e_urls_and_lint(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").withColumn("kind", F.lit("prose"))
    flagged = readers.lint(t, ["Disgusting"]).select("doc_id", F.lit(True).alias("_f"))
    return t.select("doc_id", (F.size(readers.urls_in(t, "text")) > 0).alias("has_url")).join(flagged, "doc_id", "left").select("doc_id", "has_url", F.coalesce("_f", F.lit(False)).alias("flagged"))


@query("""select evidence_id, concat_ws(' ', '(2020)', nullif(trim(title), ''), journal, case when rid % 9 = 0 then concat('doi:10.1/', cast(rid % 45 as varchar)) end) as line from
      (select paper_id as rid, concat('url:', cast(paper_id as varchar)) as evidence_id, title, journal from papers)""", "papers")
def e_biblio_block(spark: SparkSession, d: str) -> DataFrame:
    return reports.biblio_block(_corpus(spark, d).withColumn("publication_date", F.lit("2020-05")))


@query("select doc_id, case when n > 0 then concat(cast(cast(floor(n / 60) as int) as varchar), 'm') end as shown from (select doc_id, 60 + n_chars % 3000 as n from documents)")
def p_durations(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select("doc_id", M.parse_duration(F.concat((60 + F.col("n_chars") % 3000).cast("string"), F.lit("s"))).alias("s"))
    return n.select("doc_id", M.fmt_duration(F.col("s")).alias("shown"))
