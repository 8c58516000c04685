"""The driver's tables as the engine's entities, stated once as SQL that every engine reads alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Entities by name: plain projections of one table, or of documents with their labels.
ENTITIES = {
    "papers": """
        select doc_id as paper_id, concat('pmid:', cast(doc_id as string)) as evidence_id, substr(text, 1, 60) as title,
          concat('Journal of ', source) as journal, lang, source, text,
          case when doc_id % 11 = 0 then null when doc_id % 7 = 0 then 'n.d.'
            else concat(cast(1990 + doc_id % 35 as string), '-0', cast(1 + doc_id % 9 as string)) end as publication_date,
          case when doc_id % 3 = 0 then 'review' else 'article' end as paper_type,
          doc_id * 7919 % 100003 as created_at, case when doc_id % 13 = 0 then 1 else null end as deleted_at
        from documents""",
    "records": """
        select d.doc_id as rid, concat('pmid:', cast(d.doc_id as string)) as evidence_id, cast(d.doc_id as string) as pmid,
          case when l.quality = 1 then 'include' when l.quality = 0 then 'exclude' else null end as decision,
          case when d.doc_id % 5 = 0 then 'missing' when d.doc_id % 5 = 1 then 'abstract_only' else 'fulltext' end as ft_status,
          case when d.doc_id % 10 = 0 then null when d.doc_id % 5 = 0 then 'quarantine' else 'pmc' end as access_route,
          case when d.doc_id % 10 = 0 then null when d.doc_id % 5 = 0 then 8 else cast(d.doc_id % 8 as int) end as source_tier,
          case when d.doc_id % 2 = 0 then 'x.json' else null end as extraction_path,
          case when d.doc_id % 4 = 0 then 'a.json' else null end as appraisal_path,
          case when l.toxic = 1 then 'retracted' else 'none' end as retraction_status,
          d.doc_id % 6 = 0 as is_preprint, d.doc_id % 10 = 1 as truncation_detected, d.source, d.lang, d.n_chars
        from documents d left join labels l on d.doc_id = l.doc_id""",
    "verdicts": """
        select concat('pmid:', cast(doc_id as string)) as evidence_id, 'screener-a' as screener_id,
          case when quality = 1 then 'include' else 'exclude' end as decision, 'quality' as reason,
          case when quality = 1 then null else 'low quality' end as criterion_failed,
          case when toxic = 1 then 'retracted' else 'none' end as retraction_flag from labels
        union all
        select concat('pmid:', cast(doc_id as string)) as evidence_id, 'screener-b' as screener_id,
          case when toxic = 0 then 'include' else 'exclude' end as decision, 'toxicity' as reason,
          case when toxic = 0 then null else 'toxic' end as criterion_failed, 'none' as retraction_flag from labels where doc_id % 4 <> 3""",
    "adjudications": """
        select concat('pmid:', cast(doc_id as string)) as evidence_id, 'unclear' as final_decision, 'third reader' as rationale
        from labels where doc_id % 5 = 0""",
    "log": """
        select cast(user_id as string) as task_id, event_id as seq, event_type, ts,
          case event_type when 'click' then 'active' when 'purchase' then 'completed' when 'view' then 'pending' when 'signup' then 'failed' else 'blocked' end as status,
          case user_id % 4 when 0 then 'search' when 1 then 'screen' when 2 then 'adjudicate' else 'extract' end as stage,
          concat('h', cast(event_id % 3 as string)) as inputs_hash, value from events""",
    "vectors": "select vec_id as evidence_id, embedding as vector, concat('m', cast(label % 2 as string)) as model from embeddings",
    "sources": "select doc_id as paper_id, concat('s', cast(doc_id as string)) as source_id, text, concat('u', cast(doc_id as string)) as url from documents",
    "attachments": "select l_orderkey * 10 + l_linenumber as attachment_id, l_orderkey as paper_id, l_partkey as asset_id, l_linenumber, l_quantity, l_shipdate from lineitem",
    "identifiers": """
        select l_orderkey as paper_id, case when l_linenumber % 2 = 0 then 'doi' else 'pmid' end as scheme, l_partkey as value,
          l_returnflag = 'R' as is_primary, l_shipdate as created_at, l_orderkey * 10 + l_linenumber as id from lineitem""",
}


def entity(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An entity over the tables of a folder."""
    sql = ENTITIES[name]
    used = [t for t in TABLES if f"from {t}" in sql or f"join {t}" in sql]
    frames = {t: table(spark, sf_dir, t) for t in used}
    for t in used:
        sql = sql.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
    return spark.sql(sql, **frames)


def with_entities(sql: str, *names: str) -> str:
    """SQL with the entities as common table expressions in front."""
    sql = sql.strip()
    sql = ", " + sql[4:] if sql.startswith("with") else sql
    return "with " + ",\n".join(f"{n} as ({ENTITIES[n]})" for n in names) + "\n" + sql
