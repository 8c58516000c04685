"""Explicit schemas of the records; nothing is inferred on reading."""

from __future__ import annotations

FULLTEXT = "status string, source_tier int, access_route string, local_path string, sha256 string, truncation_detected boolean"
CORPUS = (
    "schema_version int, evidence_id string, pmid string, doi string, pmcid string, title string, journal string, publication_date string, "
    "authors array<string>, article_types array<string>, mesh_terms array<string>, keywords array<string>, retraction_status string, source string, "
    f"is_preprint boolean, screening struct<decision:string,reason:string>, fulltext struct<{FULLTEXT.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean').replace(', ', ',')}>, "
    "extraction_path string, appraisal_path string, first_seen_query string, seen_in_queries array<string>, merged_from array<string>, "
    "source_ids array<string>, volume string, issue string, pages string, issn string, epub_date string, abstract string, grants array<string>, url string"
)
REGISTRY = CORPUS + ", status string, metadata_status string, asset_status string, extraction_status string, appraisal_status string, appraisals map<string,string>, refmgr_paper_id string"
VERDICT = "pmid string, decision string, reason string, criterion_failed string, retraction_flag string, screener_id string, confidence double"
ADJUDICATION = "pmid string, screener_a_decision string, screener_b_decision string, final_decision string, rationale string, adjudicator_id string"
TASK = "task_id string, stage string, status string, inputs_hash string, attempts int, worker string, output_path string, error string, summary string, created_at string, updated_at string"
SNAPSHOT = "source_id string, content_hash string, url string, title string, retrieved_at string, access string, paper struct<pmid:string,doi:string,pmcid:string>, origin string, asset struct<path:string,sha256:string,bytes:bigint>, text string"
EVENT = "event_id string, type string, source_id string, url string, at string, fresh boolean, sha256 string, actor string, detail string"
SPAN = "claim string, evidence_id string, source_id string, start int, end int, access string, excerpt string"
ANNOTATION = "evidence_id string, tags array<string>, rating int, note string, updated_at string"
VECTOR = "evidence_id string, model string, dim int, vector array<float>, updated_at string"
SEARCH = "query_id string, query_string string, translated_query string, source string, count bigint, retrieved_ids array<string>, retrieved_pmids array<string>, retstart int, retmax int, executed_at string, hit_count_logged boolean"
OUTCOME = "name:string,timepoint:string,effect_measure:string,effect:double,ci_low:double,ci_high:double,p_value:double,direction:string,spans:array<struct<source_id:string,start:int,end:int>>"
EXTRACTION = f"evidence_id string, pmid string, design string, n_total int, n_arms array<int>, population string, intervention string, comparator string, outcomes array<struct<{OUTCOME}>>, evidence_basis string, quotes array<struct<text:string,section:string,page:int,source_id:string,start:int,end:int>>"
APPRAISAL = "evidence_id string, tool string, tool_variant string, target_type string, domains array<struct<domain:string,domain_group:string,judgement:string,rationale:string>>, overall_judgement string, evidence_basis string"
# Closed vocabularies.
DECISIONS = ("include", "exclude", "unclear")
RETRACTION = ("none", "retracted", "expression_of_concern", "corrected")
SOURCES = ("pubmed", "europepmc", "preprint", "guideline", "web", "pool")
FULLTEXT_STATUS = ("fulltext", "abstract_only", "missing")
