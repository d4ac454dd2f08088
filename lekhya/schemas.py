"""Record tables as Spark DDL.  Nested data are real arrays, structs and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES: dict[str, str] = {
    "sources": "source_id string, name string, department_id string, owner_name string, owner_contact string, written_authority_ref string, permitted_domains array<string>, permitted_path_prefixes array<string>, access_classification string, refresh_cadence string, rate_limit_per_minute int, status string",
    "documents": "document_id string, source_id string, department_id string, doc_type string, title string, language string, authority_level string, classification string, current_version_id string, lifecycle_status string",
    "document_versions": "version_id string, document_id string, source_url string, source_locator string, issued_on date, effective_from date, effective_to date, go_number string, gazette_number string, supersedes_version_id string, sha256 string, mime_type string, byte_size bigint, retrieved_at timestamp, http_headers map<string,string>, original_object_key string, provenance_status string",
    "document_pages": "page_id string, version_id string, page_number int, clean_text string, raw_text string, ocr_text string, selected_text string, is_scanned boolean, detected_language string, word_count int, text_confidence double, review_status string",
    "precedent_references": "edge_id string, source_version_id string, raw_text string, cited_order_number string, cited_date date, cited_act_or_rule string, target_document_id string, relation_type string",
    "document_attributes": "version_id string, subject string, issuing_authority_title string, signatory_name string, order_number string, order_date date, language_distribution struct<hi_pct:int,en_pct:int>",
    "ingestion_runs": "run_id string, source_id string, count_found int, count_downloaded int, failures array<struct<stage:string,url:string,error:string>>, started_at timestamp",
    "access_grants": "subject_id string, document_id string, classification string, action string, expires_at timestamp",
    "audit_events": "event_id string, entity_type string, entity_id string, action string, actor string, details map<string,string>, at timestamp",
    "text_blocks": "block_id string, page_id string, block_type string, text string, bbox array<double>, reading_order int, confidence double",
    "extracted_tables": "table_id string, page_id string, object_key string, bbox array<double>, table struct<table_index:int,headers:array<string>,rows:array<array<string>>,row_count:int,col_count:int>",
    "processing_runs": "run_id string, version_id string, parser_version string, ocr_engine string, config_hash string, result string",
    "review_annotations": "page_id string, reviewer string, corrected_text string, created_at timestamp",
    "document_chunks": "chunk_id string, document_id string, version_id string, chunk_index int, content string, token_count int, page_start int, page_end int, section_heading string, department_id string, doc_type string, classification string, order_date date, effective_from date, effective_to date, go_number string, gazette_number string, source_url string, sha256 string, review_status string, block_ids array<string>, bboxes array<array<double>>, embedding array<float>",
    "model_artifacts": "model_id string, family string, size_gb double, license_id string, license_status string, status string",
    "model_promotions": "model_id string, promoted boolean, failures array<string>, promoted_by string, authority_order_ref string, at timestamp",
    "agent_execution_audits": "query_id string, user_id string, query_text string, retrieval_passes int, answer_passes int, is_no_answer boolean, is_high_risk boolean, validation_passed boolean, final_state string, created_at timestamp",
    "chat_sessions": "session_id string, user_id string, retention_tag string, expires_at timestamp, created_at timestamp",
    "chat_turns": "turn_id string, session_id string, turn int, role string, content string, has_pii boolean, cited_chunk_ids array<string>, created_at timestamp",
    "session_summaries": "session_id string, item string, value string, turn int",
    "user_preferences": "user_id string, event_id string, deleted boolean, opt_in boolean, purpose string, data string, at timestamp",
    "answer_provenance": "request_hash string, trace_id string, session_id string, index_version_ids array<string>, status string, at timestamp",
    "feedback_records": "trace_id string, user_id string, rating int, feedback_type string, comment string, at timestamp",
    "idempotency_records": "key string, user_id string, endpoint string, request_hash string, response string, at timestamp",
    "ingestion_jobs": "job_id string, source_id string, status string, files_found int, files_done int, at timestamp",
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A record table below ``root``; columns added later read as NULL in older files."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def append_table(df: DataFrame, root: str, name: str) -> None:
    """Append rows in the declared column order and types; missing columns are NULL."""
    wanted = df.sparkSession.createDataFrame([], TABLES[name]).schema
    columns = [(df[f.name] if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
               for f in wanted.fields]
    df.select(*columns).write.mode("append").parquet(f"{root}/{name}")
