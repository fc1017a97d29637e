"""Explicit schemas of the catalog tables as DDL, versioned together."""

from __future__ import annotations

#: Registers indexed under another version are indexed anew. Fixed value.
INDEXER_VERSION = 2

ORGANIZATIONS = "id string, name string, description string, url string, maintainers array<struct<github:string,email:string>>"
REGISTERS = (
    "id string, org_id string, name string, register_url string, viewer_url string, description string, modified string, indexer_version int, "
    "status string, last_crawled_at timestamp, last_crawl_status string, last_error string"
)
ITEMS = (
    "id string, register_id string, name string, abstract string, status string, item_class string, version string, tags array<string>, "
    "date_time_addition string, date_of_last_change string, has_schema boolean, has_ld_context boolean, has_shacl_shapes boolean, "
    "schema_urls map<string,string>, ld_context_url string, shacl_shapes_urls array<string>, sources array<struct<title:string,link:string>>"
)
ITEM_EDGES = "source_id string, target_id string, kind string"
REGISTER_EDGES = "source_register_id string, target_register_id string, kind string"
CONFLICTS = "conflicting_id string, existing_register_id string, attempted_register_id string, detected_at timestamp"
RUNS = "run_id string, register_id string, started_at timestamp, finished_at timestamp, status string, error string"
CHUNKS = (
    "chunk_key string, text string, chunk_type string, org string, register_url string, item_id string, item_class string, status string"
)
#: What a fetch gives: the body, or why there is none.
DOCUMENTS = "url string, body string, error string"
