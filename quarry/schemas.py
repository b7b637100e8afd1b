"""Schemas of the tables, in one place."""

from __future__ import annotations

LISTING = "abs_path string, rel_path string, suffix string, hash string, mtime bigint, length bigint"
FILE_RECORD = "abs_path string, rel_path string, root string, hash string, mtime bigint, status string, source_deleted boolean, error string, updated_at timestamp"
INDEX_MANIFEST = "kb_id string, embedding_model string, chunk_size int, chunk_overlap int, doc_count bigint, chunk_count bigint, updated_at timestamp"
INGEST_ITEM = "run_id string, kb_id string, root string, bucket string, abs_path string, status string, reason string, created_at timestamp"
KB_PATHS = "root string, kb_id string"
DOCUMENT = "abs_path string, doc_pos int, text string, source_type string, page int, sheet string, row int, is_header boolean, error string"
CHUNK = "chunk_key string, kb_id string, root string, doc_id string, chunk_id int, source string, source_type string, page int, sheet string, row int, is_header boolean, text string, embedding array<float>"
EXCEL_ROW = "sheet string, row int, cells array<string>, text string, is_header boolean"
EVENT = "event_id string, at timestamp, kind string, request string, response string, error string"

#: The states of a file record.
INDEXED, SKIPPED, ERROR, DELETED = "indexed", "skipped", "error", "deleted"
