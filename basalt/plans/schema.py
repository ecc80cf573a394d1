"""Schemas and closed value sets of the code graph."""

from __future__ import annotations

NODE_KINDS = ("function", "class", "method", "interface", "enum", "type", "file", "community")
EDGE_KINDS = ("CALLS", "IMPORTS", "CONTAINS", "COUPLED_WITH", "TESTED_BY")
CALLABLE = ("function", "method")

NODES = (
    "id string, project string, kind string, source string, name string, path string, start_line int, end_line int, language string, content_hash string, "
    "file_hash string, file_mtime double, summary string, summary_hash string, summary_author string, summary_session string, token_count int, community_id string, "
    "complexity string, language_notes string, layer string, bridge_score double, metadata string, updated_at bigint, deleted_at bigint"
)
EDGES = "from_id string, to_id string, kind string, confidence double, confidence_tier string, metadata string, description string"
NODE_TAGS = "node_id string, tag string, source string"
FINGERPRINTS = "file_path string, content_sha string, mtime_ns bigint, indexed_at double"
SESSIONS = "id string, agent_id string, started_at bigint"
NODE_VISITS = "session_id string, node_id string, tool string, visited_at bigint"
SAVINGS = "ts bigint, node_id string, query string, tokens_saved int, summary_type string"
