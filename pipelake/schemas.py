"""Schemas of the canonical tables."""

from __future__ import annotations

STEPS = (
    "workflow_id string, ordinal int, step_id string, tool string, command string, input array<string>, output array<string>, "
    "previous array<string>, next array<string>, threads int, color string, wildcard_files map<string,array<string>>"
)
EDGES = "workflow_id string, src string, dst string, src_pos int, dst_pos int"
WILDCARD_FILES = "workflow_id string, name string, pos int, file string"
FILE_MANIFEST = "path string, modified_at timestamp, length bigint"
LIFECYCLE_EVENTS = "run_id string, step_id string, event_type string, ts timestamp, seq bigint, error string"
RESOURCE_SAMPLES = "run_id string, ts timestamp, seq bigint, cpu double, memory_bytes bigint"
STATE_SNAPSHOT = "workflow_path string, completed array<string>, failed_step string, updated_at timestamp"
TOOL_ENV = "tool string, env string"
EDITOR_GRAPH = (
    "nodes array<struct<id:string,data:struct<label:string,tool:string,command:string,input:string,output:string,color:string>>>, "
    "edges array<struct<source:string,target:string>>, wildcardFiles map<string,array<string>>, metadata map<string,string>"
)
