"""Column types, symbol types and the row life cycle."""

from __future__ import annotations

OFFLINE, PENDING, ONLINE, ERROR = 0, 1, 2, 3
SYMBOL_TYPES = tuple("class component function hook interface type".split())

META = (
    "struct<kind:string,params:array<string>,props:array<string>,properties:array<string>,hooks:array<string>,"
    "sideEffects:array<string>,calleeNames:array<string>,returnType:string,"
    "callers:array<struct<name:string,path:string>>,callees:array<struct<name:string,path:string>>>"
)
SYMBOLS = (
    f"id bigint, name string, type string, category string, path string, description string, content string, meta {META}, "
    "usage_count int, embedding array<float>, insert_user string, updated_user string, created_at timestamp, "
    "updated_at timestamp, file_hash string, semantic_hash string, status tinyint"
)
CHUNKS = (
    "id bigint, source_id string, title string, path string, chunk_index int, chunk_count int, content string, "
    "summary string, category string, meta string, embedding array<float>, semantic_hash string, status tinyint, "
    "created_at timestamp, updated_at timestamp"
)
EVAL_QUERY = (
    "id string, input struct<query:string,category:string,requiredProps:array<string>,requiredHooks:array<string>,"
    "semantic:boolean>, expected array<struct<name:string,path:string,rel:int>>, tags array<string>"
)
CHANGES = "op string, path string, new_path string"
JOBS = "semantic_hash string, symbols_table string, enqueued_at timestamp, attempt int"
