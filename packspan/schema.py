"""Schemas of catalogs, members, volumes, results and search hits, and of the JSON listing they are exchanged in."""

from __future__ import annotations

ENTRIES = (
    "archive string, format string, ordinal long, path string, name string, parent string, ext string, depth int, size long, "
    "is_dir boolean, is_encrypted boolean, implied boolean, entry_type string, error string"
)
#: What the catalog source itself emits; paths are derived from it by expressions.
RAW_ENTRIES = "archive string, format string, ordinal long, raw_path string, size long, is_dir boolean, is_encrypted boolean, entry_type string, error string"
#: Large members come in chunks: ``chunk_no`` counts from 0, ``offset`` is the first byte's place in the member.
MEMBERS = "archive string, format string, ordinal long, path string, size long, chunk_no int, offset long, content binary, error string"
VOLUMES = "set_key string, format string, ordinal int, path string"
RESULTS = "archive string, total long, success long, error long"
SEARCH = "path string, match_count long, first_line int, snippet string"
LISTING_JSON = "array<struct<n:string,s:bigint,d:boolean,e:boolean>>"
RESULT_JSON = "struct<total:int,success:int,error:int>"
