"""Schemas of the records that the operators exchange."""

from __future__ import annotations

FETCH_TASK = "struct<article_id:bigint,url_id:bigint,url:string,depth:bigint,priority:int,discovered_from:bigint>"
METADATA = "struct<status_code:int,content_type:string,fetch_time:bigint,authors:array<string>,title:string,document_metadata:array<map<string,string>>,json_ld:string>"
#: Page content is a tagged union in files, so it is read as raw JSON text and cut apart by `sources.archive`.
RAW_PAGE = "struct<content:string,page:bigint>"
RAW_SNAPSHOT = f"struct<content_markdown:array<{RAW_PAGE}>,metadata:{METADATA}>"
ARCHIVE_PAGE = f"struct<task:{FETCH_TASK},current:{RAW_SNAPSHOT},historical_snapshots:array<{RAW_SNAPSHOT}>,all_links:array<string>,history:array<bigint>>"
TASK_ONLY = f"struct<task:{FETCH_TASK}>"
PAGE = "struct<page:bigint,text:string>"
LEGACY_STORY = "struct<_id:string,id:string,story_id:string,page:int,uri:string,story:array<string>,keywords:array<string>,title:string,author:string>"
FRONTIER = "url string, article_url string, domain string, priority int, depth bigint, discovered_from string, status string, claimed_at bigint"
POINT = "id string, vector array<float>, text string, chunk_id bigint, source string"

PRIORITY_NORMAL, PRIORITY_ARTICLE = 0, 10
PENDING, IN_PROGRESS, COMPLETE, SKIPPED = "pending", "in_progress", "complete", "skipped"
