"""Explicit schemas of every input; nothing is inferred."""

from __future__ import annotations

HEADER = "page_id bigint, rev_id bigint, parent_id bigint, ts timestamp, page_title string, page_namespace int, length int, minor boolean"
REVISION = HEADER + ", text string, user string, user_id bigint, ip string, comment string"
REVISION_JSON = "page_id bigint, page_title string, page_namespace int, rev_id bigint, parent_id bigint, timestamp bigint, user string, user_id bigint, comment string, text string"
#: A page element of a dump, as the XML source sees it; _VALUE is an element's text beside its attributes.
PAGE_XML = (
    "id bigint, ns int, title string, redirect struct<_title:string>, "
    "revision array<struct<id:bigint, parentid:bigint, timestamp:string, "
    "contributor:struct<username:string, id:bigint, ip:string>, minor:string, comment:struct<_VALUE:string>, text:struct<_VALUE:string>, sha1:string, model:string, format:string>>"
)
ANCHOR = "ts bigint, pid bigint, revid bigint, parent bigint, anchor string, target string"
LINK_EVENT = "src bigint, dest string, ts bigint, anchor string, title string, offset int, pre string, post string"
ID_MAP = "page_id bigint, title string"
REDIRECTS = "from_id bigint, to_title string, flag int"
PAGEVIEW_SERIES = "title string, month string, total bigint, series array<bigint>"
LOG_ENTRY = "remote string, logname string, user_id string, time string, epoch_ms bigint, request string, method string, resource string, protocol string, status int, size bigint"
WARC = "doc_id string, headers map<string,string>"
DELTAS = "array<struct<op:string, orig_pos:int, orig:array<string>, rev_pos:int, rev:array<string>>>"
