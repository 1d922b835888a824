"""Declared schemas of the job document, the feed and the ledger."""

from __future__ import annotations

# Names the feed format uses.
IMAGE = "image"
RAW = "raw"
ARCHIVE = "archive"
STRING = "string"
NUMERIC = "numeric"
SCALAR_TYPES = (STRING, NUMERIC)
BLOB_TYPES = (IMAGE, RAW)
RECORD_KEYS = ("set", "data", "hash")
ENTRY_KEYS = (
    "type", "dtype", "id", "fieldid", "name", "filename", "url",
    "channels", "width", "height", "value",
)
MANIFEST_MEMBER = "file_id.diz"
API_VERSION = "1"
CLI_VERSION = "1"

JOB = (
    "count int, dataset struct<id:int, name:string, description:string>, "
    "mapping array<struct<id:int, name:string, fieldid:int>>, splits map<string,int>"
)

ENTRY = (
    "struct<id:int, type:string, dtype:string, field_id:int, field_name:string, "
    "filename:string, url:string, channels:int, width:int, height:int, "
    "string_value:string, int_value:int, float_value:float, "
    "optional:map<string,array<string>>, reason:string, "
    "content:binary, digest:string, n_bytes:bigint>"
)

HASHES = "file_id int, api_hash binary, record_hash binary, member_pos bigint, batch string"
FILES = "file_id int, file_name string, batch string"
METADATA = "key string, value string, batch string"
LABELS = "label string, category_id bigint, batch string"
