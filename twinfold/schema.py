"""Schemas and keys of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    kinds = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (x.split(":") for x in ddl.split())])


ARCHIVES = _struct("path:string mtime_ms:long size:long last_scanned:double file_count:long config:string")
FILES = _struct("full_hash:string quick_hash:string filename:string path_in_archive:string source_archive:string size:long is_nested_archive:boolean")
TARGET_FILES = _struct("path:string mtime_ms:long size:long full_hash:string quick_hash:string config:string")
SELECTION = _struct("file_hash:string target_path:string selected:boolean")
UNREAD = _struct("source_archive:string path_in_archive:string error:string")
FOLDERS = _struct("path:string parent:string mtime_ns:long seen_ns:long own:string digest:string config:string")
LISTING = _struct("path:string name:string size:long mtime_ms:long root:string")
MEMBERS = _struct("source_archive:string path_in_archive:string filename:string size:long is_nested_archive:boolean depth:long seq:long full_hash:string quick_hash:string error:string")

TABLES = {"archives": ARCHIVES, "files": FILES, "target_files": TARGET_FILES, "selection_state": SELECTION, "unread": UNREAD, "folders": FOLDERS}
KEYS = {"archives": ["path"], "files": ["source_archive", "path_in_archive"], "target_files": ["path"], "selection_state": ["file_hash", "target_path"], "unread": ["source_archive", "path_in_archive"], "folders": ["path"]}
