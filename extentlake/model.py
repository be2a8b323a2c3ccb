"""Schemas of the archive's tables and the states that evidence can have."""

from __future__ import annotations

from pyspark.sql import types as T

_LONG, _TEXT, _BYTES = T.LongType(), T.StringType(), T.BinaryType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TABLES: dict[str, T.StructType] = {
    "manifest": _schema(key=_TEXT, value=_TEXT),
    "blobs": _schema(sha256=_TEXT, codec=_TEXT, raw_length=_LONG, data=_BYTES),
    "clusters": _schema(segment=_LONG, cluster=_LONG, allocated_bytes=_LONG, metadata=_TEXT),
    "chunks": _schema(segment=_LONG, cluster=_LONG, logical_start=_LONG, length=_LONG, blob_sha256=_TEXT),
    "extents": _schema(id=_LONG, segment=_LONG, cluster=_LONG, logical_start=_LONG, physical_start=_LONG, length=_LONG, metadata=_TEXT),
    "allocation_templates": _schema(id=_LONG, digest=_TEXT, metadata=_TEXT),
    "allocation_contexts": _schema(id=_LONG, digest=_TEXT, metadata=_TEXT),
    "names": _schema(id=_LONG, name=_TEXT),
    "allocations": _schema(
        id=_LONG, segment=_LONG, cluster=_LONG, logical_offset=_LONG, size=_LONG, native_tag=_LONG, name_id=_LONG, element_count=_LONG,
        vector=T.BooleanType(), template_id=_LONG, context_id=_LONG, page_offset=_LONG, tag_relative_offset=_LONG, tag_word_index=_LONG, instance_index=_LONG,
    ),
    "pointers": _schema(
        segment=_LONG, cluster=_LONG, logical_offset=_LONG, width=T.IntegerType(), raw=_BYTES, status=_TEXT,
        target_segment=_LONG, target_cluster=_LONG, target_offset=_LONG, metadata=_TEXT,
    ),
    "documents": _schema(kind=_TEXT, name=_TEXT, blob_sha256=_TEXT),
    "document_nodes": _schema(kind=_TEXT, name=_TEXT, path=_TEXT, parent=_TEXT, member=_TEXT, ordinal=_LONG, node_type=_TEXT, child_count=_LONG, blob_sha256=_TEXT),
}

#: What identifies a row of each table, in the order of its canonical proof.
KEYS: dict[str, list[str]] = {
    "manifest": ["key"],
    "blobs": ["sha256"],
    "clusters": ["segment", "cluster"],
    "chunks": ["segment", "cluster", "logical_start"],
    "extents": ["id"],
    "allocation_templates": ["id"],
    "allocation_contexts": ["id"],
    "names": ["id"],
    "allocations": ["id"],
    "pointers": ["segment", "cluster", "logical_offset"],
    "documents": ["kind", "name"],
    "document_nodes": ["kind", "name", "path"],
}

POINTER_STATUS = ("RESOLVED", "NULL", "UNRESOLVED")
NODE_TYPES = ("leaf", "mapping", "sequence")
CODECS = ("raw", "zlib")

#: Kinds of failure: what is wrong with data is a status, what is wrong with a call an error.
FAILURES = ("MALFORMED_SOURCE", "UNSUPPORTED_LAYOUT", "RESOURCE_LIMIT", "IO_FAILURE", "INVALID_ARGUMENT", "PROGRAMMING_FAILURE")


def failure(error: BaseException) -> str:
    """The kind of an error: the one that its message begins with, else by its class."""
    text = str(error)
    for kind in FAILURES:
        if text.startswith(kind):
            return kind
    if isinstance(error, OSError):
        return "IO_FAILURE"
    if isinstance(error, MemoryError):
        return "RESOURCE_LIMIT"
    return "INVALID_ARGUMENT" if isinstance(error, (ValueError, TypeError, KeyError)) else "PROGRAMMING_FAILURE"


def pin(**what: object) -> str:
    """A digest of what a resumable run depends on: its source, its settings, and the versions of this code and of Spark."""
    import hashlib
    import json
    from pathlib import Path

    import pyspark

    code = hashlib.sha256()
    for path in sorted(Path(__file__).parent.rglob("*.py")):
        if "llm" not in path.parts:
            code.update(path.read_bytes())
    return hashlib.sha256(json.dumps({**what, "code": code.hexdigest(), "spark": pyspark.__version__}, sort_keys=True, default=str).encode()).hexdigest()
