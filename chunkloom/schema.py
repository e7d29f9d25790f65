"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 2
VECTOR_DIM = 768

_STRINGS = ("embedder_id", "chunker_id", "blob_id", "content_hash", "file_id", "relative_path", "package_name", "source_uri")

#: a chunk as it is stored; its labels are kept apart, by file
STORED_CHUNKS = T.StructType(
    [
        T.StructField("point_id", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("catalog", T.StringType(), False),
        *(T.StructField(name, T.StringType(), False) for name in _STRINGS),
        T.StructField("chunk_ordinal", T.IntegerType(), False),
        T.StructField("chunk_count", T.IntegerType(), False),
        T.StructField("start_line", T.IntegerType(), False),
        T.StructField("end_line", T.IntegerType(), False),
        T.StructField("symbol_name", T.StringType()),
        T.StructField("chunk_type", T.StringType(), False),
        T.StructField("chunk_kind", T.StringType(), False),
        T.StructField("breadcrumb", T.StringType()),
        T.StructField("split_part_ordinal", T.IntegerType()),
        T.StructField("split_part_count", T.IntegerType()),
        T.StructField("file_complete", T.BooleanType(), False),
    ]
)

MEMBERSHIP = T.StructType([T.StructField("file_id", T.StringType(), False), T.StructField("catalog", T.StringType(), False), T.StructField("label", T.StringType(), False)])

LABEL_METADATA = T.StructType(
    [
        *(T.StructField(name, T.StringType(), False) for name in ("label_id", "catalog", "label", "commit_oid", "source_kind")),
        T.StructField("crawl_complete", T.BooleanType(), False),
        T.StructField("updated_at_unix_secs", T.LongType(), False),
    ]
)
