"""The engine's functions for SQL users.

Scalar functions are SQL functions, which Spark inlines into the plan like built-in ones; cutting and embedding are a table function and a
vectorised function over Arrow.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chunkloom.operators.embedding import hashing_embedder
from chunkloom.operators.typescript import cut_script

#: name, parameters, result, body
_SCALARS = (
    ("cl_content_hash", "x STRING", "STRING", "concat('sha256:', sha2(x, 256))"),
    ("cl_file_id", "embedder STRING, chunker STRING, blob STRING, path STRING", "STRING", r"substring(sha2(concat_ws('\u001f', embedder, chunker, blob, path), 256), 1, 16)"),
    ("cl_point_id", "file STRING, ordinal INT", "STRING", "concat(file, ':', ordinal)"),
    ("cl_git_blob_id", "x STRING", "STRING", "sha1(concat(encode(concat('blob ', octet_length(x)), 'UTF-8'), X'00', encode(x, 'UTF-8')))"),
    ("cl_slug", "x STRING", "STRING", r"translate(regexp_replace(lower(x), r'[^\p{L}\p{N}\p{M}\p{Pc} -]', ''), ' ', '-')"),
    ("cl_sanitize", "x STRING", "STRING", r"regexp_replace(x, r'[\p{Cc}&&[^\t\n\r]]', '')"),
    ("cl_file_name", "path STRING", "STRING", "substring_index(path, '/', -1)"),
    ("cl_format_bytes", "n BIGINT", "STRING", "CASE WHEN n >= 1073741824 THEN format_string('%.1f GB', n / 1073741824D) WHEN n >= 1048576 THEN format_string('%.1f MB', n / 1048576D) ELSE concat(n, ' bytes') END"),
    (
        "cl_cosine_distance",
        "a ARRAY<FLOAT>, b ARRAY<FLOAT>",
        "DOUBLE",
        """CASE WHEN size(a) = size(b) THEN 1D - aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)
        / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) * sqrt(aggregate(b, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 0D) END""",
    ),
)


@F.udtf(returnType="chunk_text string, start_line int, end_line int, chunk_type string, chunk_kind string, symbol_name string")
class CutTypescript:
    """``cl_cut_typescript(text, path, limit)``: the chunks of a TypeScript source."""

    def eval(self, text: str, path: str, limit: int):
        if text is not None:
            yield from cut_script(text, path or "", limit=limit or 6000)


def register(spark: SparkSession, vector_dim: int = 768) -> list[str]:
    """Makes the functions known to this session's SQL; returns their names."""
    for name, parameters, result, body in _SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("cl_cut_typescript", CutTypescript)
    spark.udf.register("cl_embed_words", hashing_embedder(vector_dim))
    return [name for name, *_ in _SCALARS] + ["cl_cut_typescript", "cl_embed_words"]
