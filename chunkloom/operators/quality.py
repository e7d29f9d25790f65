"""How well files were cut: reports and scores of chunk sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.operators.chunking import TARGET_BYTES

SMALL_BYTES = 500


def quality_report(chunks: DataFrame, file: str = "file_id", text: str = "text", *, target: int = TARGET_BYTES) -> DataFrame:
    """Per file: number of chunks, small chunks, least, greatest and mean size in bytes, and the score."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    sized = chunks.select(file, size.alias("size"))
    totals = sized.groupBy(file).agg(
        F.count("*").alias("chunks"),
        F.count_if(F.col("size") < SMALL_BYTES).alias("small_chunks"),
        F.min("size").alias("min_bytes"),
        F.max("size").alias("max_bytes"),
        F.avg("size").alias("mean_bytes"),
        F.sum("size").alias("_total"),
    )
    limit = F.least(F.lit(target), F.col("_total"))
    scored = sized.join(totals.select(file, "_total"), file).groupBy(file).agg(F.sum(_badness(F.col("size"), limit)).alias("_bad"))
    return totals.join(scored, file).select(
        file, "chunks", "small_chunks", "min_bytes", "max_bytes", "mean_bytes", _score(F.col("chunks"), F.col("_total"), F.col("_bad"), limit).alias("score")
    )


def _badness(size: Column, limit: Column) -> Column:
    """0 just below the limit, 1 at a single byte, and as many as the limit fits in for a chunk that reaches it."""
    under = F.pow((limit - size) / F.nullif(limit - 1, F.lit(0)), F.lit(2.0))
    return F.when(size >= limit, F.greatest(size / limit, F.lit(1.0))).otherwise(under)


def _score(count: Column, total: Column, bad: Column, limit: Column) -> Column:
    """100 for the fewest, fullest chunks; less for more chunks than needed and for small or oversized ones."""
    ideal = F.ceil(total / limit)
    excess = F.when(total == ideal, 0.0).otherwise((count - ideal) / (total - ideal))
    least = _badness(total - limit * (ideal - 1), limit) / F.greatest(ideal, F.lit(1))
    uneven = F.when(least == 1.0, 0.0).otherwise((bad / count - least) / (F.lit(1.0) - least))
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return F.when(total == 0, 100.0).otherwise((F.lit(1.0) - clamp(excess)) * (F.lit(1.0) - clamp(uneven)) * 100.0)


def worst_files(report: DataFrame, file: str = "file_id", n: int = 3) -> DataFrame:
    """The ``n`` files of the lowest score."""
    return report.orderBy("score", file).limit(n)


def dump_summary(chunks: DataFrame, *, text: str = "text", crumb: str = "breadcrumb", target: int = TARGET_BYTES) -> DataFrame:
    """One row: chunks, bytes with breadcrumbs, their mean, oversized chunks and undersized ones (under 200 bytes)."""
    size = F.coalesce(F.octet_length(text), F.lit(0))
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.coalesce(F.sum(size + F.coalesce(F.octet_length(crumb), F.lit(0))), F.lit(0)).cast("long").alias("total_bytes"),
        F.avg((size + F.coalesce(F.octet_length(crumb), F.lit(0))).cast("double")).alias("mean_bytes"),
        F.count_if(size > target).alias("oversized"),
        F.count_if(size < 200).alias("undersized"),
    )
