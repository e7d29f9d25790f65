"""Labels on chunks, and what an incremental crawl has to do, as set-wise joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_points(chunks: DataFrame) -> DataFrame:
    """Each ``point_id`` once: the row with the longest label list, of equal ones the greatest list."""
    rest = [c for c in chunks.columns if c != "point_id"]
    order = F.struct(F.size("active_label_ids"), F.col("active_label_ids"))
    return chunks.groupBy("point_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("point_id", "r.*")


def add_label(labels: Column, label_id: Column) -> Column:
    """The list with the label at its end, unless it has it already."""
    return F.when(F.array_contains(labels, label_id), labels).otherwise(F.array_append(labels, label_id))


def label_add(chunks: DataFrame, files: DataFrame, label_id: str) -> DataFrame:
    """The chunks of the given files (``file_id``) with the label added; chunks of other files aren't returned."""
    return chunks.join(files.select("file_id").distinct(), "file_id", "left_semi").withColumn("active_label_ids", add_label(F.col("active_label_ids"), F.lit(label_id)))


def label_cleanup(chunks: DataFrame, touched: DataFrame, label_id: str) -> DataFrame:
    """All chunks after the label left every file that isn't ``touched``; chunks without any label are gone."""
    flagged = chunks.join(touched.select("file_id").distinct().withColumn("_touched", F.lit(True)), "file_id", "left")
    stale = F.array_contains("active_label_ids", label_id) & F.col("_touched").isNull()
    cleaned = flagged.withColumn("active_label_ids", F.when(stale, F.array_remove("active_label_ids", label_id)).otherwise(F.col("active_label_ids")))
    return cleaned.where(F.size("active_label_ids") > 0).drop("_touched")


def file_complete(chunks: DataFrame) -> DataFrame:
    """``(file_id, chunks, chunk_count, complete)``: whether all chunks of a file are there."""
    return chunks.groupBy("file_id").agg(F.countDistinct("chunk_ordinal").alias("chunks"), F.max("chunk_count").alias("chunk_count")).withColumn(
        "complete", (F.col("chunks") == F.col("chunk_count")) & (F.col("chunks") > 0)
    )


def incremental_classify(files: DataFrame, chunks: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """``files`` (with ``file_id``) with ``status``: ``existing`` if the file's first chunk is there and marked complete, else ``incomplete`` or ``new``.

    A file in ``forced`` (``relative_path``) is ``new`` in any case.
    """
    sentinels = chunks.where("chunk_ordinal = 1").groupBy("file_id").agg(F.max(F.coalesce("file_complete", F.lit(False))).alias("_complete"))
    out = files.join(sentinels, "file_id", "left").withColumn(
        "status", F.when(F.col("_complete"), "existing").when(F.col("_complete").isNotNull(), "incomplete").otherwise("new")
    )
    if forced is not None:
        out = out.join(forced.select("relative_path").distinct().withColumn("_forced", F.lit(True)), "relative_path", "left")
        out = out.withColumn("status", F.when(F.col("_forced"), "new").otherwise(F.col("status"))).drop("_forced")
    return out.drop("_complete")


def upsert(target: DataFrame, source: DataFrame, key: str = "point_id") -> DataFrame:
    """``target`` with the rows of ``source`` in place of those of equal key; nulls never match."""
    return target.join(source.select(key).distinct(), key, "left_anti").unionByName(source.select(*target.columns))


def delete_by_ids(target: DataFrame, ids: DataFrame, key: str = "point_id") -> DataFrame:
    return target.join(ids.select(key).distinct(), key, "left_anti")


def warning_files(chunks: DataFrame) -> DataFrame:
    """Paths of files of which a chunk was cut without regard to syntax."""
    return chunks.where("chunk_kind = 'fallback-split'").select("relative_path").distinct()


def warning_summary(warnings: DataFrame, show: int = 20) -> DataFrame:
    """The first ``show`` paths in order, each with the number of paths beyond these."""
    total = warnings.agg(F.greatest(F.count("*") - show, F.lit(0)).alias("more"))
    return warnings.orderBy("relative_path").limit(show).crossJoin(F.broadcast(total))  # a single row


def warnings_next(current: DataFrame, prior: DataFrame, incremental: bool) -> DataFrame:
    """The warnings to keep: this crawl's, and the earlier ones if these files weren't cut again."""
    now = current.select("relative_path")
    return (now.unionByName(prior.select("relative_path")) if incremental else now).distinct()


def row_errors(chunks: DataFrame, catalog_error: Column, labels_error: Column) -> DataFrame:
    """``chunks`` with ``error``: the first invariant that a row breaks, null for a good row."""
    return chunks.withColumn(
        "error",
        F.coalesce(
            catalog_error,
            F.when(F.size("active_label_ids") < 1, "labels_empty"),
            labels_error,
            F.when((F.col("chunk_ordinal") < 1) | (F.col("chunk_ordinal") > F.col("chunk_count")), "ordinal_out_of_range"),
            F.when(F.col("point_id") != F.concat("file_id", F.lit(":"), F.col("chunk_ordinal").cast("string")), "point_id_mismatch"),
        ),
    )
