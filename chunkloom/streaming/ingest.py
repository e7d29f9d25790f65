"""Continuous ingestion: batches of files that arrive in a folder are cut, embedded and written as they come."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chunkloom.functions import identifiers as I
from chunkloom.operators import chunking, membership
from chunkloom.operators.rules import CrawlRules
from chunkloom.plans.crawl import CHUNKER_ID, cut_files, stored_rows
from chunkloom.runtime import Scratch
from chunkloom.sources.warehouse import Warehouse

#: what arrives: one row per file
ARRIVALS = "relative_path string, blob_id string, package string, text string"


def ingest_files(store: Warehouse, batch: DataFrame, catalog: str, embedder, embedder_id: str, *, label: str = "arrivals", rules: CrawlRules | None = None) -> int:
    """Writes the chunks of a batch of files and adds the files to a label; returns how many chunks couldn't be embedded.

    A file is complete only if all its chunks have vectors; one that isn't counts as incomplete in the next crawl. A batch that is delivered again
    replaces what it wrote before.
    """
    scratch = Scratch(store.spark, "ingest")
    key = I.file_id(F.lit(embedder_id), F.lit(CHUNKER_ID), F.col("blob_id"), F.col("relative_path"))
    files = batch.where("text is not null and relative_path is not null and blob_id is not null").dropDuplicates(["relative_path", "blob_id"])
    files = files.withColumns({"file_id": key, "content_hash": I.content_hash(F.col("text")), "source_uri": F.col("relative_path"), "package": F.coalesce("package", F.lit(catalog))})
    embedded = scratch.write(chunking.chunk_ordinals(cut_files(files, rules or CrawlRules())).withColumn("_e", embedder(F.col("chunk_text"))), "embedded")
    rows = stored_rows(embedded, catalog, embedder_id)
    store.upsert_files(rows)
    store.add_members(rows.select("file_id", "catalog", F.lit(label).alias("label")))
    failed = embedded.where("_e.vector is null").count()
    scratch.close()
    return failed


def stream_files(
    spark: SparkSession, folder: str, store: Warehouse, catalog: str, embedder, embedder_id: str, *, checkpoint: str, label: str = "arrivals", rules: CrawlRules | None = None, failures: list | None = None
) -> StreamingQuery:
    """Takes up all Parquet files that have arrived in ``folder`` since the last run under ``catalog:label``, and stops.

    Progress lies in ``checkpoint``; a batch that was interrupted is repeated, which is harmless as files are replaced whole. The label's metadata says whether all that arrived so far
    could be embedded; ``failures`` gets ``(batch, failed chunks)`` of batches where some couldn't.
    """
    arrivals = spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", 64).parquet(folder)

    def take(batch: DataFrame, number: int) -> None:
        failed = ingest_files(store, batch, catalog, embedder, embedder_id, label=label, rules=rules)
        if failed and failures is not None:
            failures.append((number, failed))
        held = store.stored_chunks().where(F.col("catalog") == catalog)
        own = store.membership().where((F.col("catalog") == catalog) & (F.col("label") == label)).select("file_id")
        done = membership.file_complete(held.join(own, "file_id", "left_semi")).where("not complete").head(1) == []
        store.upsert_label(
            label_id=f"{catalog}:{label}", catalog=catalog, label=label, commit_oid="", source_kind="stream", crawl_complete=done and not failed, updated_at_unix_secs=int(time.time())
        )

    return arrivals.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
