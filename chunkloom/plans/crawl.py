"""Taking up the files of a commit or working tree under a label, as one plan of set-wise steps.

Files that are there already, complete, are only given the label. New files are read, decoded, cut, embedded and written, part by part; a file is
complete when all its chunks have vectors, and what is incomplete is done anew by the next crawl. The label's files are replaced in
one step at the end, so an interrupted crawl leaves the label as it was, and the next one goes on with the parts that weren't written yet.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import identifiers as I
from chunkloom.functions import text as T
from chunkloom.operators import chunking, membership
from chunkloom.operators.packages import nearest_package
from chunkloom.operators.rules import CrawlRules
from chunkloom.operators.typescript import typescript_chunks
from chunkloom.runtime import Scratch
from chunkloom.schema import STORED_CHUNKS
from chunkloom.sources import git
from chunkloom.sources.warehouse import Warehouse

CHUNKER_ID = "chunkloom-chunker:v1"
_CUT = ("chunk_text", "start_line", "end_line", "chunk_type", "chunk_kind", "symbol_name", "crumb", "split_part_ordinal", "split_part_count")


@dataclass
class CrawlResult:
    label_id: str
    new_files: int
    existing_files: int
    chunks: int
    failed_chunks: int
    removed_chunks: int
    warnings: list[str]

    @property
    def complete(self) -> bool:
        return self.failed_chunks == 0


def cut_files(files: DataFrame, rules: CrawlRules, *, limit: int = chunking.TARGET_BYTES) -> DataFrame:
    """Chunks of ``files`` (``relative_path``, ``package``, ``text`` and whatever else): one branch per strategy, joined again.

    Adds the columns that describe a chunk; files without a strategy have no chunks.
    """
    sorted_out = files.withColumn("_strategy", rules.strategy(F.col("relative_path")))
    rest = [c for c in files.columns if c != "text"]
    name = T.file_name(F.col("relative_path"))

    def shaped(df: DataFrame, crumb: Column, **columns: Column) -> DataFrame:
        given = {"chunk_kind": F.lit("content"), "symbol_name": F.lit(None).cast("string"), "split_part_ordinal": F.lit(None).cast("int"), "split_part_count": F.lit(None).cast("int")}
        return df.withColumns({k: v for k, v in (given | columns).items() if k in columns or k not in df.columns} | {"crumb": crumb}).select(*rest, *_CUT)

    nothing = F.lit(None).cast("string")
    by_line = shaped(chunking.line_chunks(sorted_out.where("_strategy = 'lineBased'"), limit=limit), T.encode_path(name), chunk_type=F.lit("text"))
    sections = chunking.markdown_chunks(sorted_out.where("_strategy = 'markdown'"), limit=limit)
    by_section = shaped(sections, T.breadcrumb(F.col("package"), name, F.col("slug")))
    scripts = typescript_chunks(sorted_out.where("_strategy = 'typescript'"), limit=limit)
    by_syntax = shaped(scripts, T.breadcrumb(F.col("package"), name, F.coalesce(F.col("symbol_name"), nothing)))
    return by_line.unionByName(by_section).unionByName(by_syntax)


def _eta(spark: SparkSession, seconds: float) -> str:
    return spark.range(1).select(T.format_eta(F.lit(float(seconds)))).head()[0]


def stored_rows(embedded: DataFrame, catalog: str, embedder_id: str) -> DataFrame:
    """The chunks that have vectors, as they are stored. A file is complete if all its chunks have one."""
    complete = embedded.groupBy("file_id").agg((F.count_if(F.col("_e.vector").isNull()) == 0).alias("_complete"))
    rows = embedded.where("_e.vector is not null").join(complete, "file_id")
    made = {
        "point_id": I.point_id(F.col("file_id"), F.col("chunk_ordinal")), "text": F.col("chunk_text"), "vector": F.col("_e.vector"), "catalog": F.lit(catalog), "embedder_id": F.lit(embedder_id),
        "chunker_id": F.lit(CHUNKER_ID), "package_name": F.col("package"), "breadcrumb": F.nullif("crumb", F.lit("")), "file_complete": F.col("_complete") & (F.col("chunk_ordinal") == 1),
    }
    return rows.select(*(made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in STORED_CHUNKS.fields))


def crawl(
    store: Warehouse,
    repo: str,
    catalog: str,
    label: str,
    embedder,
    embedder_id: str,
    *,
    revision: str | None = None,
    rules: CrawlRules | None = None,
    incremental_warnings: bool = False,
    limit: int = chunking.TARGET_BYTES,
    part_files: int = 20_000,
    progress: Callable[[str], None] | None = None,
) -> CrawlResult:
    """Crawls ``revision``, or the working tree without one, into ``catalog:label``.

    ``embedder`` maps a text column to ``struct<vector, error>``. Files that aren't UTF-8 are skipped. Files that gave
    warnings before are cut again, unless ``incremental_warnings``. Chunks that no label holds any more are removed after a
    crawl without failures. New files are taken up in parts of about ``part_files``; after each, ``progress`` is told how far
    the crawl is and how long it may still take.
    """
    spark, rules = store.spark, rules or CrawlRules()
    commit = git.resolve_commit(repo, revision) if revision else ""
    row = {"label_id": f"{catalog}:{label}", "catalog": catalog, "label": label, "commit_oid": commit, "source_kind": "git-commit" if commit else "working-directory"}
    store.upsert_label(**row, crawl_complete=False, updated_at_unix_secs=int(time.time()))
    scratch = Scratch(spark, "crawl")

    listed = git.commit_files(spark, repo, commit) if commit else git.working_files(spark, repo)
    packages = git.packages(listed, repo, working_tree=not commit)
    wanted = nearest_package(listed.where(rules.should_crawl(F.col("relative_path"))), packages, "relative_path", F.lit(catalog))
    key = I.file_id(F.lit(embedder_id), F.lit(CHUNKER_ID), F.col("blob_id"), F.col("relative_path"))
    prior = store.load_warnings(catalog)
    forced = None if incremental_warnings or not prior else spark.createDataFrame([(p,) for p in prior], "relative_path string")
    own = store.stored_chunks().where(F.col("catalog") == catalog)
    files = scratch.write(membership.incremental_classify(wanted.withColumn("file_id", key), own, forced), "files")

    fresh = files.where("status <> 'existing'").drop("status")
    count = fresh.count()
    parts = max(1, -(-count // part_files))
    began, failures, written, odd_paths = time.time(), 0, 0, []
    for part in range(parts):
        own_part = fresh.where(F.pmod(F.xxhash64("file_id"), F.lit(parts)) == part) if parts > 1 else fresh
        texts = git.decoded(git.with_contents(own_part, repo, working_tree=not commit))
        described = texts.withColumns({"content_hash": I.content_hash(F.col("text")), "source_uri": F.concat(F.lit(repo.rstrip("/") + "/"), F.col("relative_path"))})
        cut = chunking.chunk_ordinals(cut_files(described, rules, limit=limit))
        embedded = scratch.write(cut.withColumn("_e", embedder(F.col("chunk_text"))), f"embedded-{part}")
        store.upsert_files(stored_rows(embedded, catalog, embedder_id))
        odd_paths.append(membership.warning_files(embedded))
        all_, bad = embedded.agg(F.count("*"), F.count_if(F.col("_e.vector").isNull())).head()
        failures, written = failures + bad, written + all_ - bad
        if progress:
            spent = time.time() - began
            progress(f"{min(count, (part + 1) * part_files)} of {count} new files, {_eta(spark, spent / (part + 1) * (parts - part - 1))} left")

    # files of which nothing could be written belong to no label
    now = store.stored_chunks().where(F.col("catalog") == catalog).select("file_id").distinct()
    store.set_label(catalog, label, files.select("file_id").distinct().join(now, "file_id", "left_semi"))
    removed = store.remove_orphans(catalog) if not failures else 0
    odd = sorted({r.relative_path for df in odd_paths for r in df.collect()})  # files that couldn't be cut along their syntax
    store.save_warnings(catalog, odd + (prior if incremental_warnings else []))
    store.upsert_label(**row, crawl_complete=not failures, updated_at_unix_secs=int(time.time()))
    counts = {r.status: r["count"] for r in files.groupBy(F.when(F.col("status") == "existing", "existing").otherwise("new").alias("status")).count().collect()}
    result = CrawlResult(row["label_id"], counts.get("new", 0), counts.get("existing", 0), written, failures, removed, odd)
    scratch.close()
    return result
