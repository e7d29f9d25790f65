"""The database of chunks: a folder of Parquet tables.

A table is a set of partitions, each of one or several generations of files; the manifest says which. A change writes a new generation beside the others and then
replaces the manifest in one step, so readers see all of it or nothing, and an interrupted change leaves no trace but unused files. What a
change made useless is deleted by the next one, so that running queries can end. Changes take turns by a lock. Chunks are partitioned by catalog and by a hash of the file:
replacing a file rewrites its bucket, not its catalog.

Content and membership are kept apart. Chunks never change once their file is complete; which labels a file belongs to is a table of its own,
partitioned by catalog and label. A label is thus replaced by overwriting one small partition, and a query for a label prunes to it
instead of filtering lists.
"""

from __future__ import annotations

import contextlib
import datetime
import fcntl
import json
import os
import shutil
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom import __version__
from chunkloom.functions import identifiers as I
from chunkloom.operators.membership import row_errors, upsert
from chunkloom.runtime import Scratch
from chunkloom.schema import LABEL_METADATA, MEMBERSHIP, SCHEMA_VERSION, STORED_CHUNKS, VECTOR_DIM

META, MANIFEST, LOCK = "meta.json", "tables.json", ".lock"
#: the schema of each table, and the columns that it is partitioned by
TABLES = {"chunks": (STORED_CHUNKS, ("catalog", "bucket")), "membership": (MEMBERSHIP, ("catalog", "label")), "label_metadata": (LABEL_METADATA, ())}
#: buckets of a catalog, and the generations that a partition may have before it is rewritten as one
BUCKETS, MOST_GENERATIONS = 16, 32


class DatabaseError(RuntimeError):
    """A folder that isn't a database, or not one of this version."""


def _write_durably(path: Path, text: str) -> None:
    temporary = path.with_name(path.name + ".new")
    with open(temporary, "w") as file:
        file.write(text)
        file.flush()
        os.fsync(file.fileno())
    temporary.rename(path)
    folder = os.open(path.parent, os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


class Warehouse:
    """An open database. ``path`` must be reachable by the driver and all executors."""

    def __init__(self, spark: SparkSession, path: str | Path):
        self.spark, self.path = spark, Path(path)
        meta = _check(self.path)
        if meta is None:
            raise DatabaseError(f"no database at {self.path}; create one first")
        self.vector_dim = meta.get("vector_dim", VECTOR_DIM)

    @classmethod
    def create(cls, spark: SparkSession, path: str | Path, *, vector_dim: int = VECTOR_DIM) -> Warehouse:
        """Creates a database in a folder that is absent or empty; opens one that is there already."""
        path = Path(path)
        if not path.parent.is_dir():
            raise DatabaseError(f"the parent folder of {path} doesn't exist")
        path.mkdir(exist_ok=True)
        with _locked(path):
            if _check(path) is None:
                for name in TABLES:
                    (path / name).mkdir(exist_ok=True)
                _write_durably(path / MANIFEST, json.dumps({"generation": 0, "garbage": [], **{name: {} for name in TABLES}}))
                now = datetime.datetime.now(datetime.UTC).isoformat()
                meta = {"schema_version": SCHEMA_VERSION, "created_at": now, "created_by": __version__, "format": "parquet", "vector_dim": vector_dim}
                _write_durably(path / META, json.dumps(meta, indent=2))
        return cls(spark, path)

    # --- reading

    def _manifest(self) -> dict:
        return json.loads((self.path / MANIFEST).read_text())

    def _read(self, name: str, keep: Callable[[str], bool] = lambda partition: True) -> DataFrame:
        """A table, or some of its partitions; filters on the partitions' columns are pruned besides."""
        schema, partitions = TABLES[name]
        paths = [f"{self.path}/{name}/g={g}/{partition}".rstrip("/") for partition, made in self._manifest()[name].items() if keep(partition) for g in made]
        if not paths:
            return self.spark.createDataFrame([], schema)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", g int" + ", bucket int" * ("bucket" in partitions)
        return self.spark.read.schema(kinds).option("basePath", f"{self.path}/{name}").parquet(*paths).select(*schema.names)

    def stored_chunks(self) -> DataFrame:
        return self._read("chunks")

    def membership(self) -> DataFrame:
        return self._read("membership").distinct()

    def labels(self) -> DataFrame:
        return self._read("label_metadata")

    def chunks(self) -> DataFrame:
        """All chunks with ``active_label_ids``."""
        lists = self.membership().groupBy("catalog", "file_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "catalog", "label"))).alias("active_label_ids"))
        return self.stored_chunks().join(lists, ["catalog", "file_id"], "left").withColumn("active_label_ids", F.coalesce("active_label_ids", F.array().cast("array<string>")))

    def label_chunks(self, catalog: str, label: str) -> DataFrame:
        """The chunks of one label; both tables are pruned to its catalog, the membership to its partition."""
        files = self.membership().where((F.col("catalog") == catalog) & (F.col("label") == label)).select("file_id")
        return self.stored_chunks().where(F.col("catalog") == catalog).join(files, "file_id", "left_semi")

    # --- writing

    def _change(self, name: str, df: DataFrame | None, replaced: Callable[[str], bool]) -> None:
        """Within the lock: adds ``df`` as a generation; partitions that are ``replaced`` keep nothing else, others keep what they have."""
        manifest = self._manifest()
        g = manifest["generation"] + 1
        old, table = manifest["garbage"], manifest[name]
        folder, columns = self.path / name / f"g={g}", TABLES[name][1]
        if folder.exists():  # left by a change that was interrupted
            shutil.rmtree(folder)
        made: list[str] = []
        if df is not None:
            writer = df.write.partitionBy(*columns) if columns else df.write
            writer.parquet(str(folder))
            made = [str(p.relative_to(folder)) for p in folder.glob("/".join(f"{c}=*" for c in columns))] if columns else [""]
        gone = [partition for partition in table if replaced(partition)]
        garbage = [f"{name}/g={x}/{partition}" for partition in gone for x in table.pop(partition)]
        for partition in made:
            table[partition] = [*table.get(partition, []), g]
        _write_durably(self.path / MANIFEST, json.dumps(manifest | {"generation": g, "garbage": garbage}))
        for path in old:
            shutil.rmtree(self.path / path, ignore_errors=True)

    def upsert_files(self, chunks: DataFrame) -> None:
        """Adds whole files, in place of what is there of them. Only buckets in which a file is replaced are rewritten; a row that breaks an invariant stops the whole."""
        bucket = F.pmod(F.xxhash64("file_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
        scratch = Scratch(self.spark, "upsert")
        staged = scratch.write(chunks.select(*STORED_CHUNKS.names, bucket), "staged")
        self._validate(staged)
        files = staged.select("catalog", "bucket", "file_id").distinct()
        with _locked(self.path):
            touched = {_partition(catalog=r.catalog, bucket=r.bucket) for r in files.select("catalog", "bucket").distinct().collect()}  # at most the catalogs of one crawl times the buckets
            held = self._read("chunks", touched.__contains__).select("*", bucket)
            stale = {_partition(catalog=r.catalog, bucket=r.bucket) for r in held.join(files, ["catalog", "bucket", "file_id"], "left_semi").select("catalog", "bucket").distinct().collect()}
            stale |= {p for p, made in self._manifest()["chunks"].items() if p in touched and len(made) >= MOST_GENERATIONS}
            kept = self._read("chunks", stale.__contains__).select("*", bucket).join(files, ["catalog", "bucket", "file_id"], "left_anti") if stale else None
            rows = staged if kept is None else staged.unionByName(kept)
            self._change("chunks", rows.repartition("catalog", "bucket"), stale.__contains__)
        scratch.close()

    def _validate(self, rows: DataFrame) -> None:
        labelled = rows.withColumn("active_label_ids", F.array(F.lit("any:label")))  # labels are kept apart
        wrong = F.when(F.col("vector").isNotNull() & (F.size("vector") != self.vector_dim), F.concat(F.lit("a vector of "), F.size("vector").cast("string"), F.lit(f" entries; this database has {self.vector_dim}")))
        judged = row_errors(labelled, I.catalog_error(F.col("catalog")), F.lit(None).cast("string"))
        bad = judged.select("point_id", F.coalesce(wrong, "error").alias("error")).where("error is not null").head(1)
        if bad:
            raise ValueError(f"chunk {bad[0].point_id}: {bad[0].error}")

    def set_label(self, catalog: str, label: str, files: DataFrame) -> None:
        """Makes a label consist of exactly these files (``file_id``)."""
        rows = files.select("file_id").where("file_id is not null").distinct().select("file_id", F.lit(catalog).alias("catalog"), F.lit(label).alias("label"))
        own = _partition(catalog=catalog, label=label)
        with _locked(self.path):
            self._change("membership", rows if rows.head(1) else None, lambda partition: partition == own)

    def add_members(self, rows: DataFrame) -> None:
        """Adds files (``file_id, catalog, label``) to labels, beside those that these have."""
        rows = rows.select(*MEMBERSHIP.names).distinct()
        if rows.head(1):
            with _locked(self.path):
                crowded = {p for p, made in self._manifest()["membership"].items() if len(made) >= MOST_GENERATIONS}
                whole = rows.unionByName(self._read("membership", crowded.__contains__)).distinct() if crowded else rows
                self._change("membership", whole.repartition("catalog", "label"), crowded.__contains__)

    def remove_orphans(self, catalog: str) -> int:
        """Deletes the chunks of a catalog whose file belongs to no label; returns how many."""
        bucket = F.pmod(F.xxhash64("file_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
        with _locked(self.path):
            own = self.stored_chunks().where(F.col("catalog") == catalog)
            files = self.membership().where(F.col("catalog") == catalog).select("file_id").distinct()
            gone = own.join(files, "file_id", "left_anti").groupBy(bucket).count().collect()  # at most as many rows as there are buckets
            if gone:
                stale = {_partition(catalog=catalog, bucket=r.bucket) for r in gone}
                kept = self._read("chunks", stale.__contains__).join(files, "file_id", "left_semi").select(*STORED_CHUNKS.names, bucket)
                self._change("chunks", kept.repartition("bucket") if kept.head(1) else None, stale.__contains__)
        return sum(r["count"] for r in gone)

    def upsert_label(self, **row) -> None:
        """Writes one row of label metadata, by ``label_id``."""
        self.upsert_labels(self.spark.createDataFrame([tuple(row[c] for c in LABEL_METADATA.names)], LABEL_METADATA))

    def upsert_labels(self, rows: DataFrame) -> None:
        """Writes rows of label metadata in place of those of equal ``label_id``."""
        with _locked(self.path):
            self._change("label_metadata", upsert(self.labels(), rows, "label_id").select(*LABEL_METADATA.names).coalesce(1), lambda partition: True)

    def delete_label(self, label_id: str) -> None:
        with _locked(self.path):
            self._change("label_metadata", self.labels().where(F.col("label_id") != label_id).coalesce(1), lambda partition: True)

    def purge(self, catalog: str) -> tuple[int, int]:
        """Deletes a catalog; returns the numbers of chunks and labels that it had."""
        own = _partition(catalog=catalog)
        with _locked(self.path):
            chunks = self.stored_chunks().where(F.col("catalog") == catalog).count()
            labels = self.labels().where(F.col("catalog") == catalog).count()
            for name in ("chunks", "membership"):
                self._change(name, None, lambda partition: partition.split("/")[0] == own)
            self._change("label_metadata", self.labels().where(F.col("catalog") != catalog).coalesce(1), lambda partition: True)
        return chunks, labels

    def purge_all(self) -> None:
        with _locked(self.path):
            for name in TABLES:
                self._change(name, None, lambda partition: True)

    # --- warnings of earlier crawls

    def load_warnings(self, catalog: str) -> list[str]:
        try:
            found = json.loads((self.path / f"warnings-{catalog}.json").read_text())
        except (OSError, ValueError):
            return []
        return [p for p in found if isinstance(p, str)] if isinstance(found, list) else []

    def save_warnings(self, catalog: str, paths: list[str]) -> None:
        _write_durably(self.path / f"warnings-{catalog}.json", json.dumps(sorted(set(paths)), indent=2))


def _partition(**values: str | int) -> str:
    """The folders of a partition, as Spark names them."""
    return "/".join(f"{k}={_partition_value(str(v))}" for k, v in values.items())


def _partition_value(value: str) -> str:
    """A value as Spark spells it in the name of a partition's folder."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "\"#%'*/:=?\\\x7f{}[]^" else c for c in value)


def _check(path: Path) -> dict | None:
    """The meta data of a database; None for a folder that is absent or empty; an error for anything else."""
    if not path.is_dir():
        return None
    tables = [(path / name).is_dir() for name in TABLES]
    meta = path / META
    if not meta.exists():
        if any(tables):
            raise DatabaseError(f"{path} has tables but no {META}: an unfinished database")
        if any(p.name != LOCK for p in path.iterdir()):
            raise DatabaseError(f"{path} isn't empty and isn't a database")
        return None
    try:
        found = json.loads(meta.read_text())
        version = found["schema_version"]
    except (ValueError, KeyError, TypeError) as e:
        raise DatabaseError(f"{meta} can't be read: an unfinished database") from e
    if version != SCHEMA_VERSION:
        raise DatabaseError(f"{path} has schema version {version}; this program needs {SCHEMA_VERSION}")
    if not all(tables) or not (path / MANIFEST).exists():
        raise DatabaseError(f"{path} lacks a table: an unfinished database")
    return found


@contextlib.contextmanager
def _locked(path: Path) -> Iterator[None]:
    with open(path / LOCK, "w") as file:
        fcntl.flock(file, fcntl.LOCK_EX)
        yield
