"""What changed between consecutive full snapshots.

Method: the snapshots are range-partitioned and sorted by key, and each range is streamed once with two pointers that
stand on neighbouring rows of the sorted run. A key's rows of all snapshots lie side by side in such a run, so one pass
over it merges every pair of consecutive snapshots at the same time: two neighbouring rows of one key that belong to
consecutive snapshots are compared, and a row without such a neighbour is an addition or a removal. A range therefore
never holds more than one Arrow batch in memory, and a hot catalog spreads over ranges because the path is part of the
range key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANGES = "catalog string, snapshot_no int, relative_path string, change string"


def git_path(path: Column) -> Column:
    """A path as Git spells it: relative to the root, ``/`` between names, no empty, ``.`` or resolvable ``..`` parts."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.when(p == "..", acc).otherwise(F.array_append(acc, p))
        ),
    )
    return F.array_join(F.when(path.contains(".."), folded).otherwise(parts), "/")


def blob_key(blob: Column) -> Column:
    """A blob id without differences of spelling; null where the row names none."""
    return F.nullif(F.lower(F.regexp_replace(blob, r"\s+", "")), F.lit(""))


def clean_entries(entries: DataFrame) -> DataFrame:
    """One row per (catalog, snapshot_no, path): the blob id that was loaded last.

    Rows without a catalog, snapshot number, path or blob id say nothing and are left out; of rows loaded at the same time the
    greatest blob id wins, so that the result doesn't depend on the order of rows. A row without ``loaded_at`` counts as
    the earliest. The aggregation combines on the map side, so repeated rows never meet in one task.
    """
    return (
        valid_entries(entries)
        .groupBy("catalog", "snapshot_no", "relative_path")
        .agg(F.max(F.struct("loaded_at", "blob")).alias("last"))
        .select("catalog", "snapshot_no", "relative_path", F.col("last.blob").alias("blob"))
    )


def valid_entries(entries: DataFrame) -> DataFrame:
    """The rows that say something, in one spelling."""
    return (
        entries.select(
            "catalog",
            F.col("snapshot_no").cast("int").alias("snapshot_no"),
            F.nullif(git_path(F.col("relative_path")), F.lit("")).alias("relative_path"),
            blob_key(F.col("blob_id")).alias("blob"),
            F.coalesce(F.col("loaded_at").cast("timestamp"), F.timestamp_micros(F.lit(-(2**60)))).alias("loaded_at"),
        )
        .where("catalog is not null and snapshot_no is not null and relative_path is not null and blob is not null")
    )


def snapshot_sequence(entries: DataFrame) -> DataFrame:
    """The snapshots of each catalog that exist, each with its neighbours."""
    order = Window.partitionBy("catalog").orderBy("snapshot_no")
    return (
        entries.select("catalog", "snapshot_no")
        .distinct()
        .withColumns({"before": F.lag("snapshot_no").over(order), "after": F.lead("snapshot_no").over(order)})
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream one sorted range; the last row of a batch is carried to the next one."""
    names = ["catalog", "relative_path", "snapshot_no", "blob", "before", "after"]

    def column(values: pa.Array, kind: str) -> np.ndarray:
        return np.asarray(values.fill_null(-(2**31))) if kind == "int" else np.asarray(values.to_pylist(), dtype=object)

    def emit(out: list[tuple[np.ndarray, np.ndarray, np.ndarray, str]]) -> pa.RecordBatch:
        parts = [np.concatenate([o[i] for o in out]) for i in range(3)]
        change = [c for *cols, c in out for _ in range(len(cols[0]))]
        return pa.RecordBatch.from_arrays(
            [pa.array(parts[0], pa.string()), pa.array(parts[1], pa.int32()), pa.array(parts[2], pa.string()), pa.array(change, pa.string())],
            names=["catalog", "snapshot_no", "relative_path", "change"],
        )

    none = np.int64(-(2**31))
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [column(batch.column(batch.schema.get_field_index(n)), "int" if n in ("snapshot_no", "before", "after") else "str") for n in names]
        first_is_start = held is None
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        cat, path, no, blob, before, after = cols
        same = (cat[:-1] == cat[1:]) & (path[:-1] == path[1:])
        joined = same & (after[:-1] == no[1:])
        changed = joined & (blob[:-1] != blob[1:])
        gone = ~joined & (after[:-1] != none)
        come = ~joined & (before[1:] != none)
        out = [
            (cat[1:][changed], no[1:][changed], path[1:][changed], "changed"),
            (cat[:-1][gone], after[:-1][gone], path[:-1][gone], "removed"),
            (cat[1:][come], no[1:][come], path[1:][come], "added"),
        ]
        if first_is_start and before[0] != none:
            out.append((cat[:1], no[:1], path[:1], "added"))
        held = [c[-1:] for c in cols]
        yield emit(out)
    if held is not None and held[5][0] != none:
        yield emit([(held[0], held[5], held[1], "removed")])


def snapshot_changes(entries: DataFrame, *, ranges: int | None = None) -> DataFrame:
    """Typed changes ``(catalog, snapshot_no, relative_path, change)`` between consecutive snapshots of each catalog.

    ``snapshot_no`` is the later snapshot; ``change`` is ``added``, ``removed`` or ``changed``. Numbers of snapshots may
    have gaps: a snapshot is compared with the next one that exists. A catalog's first snapshot gives no rows. Repeated,
    contradicting and empty rows are resolved by :func:`clean_entries`; extra columns are ignored; an empty table gives
    an empty result.
    """
    clean = clean_entries(entries)
    # One row per snapshot: a few per catalog. Spark broadcasts it if its measured size allows, and else joins by sorting.
    # It comes from the rows before they are aggregated, so that only a few pairs are shuffled for it.
    merged = clean.join(snapshot_sequence(valid_entries(entries)), ["catalog", "snapshot_no"])
    key = ["catalog", "relative_path"]
    by_range = merged.repartitionByRange(ranges, *key) if ranges else merged.repartitionByRange(*key)
    return by_range.sortWithinPartitions(*key, "snapshot_no").mapInArrow(_merge, CHANGES)
