"""Per-key results although a handful of keys hold most rows.

Method: dense accumulator arrays. The input is cut into splits of equal size whatever its keys are. Each split
dictionary-encodes its keys and adds its rows into dense arrays indexed by code (numpy ``bincount``), one array per measure; the
arrays leave the split as blocks of at most one entry per key. Blocks of equal keys are then summed by a distributed
reduction. A hot key thus costs each split one array slot, and the reduction reads at most one entry per key and split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ("rows", "bytes", "lines", "label_refs")
_BLOCK = "key_field string, key_value string, label_id string, " + ", ".join(f"{m} long" for m in MEASURES)


def line_count(text: Column) -> Column:
    """Lines of a text; a final line break doesn't open another line, the empty text has none."""
    breaks = F.length(text) - F.length(F.translate(text, "\n", ""))
    return F.when(F.length(text) == 0, 0).otherwise(breaks + F.when(text.endswith("\n"), 0).otherwise(1))


def distinct_points(chunks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Each ``point_id`` once, with the measures of its text and its longest label list.

    Repeats of a point may carry an older (shorter) label list and are otherwise equal; of equally long lists the
    greatest wins. Only the measures are shuffled, never texts or vectors. Rows without a ``point_id`` are left out.
    """
    labels = F.array_distinct(F.array_compact(F.coalesce("active_label_ids", F.array().cast("array<string>"))))
    return (
        chunks.where("point_id is not null")
        .select(
            "point_id",
            *keys,
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
            F.coalesce(line_count(F.col("text")), F.lit(0)).cast("long").alias("lines"),
            labels.alias("labels"),
        )
        .groupBy("point_id")
        .agg(F.max(F.struct(F.size("labels").alias("n"), "labels", "bytes", "lines", *keys)).alias("p"))
        .select(*(F.col(f"p.{k}").alias(k) for k in (*keys, "bytes", "lines", "labels")))
    )


def _accumulate(keys: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # an Arrow batch is an equal split: its row count doesn't depend on the keys
            sizes = pc.fill_null(pc.list_value_length(batch.column("labels")), 0).to_numpy(zero_copy_only=False)
            values = {"bytes": batch.column("bytes").to_numpy(zero_copy_only=False), "lines": batch.column("lines").to_numpy(zero_copy_only=False)}
            for key in keys:
                encoded = batch.column(key).dictionary_encode(null_encoding="encode")
                codes, size = encoded.indices.to_numpy(zero_copy_only=False), len(encoded.dictionary)
                sums = {
                    "rows": np.bincount(codes, minlength=size),
                    # exact in float64 below 2**53, far above the bytes of one batch
                    "bytes": np.bincount(codes, values["bytes"], size).astype(np.int64),
                    "lines": np.bincount(codes, values["lines"], size).astype(np.int64),
                    "label_refs": np.bincount(codes, sizes, size).astype(np.int64),
                }
                yield block(key, encoded.dictionary, pa.nulls(size, pa.string()), sums)
                flat = batch.column("labels").flatten().dictionary_encode(null_encoding="encode")
                if not len(flat):
                    continue
                width = max(1, len(flat.dictionary))
                pair, count = np.unique(np.repeat(codes, sizes).astype(np.int64) * width + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
                zero = np.zeros(len(pair), np.int64)
                yield block(
                    key,
                    encoded.dictionary.take(pa.array(pair // width)),
                    flat.dictionary.take(pa.array(pair % width)),
                    {"rows": count, "bytes": zero, "lines": zero, "label_refs": count},
                )

    def block(key: str, values: pa.Array, labels: pa.Array, sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        cols = [pa.array([key] * len(values), pa.string()), values.cast(pa.string()), labels.cast(pa.string())]
        cols += [pa.array(np.asarray(sums[m], np.int64)) for m in MEASURES]
        return pa.RecordBatch.from_arrays(cols, names=["key_field", "key_value", "label_id", *MEASURES])

    return run


def key_blocks(chunks: DataFrame, keys: tuple[str, ...] = ("package_name", "file_id")) -> DataFrame:
    """The summed accumulator blocks: one row per key (``label_id`` null), and one per key and label."""
    blocks = distinct_points(chunks, keys).mapInArrow(_accumulate(keys), _BLOCK)
    return blocks.groupBy("key_field", "key_value", "label_id").agg(*(F.sum(m).alias(m) for m in MEASURES))


def key_profile(chunks: DataFrame, keys: tuple[str, ...] = ("package_name", "file_id")) -> DataFrame:
    """Rows, bytes, lines and label counts of every key value, each ``point_id`` counted once.

    ``label_refs`` counts label memberships, ``labels`` the distinct labels. A null key is a key of its own
    (``key_value`` null); a null text has no bytes and no lines; a null label list has no labels. An empty table gives
    an empty result.
    """
    return (
        key_blocks(chunks, keys)
        .groupBy("key_field", "key_value")
        .agg(
            *(F.sum(F.when(F.col("label_id").isNull(), F.col(m)).otherwise(0)).alias(m) for m in MEASURES),
            F.count_if(F.col("label_id").isNotNull()).alias("labels"),
        )
    )


def heavy_keys(chunks: DataFrame, keys: tuple[str, ...] = ("package_name", "file_id"), *, share: float = 0.03) -> DataFrame:
    """The key values that hold at least ``share`` of the distinct points, with their accumulated rows.

    A null key takes part in the total but is no value. Rows and total come from the accumulators of :func:`key_blocks` (each field's
    blocks sum to the total), the total as one row.
    """
    blocks = key_blocks(chunks, keys).where("label_id is null").select("key_field", "key_value", "rows")
    total = blocks.where(F.col("key_field") == keys[0]).agg(F.sum("rows").alias("total"))
    return (
        blocks.crossJoin(F.broadcast(total))  # the broadcast side is a single row by construction
        .where(F.col("key_value").isNotNull() & (F.col("rows") >= F.ceil(F.col("total") * share - 1e-9)))
        .select("key_field", "key_value", "rows", "total")
    )
