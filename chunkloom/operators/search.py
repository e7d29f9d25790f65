"""Answering queries over chunks: similarity search and lookups."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.vectors import cosine_distance


def vector_search(chunks: DataFrame, query: list[float], label_id: str | None = None, k: int = 10, *, id_column: str = "point_id", vector: str = "vector", repeated: bool = False) -> DataFrame:
    """The ``k`` rows of smallest cosine distance to ``query`` among those that carry the label, with ``distance``.

    The label is applied before the ranking. Ties go by id. Rows whose vector can't be compared aren't found. Spark keeps
    ``k`` rows a task and merges these, so nothing is sorted as a whole. With ``repeated``, rows may repeat an id with an older (shorter) label list: the last list counts, found
    among the ids and lists alone, so vectors are never shuffled but for the few rows that rank first.
    """
    found = chunks if label_id is None else chunks.where(F.array_contains("active_label_ids", label_id))
    if repeated:
        # a row that has the label, but not in its id's last list, is out; equal rows are one
        lists = chunks.groupBy(id_column).agg(F.max(F.struct(F.size("active_label_ids").alias("n"), "active_label_ids")).alias("l"))
        stale = lists.where(~F.array_contains("l.active_label_ids", label_id)) if label_id is not None else None
        if stale is not None:
            found = found.join(stale.select(id_column), id_column, "left_anti")
        columns = [c for c in found.columns if c != id_column]
        near = found.withColumn("distance", cosine_distance(F.col(vector), query)).where("distance is not null")
        # an id may come first as often as it is repeated, so ids are made one before the first k are taken: by their distances alone
        first = near.groupBy(id_column).agg(F.min("distance").alias("distance")).orderBy("distance", id_column).limit(k)
        order = F.struct(F.size("active_label_ids"), "active_label_ids")
        whole = near.join(F.broadcast(first.select(id_column)), id_column).groupBy(id_column).agg(F.max_by(F.struct(*columns, "distance"), order).alias("r"))  # k rows
        return whole.select(id_column, "r.*").orderBy("distance", id_column)
    return found.withColumn("distance", cosine_distance(F.col(vector), query)).where("distance is not null").orderBy("distance", id_column).limit(k)


@dataclass(frozen=True)
class Selection:
    """Chunks of a file: all, one, a range, or from one to the end; numbers count from 1 and are inclusive."""

    file_id: str
    first: int = 1
    last: int | None = None

    @classmethod
    def parse(cls, spec: str) -> Selection:
        """``id``, ``id:3``, ``id:2-4`` or ``id:3-end``."""
        m = re.fullmatch(r"([0-9a-fA-F]{16})(?::(\d+)(?:-(\d+|end))?)?", spec.strip())
        if not m:
            raise ValueError(f"expected a file id of 16 hexadecimal digits and at most ':N', ':N-M' or ':N-end': {spec!r}")
        file_id, first, last = m.groups()
        if first is None:
            return cls(file_id)
        low = int(first)
        high = None if last == "end" else int(last) if last else low
        if low < 1 or (high is not None and high < low):
            raise ValueError(f"chunk numbers count from 1 and don't fall: {spec!r}")
        return cls(file_id, low, high)


def view(chunks: DataFrame, selections: list[Selection], label_id: str | None = None) -> DataFrame:
    """The selected chunks in the order of the selections and their ordinals; a selection that finds nothing gives one row of nulls.

    ``request`` numbers the selections from 0.
    """
    spark = chunks.sparkSession
    wanted = spark.createDataFrame([(i, s.file_id, s.first, s.last) for i, s in enumerate(selections)], "request int, _file string, _first int, _last int")
    rows = chunks.where(F.col("file_id").isin(*{s.file_id for s in selections}))  # reaches the scan
    if label_id is not None:
        rows = rows.where(F.array_contains("active_label_ids", label_id))
    on = (F.col("file_id") == F.col("_file")) & (F.col("chunk_ordinal") >= F.col("_first")) & (F.col("_last").isNull() | (F.col("chunk_ordinal") <= F.col("_last")))
    return wanted.join(rows, on, "left").drop("_file", "_first", "_last").orderBy("request", "chunk_ordinal")


def view_catalogs(configured: DataFrame, labels: DataFrame) -> DataFrame:
    """``(catalog, labels)``: every configured catalog with its number of labels, 0 for one that was never crawled."""
    counted = labels.groupBy("catalog").agg(F.countDistinct("label").alias("labels"))
    return configured.select("catalog").where("catalog is not null").distinct().join(counted, "catalog", "left").fillna({"labels": 0})
