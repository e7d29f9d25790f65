"""Which package a file belongs to: the nearest folder above it that has a manifest with a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def manifest_folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?package\.json$", "")


def package_index(manifests: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``(dir, name)`` of the manifests (``package.json``) that have a top-level name.

    Broken JSON, a missing or empty name, and a name that is no string give no row; of several manifests of one folder the
    greatest name wins.
    """
    named = manifests.where((F.substring_index(F.col(path), "/", -1) == "package.json") & F.col(text).rlike(r'"name"\s*:\s*"'))
    return (
        named.select(manifest_folder(F.col(path)).alias("dir"), F.nullif(F.get_json_object(text, "$.name"), F.lit("")).alias("name"))
        .where("name is not null")
        .groupBy("dir")
        .agg(F.max("name").alias("name"))
    )


def nearest_package(files: DataFrame, packages: DataFrame, path: str, fallback: Column, *, within: tuple[str, ...] = ()) -> DataFrame:
    """``files`` with ``package``: the name of the nearest ancestor folder in ``packages``, else ``fallback``.

    ``within`` names columns that both tables share (say the catalog) and that must agree. A path is expanded into its
    ancestors, which is bounded by its depth, and the folders are joined as equals; no prefix join is needed.
    """
    parts = F.split(F.col(path), "/")
    depths = F.sequence(F.lit(0), F.size(parts) - 1)
    ancestors = F.transform(depths, lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))
    keys = (*within, path)
    expanded = files.select(*keys).distinct().withColumn("a", F.explode(ancestors)).select(*keys, "a.depth", "a.dir")
    found = expanded.join(packages.select(*within, "dir", "name"), [*within, "dir"]).groupBy(*keys).agg(F.max(F.struct("depth", "name")).alias("p"))
    found = found.select(*keys, F.col("p.name").alias("package"))
    return files.join(found, list(keys), "left").withColumn("package", F.coalesce("package", fallback))
