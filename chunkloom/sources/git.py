"""Repositories as tables: lists come from Git on the driver, contents are read in parallel where the repository is mounted."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.operators.packages import package_index

MIN_VERSION = (2, 35, 0)
FILES = "relative_path string, blob_id string"


class GitError(RuntimeError):
    pass


def _git(repo: str, *args: str, data: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], capture_output=True, input=data)
    if done.returncode:
        raise GitError(f"git {args[0]} failed: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def _parts(output: bytes) -> list[str]:
    return [p.decode("utf-8", "replace") for p in output.split(b"\0") if p]


def version_at_least(version: str, least: tuple[int, ...] = MIN_VERSION) -> bool:
    """Compares dotted numbers; what isn't a number counts as 0."""
    found = [int(n) if n.isdigit() else 0 for n in version.split(".")[: len(least)]]
    return tuple(found + [0] * (len(least) - len(found))) >= least


def ensure_git() -> None:
    said = _git(".", "--version").decode()
    m = re.search(r"\d+(?:\.\d+)*", said)
    if not m or not version_at_least(m[0]):
        raise GitError(f"Git {'.'.join(map(str, MIN_VERSION))} or newer is needed: {said.strip()}")


def resolve_commit(repo: str, revision: str) -> str:
    """The full id of the commit that a branch, tag or abbreviation stands for."""
    return _git(repo, "rev-parse", "--verify", "--end-of-options", f"{revision}^{{commit}}").decode().strip()


def commit_files(spark: SparkSession, repo: str, commit: str) -> DataFrame:
    """``(relative_path, blob_id)`` of all files of a commit; links to other repositories aren't files."""
    rows = []
    for line in _parts(_git(repo, "ls-tree", "-r", "-z", "--full-tree", commit)):
        info, path = line.split("\t", 1)
        _, kind, blob = info.split(" ")
        if kind == "blob":
            rows.append((path, blob))
    return spark.createDataFrame(rows, FILES)


def tracked_files(spark: SparkSession, repo: str) -> DataFrame:
    """``(relative_path, blob_id)`` of the files in the index, each path once."""
    rows = {}
    for line in _parts(_git(repo, "ls-files", "-s", "-z")):
        info, path = line.split("\t", 1)
        mode, blob, _ = info.split(" ")
        if mode not in ("160000", "120000"):  # links to other repositories, and symbolic links, aren't files of a working tree
            rows.setdefault(path, blob)
    return spark.createDataFrame(list(rows.items()), FILES)


def dirty_paths(spark: SparkSession, repo: str) -> DataFrame:
    """``(relative_path, state)`` of files whose content in the working tree differs from the index; state ``exists`` or ``deleted``."""
    listed = _parts(_git(repo, "--no-optional-locks", "status", "-z", "-u", "--no-renames", "--ignore-submodules", "--no-ahead-behind"))
    lines = spark.createDataFrame([(line,) for line in listed if len(line) > 3], "line string")
    return lines.select(status_path(F.col("line")).alias("relative_path"), status_state(F.col("line")).alias("state")).where("state is not null")


def status_path(line: Column) -> Column:
    """The path of a porcelain status line."""
    return F.substring(line, 4, 1 << 30)


def status_state(line: Column) -> Column:
    """``exists`` or ``deleted``, by a porcelain status line; null for one that leaves the working tree as it is."""
    state = F.substring(line, 1, 2)
    return F.when((state == "??") | state.endswith("M"), "exists").when(state.endswith("D"), "deleted")


def working_tree(tracked: DataFrame, dirty: DataFrame, hashed: DataFrame, keys: tuple[str, ...] = ("relative_path",)) -> DataFrame:
    """``(keys, blob_id)`` of a working tree: the ``tracked`` ones without deleted files, and the ``hashed`` ones of dirty files that exist."""
    kept = tracked.join(dirty.where("state = 'deleted'").select(*keys), [*keys], "left_anti").select(*keys, "blob_id")
    fresh = hashed.join(dirty.where("state = 'exists'").select(*keys), [*keys], "left_semi").select(*keys, F.col("blob_id").alias("fresh"))
    return kept.join(fresh, [*keys], "full").select(*keys, F.coalesce("fresh", "blob_id").alias("blob_id"))


def hash_files(repo: str, paths: list[str]) -> list[str]:
    """The blob ids that Git would give these files now, filters applied."""
    if not paths:
        return []
    ids = _git(repo, "hash-object", "--stdin-paths", data="".join(p + "\n" for p in paths).encode()).decode().split()
    if len(ids) != len(paths):
        raise GitError(f"hash-object gave {len(ids)} ids for {len(paths)} paths")
    return ids


def working_files(spark: SparkSession, repo: str) -> DataFrame:
    """``(relative_path, blob_id)`` of the working tree: tracked files that are still there and untracked ones that aren't ignored.

    Paths with a part that starts with a dot are left out.
    """
    dirty = dirty_paths(spark, repo)
    present = [r.relative_path for r in dirty.where("state = 'exists'").collect()]  # what one person changed by hand
    present = [p for p in present if not os.path.islink(f"{repo}/{p}")]
    hashed = spark.createDataFrame(list(zip(present, hash_files(repo, present))), FILES)
    return working_tree(tracked_files(spark, repo), dirty, hashed).where(~F.col("relative_path").rlike(r"(?:^|/)\."))


def with_contents(files: DataFrame, repo: str, *, working_tree: bool = False) -> DataFrame:
    """``files`` with ``content`` (binary): by blob id, or with ``working_tree`` as the file is now. A file that can't be read has null.

    Each task keeps one Git process for all of its blobs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if working_tree:
            for batch in batches:
                yield batch.assign(content=[_read(f"{repo}/{p}") for p in batch["relative_path"]])
            return
        with subprocess.Popen(["git", "-c", "safe.directory=*", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
            for batch in batches:
                yield batch.assign(content=[_blob(git, b) for b in batch["blob_id"]])
            git.stdin.close()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInPandas(run, f"{kinds}, content binary")


def _read(path: str) -> bytes | None:
    try:
        with open(os.open(path, os.O_RDONLY | os.O_NOFOLLOW), "rb") as file:
            return file.read()
    except OSError:
        return None


def _blob(git: subprocess.Popen, blob: str) -> bytes | None:
    git.stdin.write(blob.encode() + b"\n")
    git.stdin.flush()
    head = git.stdout.readline().split()
    if len(head) != 3 or head[1] != b"blob":
        if len(head) == 3:
            git.stdout.read(int(head[2]) + 1)
        return None
    data = git.stdout.read(int(head[2]))
    git.stdout.read(1)
    return data


def decoded(files: DataFrame) -> DataFrame:
    """``files`` with ``text`` in place of ``content``; files that aren't UTF-8, or couldn't be read, are left out."""
    text = F.col("content").cast("string")
    return files.where(F.col("content").isNotNull() & F.is_valid_utf8(text)).withColumn("text", text).drop("content")


def packages(files: DataFrame, repo: str, *, working_tree: bool = False) -> DataFrame:
    """``(dir, name)`` of the packages that the manifests among ``files`` declare."""
    manifests = files.where(F.substring_index("relative_path", "/", -1) == "package.json")
    return package_index(decoded(with_contents(manifests, repo, working_tree=working_tree)), "relative_path", "text")
