import datetime as dt
import random

from pyspark.sql import functions as F

from chunkloom.operators.snapshots import git_path, snapshot_changes

SCHEMA = "catalog string, snapshot_no int, relative_path string, blob_id string, loaded_at timestamp, before string, blob int"
T0 = dt.datetime(2025, 1, 1)


def entries(spark, rows):
    return spark.createDataFrame([(*r[:4], None if len(r) > 4 and r[4] is None else T0 + dt.timedelta(hours=r[4] if len(r) > 4 else 0), "x", 1) for r in rows], SCHEMA)


def changes(spark, rows, **how):
    return {tuple(r) for r in snapshot_changes(entries(spark, rows), **how).collect()}


def test_typed_changes_over_gaps(spark):
    rows = [("a", 1, "x", "1"), ("a", 1, "y", "2"), ("a", 4, "x", "9"), ("a", 4, "z", "3"), ("a", 5, "z", "3"), ("a", 5, "y", "2"), ("b", 4, "x", "1")]
    assert changes(spark, rows) == {
        ("a", 4, "x", "changed"), ("a", 4, "y", "removed"), ("a", 4, "z", "added"), ("a", 5, "x", "removed"), ("a", 5, "y", "added"),
    }


def test_repeats_corrections_and_spellings(spark):
    rows = [
        ("a", 1, "d/x", "AB"), ("a", 1, "./d//x", "ab"), ("a", 1, "d\\y", "1", 1), ("a", 1, "d/y", "2", 0), ("a", 1, "d/q", None),
        ("a", 2, "d/x", "ab"), ("a", 2, "d/y", "1"), ("a", 2, "D/x", "ab"), ("a", 2, "d/q", ""), ("a", 2, "d/n", "7", None), ("a", 2, "d/n", "6", 0),
        ("a", 3, "d/x", "ab"), ("a", 3, "d/y", "1"), ("a", 3, "D/x", "ab"), ("a", 3, "d/n", "6"),
    ]
    assert changes(spark, rows) == {("a", 2, "D/x", "added"), ("a", 2, "d/n", "added")}


def test_nulls_ties_and_emptiness(spark):
    rows = [(None, 1, "x", "1"), ("a", None, "x", "1"), ("a", 1, None, "1"), ("a", 1, "x", "1"), ("a", 1, "x", "2"), ("a", 2, "x", "2")]
    assert changes(spark, rows) == set()
    assert changes(spark, rows[:1]) == set() and snapshot_changes(entries(spark, rows).limit(0)).count() == 0


def test_against_brute_force_over_many_ranges(spark):
    r = random.Random(5)
    rows = [("abc"[r.randrange(3)], r.choice([1, 2, 5, 6]), f"p/{r.randrange(60)}", str(r.randrange(3)), 0) for _ in range(900)]
    rows = list({(c, n, p): (c, n, p, b, t) for c, n, p, b, t in rows}.values())
    held = {}
    for c, n, p, b, _ in rows:
        held.setdefault(c, {}).setdefault(n, {})[p] = b
    wanted = set()
    for c, snaps in held.items():
        nos = sorted(snaps)
        for old, new in zip(nos, nos[1:]):
            for p in snaps[old].keys() | snaps[new].keys():
                a, b = snaps[old].get(p), snaps[new].get(p)
                if a != b:
                    wanted.add((c, new, p, "added" if a is None else "removed" if b is None else "changed"))
    assert changes(spark, rows, ranges=7) == wanted
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        assert changes(spark, rows, ranges=3) == wanted
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_git_path(spark):
    given = ["a/b", "./a/b", "a\\b", "/a//b/", "a/./b", "a/x/../b", "../a", "", None]
    got = [r[0] for r in spark.createDataFrame([(g,) for g in given], "p string").select(git_path(F.col("p"))).collect()]
    assert got == ["a/b"] * 6 + ["a", "", None]
