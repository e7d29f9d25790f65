from collections import Counter

from chunkloom.operators.heavy_keys import heavy_keys, key_profile

SCHEMA = "point_id string, text string, active_label_ids array<string>, package_name string, file_id string, labels string, bytes int"


def chunks(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA)


def test_profile_against_brute_force(spark):
    rows = [(f"p{i}", "é\n" * (i % 4) + "x" * (i % 3), [f"c:l{j}" for j in range(i % 5)], "hot" if i % 3 else f"k{i % 11}", f"f{i % 40}") for i in range(600)]
    rows += [(*r[:2], r[2][:1], *r[3:]) for r in rows[::7]]
    got = {(r.key_field, r.key_value): tuple(r)[2:] for r in key_profile(chunks(spark, rows)).collect()}
    wanted = {}
    for _, text, labels, package, file in rows[:600]:
        for key in (("package_name", package), ("file_id", file)):
            w = wanted.setdefault(key, [0, 0, 0, 0, set()])
            w[0] += 1
            w[1] += len(text.encode())
            w[2] += text.count("\n") + (1 if text and not text.endswith("\n") else 0)
            w[3] += len(labels)
            w[4] |= set(labels)
    assert got == {k: (*w[:4], len(w[4])) for k, w in wanted.items()}


def test_heavy_keys_share(spark):
    rows = [(f"p{i}", "t", ["c:l"], "big" if i < 34 else f"k{i}", f"f{i % 33}" if i >= 3 else None) for i in range(100)]
    got = {(r.key_field, r.key_value): (r.rows, r.total) for r in heavy_keys(chunks(spark, rows + rows), share=0.03).collect()}
    counts = Counter(r[4] for r in rows if r[4])
    assert got == {("package_name", "big"): (34, 100)} | {("file_id", f): (n, 100) for f, n in counts.items() if n >= 3}


def test_nulls_and_emptiness(spark):
    rows = [("a", None, None, None, None), ("a", None, None, None, None), (None, "x", ["c:l"], "k", "f"), ("b", "", [None, "c:l"], None, "f")]
    got = {(r.key_field, r.key_value): tuple(r)[2:] for r in key_profile(chunks(spark, rows)).collect()}
    assert got[("package_name", None)]== (2, 0, 0, 1, 1) and ("package_name", "k") not in got
    assert key_profile(chunks(spark, rows).limit(0)).count() == 0 and heavy_keys(chunks(spark, rows).limit(0)).count() == 0
