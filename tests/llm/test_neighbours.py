import numpy as np
import pytest

from chunkloom.llm.neighbours import CrossPolytope, hadamard, nearest, neighbour_pairs

SCHEMA = "point_id string, vector array<float>, cls string, code int"


def rows(ids, vectors):
    return [(i, None if v is None else [None if x is None else float(x) for x in v], "clash", 1) for i, v in zip(ids, vectors)]


def brute(ids, vectors, k):
    x = np.array(vectors, float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    out = {}
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (round(d[i, j], 9), ids[j]))[:k]
        out[ids[i]] = [ids[j] for j in order]
    return out


def test_hadamard_keeps_lengths_and_is_its_own_inverse():
    x = np.random.default_rng(0).normal(size=(5, 16)).astype(np.float32)
    assert np.allclose(hadamard(hadamard(x)), x, atol=1e-5)
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1), rtol=1e-5)


def test_number_of_buckets_follows_the_parameter():
    assert CrossPolytope(64, 2, 1, 1).digits == 1
    assert CrossPolytope(64, 2, 128, 1).digits == 1
    family = CrossPolytope(64, 2, 5000, 1)
    assert (family.digits, family.last_dims) == (2, 20)


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    vectors = [centres[i % 60] + rng.normal(size=16) * 0.25 for i in range(900)]
    ids = [f"p{i:04d}" for i in range(900)]
    found = nearest(spark.createDataFrame(rows(ids, vectors), SCHEMA), dim=16, k=5).collect()
    true = brute(ids, vectors, 5)
    got = {}
    for r in found:
        got.setdefault(r.point_id, []).append(r.neighbour_id)
    hits = sum(len(set(got.get(i, ())) & set(true[i])) for i in ids)
    assert hits / (5 * len(ids)) >= 0.9
    assert all(r.point_id != r.neighbour_id and 1 <= r["rank"] <= 5 for r in found)


def test_unusable_vectors_copies_and_few_points(spark):
    e = np.eye(4)
    ids = ["a", "b", "c", "d", "e", "f", "g", None, "h", "a"]
    vectors = [e[0], 2 * e[0], e[0] + 0.1 * e[1], [0, 0, 0, 0], [1, 2, 3], [1, None, 0, 0], [float("nan"), 0, 0, 1], e[2], None, e[0]]
    got = nearest(spark.createDataFrame(rows(ids, vectors), SCHEMA), dim=4, k=3).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.point_id, []).append((r.neighbour_id, round(r.distance, 6)))
    assert set(by) == {"a", "b", "c"}
    assert by["a"] == [("b", 0.0), ("c", round(1 - 1 / np.sqrt(1.01), 6))]
    assert [n for n, _ in by["c"]] == ["a", "b"]


def test_many_copies_give_each_its_first_others(spark):
    ids = [f"c{i:02d}" for i in range(30)]
    got = nearest(spark.createDataFrame(rows(ids, [[1, 2, 0, 0]] * 30), SCHEMA), dim=4, k=3).collect()
    by = {}
    for r in got:
        by.setdefault(r.point_id, set()).add(r.neighbour_id)
    assert len(by) == 30
    assert by["c00"] == {"c01", "c02", "c03"} and by["c20"] == {"c00", "c01", "c02"}


@pytest.mark.parametrize("n", [0, 1])
def test_nothing_to_compare(spark, n):
    assert neighbour_pairs(spark.createDataFrame(rows(["a"] * n, [[1, 0]] * n), SCHEMA), dim=2, k=5).count() == 0


def test_a_tight_cluster_is_cut_into_ranges(spark):
    from chunkloom.llm.neighbours import CrossPolytope, _hash, unit_points

    r = np.random.default_rng(8)
    centre = r.normal(size=16)
    rows = [(f"p{i:04d}", [float(v) for v in centre + 1e-6 * r.normal(size=16)]) for i in range(3000)]
    points = spark.createDataFrame(rows, "point_id string, vector array<float>")
    family = CrossPolytope(16, 2, 64, 1)
    coded = unit_points(points, 16).mapInArrow(_hash(family), "code binary, vec binary")
    digits = coded.selectExpr("left(hex(code), length(hex(code)) - 8) as d").distinct().count()
    assert digits <= 2 * 2 * 4  # of each table and probe hardly more than one cell
    sizes = [p[0] for p in coded.repartitionByRange(12, "code").selectExpr("spark_partition_id() as p").groupBy("p").count().select("count").collect()]
    assert max(sizes) < 3000 and len(sizes) >= 10
    line = family.place(0, np.stack([centre * 0 - 1, centre * 0, centre * 0 + 1]).astype(np.float32) * family.lines[0])
    assert line.tobytes()[:4] < line.tobytes()[4:8] < line.tobytes()[8:]
