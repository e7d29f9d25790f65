import random

import pytest
from pyspark.sql import functions as F

from chunkloom.operators import chunking, membership, packages, quality, search
from chunkloom.operators.embedding import auto_sizing, hashing_embedder
from chunkloom.operators.rules import CrawlRules, RuleError


def test_rules(spark):
    cases = {
        "src/index.ts": (True, "typescript"), "node_modules/package/index.ts": (False, "typescript"), "utils.test.ts": (False, "typescript"), "src/utils.test.ts": (True, "typescript"),
        "src/image.png": (False, None), "package.json": (False, None), "a/lib/b.md": (False, "markdown"), "a/mylib/b.md": (True, "markdown"), "x/src.ts": (True, "typescript"), "pnpm-lock.yaml": (False, "lineBased"),
    }
    rules = CrawlRules()
    df = spark.createDataFrame([(p,) for p in cases], "p string").select("p", rules.should_crawl(F.col("p")), rules.strategy(F.col("p")))
    assert {r[0]: (r[1], r[2]) for r in df.collect()} == cases


def test_rule_files():
    good = '{"version": 1, "fileTypes": {".x": "lineBased"}, "patternsToExclude": ["a/", "**/*.{y,z}"], "patternsToKeep": []}'
    assert CrawlRules.from_json(good).exclude == ("a/", "**/*.{y,z}")
    for bad in (good.replace("1", "2", 1), good.replace('"lineBased"', '"x"'), good.replace('".x"', '"x"'), good[:-1] + ', "more": 1}', good.replace("{y,z}", "{y"), "[]"):
        with pytest.raises(RuleError):
            CrawlRules.from_json(bad)


def test_packages(spark):
    manifests = [("package.json", '{"name":"root"}'), ("a/package.json", '{"inner":{"name":"no"},"name":"@x/a"}'), ("a/b/package.json", '{"name":""}'), ("a/c/package.json", "{broken"), ("a/d/other.json", '{"name":"z"}')]
    index = packages.package_index(spark.createDataFrame(manifests, "path string, text string"))
    assert {tuple(r) for r in index.collect()} == {("", "root"), ("a", "@x/a")}
    files = spark.createDataFrame([("cat", p) for p in ("a/b/c.ts", "x.ts", "q/r.ts", "a/c.ts")], "catalog string, relative_path string")
    got = {r.relative_path: r.package for r in packages.nearest_package(files, index, "relative_path", F.col("catalog")).collect()}
    assert got == {"a/b/c.ts": "@x/a", "x.ts": "root", "q/r.ts": "root", "a/c.ts": "@x/a"}
    none = packages.nearest_package(files, index.limit(0), "relative_path", F.col("catalog")).collect()
    assert {r.package for r in none} == {"cat"}


def line_chunks_of(lines, limit):
    out, start = [], 0
    while start < len(lines):
        end, size = start, 0
        while end < len(lines) and size + len(lines[end].encode()) < limit:
            size += len(lines[end].encode()) + 1
            end += 1
        end = max(end, start + 1)
        if "\n".join(lines[start:end]).strip():
            out.append((start + 1, end, "\n".join(lines[start:end])))
        start = end
    return out


def test_line_chunks(spark):
    r = random.Random(2)
    texts = [None, "", "\n\n", "x" * 50, "a\n" * 30] + ["\n".join("é" * r.choice([0, 1, 5, 12, 40]) for _ in range(r.randint(1, 40))) for _ in range(40)]
    rows = chunking.line_chunks(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), limit=30).collect()
    got = {}
    for x in sorted(rows, key=lambda x: (x.k, x.chunk_ordinal)):
        got.setdefault(x.k, []).append((x.start_line, x.end_line, x.chunk_text))
        assert x.chunk_count == sum(y.k == x.k for y in rows)
    for k, t in enumerate(texts):
        lines = (t or "").split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        assert got.get(k, []) == line_chunks_of(lines, 30), t


MD = "# Main title\nintro\n\n## Section 1\nx\n```\n# no heading\n```\n  ### Sub\n#\ny\n"


def md(spark, text, **how):
    rows = chunking.markdown_chunks(spark.createDataFrame([(1, text)], "k int, text string"), **how).collect()
    return [(x.start_line, x.end_line, x.chunk_type, x.symbol_name, x.split_part_ordinal, x.split_part_count) for x in sorted(rows, key=lambda x: (x.start_line, x.split_part_ordinal or 0))]


def test_markdown(spark):
    assert md(spark, MD) == [(1, 3, "section", "Main title", None, None), (4, 8, "section", "Section 1", None, None), (9, 9, "section", "Sub", None, None), (10, 11, "section", None, None, None)]
    assert md(spark, "lost\n# a\n") == [(2, 2, "section", "a", None, None)]
    assert md(spark, "kept\n# a\n", keep_preamble=True) == [(1, 1, "section", None, None, None), (2, 2, "section", "a", None, None)]
    assert md(spark, "no heading\n" * 900) == [(1, 900, "markdown", None, None, None)]
    assert md(spark, "") == [] and md(spark, " \n\n") == []


def test_slugs_are_unique_in_a_document(spark):
    heads = ["Examples", "API", "Examples", "Examples-1", "examples", "???", "???", "API 1", "API"]
    text = "\n".join(f"## {h}\nx" for h in heads)
    rows = chunking.markdown_sections(spark.createDataFrame([(1, text), (2, text)], "k int, text string")).orderBy("k", "start_line").collect()
    wanted = ["examples", "api", "examples-1", "examples-1-1", "examples-2", "", "-1", "api-1", "api-2"]
    assert [r.slug for r in rows] == wanted * 2


def test_oversized_sections(spark):
    parts = md(spark, "# h\n" + ("word " * 10 + "\n\n") * 10, limit=200)
    assert [p[4] for p in parts] == list(range(1, len(parts) + 1)) and all(p[2] == "section" and p[3] is None and p[5] == len(parts) for p in parts)
    plain = md(spark, "# h\n" + "x" * 90 + "\n" + ("y" * 90 + "\n") * 9, limit=200)
    assert len(plain) > 3 and all(p[2] == "markdown" for p in plain)
    gaps = md(spark, "# h\n" + "x" * 150 + "\n\n" + " " * 190 + "\n\n" + "y" * 150 + "\n", limit=160)
    assert {p[5] for p in gaps} != {len(gaps)}


@pytest.mark.parametrize(
    "sizes, score",
    [([72], 100.0), ([1467, 3237, 3324], 86.1), ([5357, 5242, 3921, 4458, 4016, 3268, 2860], 88.9), ([2871, 3644, 1183], 86.5), ([3230, 3071, 3656, 4141], 96.0), ([1943, 2744, 5151], 79.4), ([5798, 5552, 5060, 5061], 100.0)],
)
def test_scores_of_known_cuts(spark, sizes, score):
    rows = [("f", "x" * n) for n in sizes]
    r = quality.quality_report(spark.createDataFrame(rows, "file_id string, text string")).head()
    assert round(r.score, 1) == score and r.chunks == len(sizes)


def test_search_prefers_the_label_before_the_rank(spark):
    rows = [(f"p{i}", ["c:near"], [1.0, i / 100]) for i in range(20)] + [("far", ["c:far"], [0.0, 1.0]), ("none", ["c:far"], [0.0, 0.0])]
    df = spark.createDataFrame(rows, "point_id string, active_label_ids array<string>, vector array<float>")
    assert [r.point_id for r in search.vector_search(df, [1.0, 0.0], "c:far", 5).collect()] == ["far"]
    assert [r.point_id for r in search.vector_search(df, [1.0, 0.0], None, 3).collect()] == ["p0", "p1", "p2"]
    assert search.vector_search(df, [1.0, 0.0], "c:other").count() == 0


def test_selections(spark):
    f = "aaaabbbbcccc1111"
    S = search.Selection
    assert [S.parse(x) for x in (f, f + ":3", f + ":2-4", f" {f}:3-end ")] == [S(f), S(f, 3, 3), S(f, 2, 4), S(f, 3, None)]
    for bad in ("invalid", f + ":abc", f + ":end", f + ":0", f + ":5-2", f + ":1-2-3", f + ":"):
        with pytest.raises(ValueError):
            S.parse(bad)
    df = spark.createDataFrame([(f, i, ["c:l"]) for i in (1, 2, 3)], "file_id string, chunk_ordinal int, active_label_ids array<string>")
    got = [(r.request, r.chunk_ordinal) for r in search.view(df, [S(f, 2, None), S("0" * 16), S(f, 1, 1)], "c:l").collect()]
    assert got == [(0, 2), (0, 3), (1, None), (2, 1)]


CHUNK = "point_id string, file_id string, chunk_ordinal int, chunk_count int, active_label_ids array<string>, file_complete boolean"


def test_membership(spark):
    chunks = spark.createDataFrame(
        [("a:1", "a", 1, 2, ["c:x", "c:y"], True), ("a:2", "a", 2, 2, ["c:x"], False), ("a:2", "a", 2, 2, ["c:x", "c:z"], False), ("b:1", "b", 1, 3, ["c:x"], False)], CHUNK
    )
    points = membership.distinct_points(chunks)
    assert {r.point_id: r.active_label_ids for r in points.collect()}["a:2"] == ["c:x", "c:z"]
    files = spark.createDataFrame([("a", "p/a"), ("b", "p/b"), ("n", "p/n"), (None, "p/0")], "file_id string, relative_path string")
    status = lambda forced=None: {r.relative_path: r.status for r in membership.incremental_classify(files, chunks, forced).collect()}
    assert status() == {"p/a": "existing", "p/b": "incomplete", "p/n": "new", "p/0": "new"}
    assert status(spark.createDataFrame([("p/a",)], "relative_path string"))["p/a"] == "new"
    added = membership.label_add(points, files.where("file_id = 'a'"), "c:y")
    assert {r.point_id: r.active_label_ids for r in added.collect()} == {"a:1": ["c:x", "c:y"], "a:2": ["c:x", "c:z", "c:y"]}
    cleaned = membership.label_cleanup(points, files.where("file_id = 'a'"), "c:x")
    assert {r.point_id for r in cleaned.collect()} == {"a:1", "a:2"}
    assert {r.file_id: r.complete for r in membership.file_complete(chunks).collect()} == {"a": True, "b": False}
    merged = membership.upsert(points, points.where("point_id = 'b:1'").withColumn("chunk_count", F.lit(9)))
    assert {r.point_id: r.chunk_count for r in merged.collect()} == {"a:1": 2, "a:2": 2, "b:1": 9}


def test_embedding(spark):
    rows = spark.createDataFrame([("two words",), ("",), (None,), ("words two",)], "t string").select(hashing_embedder(8)(F.col("t")).alias("e")).collect()
    assert rows[0].e.vector == rows[3].e.vector and len(rows[0].e.vector) == 8
    assert rows[1].e.vector is None and rows[2].e.error
    df = spark.createDataFrame([(1 << 30, 1), (64 << 30, 16), (8 << 30, 2)], "ram long, cores long").select(auto_sizing(F.col("ram"), F.col("cores")).alias("s"))
    assert [(r.s.instances, r.s.threads) for r in df.collect()] == [(1, 1), (4, 4), (1, 2)]
