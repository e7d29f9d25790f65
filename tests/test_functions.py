import hashlib

import pytest
from pyspark.sql import functions as F

from chunkloom.functions import identifiers as I
from chunkloom.functions import text as T
from chunkloom.functions.vectors import cosine_distance


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(f(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "name, code",
    [("my-repo", None), ("a1", None), ("", "catalog_empty"), ("a" * 65, "catalog_too_long"), ("-repo", "catalog_leading_hyphen"), ("repo-", "catalog_trailing_hyphen"), ("my--repo", "catalog_consecutive_hyphens"), ("MyRepo", "catalog_uppercase"), ("my_repo", "catalog_underscore"), ("a:b", "catalog_reserved_char"), ("a b", "catalog_invalid_char"), ("é", "catalog_invalid_char"), (None, None)],
)
def test_catalogs(spark, name, code):
    assert column(spark, [name], I.catalog_error) == [code]


def test_labels(spark):
    good = ["main", "feature/x", "release/v1.2.3", "branch=main", "foo=bar=baz"]
    assert column(spark, good, I.label_error) == [None] * 5
    bad = {"": "label_empty", "Main": "label_uppercase", "feature_x": "label_underscore", "feature/": "label_trailing_separator", "=main": "label_leading_separator", "a//b": "label_leading_separator", "a:b": "label_reserved_char", "a@b": "label_reserved_char", "a b": "label_invalid_char", "a" * 129: "label_too_long", "a/B/": "label_uppercase"}
    assert dict(zip(bad, column(spark, list(bad), I.label_error))) == bad
    assert column(spark, ["a:b/c:d", "ab", "a:b"], I.label_id_error) == ["label_reserved_char", "label_id_no_colon", None]


def test_hashes(spark):
    text = "grüße\n"
    data = text.encode()
    assert column(spark, [text], I.git_blob_id) == [hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()]
    assert column(spark, [text], I.content_hash) == ["sha256:" + hashlib.sha256(data).hexdigest()]


def test_encoding(spark):
    cases = {"weird:file.ts": "weird%3Afile.ts", "@scope/pkg": "%40scope/pkg", "key=value": "key%3Dvalue", "a+b": "a%2Bb", "heading#id": "heading%23id", "100%": "100%25", " ": "%20", "\t": "%09", "\n": "%0A", "\0": "%00", "\x7f": "%7F", " ": "%C2%A0", "ä/b": "ä/b", "": ""}
    assert dict(zip(cases, column(spark, list(cases), T.encode_path))) == cases


def test_slugs_and_headings(spark):
    cases = {"API Reference": "api-reference", "What's New?": "whats-new", "   ": "---", "API: Configuration": "api-configuration", "Über_uns 2": "über_uns-2"}
    assert dict(zip(cases, column(spark, list(cases), T.slug))) == cases
    assert column(spark, ["## A b ", "\t# x", "###", "plain"], T.heading_text) == ["A b", "x", None, "plain"]


def test_lines(spark):
    got = column(spark, ["", "\n", "a", "a\n", "a\r\nb\n\n", "a\rb", None], T.split_lines)
    assert got == [[], [""], ["a"], ["a"], ["a", "b", ""], ["a\rb"], None]
    assert column(spark, ["a\nb\nc\nd"], T.blurb) == ["> a\n> b\n> c"]


def test_display(spark):
    assert column(spark, [0.0, 59.9, 60.0, 3599.0, 3600.0, 7325.0, -5.0], T.format_duration, "double") == ["0s", "59s", "1m 0s", "59m 59s", "1h 0m", "2h 2m", "0s"]
    assert column(spark, [0.0, -1.0, float("inf"), float("nan"), 61.0], T.format_eta, "double") == ["--", "--", "--", "--", "1m 1s"]
    assert column(spark, [0, 1024, 1 << 20, 2 << 30, 2_500_000_000], T.format_bytes, "long") == ["0 bytes", "1024 bytes", "1.0 MB", "2.0 GB", "2.3 GB"]
    assert column(spark, ["a\x1b[31m\tb\x85\n"], T.sanitize) == ["a[31m\tb\n"]


def test_cosine(spark):
    vectors = [[1.0, 0.0], [0.0, 2.0], [-1.0, 0.0], [0.0, 0.0], [1.0], [1.0, None], [float("nan"), 1.0], None]
    got = column(spark, vectors, lambda v: cosine_distance(v, [1.0, 0.0]), "array<float>")
    assert got == [0.0, 1.0, 2.0, None, None, None, None, None]
