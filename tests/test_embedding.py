"""A model of a few bytes, written by hand, stands in for a real one: it gives every token its id as its state."""

import pytest
from pyspark.sql import functions as F

from chunkloom import cli
from chunkloom.operators.embedding import onnx_embedder
from chunkloom.sources.config import Config

pytest.importorskip("onnxruntime")
tokenizers = pytest.importorskip("tokenizers")


def number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(at, value):
    """A field of a protocol buffer: a number, or bytes with their length."""
    return number(at << 3) + number(value) if isinstance(value, int) else number(at << 3 | 2) + number(len(value)) + value


def tensor(name, kind, dims):
    shape = b"".join(field(1, field(1, d) if isinstance(d, int) else field(2, d)) for d in dims)
    return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))


def node(op, given, made, attributes):
    return field(1, given) + field(2, made) + field(4, op) + b"".join(field(5, a) for a in attributes)


def model():
    cast = node(b"Cast", b"input_ids", b"f", [field(1, b"to") + field(3, 1) + field(20, 2)])
    wide = node(b"Unsqueeze", b"f", b"states", [field(1, b"axes") + field(8, 2) + field(20, 7)])
    graph = field(1, cast) + field(1, wide) + field(2, b"g") + field(11, tensor(b"input_ids", 7, [1, b"n"])) + field(12, tensor(b"states", 1, [1, b"n", 1]))
    return field(1, 6) + field(7, graph) + field(8, field(1, b"") + field(2, 11))


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "model.onnx").write_bytes(model())
    words = tokenizers.Tokenizer(tokenizers.models.WordLevel({"?": 0, "one": 1, "two": 2, "three": 3}, unk_token="?"))
    words.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    words.save(str(tmp_path / "tokenizer.json"))
    return tmp_path


def test_states_are_pooled(spark, folder):
    rows = spark.createDataFrame([(1, "one two three"), (2, "three three one what"), (3, ""), (4, None), (5, "two " * 50)], "i int, text string")
    got = {r.i: r.e for r in rows.select("i", onnx_embedder(str(folder), max_tokens=10, threads=2)(F.col("text")).alias("e")).collect()}
    assert [float(got[i].vector[0]) for i in (1, 2, 5)] == pytest.approx([2.0, 1.75, 2.0])
    assert all(got[i].vector is None and got[i].error for i in (3, 4))


def test_sizing_reaches_the_model(folder, monkeypatch, capsys):
    seen = {}
    monkeypatch.setattr(cli, "onnx_embedder", lambda path, **how: seen.update(how) or path)
    monkeypatch.setattr(cli.os, "cpu_count", lambda: 12)
    config = Config(model_dir=folder, model_instances=3, threads_per_instance="auto")
    assert cli.embedder_of(config) == (str(folder), f"onnx:{folder.name}") and seen == {"threads": 4}
    cli.embedder_of(Config(model_dir=folder, model_instances=1000, threads_per_instance=1))
    assert "1000 instances" in capsys.readouterr().err
