import os

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from chunkloom.llm.mixing import Mixture, language, rake, residuals, source_key
from chunkloom.llm.tokens import TOKENIZERS, token_counter

pytestmark = pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no tokenizer files")
DOCS = "doc_id long, text string, lang string, source string, package_name string, weight int, topic string"
TARGETS = "source string, target_share double, max_repeats int"


def documents(spark, sources):
    return spark.createDataFrame([(i, "one two three four five", "en" if i % 3 else "de", s, f"p{i % 7}", 5, "t") for i, s in enumerate(sources)], DOCS)


def cells_of(sources, langs, topics):
    r = np.random.default_rng(4)
    return pd.DataFrame([(s, lang, t, int(r.integers(50, 900)), 1) for s in sources for lang in langs for t in topics], columns=["source", "lang", "topic", "tokens", "documents"])


def test_rake_meets_all_marginals(spark):
    cells = cells_of("abc", ["en", "de"], [0, 1, 2])
    targets = pd.DataFrame({"source": list("abc"), "target_share": [0.6, 0.3, 0.1], "max_repeats": [50.0] * 3})
    # one factor for each source would give other shares of languages and topics
    by_source = cells["source"].map(dict(zip("abc", [0.6, 0.3, 0.1]))) / cells.groupby("source")["tokens"].transform("sum") * cells["tokens"]
    for shares in ({"lang": {"en": 0.2, "de": 0.8}, "topic": {0: 0.7, 1: 0.2, 2: 0.1}}, {"lang": {"en": 0.9, "de": 0.1}}, {}):
        out = rake(cells, targets, 1000.0, shares)
        left = residuals(out, 1000.0, shares)
        assert (left["wanted"] - left["attained"]).abs().max() < 1e-6 * 1000
        wanted = shares.get("lang") or (cells.groupby("lang")["tokens"].sum() / cells["tokens"].sum()).to_dict()
        used = (out["tokens"] * out["weight"]).groupby(out["lang"]).sum() / 1000
        assert used.to_dict() == pytest.approx(wanted, abs=1e-6)
        assert abs(by_source.groupby(cells["lang"]).sum()["en"] - wanted["en"]) > 0.001


def test_rake_within_caps():
    cells = cells_of("ab", ["en", "de"], [0])
    targets = pd.DataFrame({"source": list("ab"), "target_share": [0.5, 0.5], "max_repeats": [2.0, 40.0]})
    size = cells.groupby("source")["tokens"].sum()
    out = rake(cells, targets, 10.0 * size["a"], {"lang": {"en": 0.4, "de": 0.6}})
    used = (out["tokens"] * out["weight"]).groupby(out["source"]).sum()
    assert used["a"] == pytest.approx(2 * size["a"]) and used["b"] == pytest.approx(5 * size["a"])
    assert out["weight"].max() <= 40 and (out.loc[out["source"] == "a", "weight"] == 2).all()
    # the other source makes up for the language that the exhausted one can't give
    assert residuals(out, 10.0 * size["a"], {"lang": {"en": 0.4, "de": 0.6}}).query("dimension == 'lang'").eval("abs(wanted - attained)").max() < 1e-5 * size["a"]


def test_language_and_package_targets(spark):
    docs = documents(spark, ["a", "b"] * 1500)
    targets = spark.createDataFrame([("a", 0.5, 9), ("b", 0.5, 9)], TARGETS)
    mix = Mixture(docs, targets, languages={"en": 0.3, "de": 0.7}, packages={"p3": 0.5, "p4": 0.1})
    assert mix.residuals().eval("abs(wanted - attained)").max() < 1e-5
    drawn = mix.draws().join(docs.select("doc_id", "package_name"), "doc_id").toPandas()
    whole = (drawn["tokens"] * drawn["uses"]).sum()
    share = lambda c: ((drawn["tokens"] * drawn["uses"]).groupby(drawn[c]).sum() / whole).to_dict()
    assert share("lang") == pytest.approx({"en": 0.3, "de": 0.7}, abs=0.03)
    assert share("package_name")["p3"] == pytest.approx(0.5, abs=0.03) and share("package_name")["p4"] == pytest.approx(0.1, abs=0.03)


def test_caps_hold_and_short_sources_are_reported(spark):
    docs = documents(spark, ["big"] * 900 + ["small"] * 50 + ["mid"] * 300 + [None] * 40 + ["other"] * 10)
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.5, 2), ("mid", 0.1, 3), ("absent", 0.0001, 9)], TARGETS)
    mix = Mixture(docs, targets)
    assert {r.source for r in mix.short_sources().collect()} == {"small", "absent"}
    drawn = mix.draws().toPandas()
    assert drawn.groupby("source")["uses"].max().to_dict() == {"big": 1, "small": 2, "mid": 1}
    assert drawn[drawn["source"] == "small"]["uses"].eq(2).all()
    reached = mix.reached().toPandas().set_index("source")
    whole = 1260 * 5
    assert abs(reached.loc["big", "tokens"] - 0.4 * whole) < 0.06 * whole
    assert reached["share"].sum() == pytest.approx(1.0) and reached.loc["absent", "tokens"] == 0


def test_draws_are_repeatable(spark):
    docs, targets = documents(spark, ["a"] * 200 + ["b"] * 200), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 4)], TARGETS)
    first, second = (sorted(map(tuple, Mixture(docs, targets).draws().collect())) for _ in range(2))
    assert first == second


def test_spellings(spark):
    got = spark.createDataFrame([("EN",), ("eng",), ("de-AT",), (None,), ("und",), ("xx",), (" fr ",)], "lang string").select(language(F.col("lang"))).collect()
    assert [r[0] for r in got] == ["en", "en", "de", "unknown", "unknown", "other", "fr"]
    assert spark.createDataFrame([(" A ",), ("",), (None,)], "s string").select(source_key(F.col("s")).alias("s")).collect() == [("a",), (None,), (None,)]


def test_edges(spark):
    targets = spark.createDataFrame([("a", 1.0, 2), (None, 0.5, 1)], TARGETS)
    empty = documents(spark, ["a"]).limit(0)
    assert {r.source for r in Mixture(empty, targets).short_sources().collect()} == set()
    assert Mixture(empty, targets).draws().count() == 0
    blank = spark.createDataFrame([(1, None, None, "a", None, 1, "t"), (2, "  ", None, "a", None, 1, "t")], DOCS)
    assert Mixture(blank, targets).draws().where("tokens > 0").count() == 0
    assert Mixture(documents(spark, ["a"]), targets.limit(0)).draws().count() == 0


def test_token_counts(spark):
    texts = [None, "", "hello world", "x" * 120_001, "line\n" * 30_000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(token_counter(spark)(F.col("text"))).collect()]
    assert got[:3] == [None, 0, 2] and got[3] > 1000 and got[4] > 10_000
