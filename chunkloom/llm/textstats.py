"""Per-document text statistics, and from them whether a text is prose, a list, a table or junk.

Method: every text gets a vector of statistics. Per language, a mean and covariance of prose are estimated robustly from all texts of it: from
the shortest halves of each statistic, then, in concentration steps, from the texts within the central ellipsoid of the last estimate. A text's
squared Mahalanobis distance from its language's prose is its outlierness, and each statistic's share of that distance is reported. The
distance decides: what lies within is prose, and of an outlier the statistic of layout (entries, rows, other lines) that contributes most
to the distance is its kind.

Deciles, means and covariances are aggregates over all documents; only these (one row per language) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.prose import COMMON_WORDS, STATISTICS, statistics
from chunkloom.runtime import Scratch

_N = len(STATISTICS)
#: fixed values: quantiles of the chi-square distribution with 12 degrees of freedom
_CENTRAL, _OUTLIER = 23.337, 32.909  # 0.975 and 0.999
#: the layout statistics, and the kind of a text in whose distance they lead
_KINDS = {"list_share": "list", "table_share": "table", "other_share": "junk"}
#: fixed values: mean and standard deviation of ordinary prose in any language. They count as a few texts, so that an estimate from few texts is one too.
_PRIOR = {
    "log_words": (4.5, 1.2), "word_length": (4.8, 0.8), "symbol_ratio": (0.04, 0.03), "digit_ratio": (0.01, 0.02), "common_share": (0.42, 0.12), "line_end_share": (0.7, 0.3),
    "log_line_words": (3.2, 0.8), "sentence_rate": (0.07, 0.03), "variety": (1.5, 0.4), "list_share": (0.0, 0.1), "table_share": (0.0, 0.1), "other_share": (0.0, 0.1),
}
_PRIOR_TEXTS = 20
#: the least standard deviation: a short list or code sample makes no prose an outlier, nor does a tight collection make slight deviations ones
_LEAST = np.array([0.8, 0.5, 0.03, 0.03, 0.08, 0.3, 0.7, 0.03, 0.4, 0.1, 0.1, 0.1])
#: texts of unlisted languages: of what is pooled from the listed ones, more varies
_FOREIGN = np.array([1.0, 2.0, 0.03, 0.02, 0.2, 0.3, 0.8, 0.05, 0.6, 0.1, 0.1, 0.1])

_MEASURED = "key {kind}, language string, stats array<double>, prose double, item double, row double, other double"


def measure(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, language, stats, prose, item, row, other)``: the statistics, in order of :data:`STATISTICS`, and the shares of line kinds.

    Null and blank texts have null statistics. Texts are measured whole.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["key"], batch["text"]):
                if t is None or not t.strip():
                    rows.append((k, None, None, None, None, None, None))
                    continue
                stats, shares, lang = statistics(t)
                rows.append((k, lang, [stats[s] for s in STATISTICS], shares["prose"], shares["item"], shares["row"], shares["other"]))
            yield pd.DataFrame(rows, columns=["key", "language", "stats", "prose", "item", "row", "other"])

    return documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, _MEASURED.format(kind=kind))


class ProseModel:
    """Mean and inverse covariance of prose by language; a language with little prose, and unlisted ones, use that of all languages."""

    def __init__(self, moments: dict[str, tuple[float, np.ndarray, np.ndarray]], least: int = 50):
        mean0, sd0 = (np.array([_PRIOR[s][i] for s in STATISTICS]) for i in (0, 1))
        prior = (float(_PRIOR_TEXTS), mean0 * _PRIOR_TEXTS, (np.diag(sd0**2) + np.outer(mean0, mean0)) * _PRIOR_TEXTS)
        listed = [moments[lang] for lang in COMMON_WORDS if lang in moments]
        pooled = tuple(sum(x) for x in zip(prior, *listed))
        self.by: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for lang in (*COMMON_WORDS, "other"):
            own = moments.get(lang)
            n, total, products = own if lang != "other" and own is not None and own[0] >= least else pooled
            mean = total / n
            cov = products / n - np.outer(mean, mean)
            more = _FOREIGN if lang == "other" else _LEAST
            self.by[lang] = mean, np.linalg.inv(cov + np.diag((more**2 - np.diag(cov)).clip(0) + 1e-6))

    @classmethod
    def of_quantiles(cls, quantiles: dict[str, tuple[float, np.ndarray]]) -> ProseModel:
        """The first estimate, from deciles: of each statistic the shortest interval that holds half of the texts, as an outlying half can't move it."""
        moments = {}
        for lang, (n, q) in quantiles.items():
            at = (q[:, 5:] - q[:, :-5]).argmin(axis=1)
            low, high = (np.take_along_axis(q, (at + k)[:, None], axis=1)[:, 0] for k in (0, 5))
            mean, sd = (low + high) / 2, np.maximum((high - low) / 1.349, 1e-3)
            moments[lang] = n, n * mean, n * (np.diag(sd**2) + np.outer(mean, mean))
        return cls(moments)

    def contributions(self, lang: str, x: np.ndarray) -> np.ndarray:
        mean, inverse = self.by[lang]
        z = x - mean
        return z * (z @ inverse)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, _N)


def _sums(model: ProseModel):
    """Per batch and language: count, sum and sum of products of the statistics of the texts within the model's central ellipsoid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats, langs = _matrix(batch), batch.column("language").to_numpy(zero_copy_only=False)
            names, sums = [], []
            for lang in sorted(set(langs)):
                x = stats[langs == lang]
                x = x[model.contributions(lang, x).sum(axis=1) <= _CENTRAL]
                names.append(lang)
                sums.append(np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel())).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sums, pa.list_(pa.float64()))], names=["language", "sums"])

    return run


def _judge(model: ProseModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("stats").is_valid().to_numpy(zero_copy_only=False)
            stats = np.full((batch.num_rows, _N), np.nan)
            stats[known] = _matrix(batch)
            langs = batch.column("language").to_numpy(zero_copy_only=False)
            parts = np.full_like(stats, np.nan)
            for lang in sorted(set(langs[known])):
                own = langs == lang
                parts[own] = model.contributions(lang, stats[own])
            distance = parts.sum(axis=1)
            layout = parts[:, [STATISTICS.index(s) for s in _KINDS]]
            kind = np.array(list(_KINDS.values()), dtype=object)[np.nan_to_num(layout).argmax(axis=1)]
            with np.errstate(invalid="ignore"):
                kind[distance <= _OUTLIER] = "prose"
            kind[~known] = "empty"
            unknown = pa.array(~known)
            numbers = [pc.if_else(unknown, pa.scalar(None, pa.float64()), pa.array(np.ascontiguousarray(x))) for x in (*stats.T, distance)]
            offsets = np.concatenate(([0], np.cumsum(np.where(known, _N, 0))))
            maps = pa.MapArray.from_arrays(
                pa.array(offsets, pa.int32(), mask=np.concatenate((~known, [False]))), pa.array(STATISTICS * int(known.sum()), pa.string()), pa.array(parts[known].ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("language"), *numbers, maps, pa.array(kind, pa.string())],
                names=["key", "language", *STATISTICS, "distance", "contributions", "kind"],
            )

    return run


def fit_prose(measured: DataFrame, steps: int = 3) -> ProseModel:
    """The robust model of all measured texts: an estimate from shortest halves, and ``steps`` concentration steps."""
    usable = measured.where("stats is not null").select("language", "stats")
    deciles = [i / 10 for i in range(11)]
    quantiles = usable.groupBy("language").agg(F.count("*").alias("n"), *(F.percentile_approx(F.col("stats")[i], deciles, 1000).alias(f"q{i}") for i in range(_N)))
    model = ProseModel.of_quantiles({r[0]: (float(r[1]), np.array(r[2:], float)) for r in quantiles.collect()})
    size = 1 + _N + _N * _N
    for _ in range(steps):
        added = usable.mapInArrow(_sums(model), "language string, sums array<double>").groupBy("language").agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)))
        sums = {r[0]: np.array(r[1:], float) for r in added.collect()}
        model = ProseModel({lang: (s[0], s[1 : 1 + _N], s[1 + _N :].reshape(_N, _N)) for lang, s in sums.items() if s[0]})
    return model


def classify(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics, outlierness and kind of every text.

    Columns: ``key``, ``language`` (a listed one or ``other``), one per statistic, ``distance`` (squared Mahalanobis distance from prose of the
    language), ``contributions`` (map of statistic to its part of the distance; the parts add up to it), ``kind``:
    ``prose``, ``list``, ``table`` or ``junk``, and ``empty`` for null and blank texts, whose statistics are null. A
    repeated row is classified repeatedly; a null key is kept; an empty table gives an empty result.
    """
    kind = documents.schema[key].dataType.simpleString()
    measured = Scratch(documents.sparkSession, "textstats").write(measure(documents, key, text), "measured")
    model = fit_prose(measured)
    schema = f"key {kind}, language string, {', '.join(f'{s} double' for s in STATISTICS)}, distance double, contributions map<string,double>, kind string"
    return measured.mapInArrow(_judge(model), schema).withColumnRenamed("key", key)
