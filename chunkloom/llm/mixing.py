"""Mixing sources to target weights.

Method: iterative proportional fitting. The documents' tokens are summed by cell (source, language, topic). Cell weights - how often
each of a cell's documents is used on average - are raked to the topic, language and source marginals in turn, the source
marginal last, and never beyond the source's cap, until they no longer change. Languages and topics have targets of their own; without any, a
language or topic is to have the share that it has in the pool. Documents are then drawn by these calibrated probabilities: the whole part of a weight
is certain, its fraction is a chance decided by a hash of the document's id.

The cell table is bounded: the sources of the targets, a fixed set of languages and a fixed number of topic classes (topics are
hashed into classes, or are those that have a target). Only it reaches the driver, in columns; documents are joined to it as a broadcast of that bounded size.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.tokens import TOKENIZERS, token_counter
from chunkloom.runtime import Scratch

#: fixed values: spellings of the languages that are told apart; everything else is "other", a missing language "unknown"
LANGUAGES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français"),
    "es": ("es", "spa", "spanish", "español"),
    "unknown": ("", "und", "unk", "unknown", "null", "none"),
}


def language(lang: Column) -> Column:
    """A declared language in one spelling: the part before a region, lower case."""
    said = F.lower(F.trim(F.regexp_extract(F.coalesce(lang, F.lit("")), r"^\s*([^-_]*)", 1)))
    found = F.when(F.lit(False), F.lit(""))
    for name, spellings in LANGUAGES.items():
        found = found.when(said.isin(*spellings), name)
    return found.otherwise("other")


def source_key(source: Column) -> Column:
    return F.nullif(F.lower(F.trim(source)), F.lit(""))


def sized_documents(documents: DataFrame, *, topics: int | list[str], tokenizer: str) -> DataFrame:
    """``(doc_id, source, lang, topic, tokens)``; a null or blank text has no tokens.

    ``topics`` is a number of classes that packages are hashed into, or the packages that are classes 1, 2, ... of their own, all others being class 0.
    """
    tokens = token_counter(documents.sparkSession, tokenizer)
    package = F.coalesce("package_name", F.lit(""))
    topic = F.pmod(F.xxhash64(package), F.lit(topics)) if isinstance(topics, int) else F.array_position(F.array(*map(F.lit, topics)).cast("array<string>"), package)
    return documents.select(
        "doc_id",
        source_key(F.col("source")).alias("source"),
        language(F.col("lang")).alias("lang"),
        topic.cast("int").alias("topic"),
        F.coalesce(tokens(F.when(F.trim("text") != "", F.col("text"))), F.lit(0)).alias("tokens"),
    )


_DIMENSIONS = ("topic", "lang", "source")


def rake(
    cells: pd.DataFrame, targets: pd.DataFrame, budget: float, shares: Mapping[str, Mapping] | None = None, rounds: int = 2000, tolerance: float = 1e-10
) -> pd.DataFrame:
    """The cells with their ``weight``: uses per document that meet the marginals as far as the caps allow.

    The source marginal is ``target_share`` of the budget. ``shares`` gives the shares of the whole that languages (``lang``) and classes of ``topic`` are to have; where a
    dimension is missing, these are the shares of its values in the cells. Shares of values that no cell has are left out, values without a share get none. What a cap cuts off,
    the rest of the source takes over; a source whose cells all reach their cap stays below its target. Marginals that no weights can meet together are met in the order of sources, languages, topics.
    """
    cells = cells.merge(targets, on="source", how="inner").reset_index(drop=True)
    size, cap = cells["tokens"].to_numpy(float), cells["max_repeats"].clip(lower=0).to_numpy(float)
    weight = np.minimum(1.0, cap)
    if not len(cells):
        return cells.assign(weight=weight)
    codes, goals = {}, {}
    for d in _DIMENSIONS:
        codes[d], values = pd.factorize(cells[d])
        if d == "source":
            goals[d] = np.zeros(len(values))
            goals[d][codes[d]] = cells["target_share"].to_numpy(float) * budget
        else:
            wanted = (shares or {}).get(d)
            share = np.bincount(codes[d], size) if wanted is None else np.array([float(wanted.get(v, 0.0)) for v in values])
            goals[d] = share / share.sum() if share.sum() > 0 else np.full(len(values), 1.0 / len(values))
    total = lambda d, w: np.bincount(codes[d], size * w, len(goals[d]))
    for _ in range(rounds):
        before = weight
        for d in _DIMENSIONS:
            for _ in range(20 if d == "source" else 1):  # what a cap cuts off, the rest of its source takes over
                now = total(d, weight)
                factor = np.divide(goals[d] if d == "source" else goals[d] * now.sum(), now, out=np.ones_like(now), where=now > 0)
                after = np.minimum(weight * factor[codes[d]], cap)
                still = np.abs(after - weight).max() < tolerance
                weight = after
                if still:
                    break
        if np.abs(weight - before).max() < tolerance:
            break
    return cells.assign(weight=weight)


def residuals(raked: pd.DataFrame, budget: float, shares: Mapping[str, Mapping] | None = None) -> pd.DataFrame:
    """``(dimension, value, wanted, attained)`` in tokens of every marginal of raked cells; languages and topics want shares of what the sources attain."""
    out = []
    used = raked["tokens"] * raked["weight"]
    for d in _DIMENSIONS:
        attained = used.groupby(raked[d]).sum()
        if d == "source":
            wanted = raked.groupby(d)["target_share"].first() * budget
        else:
            given = (shares or {}).get(d)
            wanted = raked["tokens"].groupby(raked[d]).sum() if given is None else pd.Series({v: float(given.get(v, 0.0)) for v in attained.index}, dtype=float)
            wanted = wanted / (wanted.sum() or 1.0) * used.sum()
        out.append(pd.DataFrame({"dimension": d, "value": attained.index.astype(str), "wanted": wanted.reindex(attained.index).to_numpy(), "attained": attained.to_numpy()}))
    return pd.concat(out, ignore_index=True)


class Mixture:
    """A mixture of ``documents`` by ``targets`` (``source``, ``target_share``, ``max_repeats``).

    Documents of sources without a target, and documents without a source, aren't used; the latter don't count in the
    budget either. Several targets of one source add up their shares and take the larger cap. ``budget`` is the size of
    the mixture in tokens; by default that of all documents that have a source, each once. ``languages`` and ``packages`` may
    give the shares that languages (the names of :data:`LANGUAGES` and "other") and packages are to have; what a
    package's shares leave of the whole belongs to all other packages together.
    """

    def __init__(
        self,
        documents: DataFrame,
        targets: DataFrame,
        *,
        budget: float | None = None,
        languages: Mapping[str, float] | None = None,
        packages: Mapping[str, float] | None = None,
        topics: int = 64,
        tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken",
        seed: int = 1,
        most_sources: int = 10_000,
    ):
        self.spark, self.seed = documents.sparkSession, seed
        # tokens are counted once: a few numbers a document are kept for the draws
        self.sized = Scratch(self.spark, "mixture").write(sized_documents(documents, topics=topics if packages is None else list(packages), tokenizer=tokenizer), "sized")
        self.shares: dict[str, Mapping] = {}
        if languages is not None:
            self.shares["lang"] = languages
        if packages is not None:
            self.shares["topic"] = {0: max(0.0, 1.0 - sum(packages.values())), **dict(enumerate(packages.values(), 1))}
        wanted = (
            targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("double"))
            .where("source is not null")
            .groupBy("source")
            .agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1.0))).alias("max_repeats"))
        )
        rows = wanted.limit(most_sources + 1).collect()
        if len(rows) > most_sources:
            raise ValueError(f"more than {most_sources} target sources")
        self.targets = pd.DataFrame([r.asDict() for r in rows], columns=["source", "target_share", "max_repeats"])
        # at most (sources + 1) x languages x topics rows: sources without a target are one
        named = F.when(F.col("source").isin(*self.targets["source"]), F.col("source")) if rows else F.lit(None).cast("string")
        summed = (
            self.sized.where("source is not null")
            .groupBy(named.alias("source"), "lang", "topic")
            .agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
        )
        cells = pd.DataFrame(summed.toArrow().to_pandas(), columns=["source", "lang", "topic", "tokens", "documents"])
        self.budget = float(cells["tokens"].sum()) if budget is None else float(budget)
        self.cells = rake(cells[cells["source"].notna()], self.targets, self.budget, self.shares)

    def residuals(self) -> pd.DataFrame:
        """How far each marginal is met by the raked weights, see :func:`residuals`."""
        return residuals(self.cells, self.budget, self.shares)

    def report(self) -> pd.DataFrame:
        """Per source: available tokens, what its cap allows, target and attained tokens and shares."""
        by = self.cells.assign(attained=self.cells["tokens"] * self.cells["weight"]).groupby("source")[["documents", "tokens", "attained"]].sum()
        out = self.targets.merge(by, left_on="source", right_index=True, how="left")
        for c in ("documents", "tokens", "attained"):
            out[c] = pd.to_numeric(out[c]).fillna(0.0)
        out["wanted"] = out["target_share"] * self.budget
        out["capacity"] = out["tokens"] * out["max_repeats"].clip(lower=0)
        whole = out["attained"].sum()
        out["expected_share"] = out["attained"] / whole if whole else 0.0
        out["short"] = out["attained"] < out["wanted"] * (1 - 1e-9)
        return out

    def draws(self) -> DataFrame:
        """``(doc_id, source, lang, tokens, uses)`` of every document of a target source that is used at least once."""
        weights = self.spark.createDataFrame(
            pa.table(
                {
                    "source": pa.array(self.cells["source"].tolist(), pa.string()), "lang": pa.array(self.cells["lang"].tolist(), pa.string()),
                    "topic": pa.array(self.cells["topic"].tolist(), pa.int32()), "weight": pa.array(self.cells["weight"].tolist(), pa.float64()),
                }
            )
        )
        chance = F.pmod(F.xxhash64(F.lit(self.seed), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
        whole = F.floor(F.col("weight") + 1e-12)
        return (
            self.sized.join(F.broadcast(weights), ["source", "lang", "topic"])  # bounded by the cell table
            .withColumn("uses", (whole + F.when(chance < F.col("weight") - whole, 1).otherwise(0)).cast("int"))
            .where("uses > 0")
            .select("doc_id", "source", "lang", "tokens", "uses")
        )

    def reached(self) -> DataFrame:
        """Per target source: target share, tokens drawn and the share of the drawn tokens that it reached."""
        report = self.report()
        planned = self.spark.createDataFrame(
            [(r.source, float(r.target_share), float(r.max_repeats), float(r.capacity), bool(r.short)) for r in report.itertuples()],
            "source string, target_share double, max_repeats double, capacity double, short boolean",
        )
        drawn = self.draws().groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("drawn"), F.max("uses").alias("most_uses"))
        joined = planned.join(drawn, "source", "left").fillna({"drawn": 0, "most_uses": 0})
        whole = joined.agg(F.sum("drawn").alias("all"))
        return joined.crossJoin(F.broadcast(whole)).select(  # a single row
            "source",
            "target_share",
            "max_repeats",
            "most_uses",
            F.col("drawn").alias("tokens"),
            F.when(F.col("all") > 0, F.col("drawn") / F.col("all")).otherwise(0.0).alias("share"),
            "short",
        )

    def short_sources(self) -> DataFrame:
        """Sources that stay below their target although every document is used as often as allowed."""
        report = self.report()
        return self.spark.createDataFrame([(s,) for s in report.loc[report["short"], "source"]], "source string")
