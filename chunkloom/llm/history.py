"""Deduplicating new batches against everything already accepted.

Method: texts are known by fingerprints of their lines, and of their lines without each of the words that might be a changed name
(winnowed runs of words can't promise to meet: in short lines a frequent changed name is in every run), and by keys: their class (texts equal apart from layout) and, where
they are told, the file's ``content_hash`` and ``blob_id`` with the place in the file. A persistent store holds, for every class of texts, hashes of its
lines, its fingerprints, and partitioned Bloom filters over the fingerprints. The fingerprints of a batch are first screened by the
filters; only positives are looked up in the store. Texts that share enough fingerprints, or a key, with a held one are
verified by the share of lines that they keep, whatever their keys say. Then the batch enters both the store and the filters. The texts of the
history are read once, when the store is made, and never again.

Layout: postings and held rows lie in folders by part of their hash, and by the version (founding or batch) that brought them. A batch reads only the parts that its positives
and candidates fall in, adds a version of its own with small filters for what it brings, and rewrites nothing. When the parts have grown beyond their
size, or versions are many, they are rewritten into more parts, which happens ever more seldom as the store grows. A
manifest, written last, says what belongs to the store: a batch that failed half way has changed nothing.

Hot fingerprints (stock lines that very many texts share): a fingerprint's first few postings make up tier 0, the
rest tier 1; ranks are taken in salted groups first, so that no task sorts all holders. All lookups read tier 0. Tier 1 is read only for texts still unmatched so many of whose lines
are hot that a match might hide behind them, and only those of its texts are compared that share as many lines as a match must (see :meth:`History._may_match`), so nothing is dropped
and few texts meet all holders of a stock line in vain.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from chunkloom.llm.fingerprints import Bloom, WordArrays, class_of, kept_share, word_lines
from chunkloom.runtime import Scratch, SharedFiles

_READ = "b long, key string, seq long, cls binary, id long, hashes array<long>, fps array<long>, prints array<long>, places array<int>, firsts array<boolean>, labels array<string>"
_HELD = "id long, key string, seq long, labels array<string>, hashes array<long>, v int, part int"
_POSTINGS = "fp long, id long, b long, seq long, fresh boolean, v int, tier int, part int"
_FILTERS = "part int, bits binary, v int"
#: bits of a Bloom filter per fingerprint
_BITS = 12
#: ranks are taken in this many groups of a fingerprint's holders first
_SALTS = 16
#: the numbers of a batch that what the store holds, and texts without a number, count as
_HELD_BATCH, _LAST_BATCH = -(1 << 63), 1 << 31
#: held in the store, an earlier batch, or an earlier row of the batch
_EARLIER = "held_b < b or held_b = b and held_seq < seq"


def _read_texts(often: float, placed: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.iloc[at : at + 2000]
                lines = [word_lines(t) for t in batch["text"]]
                keep = np.array([bool(x) for x in lines], bool)
                batch, lines = batch[keep], [x for x in lines if x]
                if not lines:
                    continue
                classes = [class_of(x) for x in lines]
                ids = np.array([int.from_bytes(c[:8], "little", signed=True) for c in classes], np.int64)
                words = WordArrays(lines)
                if placed:  # a fingerprint has a row for each line that it may be of; the first of them stands for it
                    owner, fps, place = words.placed_line_prints(often)
                    fps = fps & ~np.uint64(1)
                    order = np.lexsort((place, fps, owner))
                    owner, fps, place = owner[order], fps[order], place[order]
                    first = np.concatenate(([True], (owner[1:] != owner[:-1]) | (fps[1:] != fps[:-1])))
                    new = first | np.concatenate(([True], place[1:] != place[:-1]))
                    owner, fps, place, first = owner[new], fps[new], place[new], first[new]
                    ends = np.cumsum(np.bincount(owner, minlength=len(ids)))[:-1]
                    prints, places, firsts = (np.split(x, ends) for x in (fps.view(np.int64), place.astype(np.int32), first))
                    owner, fps = owner[first], fps[first]
                else:
                    owner, fps = words.line_prints(often)
                    prints = places = firsts = [[]] * len(ids)
                # keys are odd, fingerprints of lines even
                keys = batch["keys"].tolist()
                told = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                own = np.concatenate([np.asarray(k, np.int64) for k in keys]) if len(told) else np.zeros(0, np.int64)
                owner = np.concatenate((owner, np.arange(len(ids)), told))
                fps = np.concatenate((fps.view(np.int64) & ~1, (ids ^ 0x5555555555555555) | 1, own | 1))
                order = np.argsort(owner, kind="stable")
                each = [np.unique(x) for x in np.split(fps[order], np.cumsum(np.bincount(owner, minlength=len(ids)))[:-1])]
                yield pd.DataFrame({"b": batch["b"], "key": batch["key"], "seq": batch["seq"], "cls": classes, "id": ids, "hashes": words.line_hashes(), "fps": each, "prints": prints, "places": places, "firsts": firsts, "labels": batch["labels"]})

    return run


def _verify(enough: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            share = [kept_share(a, b, enough) for a, b in zip(batch["new_hashes"], batch["held_hashes"])]
            out = batch.drop(columns=["new_hashes", "held_hashes"]).assign(share=np.array(share, float))
            out.loc[out["id"] == out["held"], "share"] = 1.0  # one class, though its lines may be broken elsewhere
            yield out[out["share"] >= enough]

    return run


def _file_keys(rows: DataFrame) -> Column:
    """What tells the place of a text in a known file: its ``content_hash`` or ``blob_id``, in one spelling, with ``chunk_ordinal``."""
    if "chunk_ordinal" not in rows.columns:
        return F.array().cast("array<long>")
    found = []
    for name in ("content_hash", "blob_id"):
        if name in rows.columns:
            said = F.regexp_extract(F.lower(F.trim(F.col(name).cast("string"))), r"([0-9a-f]{16,})$", 1)
            found.append(F.when((said != "") & F.col("chunk_ordinal").isNotNull(), F.xxhash64(F.lit(name), said, "chunk_ordinal")))
    return F.array_compact(F.array(*found).cast("array<long>"))


class History:
    """The persistent store of one collection of texts, in the folder ``path``; an existing one is opened and goes on with its own parameters.

    Two texts that keep the share ``enough`` of the longer one's lines share at least half as many fingerprints (see
    :meth:`WordArrays.line_prints`), so that many are asked for; ``head`` is the number of postings of a fingerprint in tier 0; ``part_rows`` is the number of
    fingerprints that a part is meant for, ``most_versions`` that of the versions a lookup may meet; ``broadcast_rows`` bounds what is broadcast in lookups. One writer at a time.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        *,
        enough: float = 0.5,
        head: int = 8,
        broadcast_rows: int = 2_000_000,
        part_rows: int = 500_000,
        most_versions: int = 64,
    ):
        self.spark, self.path, self.broadcast_rows = spark, path.rstrip("/"), broadcast_rows
        self.scratch = Scratch(spark, "history")
        self.files = SharedFiles(spark, self.path)
        self.state = self._manifest() or {
            "number": 0, "enough": enough, "head": head, "part_rows": part_rows, "most_versions": most_versions, "next": 0, "parts": 1, "held_parts": 1, "rows": 0, "postings": [], "held": [],
        }
        self.enough, self.head = self.state["enough"], self.state["head"]

    @classmethod
    def open(cls, spark: SparkSession, path: str, **how) -> History:
        """An existing store; an error if there is none."""
        store = cls(spark, path, **how)
        if not store.exists:
            raise FileNotFoundError(f"no store at {path}")
        return store

    @property
    def exists(self) -> bool:
        return self.state["number"] > 0

    def close(self) -> None:
        """Removes what the screening of batches left behind; results that were not consumed are lost, the store isn't."""
        self.scratch.close()

    # --- what belongs to the store

    def _manifest(self) -> dict | None:
        numbers = [int(name[9:-5]) for name in self.files.names() if name.startswith("manifest-") and name.endswith(".json")]
        return json.loads(self.files.read(f"manifest-{max(numbers):010d}.json")) if numbers else None

    def _commit(self, **changed) -> None:
        self.state = {**self.state, **changed, "number": self.state["number"] + 1}
        self.files.put(f"manifest-{self.state['number']:010d}.json", json.dumps(self.state))

    def _table(self, name: str, versions: list[int], schema: str) -> DataFrame:
        """The committed versions of a table, with ``v`` and the folders' columns."""
        paths = [f"{self.path}/{name}/v={v}" for v in versions]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths)

    def _write(self, df: DataFrame, name: str, v: int, *folders: str) -> None:
        """A version of a table. What a failed run left there is overwritten."""
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*folders) if folders else writer).parquet(f"{self.path}/{name}/v={v}")

    def _part(self, column: str, parts: int) -> Column:
        return F.pmod(F.shiftright(column, 17), F.lit(parts)).cast("int").alias("part")

    def _in_parts(self, table: DataFrame, wanted: DataFrame, column: str, parts: int) -> tuple[DataFrame, int]:
        """The rows of a table in the parts that the wanted values fall in, and how many values there are; as many numbers as there are parts, at most, reach the driver."""
        counts = wanted.groupBy(self._part(column, parts)).count().collect()
        touched = sorted(r[0] for r in counts)
        return (table.where(F.col("part").isin(touched)) if touched else table.where(F.lit(False))), sum(r[1] for r in counts)

    def _small(self, df: DataFrame, rows: int) -> DataFrame:
        """A table of a known number of narrow rows: broadcast within the bound, else joined by shuffling."""
        return F.broadcast(df) if rows <= self.broadcast_rows else df

    # --- texts

    def _read(self, rows: DataFrame, key: Column, seq: Column, number: Column | None = None, placed: bool = True) -> DataFrame:
        """The texts that hold words, read; ``b`` is the number of their batch, ``form`` tells how their lines are broken. With ``placed`` their fingerprints tell the lines that they may be of."""
        texts = rows.select(
            F.coalesce((F.lit(None) if number is None else number).cast("int").cast("long"), F.lit(_LAST_BATCH)).alias("b"),
            key.cast("string").alias("key"),
            seq.cast("long").alias("seq"),
            "text",
            F.coalesce("active_label_ids", F.array().cast("array<string>")).alias("labels"),
            _file_keys(rows).alias("keys"),
        )
        return texts.where("key is not null and text is not null").mapInPandas(_read_texts(self.enough / 2, placed), _READ).withColumn("form", F.xxhash64("hashes"))

    def _distinct(self, read: DataFrame) -> DataFrame:
        """One row per class of texts: its first member with that one's labels."""
        return (
            read.groupBy("cls")
            .agg(F.min(F.struct("seq", "key", "labels")).alias("f"), *(F.first(c).alias(c) for c in ("id", "hashes", "fps")))
            .select("id", F.col("f.key").alias("key"), F.col("f.seq").alias("seq"), F.col("f.labels").alias("labels"), "hashes", "fps")
        )

    def _forms(self, read: DataFrame) -> DataFrame:
        """One row per class of texts and form of its lines: its first member, by batch and number, with that one's labels; ``lead`` are the first of their class."""
        forms = read.groupBy("cls", "form").agg(F.min(F.struct("b", "seq", "key", "labels")).alias("f"), *(F.first(c).alias(c) for c in ("id", "hashes", "fps", "prints", "places", "firsts")))
        forms = forms.withColumn("lead", F.row_number().over(Window.partitionBy("cls").orderBy("f.b", "f.seq", "form")) == 1)
        return forms.select("id", "form", "lead", *(F.col(f"f.{c}").alias(c) for c in ("b", "seq", "key", "labels")), "hashes", "fps", "prints", "places", "firsts")

    # --- postings and filters

    def _tiers(self, fingers: DataFrame, taken: DataFrame | None = None, order: tuple[str | Column, ...] = ("seq", "id")) -> DataFrame:
        """The fingerprints with their tier: the first ``head`` holders, in the store and here, are tier 0.

        Who isn't among the first of a salted group isn't among the first of all; only the first of the groups are ranked again.
        """
        near = F.row_number().over(Window.partitionBy("fp", F.pmod("id", F.lit(_SALTS))).orderBy(*order))
        ranked = fingers.withColumn("near", near <= self.head)
        ranked = ranked.withColumn("at", F.row_number().over(Window.partitionBy("fp", F.when(F.col("near"), F.lit(0)).otherwise(F.col("id"))).orderBy(*order)))
        if taken is not None:
            ranked = ranked.join(taken, "fp", "left").withColumn("at", F.col("at") + F.coalesce("taken", F.lit(0)))
        return ranked.withColumn("tier", F.when(F.col("near") & (F.col("at") <= self.head), 0).otherwise(1))

    def _post(self, tiers: DataFrame, v: int, parts: int) -> None:
        rows = tiers.select("fp", "id", *(["b"] if "b" in tiers.columns else []), "seq", "fresh", "tier", self._part("fp", parts))
        # tier 1 of a hot fingerprint may be most of its part: it is written by several tasks
        several = F.when(F.col("tier") == 1, F.pmod("id", F.lit(_SALTS))).otherwise(-1)
        self._write(rows.repartition(parts, "part", several), "postings", v, "tier", "part")

    def _filter(self, v: int, parts: int) -> int:
        """Writes the filters of a version's parts; returns how many fingerprints they are for."""

        def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            bloom = Bloom(8 * max(128, -(-len(rows) * _BITS // 8)))  # whole bytes: a filter's size tells its bits
            bloom.add(rows["fp"].to_numpy(np.int64).view(np.uint64))
            return pd.DataFrame({"part": [key[0]], "bits": [bloom.data.tobytes()], "rows": [len(rows)]})

        # every fingerprint has a tier-0 posting in the version that brings it, and few of them
        fps = self._table("postings", [v], _POSTINGS).where("tier = 0 and fresh").select("part", "fp")
        self._write(fps.groupBy("part").applyInPandas(fill, "part int, bits binary, rows long"), "filters", v)
        return self.spark.read.parquet(f"{self.path}/filters/v={v}").agg(F.coalesce(F.sum("rows"), F.lit(0))).head()[0]

    def _screen(self, fps: DataFrame) -> DataFrame:
        """The fingerprints that the filters don't rule out."""

        def holds(key: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            fps = new["fp"].to_numpy(np.int64).view(np.uint64)
            held = np.zeros(len(fps), bool)
            for data in old["bits"]:
                held[~held] = Bloom(len(data) * 8, data).holds(fps[~held])
            return new.loc[held, ["fp"]]

        filters = self._table("filters", self.state["postings"], _FILTERS).select("part", "bits")
        return fps.select(self._part("fp", self.state["parts"]), "fp").groupBy("part").cogroup(filters.groupBy("part")).applyInPandas(holds, "fp long")

    def _lookup(self, tier: int, fps: DataFrame) -> DataFrame:
        """``(fp, held)`` of the wanted fingerprints in the store."""
        held, rows = self._in_parts(self._table("postings", self.state["postings"], _POSTINGS), fps, "fp", self.state["parts"])
        return held.where((F.col("tier") == tier) & F.col("fresh")).select("fp", F.col("id").alias("held")).join(self._small(fps, rows), "fp")

    # --- the operations

    def found(self, history: DataFrame, key: str = "point_id") -> None:
        """Makes the store from the accepted texts; repeats of a key and equal texts are held once."""
        distinct = self.scratch.write(self._distinct(self._read(history, F.col(key), F.lit(-1), placed=False)), "founding")
        sizes = distinct.agg(F.count("*"), F.coalesce(F.sum(F.size("fps")), F.lit(0))).head()
        parts = _power(sizes[1] / self.state["part_rows"])
        held_parts = _power(8 * sizes[0] / self.state["part_rows"])  # a held row is about as large as eight postings
        self._hold(distinct, 0, held_parts)
        self._post(self._tiers(distinct.select("id", "seq", F.explode("fps").alias("fp"))).withColumn("fresh", F.lit(True)), 0, parts)
        rows = self._filter(0, parts)
        self._commit(next=1, parts=parts, held_parts=held_parts, rows=rows, postings=[0], held=[0])
        self.scratch.remove("founding")

    def _hold(self, distinct: DataFrame, v: int, parts: int) -> None:
        rows = distinct.select("id", "key", "seq", "labels", "hashes", self._part("id", parts))
        self._write(rows.repartition(parts, "part"), "held", v, "part")

    def compact(self) -> None:
        """Rewrites the store as one version, in as many parts as it now needs."""
        v = self.state["next"]
        postings = self._table("postings", self.state["postings"], _POSTINGS).where("fresh")
        held = self._table("held", self.state["held"], _HELD)
        parts, held_parts = _power(postings.count() / self.state["part_rows"]), _power(8 * held.count() / self.state["part_rows"])
        self._hold(held, v, held_parts)
        self._post(self._tiers(postings.select("fp", "id", "seq")).withColumn("fresh", F.lit(True)), v, parts)
        rows = self._filter(v, parts)
        old = self.state
        self._commit(next=v + 1, parts=parts, held_parts=held_parts, rows=rows, postings=[v], held=[v])
        for name, versions in (("postings", old["postings"]), ("filters", old["postings"]), ("held", old["held"])):
            for gone in versions:
                self.files.delete(f"{name}/v={gone}")

    def screen(self, batch: DataFrame, key: str = "incoming_id") -> DataFrame:
        """``(key, held_key, held_seq, share, gained)`` of the batch's texts that are held already; then the batch is held too.

        A text is held if it is in the store or in a row of the batch with a smaller key. ``held_key`` is the best
        match (of equal shares the earliest) of the texts that it was compared with; a text of the same class always is one. ``gained`` are the labels of the new row that the held one lacks.
        The result reads tables that :meth:`close` removes.
        """
        v = self.state["next"]
        return self._screened(self.scratch.write(self._read(batch, F.col(key), F.col(key)), f"read-{v}")).drop("b")

    def screen_all(self, batches: DataFrame, number: str = "batch_no", key: str = "incoming_id") -> list[DataFrame]:
        """Screens batches that have all arrived, in order of their number (none is last, as ``b`` of the result it is ``_LAST_BATCH``), each as :meth:`screen` does after those before it.

        Their texts are read in one go, and consecutive batches make up one round of jobs and one version, as long as they have no more fingerprints than the parts of the store are meant for. So
        rounds, with their plans and broadcasts on the driver, grow with what is new as measured by the store, not with the number of batches.
        """
        v = self.state["next"]
        read = self.scratch.write(self._read(batches, F.col(key), F.col(key), F.col(number)), f"read-{v}", partition_by=("b",))
        sizes = sorted(tuple(r) for r in read.groupBy("b").agg(F.sum(F.size("fps"))).collect())
        found = []
        while sizes:
            room, rows, last = self.state["part_rows"] * self.state["parts"], 0, 0
            while last < len(sizes) and (not last or rows + sizes[last][1] <= room):
                rows, last = rows + sizes[last][1], last + 1
            found.append(self._screened(read.where(F.col("b").between(sizes[0][0], sizes[last - 1][0]))))
            sizes = sizes[last:]
        return found

    def _screened(self, read: DataFrame) -> DataFrame:
        """One round: texts of one or more batches, each held if the store, an earlier batch or an earlier row of its own batch holds it."""
        v, write = self.state["next"], lambda df, name: self.scratch.write(df, f"{name}-{v}")
        distinct = write(self._forms(read), "distinct")
        texts = distinct.count()
        own = distinct.select("id", "form", "lead", "b", "seq", F.size("hashes").alias("n"), F.explode("fps").alias("fp"))
        positive = write(self._screen(own.select("fp").distinct()), "positive")
        hits = write(self._lookup(0, positive), "hits")
        taken = hits.groupBy("fp").agg(F.count("*").cast("int").alias("taken"))
        # a class has one posting of its own key, which never is hot: classes that the store lacks are those without
        known = hits.where(F.col("fp") == F.col("held").bitwiseXOR(F.lit(0x5555555555555555)).bitwiseOR(F.lit(1))).select(F.col("held").alias("id"), F.lit(False).alias("fresh"))
        # of a class that is new, the first form is held; the others, and classes that the store has, are met in this round only, and leave tier 0 to what is held
        fresh = own.join(self._small(known, texts), "id", "left").withColumn("fresh", F.coalesce("fresh", "lead"))
        tiers = self._tiers(fresh, taken, (F.desc("fresh"), "b", "seq", "id"))
        with ThreadPoolExecutor(2) as beside:
            # update the store, while the texts are compared: classes that it lacks, and the filters
            holding = beside.submit(self._hold, distinct.where("lead").join(self._small(known.select("id"), texts), "id", "left_anti"), v, self.state["held_parts"])
            self._post(tiers, v, self.state["parts"])
            filtering = beside.submit(self._filter, v, self.state["parts"])
            result = self._compared(read, distinct, own, hits, taken, texts, v)
            holding.result()
            rows = self.state["rows"] + filtering.result()
        self._commit(next=v + 1, rows=rows, postings=[*self.state["postings"], v], held=[*self.state["held"], v])
        if rows > 2 * self.state["part_rows"] * self.state["parts"] or len(self.state["postings"]) > self.state["most_versions"]:
            self.compact()
        return result

    def _compared(self, read: DataFrame, distinct: DataFrame, own: DataFrame, hits: DataFrame, taken: DataFrame, texts: int, v: int) -> DataFrame:
        write = lambda df, name: self.scratch.write(df, f"{name}-{v}")
        tiers = self._table("postings", [v], _POSTINGS)

        line = F.col("fp").bitwiseAND(F.lit(1)) == 0
        # tier 0 of the history, and of this round's earlier texts
        posted = lambda rows: rows.select("fp", F.col("id").alias("held"), F.col("b").alias("held_b"), F.col("seq").alias("held_seq"))
        stored = lambda rows: rows.withColumns({"held_b": F.lit(_HELD_BATCH), "held_seq": F.lit(-1).cast("long")})
        met = own.join(stored(hits).unionByName(posted(tiers.where("tier = 0"))), "fp").where(_EARLIER)
        # fingerprints that have, or may have, holders in tier 1
        full = taken.where(F.col("taken") >= self.head).select("fp").unionByName(tiers.where("tier = 1").select("fp")).distinct()
        placed = distinct.select("id", "form", "b", "seq", F.size("hashes").alias("n"), F.explode(F.arrays_zip("prints", "places", "firsts")).alias("x"))
        placed = placed.select("id", "form", "b", "seq", "n", F.col("x.prints").alias("fp"), F.col("x.places").alias("place"), F.col("x.firsts").alias("first"))
        hot = write(placed.join(full, "fp").groupBy("id", "form", "n").agg(F.count_if("first").alias("hot"), *_whole_and_covered()), "hot")
        need = F.ceil(F.col("n") * (self.enough / 2))
        hot_n = F.coalesce("hot", F.lit(0))
        # all holders of a fingerprint that isn't hot are in tier 0; texts that hot ones might match alone are looked up in tier 1 too
        least = F.when(hot_n < need, need - hot_n).otherwise(F.least(need, F.lit(2)))
        pairs = (
            met.groupBy("id", "form", "held", "n")
            .agg(F.count_if(line).alias("shared"), F.count_if(~line).alias("keyed"))
            .join(self._small(hot.select("id", "form", "hot"), texts), ["id", "form"], "left")
            .where((F.col("shared") >= least) | (F.col("keyed") > 0))
            .select("id", "form", "held")
        )
        sure = self._verified(write(pairs, "pairs"), distinct, write, "sure")
        # tier 1, for texts that tier 0 left unmatched although their hot fingerprints, and what it may have shown of a match besides, might make one
        shown = F.least(need, F.lit(2)) - 1
        open_ids = hot.where((F.col("hot") >= need) & self._may_match(F.col("whole") + shown, F.col("covered") + shown))
        open_ids = write(open_ids.join(sure.select("id", "form").distinct(), ["id", "form"], "left_anti").select("id", "form"), "open")
        if open_ids.head(1):
            lost = placed.join(open_ids, ["id", "form"], "left_semi")
            wanted = write(lost.select("fp").distinct(), "wanted")
            # a class of the round that the store holds too is met there, so each holder of a fingerprint comes once
            tail = write(stored(hits.unionByName(self._lookup(1, wanted))).unionByName(posted(tiers.where("fresh"))), "tail")
            earlier = (F.col("id") != F.col("held")) & F.expr(_EARLIER)
            near = self._rare_lines(lost, tail.groupBy("fp").agg(F.count("*").alias("holders"))).join(tail, "fp").where(earlier)
            near = write(near.select("id", "form", "held").distinct(), "near")
            deep = (
                tail.join(near, "held")
                .join(lost, ["id", "form", "fp"])
                .where(earlier)
                .groupBy("id", "form", "held", "n")
                .agg(*_whole_and_covered())
                .where(self._may_match(F.col("whole"), F.col("covered")))
                .select("id", "form", "held")
            )
            sure = sure.unionByName(self._verified(write(deep, "deep"), distinct, write, "far"))
            self.scratch.remove(f"tail-{v}")
        best = sure.groupBy("id", "form").agg(F.min(F.struct((-F.col("share")).alias("less"), "held_seq", "held_key", "held_labels")).alias("m"))
        inside = distinct.where("lead").select("id", *(F.col(c).alias(f"first_{c}") for c in ("key", "b", "seq", "labels")))
        later = F.expr("first_b < b or first_b = b and first_seq < seq")
        return (
            read.select("id", "form", "b", "key", "seq", "labels")
            .join(inside, "id")
            .join(best, ["id", "form"], "left")
            .where(F.col("m").isNotNull() | later)
            # an earlier row of the same class is a match of share 1, which only one before that can outdo
            .withColumn("copy", later & F.coalesce(F.col("m.less") > -1.0, F.lit(True)))
            .select(
                "b",
                "key",
                F.when(F.col("copy"), F.col("first_key")).otherwise(F.col("m.held_key")).alias("held_key"),
                F.when(F.col("copy"), F.col("first_seq")).otherwise(F.col("m.held_seq")).alias("held_seq"),
                F.when(F.col("copy"), 1.0).otherwise(-F.col("m.less")).alias("share"),
                F.array_except("labels", F.when(F.col("copy"), F.col("first_labels")).otherwise(F.col("m.held_labels"))).alias("gained"),
            )
        )

    def _least(self) -> Column:
        """How many of its ``n`` lines a text shares with a match at least, as they are or but for one name."""
        return F.ceil(F.col("n") * self.enough - 1e-9)

    def _may_match(self, whole: Column, covered: Column) -> Column:
        """Whether a text of ``n`` lines may be a match that shares ``whole`` of its lines as they are, and ``covered`` as they are or without a word.

        A match keeps the share ``enough`` of the longer text's lines: some as they are, the others but for one name. If that is frequent in both texts (see
        :meth:`WordArrays.line_prints`), they share the others without it. Else fewer than half of that share can hold it, so the greater half is shared as it is.
        """
        return (covered >= self._least()) | (whole > F.floor(self._least() / 2))

    def _rare_lines(self, placed: DataFrame, holders: DataFrame) -> DataFrame:
        """``(id, form, b, seq, fp)`` of texts, of which every match by :meth:`_may_match` shares one: without the lines of most holders, one fewer than a match must share."""
        line = F.expr("if(place < 0, ~place, place)")
        held = placed.withColumn("line", line).join(holders, "fp", "left")
        held = held.withColumn("weight", F.coalesce(F.sum("holders").over(Window.partitionBy("id", "form", "line")), F.lit(0)))
        rank = F.dense_rank().over(Window.partitionBy("id", "form").orderBy(F.desc("weight"), "line"))
        rare = (rank >= self._least()) | ((F.col("place") >= 0) & (rank > F.floor(self._least() / 2)))
        return held.withColumn("rare", rare).where("rare and holders is not null").select("id", "form", "b", "seq", "fp").distinct()

    def _verified(self, pairs: DataFrame, distinct: DataFrame, write, name: str) -> DataFrame:
        """The pairs that keep enough lines, with their share and what is told of the held text."""
        about = (F.col("id").alias("held"), F.col("key").alias("held_key"), F.col("seq").alias("held_seq"), F.col("labels").alias("held_labels"), F.col("hashes").alias("held_hashes"))
        stored, rows = self._in_parts(self._table("held", self.state["held"], _HELD), pairs.select(F.col("held").alias("id")), "id", self.state["held_parts"])
        # a text of the round may be of a class that the store holds too: that one is its match
        both = stored.select(*about, F.lit(_HELD_BATCH).alias("held_b")).unionByName(distinct.select(*about, F.col("b").alias("held_b")))
        with_held = both.join(self._small(pairs, rows), "held")
        full = with_held.join(distinct.select("id", "form", F.col("hashes").alias("new_hashes"), "b", "seq"), ["id", "form"]).where(_EARLIER).drop("held_b", "b", "seq")
        # comparing takes longer than reading, so the pairs are spread by number, not by size
        full = full.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "id", "held")
        return write(full.mapInPandas(_verify(self.enough), "held long, held_key string, held_seq long, held_labels array<string>, id long, form long, share double"), name)


def _whole_and_covered() -> tuple[Column, Column]:
    """Of a text's fingerprints that are met: how many of its lines are met as they are, and how many as they are or without a word."""
    return F.count_if(F.col("place") >= 0).alias("whole"), F.count_distinct(F.expr("if(place < 0, ~place, place)")).alias("covered")


def _power(parts: float) -> int:
    """The least power of two that isn't below a number of parts."""
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, parts)))))


def screen_batches(history: DataFrame, incoming: DataFrame, *, key: str = "incoming_id", batch: str = "batch_no", path: str | None = None, **how) -> DataFrame:
    """Screens the batches in order: ``(batch, key, held_key, held_seq, share, gained)`` of the rows whose text is held already.

    ``held_seq`` is -1 for a text of the history, else the key of the earlier row. Null texts, and texts without words,
    are never held; a row without a batch number belongs to a last batch. Batches that are small beside the store share
    a round of jobs (see :meth:`History.screen_all`). An empty history or incoming table gives an empty store or result. With ``path`` the store is kept there; if it exists
    already it is opened and ``history``, which it holds, isn't read.
    """
    spark = history.sparkSession
    store = History(spark, path or f"{Scratch(spark, 'store').path}/store", **how)
    if not store.exists:
        store.found(history)
    out = spark.createDataFrame([], f"batch int, {key} long, held_key string, held_seq long, share double, gained array<string>")
    for found in store.screen_all(incoming, batch, key):
        number = F.when(F.col("b") != _LAST_BATCH, F.col("b")).cast("int")
        out = out.unionByName(found.select(number.alias("batch"), F.col("key").cast("long").alias(key), "held_key", "held_seq", "share", "gained"))
    return out
