"""The registered queries of this subpackage: each takes a session and a data folder."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.docpairs import function_pairs
from chunkloom.llm.handwritten import classify_files
from chunkloom.llm.history import screen_batches
from chunkloom.llm.leakage import leaked_items
from chunkloom.llm.mixing import Mixture
from chunkloom.llm.neighbours import nearest, neighbour_pairs
from chunkloom.llm.splitting import split_oversized
from chunkloom.llm.textstats import classify
from chunkloom.runtime import table

VECTOR_DIM = 64


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_held(spark, folder).select("incoming_id").distinct()


def p1_held(spark: SparkSession, folder: str) -> DataFrame:
    return screen_batches(table(spark, folder, "chunks"), table(spark, folder, "incoming_chunks"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_files(spark, folder).where("kind <> 'written'").select("file_id")


def p2_files(spark: SparkSession, folder: str) -> DataFrame:
    return classify_files(table(spark, folder, "chunks"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbour_pairs(table(spark, folder, "chunks"), dim=VECTOR_DIM, k=5)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_pairs(spark, folder).select("point_id", "function_name").distinct()


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return function_pairs(table(spark, folder, "chunks"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_pieces(spark, folder).select("point_id").distinct()


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(_points(spark, folder), "point_id", limit=6000)


def p5_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Every cut text put together again from its pieces: whether these are numbered, fit the limit and overlap as they should, and the digest of the whole."""

    def rebuild(rows: pd.DataFrame) -> pd.DataFrame:
        pieces = rows.sort_values("split_part_ordinal")
        text, fits = "", pieces["split_part_ordinal"].tolist() == list(range(1, len(pieces) + 1)) and set(pieces["split_part_count"]) == {len(pieces)}
        whole = rows["whole"].iloc[0]
        for piece in pieces["text"]:
            fits &= len(piece.encode()) <= 6000
            # of repetitive texts several overlaps are possible: that which the text goes on with
            shared = [n for n in range(50, 401) if text.endswith(piece[:n]) and 200 <= len(piece[:n].encode()) <= 400 and whole.startswith(text + piece[n:])] if text else [0]
            fits &= bool(shared)
            text += piece[shared[0] if shared else 0 :]
        return pd.DataFrame({"point_id": rows["point_id"].iloc[:1], "fits": [bool(fits)], "digest": [hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()]})

    whole = _points(spark, folder).select("point_id", F.col("text").alias("whole"))
    return p5_pieces(spark, folder).join(whole, "point_id").groupBy("point_id").applyInPandas(rebuild, "point_id string, fits boolean, digest string")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_leaks(spark, folder).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return Mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets")).short_sources()


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return Mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets")).reached()


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Which sources can reach their targets, and whether the shares drawn are those that targets and caps allow, up to the chance of the draws.

    A draw decides by chance over less than one use of each document; four standard deviations of that are tolerated, which vanish as documents become many.
    """
    mixture = Mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))
    wanted = spark.createDataFrame([(r.source, float(r.expected_share)) for r in mixture.report().itertuples()], "source string, expected double")
    tolerance = mixture.draws().agg((2 * F.sqrt(F.sum(F.col("tokens") * F.col("tokens"))) / F.sum(F.col("tokens") * F.col("uses"))).alias("chance"))
    close = (F.abs(F.col("share") - F.col("expected")) <= F.col("chance")) & (F.col("most_uses") <= F.col("max_repeats"))
    both = mixture.reached().join(F.broadcast(wanted), "source").crossJoin(F.broadcast(tolerance))  # a row per source; a single row
    return both.select("source", "target_share", "short", close.alias("kept"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return classify(table(spark, folder, "documents")).where("kind in ('list', 'table', 'junk')").select("doc_id", "kind")


def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return classify(table(spark, folder, "documents"))


def _points(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks without their vectors; repeats of a ``point_id`` carry the same text."""
    return table(spark, folder, "chunks").select("point_id", "text").where("octet_length(text) > 6000").dropDuplicates(["point_id"])


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "p9_found": """
            WITH s AS (SELECT lower(trim(source)) AS source, sum(length(text)) AS size FROM documents WHERE source IS NOT NULL GROUP BY 1)
            SELECT t.source FROM mix_targets t LEFT JOIN s USING (source)
            WHERE coalesce(s.size, 0) * t.max_repeats < t.target_share * (SELECT sum(size) FROM s)""",
        # by comparing every vector with every other one
        "p3_found": """
            WITH u AS (SELECT DISTINCT ON (point_id) point_id, vector::DOUBLE[] AS v FROM chunks WHERE len(vector) = 64
              AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
            n AS (SELECT point_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))::DOUBLE[64] AS v FROM u),
            d AS (SELECT a.point_id AS a, b.point_id AS b, row_number() OVER (PARTITION BY a.point_id ORDER BY array_inner_product(a.v, b.v) DESC, b.point_id) AS r FROM n a JOIN n b ON a.point_id <> b.point_id)
            SELECT DISTINCT least(a, b) AS point_a, greatest(a, b) AS point_b FROM d WHERE r <= 5""",
        "p5_rebuilt": "SELECT DISTINCT point_id, true AS fits, md5(text) AS digest FROM chunks WHERE strlen(text) > 6000",
        # the order of characters is that of tokens; a share is the target's, or the capacity's, of all that is drawn
        "p9_shares": """
            WITH s AS (SELECT lower(trim(source)) AS source, sum(length(text)) AS size FROM documents WHERE source IS NOT NULL GROUP BY 1)
            SELECT t.source, t.target_share, coalesce(s.size, 0) * t.max_repeats < t.target_share * (SELECT sum(size) FROM s) AS short, true AS kept FROM mix_targets t LEFT JOIN s USING (source)""",
        "p5_found": "SELECT DISTINCT point_id FROM chunks WHERE strlen(text) > 6000",
    }
