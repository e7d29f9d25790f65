"""Files that nobody wrote by hand: generated, minified, vendored, or data kept as code.

Method: Re-Pair grammars of token sequences. A text whose grammar is small - rules are reused over and over - is generated, or a
table of data; literals that hardly compress make a blob; long runs of tokens that files of several repositories share
are vendored code: they are rules of the token sequences of all repositories together, each used in more than one. What a file says of itself at its very start, where it lies, and names of a single letter on long lines
complete the picture.

Which evidence decides what: grammars alone find every generated file of the test tables, whatever its notice says, and all data by literals or grammars. The method says nothing of
minified files, which layout and names tell. Vendored files have no copy in another repository there, so their folder or notice tells them.

Grammars are inferred by chunk, and their sizes are added up by file, so no file is ever assembled in one place however
many chunks it has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.llm.grammars import Grammar, literal_share, long_runs, tokens
from chunkloom.runtime import Scratch

#: suffixes of files that hold text for people; their wording isn't judged, only their place and their notice
_PROSE = ("md", "mdx", "markdown", "txt", "rst", "adoc")
#: folders that hold code of others, and a folder named after a release of something
_FOREIGN = r"(?i)(?:^|/)(?:third[-_]?party|3rd[-_]?party|vendors?|vendored|externals?|deps|node_modules|bower_components|site-packages)/|(?:^|/)[a-z][a-z0-9_.]*-v?\d+\.\d+(?:\.\d+)?/"
_COMMENTS = re.compile(r"\A﻿?\s*(?:(?:/\*.*?\*/|<!--.*?-->|//[^\n]*|\#[^\n]*|\"\"\".*?\"\"\")\s*)+", re.S)
_MADE = re.compile(
    r"@generated\b|<auto-?generated|\b(?:code|file|source|module|class(?:es)?) (?:is |was |has been |were )?(?:auto(?:matically)?[- ]?)?generated\b|\bautogenerated file\b"
    r"|\bauto-?generated (?:by|from|file|code)|^\W*generated (?:by|from|with)\b|\bproduced by the\b.{0,60}\b(?:compiler|generator)\b"
    r"|\bdo not (?:edit|modify)\b|\b(?:manual )?(?:edits|changes)\b.{0,40}\b(?:overwritten|be lost)\b|\bautomatisch (?:erzeugt|generiert)\b|\bnicht von hand\b"
    r"|\bgénéré automatiquement\b|\bne pas modifier\b|\bgenerado automáticamente\b|\bno (?:editar|modificar)\b",
    re.I | re.M,
)
_NEIGHBOUR = re.compile(r"\bthe generated (?:file|code|sources?|output)\b", re.I)
_COPIED = re.compile(
    r"\bthird[- ]party (?:copy|code|library|file|module)\b|\bunchanged copy\b|\bcopy of (?:the )?upstream\b|\bvendored\b|\bimported from the .{1,80} project\b"
    r"|\A\W*[\w.@/-]+ v?\d+\.\d+(?:\.\d+)?\b.{0,200}(?:\(c\)|©|copyright|licen[cs]e)",
    re.I | re.S,
)
_NAME = re.compile(r"(?<![\w$])[A-Za-z_$][\w$]*")

_MEASURED = (
    "point_id string, file_id string, repository string, tokens long, body long, symbols long, covered long, literal long, solid long, chars long, lines long, names long, single long, "
    "made boolean, copied boolean, rules array<struct<rule:long,width:long>>"
)


def notice(text: str) -> tuple[bool, bool]:
    """Whether a file's opening comments say that it was generated; that it is a copy of others' work."""
    opening = _COMMENTS.match(text)
    if not opening:
        return False, False
    said = opening[0]
    return bool(_MADE.search(said)) and not _NEIGHBOUR.search(said), bool(_COPIED.search(said))


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for at in range(0, len(whole), 250):
            batch = whole.iloc[at : at + 250]
            texts, prose = batch["text"].tolist(), batch["prose"].tolist()
            sequences = [[] if p else tokens(t) for t, p in zip(texts, prose)]
            grammar = Grammar(sequences)
            # files of several repositories may open with the same licence, so opening comments say nothing about the rest
            bodies = [s[len(tokens(opening[0])) :] if f and s and (opening := _COMMENTS.match(t)) else s for s, t, f in zip(sequences, texts, batch["first"])]
            rules: list[list[dict]] = [[] for _ in texts]
            owner, runs, widths = long_runs(bodies)
            for i, rule, width in zip(owner.tolist(), runs.view(np.int64).tolist(), widths.tolist()):
                rules[i].append({"rule": rule, "width": width})
            literal, solid, lines, names, single, made, copied = ([] for _ in range(7))
            for t, p, first in zip(texts, prose, batch["first"]):
                inside, size = (0, 0) if p else literal_share(t)
                literal.append(inside)
                solid.append(size)
                lines.append(0 if p else max(1, sum(1 for line in t.split("\n") if line and not line.isspace())))
                found = [] if p else _NAME.findall(t)
                names.append(len(found))
                single.append(sum(1 for n in found if len(n) == 1))
                m, c = notice(t) if first else (False, False)
                made.append(m)
                copied.append(c)
            yield pd.DataFrame(
                {
                    "point_id": batch["point_id"], "file_id": batch["file_id"], "repository": batch["repository"], "tokens": grammar.length, "body": [len(b) for b in bodies], "symbols": grammar.size, "covered": grammar.covered,
                    "literal": literal, "solid": solid, "chars": [0 if p else len(t) for t, p in zip(texts, prose)], "lines": lines, "names": names, "single": single,
                    "made": made, "copied": copied, "rules": rules,
                }
            )


_SUMS = ("tokens", "body", "symbols", "covered", "literal", "solid", "chars", "lines", "names", "single")


def chunk_evidence(chunks: DataFrame) -> DataFrame:
    """Per chunk: sizes of text and grammar, and what its opening comments say if it is the first of its file.

    Null texts count as empty, chunks without a ``file_id`` are left out. Repeats of a chunk are measured repeatedly; :func:`classify_files` counts each ``point_id`` once.
    """
    name = F.lower(F.coalesce("relative_path", F.lit("")))
    suffix = F.regexp_extract(name, r"\.([a-z0-9]+)$", 1)
    point = F.col("point_id").cast("string") if "point_id" in chunks.columns else F.lit(None).cast("string")
    rows = chunks.where("file_id is not null").select(
        point.alias("point_id"),
        "file_id",
        F.col("catalog").alias("repository"),
        F.coalesce("text", F.lit("")).alias("text"),
        (F.coalesce("chunk_ordinal", F.lit(0)) == 1).alias("first"),
        suffix.isin(*_PROSE).alias("prose"),
    )
    return rows.mapInPandas(_measure, _MEASURED)


def _shares(evidence: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return evidence.withColumns(
        {
            "grammar_ratio": F.when(F.col("tokens") > 0, F.col("symbols") / F.col("tokens")).otherwise(1.0),
            "coverage": ratio("covered", "tokens"),
            "literal_share": ratio("literal", "solid"),
            "blank_share": F.lit(1.0) - ratio("solid", "chars"),
            "line_length": ratio("chars", "lines"),
            "single_share": ratio("single", "names"),
            "shared_share": ratio("shared", "body"),
        }
    )


def classify_files(chunks: DataFrame, *, reuse: float = 0.46, coverage: float = 0.78, literal: float = 0.5, least_tokens: int = 40, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``(file_id, kind, ...)``: one row per file, ``kind`` ``generated``, ``minified``, ``vendored``, ``data`` or ``written``.

    A file is generated if its opening comments say so or its grammar is small (at most ``reuse`` symbols per token,
    ``coverage`` of the tokens under rules, ``least_tokens`` tokens); data if most of it is long literals or numbers; minified
    if its lines are long, hardly broken by blanks, and its names mostly single letters; vendored if it lies in a folder
    of others' code, says at its start whose copy it is, or consists mostly, apart from its opening comments, of runs of
    tokens that files of another repository have too. The first of data, minified, generated and vendored that holds is reported. Empty files are
    ``written``; an empty table gives an empty result. Numbers of repeated rows are broadcast up to ``broadcast_rows``, joined by shuffling beyond.
    """
    # measured once: without the texts a chunk's evidence is a few numbers
    scratch = Scratch(chunks.sparkSession, "handwritten")
    measured = scratch.write(chunk_evidence(chunks).withColumn("row", F.monotonically_increasing_id()), "measured")
    # only ids are shuffled to find the repeats, which are few; chunks without an id are no repeats
    first = F.row_number().over(Window.partitionBy("point_id").orderBy("row"))
    repeats = scratch.write(measured.where("point_id is not null").select("row", first.alias("at")).where("at > 1").select("row"), "repeats")
    measured = measured.join(F.broadcast(repeats) if repeats.count() <= broadcast_rows else repeats, "row", "left_anti")
    rules = measured.select("file_id", "repository", F.explode("rules").alias("r")).select("file_id", "repository", "r.rule", "r.width")
    shared = rules.groupBy("rule").agg(F.min("repository").alias("a"), F.max("repository").alias("b")).where("a <> b").select("rule")
    by_file = rules.join(shared, "rule").groupBy("file_id").agg(F.sum("width").alias("shared"))
    evidence = measured.groupBy("file_id").agg(*(F.sum(s).alias(s) for s in _SUMS), *(F.max(b).alias(b) for b in ("made", "copied")))
    places = chunks.where("file_id is not null").groupBy("file_id").agg(F.max(F.coalesce(F.translate("relative_path", "\\", "/").rlike(_FOREIGN), F.lit(False))).alias("foreign"), F.min("relative_path").alias("relative_path"))
    files = _shares(evidence.join(places, "file_id").join(by_file, "file_id", "left").fillna({"shared": 0}))
    small = (F.col("grammar_ratio") <= reuse) & (F.col("coverage") >= coverage) & (F.col("tokens") >= least_tokens)
    kind = (
        F.when((F.col("literal_share") >= literal) | (small & (F.col("names") <= 0.02 * F.col("tokens"))), "data")
        .when((F.col("single_share") >= 0.4) & (F.col("blank_share") < 0.08) & (F.col("line_length") >= 120), "minified")
        .when(F.col("made") | small, "generated")
        .when(F.col("foreign") | F.col("copied") | (F.col("shared_share") >= 0.5), "vendored")
        .otherwise("written")
    )
    return files.select("file_id", "relative_path", kind.alias("kind"), "tokens", *(F.round(c, 6).alias(c) for c in ("grammar_ratio", "coverage", "literal_share", "blank_share", "line_length", "single_share", "shared_share")), "made", "copied", "foreign")
