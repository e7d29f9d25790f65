"""Cutting oversized texts at natural boundaries, with overlap.

Method: lexical-cohesion segmentation. The text is a sequence of units (lines; a line too long to be one is divided at sentence ends,
then blanks, then characters). At every gap between units the words of a block before it are compared with those of a
block after it; where their similarity dips below the peaks around it lies a topic boundary, the deeper the clearer.
Each piece ends at the deepest valley of the window of sizes that it may have, and the next piece opens with the end of
the one before.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")
#: ends of units inside a line that is too long: after a sentence end, and after white space or a separator
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|(?<=[;}])(?=\S)")
_BLANK = re.compile(r"(?<=[\s,|])(?=\S)")


def _fits(text: str, limit: int) -> bool:
    return len(text) <= limit and (text.isascii() or len(text.encode()) <= limit)


def _divide(text: str, limit: int) -> Iterator[str]:
    """Units of at most ``limit`` bytes that join to ``text``."""
    levels = [re.compile(r"(?<=\n)"), _SENTENCE, _BLANK]

    def down(part: str, level: int) -> Iterator[str]:
        if _fits(part, limit) and level:
            yield part
        elif level < len(levels):
            cuts = [0, *(m.end() for m in levels[level].finditer(part) if 0 < m.end() < len(part)), len(part)]
            for a, b in pairwise(cuts):
                yield from down(part[a:b], level + 1)
        else:
            step = max(1, limit // 4)  # a character has four bytes at most
            for a in range(0, len(part), step):
                yield part[a : a + step]

    yield from (u for u in down(text, 0) if u)


def _merged(units: list[str], limit: int, least: int = 24) -> list[str]:
    """Very short units within one line join to their neighbours, so that a line without blanks costs no gap per word."""
    out: list[str] = []
    size = 0
    for u in units:
        n = len(u.encode())
        if out and size + n <= limit and size < least and not out[-1].endswith("\n"):
            out[-1] += u
            size += n
        else:
            out.append(u)
            size = n
    return out


def gap_depths(units: list[str], block: int = 6) -> np.ndarray:
    """The depth of the similarity valley at each gap (before unit i, i from 1): 0 where there is none."""
    words = [Counter(w.lower() for w in _WORD.findall(u)) for u in units]
    gaps = len(units) - 1
    if gaps < 1:
        return np.zeros(0)
    similarity = np.zeros(gaps)
    left: Counter = Counter()
    right: Counter = Counter()
    for w in words[:block]:
        right.update(w)
    for i in range(gaps):
        left.update(words[i])
        right.subtract(words[i])
        if i + block < len(units):
            right.update(words[i + block])
        if i >= block:
            left.subtract(words[i - block])
        dot = sum(n * right[w] for w, n in left.items() if n > 0 and right[w] > 0)
        norm = sum(n * n for n in left.values()) * sum(n * n for n in right.values())
        similarity[i] = dot / norm**0.5 if norm else 0.0
    # the peak to either side: climb while similarity doesn't fall
    up_left, up_right = similarity.copy(), similarity.copy()
    for i in range(1, gaps):
        if up_left[i - 1] >= similarity[i]:
            up_left[i] = up_left[i - 1]
    for i in range(gaps - 2, -1, -1):
        if up_right[i + 1] >= similarity[i]:
            up_right[i] = up_right[i + 1]
    depth = (up_left - similarity) + (up_right - similarity)
    # a blank line, or a step back to the margin, is natural by itself and decides between equal valleys
    for i in range(gaps):
        before, after = units[i], units[i + 1]
        if not before.strip() or not after.strip():
            depth[i] += 0.3
        elif before.endswith("\n") and not after[0].isspace() and after[0] not in "})]":
            depth[i] += 0.2
        elif before.endswith("\n"):
            depth[i] += 0.1
    return depth


def split_text(text: str, limit: int = 6000, overlap: tuple[int, int] = (200, 400)) -> list[tuple[int, int]]:
    """Character ranges ``(opens, ends)`` of the pieces; a piece's own part starts where the piece before it ends.

    A text within the limit is one piece. Every piece has at most ``limit`` UTF-8 bytes and all but the last more than
    the overlap; each but the first opens with the last ``overlap[0]`` to ``overlap[1]`` bytes of the one before.
    """
    if limit < 4 * overlap[1]:
        raise ValueError("the limit must be at least four times the overlap")
    if _fits(text, limit):
        return [(0, len(text))]
    units = _merged(list(_divide(text, limit // 4)), limit // 4)
    sizes = np.array([len(u.encode()) for u in units])
    ends = np.cumsum(sizes)  # bytes up to the end of each unit
    chars = np.cumsum([len(u) for u in units])
    depth = gap_depths(units)
    pieces: list[tuple[int, int]] = []
    done = opens = 0  # units used; where the next piece opens
    room = limit
    while done < len(units):
        base = int(ends[done - 1]) if done else 0
        last = int(np.searchsorted(ends, base + room, side="right"))  # units [done, last) fit
        if last >= len(units):
            pieces.append((opens, len(text)))
            break
        first = int(np.searchsorted(ends, base + room // 2, side="left")) + 1
        first = min(max(first, done + 1), last)
        window = depth[first - 1 : last]
        # the deepest valley; of equal ones the last, for fewer pieces
        cut = first + len(window) - 1 - int(np.argmax(window[::-1]))
        end = int(chars[cut - 1])
        pieces.append((opens, end))
        opens, size = _overlap(text, int(chars[done - 1]) if done else 0, end, overlap)
        done, room = cut, limit - size
    return pieces


def _overlap(text: str, start: int, end: int, bounds: tuple[int, int]) -> tuple[int, int]:
    """Where the overlap before ``end`` opens and its bytes: at a line if one starts within the bounds, else a word, else a character."""
    low, high = bounds
    places: list[tuple[int, int, int]] = []
    size, at = 0, end
    while at > start:
        size += len(text[at - 1].encode())
        if size > high:
            break
        at -= 1
        if size >= low:
            rank = 2 if at == 0 or text[at - 1] == "\n" else 1 if text[at - 1].isspace() and not text[at].isspace() else 0
            places.append((rank, -size, at))
    rank, size, at = max(places)
    return at, -size


def split_oversized(
    rows: DataFrame, key: str, text: str = "text", *, limit: int = 6000, overlap: tuple[int, int] = (200, 400)
) -> DataFrame:
    """``(key, split_part_ordinal, split_part_count, text)`` for each row whose text exceeds ``limit`` UTF-8 bytes.

    Rows within the limit (and null texts) give no rows: they need no cutting and keep their own numbering. Texts are
    whole, whatever their length. A null key is kept; repeated rows are cut repeatedly. Only the key and the
    oversized texts reach Python; a row is cut where it lies, without a shuffle.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t in zip(batch["key"], batch["text"]):
                pieces = split_text(t, limit, overlap)
                out += [(k, i, len(pieces), t[a:b]) for i, (a, b) in enumerate(pieces, 1)]
            yield pd.DataFrame(out, columns=["key", "split_part_ordinal", "split_part_count", "text"])

    large = rows.where(F.octet_length(text) > limit).select(F.col(key).alias("key"), F.col(text).alias("text"))
    pieces = large.mapInPandas(run, f"key {kind}, split_part_ordinal int, split_part_count int, text string")
    return pieces.withColumnRenamed("key", key)
