"""Evaluation texts that leak into training text.

Method: one Aho-Corasick automaton holds every run of five words of the normalised test items. Each document is normalised
(case, punctuation, markup and layout go; every word keeps its place in the original) and scanned once. Hits that keep
their distance between document and item (up to a slight drift) and follow each other closely form a passage; words that were
replaced leave short gaps in it. A passage counts by its extent, or by the lines of code in it.

Stock phrases are told from the items alone: a run of words that unrelated items share (items without a passage in common) belongs to none
of them, and a passage must have enough words beside such runs. What a document holds is thus judged by itself, and no
leak is lost because many documents hold it.

The automaton is built once, from the held-out items, and shared with the executors; its size is checked before. The documents are
scanned where they lie, without a shuffle, and only passages leave the scan.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate, repeat
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: words of letters and digits; an HTML entity is matched first and is no word, unless it stands for a letter
_TOKEN = re.compile(r"&#?\w{1,10};|[^\W_]+")
_INVISIBLE = dict.fromkeys(map(ord, "­​‌‍﻿"))


def words_of(text: str) -> list[tuple[str, int, int]]:
    """``(word, start, end)`` of a text: normalised words with their place in the original."""
    out: list[tuple[str, int, int]] = []
    for m in _TOKEN.finditer(text):
        w, start, end = m[0], m.start(), m.end()
        if w[0] == "&":
            w = html.unescape(w)
            if len(w) != 1 or not w.isalnum():
                continue
        if not w.isascii():
            w = unicodedata.normalize("NFKC", w)
        w = w.casefold()
        # a soft hyphen or an entity inside a word doesn't end it
        if out and start > out[-1][2] and text[out[-1][2] : start].translate(_INVISIBLE) == "":
            w, start = out[-1][0] + w, out[-1][1]
            out.pop()
        elif out and start == out[-1][2] and "&" in (text[start], text[out[-1][1]]):
            w, start = out[-1][0] + w, out[-1][1]
            out.pop()
        out.append((w, start, end))
    return out


_PLAIN = re.compile(r"[^\W_]+")
_TROUBLE = re.compile(f"[&{''.join(map(chr, _INVISIBLE))}]")


def plain_words(text: str) -> list[str] | None:
    """The words of :func:`words_of` without their places, for a text without entities and invisible signs; None for others."""
    if _TROUBLE.search(text):
        return None
    if text.isascii():
        return _PLAIN.findall(text.lower())
    return [w.casefold() if w.isascii() else unicodedata.normalize("NFKC", w).casefold() for w in _PLAIN.findall(text)]


_CODE_LINE = re.compile(r"[;{}()\[\],:>=]\s*\Z|^\s*(?://|/\*|\*|#|[}\])])|[=!<>]=|=>|\w\(")


def code_lines(text: str) -> list[tuple[int, int]]:
    """``(first word, last word + 1)`` of the lines of code that hold words."""
    out, at = [], 0
    ends, end = [], 0
    for line in text.splitlines(keepends=True):
        end += len(line)
        ends.append((end, bool(_CODE_LINE.search(line.rstrip()))))
    starts = [s for _, s, _ in words_of(text)]
    for end, code in ends:
        first = at
        while at < len(starts) and starts[at] < end:
            at += 1
        if code and at > first:
            out.append((first, at))
    return out


class ItemIndex:
    """The items' runs of ``n`` words: an automaton over them and, for each, where it stands in which items."""

    def __init__(self, items: list[tuple[int, str]], n: int = 5):
        self.n, self.ids = n, [i for i, _ in items]
        self.runs: dict[str, int] = {}
        self.places: list[list[tuple[int, int]]] = []
        self.words: list[list[str]] = []
        self.lines: list[list[tuple[int, int]]] = []  # of code: first word, last word + 1
        for at, (_, text) in enumerate(items):
            words = [w for w, _, _ in words_of(text or "")]
            self.words.append(words)
            self.lines.append(code_lines(text or ""))
            for k in range(len(words) - n + 1):
                run = " " + " ".join(words[k : k + n]) + " "
                if run not in self.runs:
                    self.runs[run] = len(self.places)
                    self.places.append([])
                self.places[self.runs[run]].append((at, k))
        # the same as arrays: every word a number, all items in a row with a 0 between them
        self.codes: dict[str, int] = {}
        for words in self.words:
            for w in words:
                self.codes.setdefault(w, len(self.codes) + 1)
        self.starts = np.cumsum([1] + [len(w) + 1 for w in self.words])[:-1]
        self.flat = np.zeros(1 + sum(len(w) + 1 for w in self.words), np.int32)
        for start, words in zip(self.starts, self.words):
            self.flat[start : start + len(words)] = [self.codes[w] for w in words]
        self.line_starts, self.line_ends = (np.array([start + x[e] for start, own in zip(self.starts, self.lines) for x in own], np.int64) for e in (0, 1))
        self.place_starts = np.cumsum([0] + [len(p) for p in self.places])
        flat = np.array([x for p in self.places for x in p], np.int64).reshape(-1, 2)
        self.place_items, self.place_words = flat[:, 0], flat[:, 1]
        self.automaton = self._automaton()

    def _automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for run, at in self.runs.items():
            found.add_word(run, at)
        if self.runs:
            found.make_automaton()
        return found

    def stock(self, least: int, gap: int, drift: int) -> frozenset[int]:
        """The runs that unrelated items share: items that no passages of ``least`` words in common connect."""
        group = list(range(len(self.ids)))

        def root(i: int) -> int:
            while group[i] != i:
                group[i] = i = group[group[i]]
            return i

        for other in range(len(self.ids)):
            hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
            words = self.words[other]
            for d in range(len(words) - self.n + 1):
                for item, k in self.places[self.runs[" " + " ".join(words[d : d + self.n]) + " "]]:
                    if item < other:
                        hits[item].append((d, k))
            for item, pairs in hits.items():
                if root(item) != root(other) and any(extent(c, words, self.words[item], self.n)[4] >= least for c in passages(pairs, self.n, gap, drift)):
                    group[root(other)] = root(item)
        return frozenset(r for r, places in enumerate(self.places) if len({root(i) for i, _ in places}) > 1)


def passages(hits: list[tuple[int, int]], n: int, gap: int, drift: int) -> Iterator[list[tuple[int, int]]]:
    """Chains of ``(document word, item word)`` hits of one item.

    Hits belong together if their distance differs by at most ``drift`` and the words they cover lie at most ``gap`` apart.
    """
    by: dict[int, set[int]] = defaultdict(set)
    for d, i in hits:
        by[d - i].add(d)
    done = set()
    for shift in by:
        near = {s: s - x for y in range(-drift, drift + 1) for x in (shift + y,) for s in by.get(x, ())}
        near.update((s, s - shift) for s in by[shift])
        chain: list[tuple[int, int]] = []
        for s in [*sorted(near), None]:
            if chain and (s is None or s - (chain[-1][0] + n) >= gap):
                if tuple(chain) not in done:
                    done.add(tuple(chain))
                    yield chain
                chain = []
            if s is not None:
                chain.append((s, near[s]))


def extent(chain: list[tuple[int, int]], document: list[str], item: list[str], n: int) -> tuple[int, int, int, int, int]:
    """First word and last word + 1 in the document, the same in the item, and the matching words, of a chain of hits.

    Beyond its runs a passage goes on over single replaced words, as long as a word that matches follows each.
    """
    (d, i), (e, j) = chain[0], (chain[-1][0] + n, chain[-1][1] + n)
    matching = n + sum(min(n, b - a) for (a, _), (b, _) in zip(chain, chain[1:]))
    for (a, x), (b, y) in zip(chain, chain[1:]):
        if b - a == y - x:  # no drift: words between two runs may match too
            matching += sum(document[a + k] == item[x + k] for k in range(n, b - a))
    while True:
        step = next((k for k in (1, 2) if d >= k and i >= k and document[d - k] == item[i - k]), 0)
        if not step:
            break
        d, i, matching = d - step, i - step, matching + 1
    while True:
        step = next((k for k in (1, 2) if e + k <= len(document) and j + k <= len(item) and document[e + k - 1] == item[j + k - 1]), 0)
        if not step:
            break
        e, j, matching = e + step, j + step, matching + 1
    return d, e, i, j, matching


_SCANNED = "id {kind}, item int, start int, end int, words int"


def _candidates(index: ItemIndex, doc: np.ndarray, word: np.ndarray, run: np.ndarray, codes: np.ndarray, gap: int, drift: int, least: int, lines: int) -> np.ndarray:
    """The hits, as ``(hit, place)``, of documents and items between which a passage is possible; an upper bound, for all documents of a batch at once.

    Hits lie at ``word`` of the row of all documents' words ``codes`` (a 0 after each document); hits of one distance
    between document and item that follow each other within ``gap`` are extended over single replaced words. Where all
    that so matches, taken together, is too little, no passage is.
    """
    times = index.place_starts[run + 1] - index.place_starts[run]
    hit = np.repeat(np.arange(len(run)), times)
    place = np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times) + index.place_starts[run][hit]
    item = index.place_items[place]
    a, b = word[hit], index.starts[item] + index.place_words[place]
    n, flat = index.n, index.flat
    order = np.lexsort((a, a - b))
    oa, shift, owner, its = a[order], (a - b)[order], doc[hit][order], item[order]
    new = np.ones(len(oa), bool)
    new[1:] = (shift[1:] != shift[:-1]) | (owner[1:] != owner[:-1]) | (its[1:] != its[:-1]) | (oa[1:] - oa[:-1] >= n + gap)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(oa)])) - 1
    left, right = oa[first], oa[last] + n
    off = shift[first]
    left, right = left.copy(), right.copy()
    for edge, step in ((left, -1), (right, 1)):
        open_ = np.arange(len(edge))
        while len(open_):
            at = edge[open_] - (step < 0)
            move = np.zeros(len(open_), np.int64)
            for k in (2, 1):
                d, i = at + step * (k - 1), at + step * (k - 1) - off[open_]
                # a step of two mustn't pass the end of a document or an item
                inside = (codes[np.clip(at, 0, len(codes) - 1)] >= 0) & (flat[np.clip(at - off[open_], 0, len(flat) - 1)] > 0)
                ok = inside & (d >= 0) & (d < len(codes)) & (i >= 0) & (i < len(flat))
                ok[ok] = (codes[d[ok]] == flat[i[ok]]) & (flat[i[ok]] > 0)
                move[ok] = k
            edge[open_] += step * move
            open_ = open_[move > 0]
    # a passage drifts from one distance to another near by: pieces of near distances count together
    row, col = owner[first], its[first]
    by = np.lexsort((off, col, row))
    fresh = np.ones(len(by), bool)
    fresh[1:] = (row[by][1:] != row[by][:-1]) | (col[by][1:] != col[by][:-1]) | (np.diff(off[by]) > drift)
    group = np.empty(len(by), np.int64)
    group[by] = np.cumsum(fresh) - 1
    pieces = np.bincount(group)
    total = np.bincount(group, right - left + gap) - gap  # they may lie up to the gap apart
    wide = np.where(pieces[group] > 1, gap, 0)
    code = np.searchsorted(index.line_ends, right - off + wide, "right") - np.searchsorted(index.line_starts, left - off - wide)
    possible = (total >= least) | (np.bincount(group, np.maximum(code, 0)) >= lines)
    keep = order[possible[group][np.cumsum(new) - 1]]
    return np.stack((hit[keep], place[keep]), axis=1)


def _scan(shared, stock: frozenset[int], gap: int, drift: int, least: int, least_lines: int, matching_share: float, own_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: ItemIndex = shared.value
        n = index.n

        def judge(key, text: str, words: list[str], hits: dict[int, list[tuple[int, int, int]]], rows: list) -> None:
            places_of: list[tuple[str, int, int]] = []
            for item, met in hits.items():
                run_at = {d: r for d, _, r in met}
                best = None
                for chain in passages([(d, k) for d, k, _ in met], n, gap, drift):
                    first, last, i, j, matching = extent(chain, words, index.words[item], n)
                    long = matching >= least or (min(last - first, j - i) >= least and matching >= matching_share * (last - first))
                    if not long and sum(i <= a and b <= j for a, b in index.lines[item]) < least_lines:
                        continue
                    starts = [d for d, _ in chain]
                    own = sum(min(n, b - a) for a, b in zip(starts, [*starts[1:], starts[-1] + n]) if run_at[a] not in stock)
                    if own >= min(own_words, (last - first) / 2) and (best is None or (matching, first, last) > best):
                        best = matching, first, last
                if best:
                    places_of = places_of or words_of(text)
                    rows.append((key, item, places_of[best[1]][1], places_of[best[2] - 1][2], best[0]))

        for whole in batches:
            for low in range(0, len(whole), 500):
                batch = whole.iloc[low : low + 500]
                keys, texts, rows = batch["id"].tolist(), batch["text"].tolist(), []
                told, codes, base = [], [], 0
                hit_doc, hit_word, hit_run = [], [], []
                for at, text in enumerate(texts):
                    words = plain_words(text)
                    if words is None:
                        words = [w for w, _, _ in words_of(text)]
                    met = list(index.automaton.iter(" " + " ".join(words) + " ")) if index.runs and len(words) >= n else []
                    if not met:
                        continue
                    ends = list(accumulate(map(len, words)))  # word k is followed by the blank at ends[k] + k + 1
                    place = dict(zip(map(add, ends, range(1, len(ends) + 1)), range(base - n + 1, base + len(ends))))
                    told.append((at, base, words))
                    hit_doc += [len(told) - 1] * len(met)
                    hit_word += [place[stop] for stop, _ in met]
                    hit_run += [r for _, r in met]
                    codes += map(index.codes.get, words, repeat(0))
                    codes.append(-1)  # between two documents
                    base += len(words) + 1
                if told:
                    doc, word, runs = (np.array(x, np.int64) for x in (hit_doc, hit_word, hit_run))
                    found = _candidates(index, doc, word, runs, np.array(codes, np.int32), gap, drift, min(least, int(matching_share * least)), least_lines)
                    by: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
                    for h, p in found.tolist():
                        d = int(doc[h])
                        by[d][int(index.place_items[p])].append((int(word[h]) - told[d][1], int(index.place_words[p]), int(runs[h])))
                    for d, hits in by.items():
                        at, _, words = told[d]
                        judge(keys[at], texts[at], words, hits, rows)
                yield pd.DataFrame(rows, columns=["id", "item", "start", "end", "words"])

    return run


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    *,
    key: str = "doc_id",
    item_key: str = "item_id",
    words: int = 20,
    lines: int = 6,
    matching: float = 0.85,
    own_words: int = 10,
    run: int = 5,
    gap: int = 8,
    drift: int = 2,
    most_item_bytes: int = 64 << 20,
) -> DataFrame:
    """``(doc_id, item_id, words, start, end)``: documents that hold a passage of an item, with its place in the text.

    A passage extends over ``words`` words, that share ``matching`` of it (or ``words`` of them) unchanged, or over ``lines`` whole lines of code; ``own_words`` of the words
    under its runs (or half of a shorter passage) lie outside stock phrases, which are runs that unrelated items share. All passages are judged; the longest
    that holds of each item is reported. A passage that several items share counts for each of them. Null and blank texts hold nothing; a
    repeated row is reported once; texts are scanned whole. Items with equal ids are scanned separately and reported once. No items or
    no documents give an empty result. The items are shared with all executors and must therefore be bounded: more
    than ``most_item_bytes`` of text is an error; larger sets are scanned in parts by their callers, since items don't depend on each other
    but for stock phrases.
    """
    spark = documents.sparkSession
    kind, item_kind = (t.schema[k].dataType.simpleString() for t, k in ((documents, key), (items, item_key)))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    if size > most_item_bytes:
        raise ValueError(f"the items have {size} bytes of text; at most {most_item_bytes} can be shared with all executors")
    held = [(r[0], r[1]) for r in items.where(F.col(item_key).isNotNull()).select(item_key, "text").collect()]
    index = ItemIndex(held, run)
    stock = index.stock(words, gap, drift)
    scanned = (
        documents.where(F.col("text").isNotNull() & F.col(key).isNotNull())
        .select(F.col(key).alias("id"), "text")
        .mapInPandas(_scan(spark.sparkContext.broadcast(index), stock, gap, drift, words, lines, matching, own_words), _SCANNED.format(kind=kind))
    )
    names = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(held)], f"item int, {item_key} {item_kind}")
    return (
        scanned.join(F.broadcast(names), "item")  # as many rows as there are items, checked above
        .groupBy(F.col("id").alias(key), item_key)
        .agg(F.max(F.struct("words", "start", "end")).alias("p"))
        .select(key, item_key, "p.words", "p.start", "p.end")
    )
