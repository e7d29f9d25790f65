"""Re-Pair grammars of token sequences, for many texts at a time.

Re-Pair replaces the most frequent pair of neighbouring symbols by a new symbol, a rule, until no pair repeats. Here all
texts of a batch are rewritten together in numpy, and a round replaces, in every text, each pair that is more frequent than
the pairs it overlaps, instead of a single pair; a long repetition is thus found in a few rounds. Rounds end when no pair occurs twice in any text any more.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd

#: words, split where case changes; numbers, however written, are one symbol; any other sign is a symbol of its own
_TOKEN = re.compile(r"0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?|[A-Z]?[a-z]+|[A-Z]+|[^\s\w]|_|[^\W\d_a-zA-Z]+")
#: strings, to the end of the line if that is where a chunk was cut, and long runs of the signs of encoded data
_LITERAL = re.compile(r"\"(?:\\.|[^\"\\\n])*(?:\"|$)|'(?:\\.|[^'\\\n])*(?:'|$)|`(?:\\.|[^`\\])*`|[\w+/=-]{80,}", re.M)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


class Grammar:
    """Grammars of the token sequences of several texts.

    After the rewriting: ``length`` is the number of tokens of each text, ``size`` that of the symbols in its final sequence and rules,
    ``covered`` the tokens under rules.
    """

    def __init__(self, texts: list[list[str]]):
        count = len(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        self.length, self.size, self.covered = lengths, lengths.copy(), np.zeros(count, np.int64)
        if not lengths.any():
            return
        owner = np.repeat(np.arange(count), lengths)
        width = np.ones(len(owner), np.int64)
        symbol = _token_hashes(texts)  # a symbol is known by the hash of what it stands for
        rules = np.zeros(count, np.int64)
        while len(symbol) >= 2:
            left, right = symbol[:-1], symbol[1:]
            inside = owner[:-1] == owner[1:]
            pair = left * np.uint64(0x9E3779B97F4A7C15) ^ (right + (left << np.uint64(13)) + np.uint64(0x1B873593))
            pair *= np.uint64(0xD6E8FEB86659FD93)
            pair ^= pair >> np.uint64(32)
            key = pair + owner[:-1].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
            order = np.argsort(key)
            ordered = key[order]
            starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(ordered)])))
            times = np.empty(len(key), np.int64)
            times[order] = np.repeat(sizes, sizes)
            times[~inside] = 0
            # better than both neighbours; among equals the leftmost of each run of them, and every second one after it
            before = np.concatenate(([0], times[:-1]))
            after = np.concatenate((times[1:], [0]))
            good = times >= 2
            higher = good & (times > before) & (times >= after)
            equal = good & (times == before) & (times >= after)
            # in a run of equals (x x x x ...) the pairs at even distance from its start
            at = np.arange(len(key))
            run_start = np.maximum.accumulate(np.where(~equal, at, 0))
            chosen = higher | (equal & higher[run_start] & ((at - run_start) % 2 == 0))
            # no two neighbours may both be chosen
            chosen[1:] &= ~chosen[:-1]
            where = np.flatnonzero(chosen)
            if not len(where):
                break
            # a rule must be used at least twice in its text
            used, inverse, uses = np.unique(key[where], return_inverse=True, return_counts=True)
            keep = uses[inverse] >= 2
            where, inverse = where[keep], inverse[keep]
            if not len(where):
                break
            _, first = np.unique(key[where], return_index=True)
            np.add.at(rules, owner[where[first]], 1)
            symbol[where] = pair[where]
            width[where] += width[where + 1]
            gone = np.zeros(len(symbol), bool)
            gone[where + 1] = True
            symbol, owner, width = symbol[~gone], owner[~gone], width[~gone]
        left_over = np.bincount(owner, minlength=count)
        self.size = left_over + 2 * rules
        self.covered = np.bincount(owner, np.where(width > 1, width, 0), count).astype(np.int64)


def _token_hashes(texts: list[list[str]]) -> np.ndarray:
    """The hashes of all tokens of the texts in a row; all numbers have the same."""
    codes, names = pd.factorize(np.array([w for t in texts for w in t], dtype=object))
    words = pd.util.hash_array(np.array(names, dtype=object).astype(str).astype(object)).astype(np.uint64)
    words[np.array([n[0].isdigit() for n in names], bool)] = np.uint64(0x9D39247E33776D41)
    return words[codes]


def long_runs(texts: list[list[str]], long: int = 24, window: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, hash, width)`` of runs of ``long`` tokens: rules over all texts there are, if their hashes are joined.

    A text's first and last run are taken and, of every ``window`` consecutive runs, the one with the least hash. So two texts with
    ``long + window - 1`` tokens in common have a run in common, wherever they lie and however seldom it occurs in either.
    ``width`` counts the tokens of a run before the next one: the widths of a text's runs are its length. Texts of
    fewer than ``long`` tokens have none.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not (lengths >= long).any():
        return none
    symbol = _token_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), lengths)
    n = len(symbol) - long + 1
    runs = np.zeros(n, np.uint64)
    for k in range(long):
        runs = (runs ^ symbol[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(29)
    at = np.flatnonzero(owner[:n] == owner[long - 1 :])
    runs, owner = runs[at], owner[at]
    edge = owner[1:] != owner[:-1]
    taken = np.concatenate(([True], edge)) | np.concatenate((edge, [True]))
    if len(runs) >= window:
        views = np.lib.stride_tricks.sliding_window_view(runs, window)
        inside = np.flatnonzero(owner[: len(views)] == owner[window - 1 :])
        taken[inside + views[inside].argmin(axis=1)] = True
    at, runs, owner = at[taken], runs[taken], owner[taken]
    width = np.full(len(at), long, np.int64)
    same = owner[1:] == owner[:-1]
    width[:-1][same] = np.diff(at)[same]
    return owner, runs, width


def literal_share(text: str, least: int = 80, incompressible: float = 0.6) -> tuple[int, int]:
    """``(characters in long literals that hardly compress, characters)``; white space doesn't count.

    A list of words in a string compresses well and is no blob; encoded data doesn't.
    """
    size = len("".join(text.split()))
    if size < least:
        return 0, size
    long = [m for m in _LITERAL.findall(text) if len(m) >= least]
    return sum(len(m) for m in long if len(zlib.compress(m.encode("utf-8", "surrogatepass"), 6)) >= incompressible * len(m)), size
