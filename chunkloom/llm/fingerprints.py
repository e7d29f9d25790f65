"""Fingerprints of texts (of their lines, and winnowed runs of words), Bloom filters over them, and the share of lines that two texts have in common."""

from __future__ import annotations

import re
from hashlib import md5

import numpy as np
import pandas as pd
import xxhash

_WORD = re.compile(r"\w+")
_NONE = np.uint64(2**64 - 1)


def word_lines(text: str) -> list[str]:
    """The lines that hold words, as their words: layout, punctuation and quotes don't count."""
    found = (" ".join(_WORD.findall(line)) for line in re.split(r"\r\n?|\n", text))
    return [line for line in found if line]


def class_of(lines: list[str]) -> bytes:
    """The class of texts that are equal apart from layout: a digest of their words (lines may be broken elsewhere)."""
    return md5(" ".join(lines).encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


class WordArrays:
    """The words of several texts, given as their lines, as arrays: every different word is hashed once."""

    def __init__(self, texts: list[list[str]]):
        lines = [line for text in texts for line in text]
        flat = " ".join(lines).split(" ") if lines else []
        self.lines = np.array([len(text) for text in texts], np.int64)  # of each text
        self.line_words = np.array([line.count(" ") + 1 for line in lines], np.int64)
        codes, different = pd.factorize(np.array(flat, dtype=object))
        self.codes = codes
        self.hashes = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in different], np.uint64)[codes] if flat else np.zeros(0, np.uint64)
        starts = np.concatenate(([0], np.cumsum(self.line_words)))
        self.line_starts = starts[:-1]
        self.words = np.diff(starts[np.concatenate(([0], np.cumsum(self.lines)))])  # of each text

    def winnow(self, run: int = 5, window: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """``(owner, fingerprint)``, in order of the texts.

        Runs of ``run`` words are hashed; of every ``window`` consecutive runs the least hash is kept. Two texts that
        share ``run + window - 1`` words in a row share a fingerprint. A text with fewer words than ``run`` has one of
        all of them.
        """
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        # pads before, between and after the texts: no window holds runs of two texts, and none depends on a text's neighbours
        pad, short = run + window, np.where(self.words > 0, np.maximum(run - self.words, 0), 0)
        at = np.arange(len(self.hashes)) + np.repeat(pad * np.arange(1, len(self.words) + 1) + np.concatenate(([0], np.cumsum(short)[:-1])), self.words)
        size = len(self.hashes) + pad * (len(self.words) + 1) + int(short.sum())
        h, owner, empty = np.zeros(size, np.uint64), np.full(size, -1), np.ones(size, bool)
        h[at], empty[at] = self.hashes, False
        owner[at] = np.repeat(np.arange(len(self.words)), self.words)
        if short.any():  # what a short text lacks to a run counts as empty words
            ends = at[np.cumsum(self.words)[short > 0] - 1]
            for end, k, i in zip(ends, short[short > 0], np.flatnonzero(short)):
                empty[end + 1 : end + 1 + k], owner[end + 1 : end + 1 + k] = False, i
        n = size - run + 1
        runs, padded = np.zeros(n, np.uint64), np.zeros(n, bool)
        for k in range(run):
            runs = (runs ^ h[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
            runs ^= runs >> np.uint64(29)
            padded |= empty[k : n + k]
        runs[padded] = _NONE
        first = np.where(padded, -1, owner[:n])
        least, own = runs, first
        width = 1
        while width < window:  # minima over windows by doubling
            step = min(width, window - width)
            least, own = np.minimum(least[:-step], least[step:]), np.maximum(own[:-step], own[step:])
            width += step
        good = least != _NONE
        own, least = own[good].astype(np.int64), least[good]
        # neighbouring windows mostly have the same minimum
        changed = np.concatenate(([True], (least[1:] != least[:-1]) | (own[1:] != own[:-1])))
        own, least = own[changed], least[changed]
        order = np.lexsort((least, own))
        own, least = own[order], least[order]
        changed = np.concatenate(([True], (least[1:] != least[:-1]) | (own[1:] != own[:-1])))
        return own[changed], least[changed]

    def line_hashes(self) -> list[np.ndarray]:
        """For each text, the hashes of its lines: sums of the hashes of their words (mod 2**64), sorted.

        As a sum, a line's hash changes by the same amount wherever one name is replaced by another, once for each time
        that the line has it; :func:`kept_share` makes use of that.
        """
        if not len(self.hashes):
            return [np.zeros(0, np.int64) for _ in self.lines]
        per_line = np.add.reduceat(_mixed(self.hashes), self.line_starts).view(np.int64)
        ends = np.cumsum(self.lines)
        return [np.sort(x) for x in np.split(per_line, ends[:-1])]


    def line_prints(self, often: float) -> tuple[np.ndarray, np.ndarray]:
        """``(owner, fingerprint)``, in order of the texts: one for each line, and one for each line without each of its frequent words.

        A word is frequent if at least two lines and the share ``often`` of the text's lines hold it; a line without a word is known
        by the rest and by how often the word stood there. Equal lines have different fingerprints, the first, second, third ... of
        them, so repeated lines count as often as both texts have them. Two texts that keep ``K`` lines, if one looks past
        one name changed to another that those lines don't hold, share at least ``K / 2`` fingerprints if ``K`` is at least twice the
        share ``often`` of the lines of either: half of the ``K`` lines are without the name, or else it is frequent in both texts.
        """
        owner, value, _ = self.placed_line_prints(often)
        order = np.lexsort((value, owner))
        owner, value = owner[order], value[order]
        new = np.concatenate((np.ones(min(1, len(value)), bool), (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])))
        return owner[new], value[new]

    def placed_line_prints(self, often: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(owner, fingerprint, line)`` of :meth:`line_prints`, where a fingerprint has a row for each line that it may be of: the line's number, inverted (``~``) if it is without a word.

        Of equal lines, the first ones have the first fingerprints, but the last ones the first of those without a word. So of equal lines, of which some are met as they are and
        others without a word, as many lines are met as the two together, or all.
        """
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        mixed = _mixed(self.hashes)
        sums = np.add.reduceat(mixed, self.line_starts)
        text_of = np.repeat(np.arange(len(self.lines)), self.lines)
        size = int(self.codes.max()) + 1
        key, first, times = np.unique(np.repeat(np.arange(len(sums)), self.line_words) * size + self.codes, return_index=True, return_counts=True)
        line, code = key // size, key % size
        _, group, holders = np.unique(text_of[line] * size + code, return_inverse=True, return_counts=True)
        name = holders[group] >= np.maximum(2, often * self.lines[text_of[line]])
        line, code, first, times = line[name], code[name], first[name], times[name].astype(np.uint64)
        blind = _mixed(sums[line] - times * mixed[first] + times * np.uint64(0xD6E8FEB86659FD93))
        owner = np.concatenate((text_of, text_of[line]))
        word = np.concatenate((np.full(len(sums), -1), code))
        place = np.concatenate((np.arange(len(sums)), line))
        value = np.concatenate((sums, blind))
        order = np.lexsort((value, word, owner))
        owner, word, value, place = owner[order], word[order], value[order], place[order]
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (word[1:] != word[:-1]) | (value[1:] != value[:-1])))
        at = np.arange(len(value))
        rank = at - np.maximum.accumulate(np.where(new, at, 0))
        size = np.diff(np.append(np.flatnonzero(new), len(value)))[np.cumsum(new) - 1]
        return owner, _mixed(value + rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.where(word < 0, place, ~place[at - 2 * rank + size - 1])


def _mixed(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return mixed ^ (mixed >> np.uint64(29))


def winnow(texts: list[list[str]], run: int = 5, window: int = 8) -> tuple[np.ndarray, np.ndarray]:
    return WordArrays(texts).winnow(run, window)


def line_hashes(texts: list[list[str]]) -> list[np.ndarray]:
    return WordArrays(texts).line_hashes()


class Bloom:
    """A Bloom filter of a fixed number of bits over 64-bit fingerprints."""

    def __init__(self, bits: int, data: bytes | None = None, probes: int = 6):
        self.bits, self.probes = bits, probes
        self.data = np.zeros((bits + 7) // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8).copy()

    def _at(self, fps: np.ndarray) -> np.ndarray:
        a = fps.astype(np.uint64)
        b = (a ^ (a >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
        steps = np.arange(self.probes, dtype=np.uint64)[:, None]
        return ((a * np.uint64(0x94D049BB133111EB))[None, :] + steps * b[None, :]) % np.uint64(self.bits)

    def add(self, fps: np.ndarray) -> None:
        at = self._at(fps).ravel()
        np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def holds(self, fps: np.ndarray) -> np.ndarray:
        at = self._at(fps)
        return ((self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def kept_share(new: np.ndarray, held: np.ndarray, enough: float = 0.5) -> float:
    """The share of lines that two texts (as :func:`line_hashes`) have in common, of the longer one.

    If it isn't ``enough``, one changed name is looked past: a name counts as changed if at least two of the remaining
    lines differ by it and nothing else. (Two names that only ever occur together, in the same lines, count as one.)
    """
    whole = max(len(new), len(held))
    if not whole:
        return 0.0
    new_lines, new_counts = np.unique(new, return_counts=True)
    held_lines, held_counts = np.unique(held, return_counts=True)
    _, i, j = np.intersect1d(new_lines, held_lines, assume_unique=True, return_indices=True)
    both = np.minimum(new_counts[i], held_counts[j])
    share = both.sum() / whole
    if share >= enough:
        return float(share)
    left_new, left_held = new_counts.copy(), held_counts.copy()
    left_new[i] -= both
    left_held[j] -= both
    if min(left_new.sum(), left_held.sum()) + both.sum() < enough * whole:
        return float(share)
    rest_new, left_new = new_lines[left_new > 0], left_new[left_new > 0]
    rest_held, left_held = held_lines[left_held > 0], left_held[left_held > 0]
    change = _change(rest_new, left_new, rest_held, left_held)
    if change is None:
        return float(share)
    return float(min(1.0, share + _changed(rest_new, left_new, rest_held, left_held, change) / whole))


def _changed(new: np.ndarray, new_counts: np.ndarray, held: np.ndarray, held_counts: np.ndarray, found: tuple[np.ndarray, np.ndarray], most: int = 1 << 20) -> int:
    """How many lines differ by the change of one name, of the differences (and their weights) that several pairs of lines have.

    A line that has the name ``k`` times differs by ``k`` times the change. The most frequent difference is ``m`` times the change (``m`` up to 64 is tried). Times ``m`` and
    divided by the odd part of that difference (mod 2**64), two lines lie as close to each other as they have the name.
    """
    values, weights = found
    heaviest = int(values[weights.argmax()]) % (1 << 64)
    shift = (heaviest & -heaviest).bit_length() - 1
    inverse = np.uint64(pow(heaviest >> shift, -1, 1 << 64))
    reach = np.uint64(most << shift)
    heavy = weights * 64 >= weights.max()
    scaled, heavy = values[heavy].view(np.uint64) * inverse, weights[heavy]
    m = max(range(1, 65), key=lambda m: (heavy[scaled * np.uint64(m) <= reach].sum(), -m))
    a, b = new.view(np.uint64) * inverse * np.uint64(m), held.view(np.uint64) * inverse * np.uint64(m)
    new_order, held_order = np.argsort(a), np.argsort(b)
    a, left, b, right = a[new_order], new_counts[new_order], b[held_order], held_counts[held_order].copy()
    at = np.searchsorted(b, a, "left") - 1
    near = (at >= 0) & (a - b[at.clip(0)] <= reach)
    matched = 0
    for i, j in zip(np.flatnonzero(near), at[near]):
        taken = min(left[i], right[j])
        right[j] -= taken
        matched += taken
    return int(matched)


def _change(new: np.ndarray, new_counts: np.ndarray, held: np.ndarray, held_counts: np.ndarray, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray] | None:
    """The differences that at least two pairs of different lines have, and how many lines have them; None if there are none.

    Differences are counted in parts, by their remainder, so that only about ``most`` are held at a time, however long the texts.
    """
    parts = 1 << (-(-len(new) * len(held) // most) - 1).bit_length()
    # the number of parts is a power of two, as hashes wrap around; differences of a remainder come from pairs of remainders
    new_at, held_at = (np.argsort(x % parts, kind="stable") for x in (new, held))
    new_ends, held_ends = (np.concatenate(([0], np.cumsum(np.bincount((x % parts).astype(np.int64), minlength=parts)))) for x in (new, held))
    found = []
    for part in range(parts):
        changes, weights = [], []
        for of_held in range(parts):
            of_new = (part + of_held) % parts
            a = new_at[new_ends[of_new] : new_ends[of_new + 1]]
            b = held_at[held_ends[of_held] : held_ends[of_held + 1]]
            changes.append((new[a][:, None] - held[b][None, :]).ravel())
            weights.append(np.minimum(new_counts[a][:, None], held_counts[b][None, :]).ravel())
        values, at, counts = np.unique(np.concatenate(changes), return_inverse=True, return_counts=True)
        total = np.where(counts >= 2, np.bincount(at, np.concatenate(weights), len(values)), 0)
        found.append((values[total > 0], total[total > 0]))
    values, weights = (np.concatenate(x) for x in zip(*found))
    return (values, weights) if len(values) else None
