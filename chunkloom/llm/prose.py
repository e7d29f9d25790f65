"""Statistics of a text's words, lines and layout."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

#: Frequent function words by language, in their usual spelling.
COMMON_WORDS = {
    "en": "the a an and or but if of to in on at by for with from as is are was were be been has have had it its this that these those not no "
    "which what who when while until unless because since although so than then there they you we he she his her their our your can may must "
    "should would will do does did nobody nothing every each another one still after before why how into out up down about more most only".split(),
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber wenn von zu im in am an auf bei für mit aus als ist sind war "
    "waren wird werden wurde hat haben hatte es sie er wir ihr nicht kein keine auch noch nur mehr dann denn dass ob wie was wer nach vor über "
    "unter um bis seit ohne durch sich muss kann soll nie zum zur vom erst etwa genau gibt".split(),
    "fr": "le la les un une des du de et ou mais si que qui quoi dans en au aux à sur par pour avec sans est sont était être a ont avait il elle "
    "ils elles nous vous on ce cette ces cet se sa son ses leur leurs ne pas plus encore quand parce comme avant après depuis pendant entre soit "
    "faut très trop toujours même fois où y".split(),
    "es": "el la los las un una unos unas de del y o pero si que quien en a al por para con sin es son era fue ser ha han había se su sus lo le "
    "les nos este esta estos estas ese esa no más todavía ya cuando porque como antes después desde hasta durante entre está debe muy siempre "
    "también cada vez tras donde".split(),
}
_COMMON = {lang: frozenset(words) for lang, words in COMMON_WORDS.items()}
_ANY = frozenset().union(*_COMMON.values())
_LANGUAGES = {w: tuple(lang for lang, words in _COMMON.items() if w in words) for w in _ANY}

#: signs of scripts that are written without blanks; two of them count as a word
_DENSE = "\u0e00-\u0edf\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
_HAS_DENSE = re.compile(f"[{_DENSE}]")
_WORD = re.compile(r"(?<!\w)[^\W\d_]+(?:['’][^\W\d_]+)*(?!\w)")
_DENSE_WORD = re.compile(rf"[{_DENSE}]{{1,2}}|(?<!\w)(?:(?![{_DENSE}])[^\W\d_])+(?:['’](?:(?![{_DENSE}])[^\W\d_])+)*")
#: a text in which fewer words than this share are function words of the listed languages is in none of them
LISTED = 0.3
_VOWELS = frozenset("aeiouyáàâãäåæéèêëíìîïóòôõöøœúùûüýāēīōūąęăıőű")
_GAP, _NO_ALNUM, _NO_DIGIT = re.compile(r"\s+"), re.compile(r"[\W_]+"), re.compile(r"\D+")
_BREAK = re.compile(r"\r\n?|\n")
_MARK = re.compile(r"\s*(?:[-*+•‣◦▪·–—o]\s|(?:\d{1,4}|[a-zA-Z]|[ivxIVX]{1,5})[.):]\s|\(\w{1,4}\)\s|\[[ xX✓-]?\]\s|#\d+\s)\s*(?:\[[ xX✓-]?\]\s+)?\S")
_KEYED = re.compile(r"\s*[\w.$/-]+(?:\s[\w.$/-]+){0,2}\s*(?::|=>?|→|->|–|—)\s+\S")
_RULER = re.compile(r"\s*[-+=|:\s_*~]{4,}$")
_CELLS = (("|", re.compile(r"\|")), ("\t", re.compile(r"\t")), (";", re.compile(r";")), (",", re.compile(r",")), ("  ", re.compile(r"(?<=\S)\s*  \s*(?=\S)")), ("&", re.compile(r"\s&\s")))
_HTML_ROW = re.compile(r"</?(?:t[rdh]|table|thead|tbody)\b", re.I)
_END = re.compile(r"[.!?…:;。！？।॥؟։]['\"”’»)\]*_」』]*\s*$")
_SENTENCE_END = re.compile(r"[.!?…।॥؟։]['\"”’»)\]*_]*(?=\s|$)|[。！？]")

STATISTICS = (
    "log_words",
    "word_length",
    "symbol_ratio",
    "digit_ratio",
    "common_share",
    "line_end_share",
    "log_line_words",
    "sentence_rate",
    "variety",
    "list_share",
    "table_share",
    "other_share",
)


def dominant_language(words: list[str]) -> str:
    """The language whose function words are most frequent; "en" if none occur."""
    return _scored(Counter(words))[0]


def _scored(times: Counter) -> tuple[str, int]:
    scores = dict.fromkeys(_COMMON, 0)
    for w in times.keys() & _ANY:
        for lang in _LANGUAGES[w]:
            scores[lang] += times[w]
    lang = max(scores, key=lambda lang: (scores[lang], lang == "en"))
    return lang, scores[lang]


def natural(text: str, times: Counter) -> bool:
    """Whether the words of a text in none of the listed languages may be those of some language.

    Its letters are of one script. If that is Latin, letters follow each other in other ways too than in strict turns of vowel and consonant, or some words are as much
    more frequent than others as function words are: words made up from syllables lack both.
    """
    n = sum(times.values())
    if not n:
        return False
    if not text.isascii():
        scripts: Counter = Counter()
        for ch, k in Counter(filter(str.isalpha, text)).items():
            script = unicodedata.name(ch, "?").split()[0]
            scripts["CJK" if script in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL") else script] += k
        script, most = scripts.most_common(1)[0]
        if most < 0.9 * scripts.total():
            return False
        if script != "LATIN":
            return True
    same = pairs = 0
    for w, k in times.items():
        turns = [ch in _VOWELS for ch in w if ch.isalpha()]
        same += k * sum(a == b for a, b in zip(turns, turns[1:]))
        pairs += k * max(0, len(turns) - 1)
    met = sum(k * (k - 1) for k in times.values())
    return same >= 0.08 * pairs > 0 or met >= 0.006 * n * (n - 1) > 0


def line_kinds(lines: list[str], words: list[list[str]], unlisted: bool = False) -> list[tuple[int, str]]:
    """``(line, kind)`` of each line that is neither blank nor a ruler, given the lines and their words in lower case.

    Kinds: ``prose`` (a line, or a part of a paragraph, with the function words of sentences, not repeated over and
    over), ``item``, ``row`` and ``other``. In an ``unlisted`` language, paragraphs that end sentences are prose too.
    """
    bare = [line.strip() for line in lines]
    seen = [i for i, line in enumerate(bare) if line]
    times = Counter(bare)
    cells = [_cells(line) for line in bare]
    told = _sentences(bare) if unlisted else frozenset()
    out: list[tuple[int, str]] = []
    for at, i in enumerate(seen):
        own = words[i]
        # a sentence that is said over and over says nothing more
        if len(own) >= 4 and times[bare[i]] <= 2 and ((i in told and not _MARK.match(bare[i])) or (len(_ANY.intersection(own)) and sum(map(_ANY.__contains__, own)) >= 0.2 * len(own))):
            if sum(map(len, own)) >= 0.5 * len(_GAP.sub("", bare[i])):
                out.append((i, "prose"))
                continue
        line = lines[i]
        if _RULER.match(line):
            continue
        near = [seen[j] for j in (at - 2, at - 1, at + 1, at + 2) if 0 <= j < len(seen)]
        # a row has as many cells as its neighbours, in the same notation
        if (near and any((n >= 2 or kind in "|\t") and sum(cells[j].get(kind) == n for j in near) >= min(2, len(near)) for kind, n in cells[i].items())) or (
            "<" in line and _HTML_ROW.search(line)
        ):
            out.append((i, "row"))
        elif _MARK.match(line) or (len(own) <= 12 and _KEYED.match(line) and any(_KEYED.match(lines[j]) for j in near)):
            out.append((i, "item"))
        else:
            out.append((i, "other"))
    return out


def _sentences(bare: list[str]) -> set[int]:
    """The lines of paragraphs that hold a sentence end, up to the last one."""
    out: set[int] = set()
    block: list[int] = []
    for i, line in enumerate(bare):
        if not line:
            block = []
            continue
        block.append(i)
        if _SENTENCE_END.search(line):
            out.update(block)
            block = []
    return out


def _cells(line: str) -> dict[str, int]:
    return {kind: n for kind, rx in _CELLS if kind in line and (n := len(rx.findall(line)))}


def _bare_items(lines: list[str]) -> bool:
    """Whether lines without marks are entries, one per line: short, of plain words, mostly different from each other."""
    if len(lines) < 4:
        return False
    words = [_WORD.findall(line) for line in lines]
    plain = [len(w) > 0 and len(w) <= 7 and sum(map(len, w)) >= 0.8 * len(line.replace(" ", "")) for w, line in zip(words, lines)]
    return sum(plain) >= 0.8 * len(lines) and len(set(lines)) >= 0.6 * len(lines)


def statistics(text: str) -> tuple[dict[str, float], dict[str, float], str]:
    """``(statistics, shares, language)``: :data:`STATISTICS`, and the share of characters in lines of each kind.

    The language is one of the listed ones or "other". Common words are the function words of a listed language; in
    another one, the short words that the text repeats.
    """
    lines = _BREAK.split(text)
    find = (_DENSE_WORD if not text.isascii() and _HAS_DENSE.search(text) else _WORD).findall
    per_line = [find(line.lower()) for line in lines]
    words = [w for own in per_line for w in own]
    times = Counter(words)
    lang, common = _scored(times)
    n = len(words)
    unlisted = common < LISTED * n or not n
    if unlisted:
        lang = "other"
        common = max(common, sum(k for w, k in times.items() if k > 1 and len(w) <= 5))
    kinds = line_kinds(lines, per_line, unlisted and natural(text, times))
    solid = len(_GAP.sub("", text))
    size = max(1, solid)
    sums: dict[str, float] = dict.fromkeys(("prose", "item", "row", "other"), 0.0)
    for i, kind in kinds:
        sums[kind] += len(lines[i].strip())
    count = Counter(kind for _, kind in kinds)
    loose = [lines[i].strip() for i, kind in kinds if kind == "other" and not lines[i].lstrip().startswith("#")]
    lines = [line for line in lines if line and not line.isspace()]
    if _bare_items(loose):
        moved = sum(map(len, loose))
        sums["item"] += moved
        sums["other"] -= moved
        count["item"] += len(loose)
    # a sentence or two above many short entries or rows may have more letters than these; it is still no prose
    if count["item"] + count["row"] >= 4 * count["prose"] and sums["prose"] < 0.65 * sum(sums.values()):
        sums["prose"] *= 0.5
    whole = sum(sums.values()) or 1.0
    shares = {k: max(0.0, v) / whole for k, v in sums.items()}
    stats = {
        "log_words": math.log1p(n),
        "word_length": sum(map(len, words)) / max(1, n),
        "symbol_ratio": (solid - len(_NO_ALNUM.sub("", text))) / size,
        "digit_ratio": len(_NO_DIGIT.sub("", text)) / size,
        "common_share": common / max(1, n),
        "line_end_share": sum(bool(_END.search(line)) for line in lines) / max(1, len(lines)),
        "log_line_words": math.log1p(n / max(1, len(lines))),
        "sentence_rate": len(_SENTENCE_END.findall(text)) / max(1, n),
        "variety": len(times) / max(1.0, n**0.8),
        "list_share": shares["item"],
        "table_share": shares["row"],
        "other_share": shares["other"] if sum(sums.values()) else 1.0,
    }
    return stats, shares, lang
