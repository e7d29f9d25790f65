"""Functions paired with their documentation.

Method: sources are parsed into syntax trees; function nodes - declarations, methods, and functions bound to a variable
or class field - are visited with the comment attached to them, or their docstring, and their exact range in the source. Documentation that is
empty, short, or only repeats the name is dropped, as are licence headers, dividers, directives and commented-out code.
"""

from __future__ import annotations

import re
import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.syntax import Comment, FunctionNode, Source, hash_source, python_functions, script_functions, script_source, shell_functions

SCRIPTS, PYTHONS, SHELLS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"), ("py", "pyi"), ("sh", "bash", "zsh", "ksh")

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+")
_DIRECTIVE = re.compile(
    r"^\W*(?:eslint\b|@ts-\w+|tslint:|jshint\b|jslint\b|jscs:|istanbul\s+ignore|c8\s+ignore|v8\s+ignore|prettier-ignore|biome-ignore|webpack\w*:|@__PURE__|#__PURE__"
    r"|#?\s*sourceMappingURL|noinspection\b|noqa\b|type:\s*ignore|pylint:|pragma:|mypy:|fmt:|isort:|ruff:|yapf:|flake8[:\b]|nosec\b|shellcheck\s|@?globals?\s+\w+|#?(?:end)?region\b|!/)",
    re.I,
)
_LICENCE = re.compile(r"\bcopyright\b|\(c\)\s|©|\blicen[cs]ed?\b|\bSPDX-|\ball rights reserved\b|\bpermission is hereby granted\b", re.I)
_CODE_LINE = re.compile(
    r"(?:[;{}]|\)\s*=>|=>|\w\(.*\)[;,]?)\s*$|^\s*(?:const|let|var|if|for|while|return|import|export|throw|await|try|def|class|function|else|public|private|static)\b.*[({=;:]"
    r"|^\s*[\w$.\[\]]+\s*[-+*/|&?]?=\s*\S|^\s*[)}\]]+|^\s*[\w$.]+\(.*\)\s*[;:]?$"
)


def comment_body(comment: Comment | str) -> str:
    """The text of a comment without its marks."""
    raw = comment if isinstance(comment, str) else comment.text
    if raw.startswith("/*"):
        raw = re.sub(r"^/\*+!?|\*+/$", "", raw)
        return "\n".join(re.sub(r"^[ \t]*\*+[ \t]?", "", line) if i else line for i, line in enumerate(re.split(r"\r\n?|\n", raw)))
    return "\n".join(re.sub(r"^[ \t]*(?://+[!/]?|#+)[ \t]?", "", line) for line in re.split(r"\r\n?|\n", raw))


def description(body: str) -> str:
    """The body without block tags and their text, and without what inline tags and markup say."""
    out, tag = [], False
    for line in body.split("\n"):
        if re.match(r"\s*[@\\][A-Za-z]", line):
            tag = True
        elif not line.strip():
            tag = tag and not out  # a blank line doesn't end a tag's text in doc comments, unless nothing came before
            tag = True if out and tag else tag
        if not tag:
            out.append(line)
    text = re.sub(r"\{@\w+[^}]*\}", " ", "\n".join(out))
    return re.sub(r"\s+@[A-Za-z]\w*[^\n]*", " ", text)


def real_words(body: str, name: str) -> int:
    """The words of a documentation besides tags with their text and the words of the function's own name."""
    own = {p.lower() for p in _PARTS.findall(name)} | {name.lower()}
    return sum(w.lower() not in own for w in _WORD.findall(description(body)))


def is_code(body: str) -> bool:
    lines = [line for line in body.split("\n") if line.strip()]
    return bool(lines) and sum(bool(_CODE_LINE.search(line)) for line in lines) > 0.5 * len(lines)


def _groups(source: Source) -> list[Comment]:
    """Comments that stand on lines of their own; line comments on consecutive lines are one, directives stay apart."""
    out: list[Comment] = []
    for c in source.comments:
        begins = source.line_start(c.start)
        if source.text[begins : c.start].strip():
            if not out or source.text[begins : c.start].strip() != out[-1].text:
                continue
        last = out[-1] if out else None
        if (
            last
            and not c.block
            and not last.block
            and source.line(last.end) + 1 == source.line(c.start)
            and not _DIRECTIVE.match(comment_body(c))
            and not _DIRECTIVE.match(comment_body(last))
            and c.text[:2] == last.text[:2]
        ):
            out[-1] = Comment(last.start, c.end, last.text + "\n" + c.text, False)
        else:
            out.append(c)
    return out


def attached(source: Source, groups: list[Comment], node: FunctionNode) -> Comment | None:
    """The comment right above a function: only decorators and directives may stand between, no blank line."""
    if source.text[source.line_start(node.start) : node.start].strip():
        return None
    by_end = {source.line(c.end - 1): c for c in groups if c.end <= node.head}
    line = source.line(node.head) - 1
    first = source.line(node.start)
    while line > 0:
        if c := by_end.get(line):
            if not _DIRECTIVE.match(comment_body(c)):
                return c
            line = source.line(c.start) - 1
        elif line >= first:
            line -= 1  # a decorator
        else:
            return None
    return None


def documented(text: str, suffix: str, least_words: int = 4) -> list[tuple[str, str, str, int, int]]:
    """``(name, documentation, code, first line, last line)`` of the documented functions of a source."""
    if suffix in SCRIPTS:
        if "//" not in text and "/*" not in text:
            return []
        source = script_source(text)
        if not source.comments:
            return []
        nodes = script_functions(source)
    elif suffix in PYTHONS:
        if "def" not in text:
            return []
        source = hash_source(textwrap.dedent(text.replace("\r\n", "\n")))
        nodes = python_functions(source)
    elif suffix in SHELLS:
        source = hash_source(text.replace("\r\n", "\n"), shell=True)
        nodes = shell_functions(source)
    else:
        return []
    if not nodes:
        return []
    groups = _groups(source)
    out = []
    for node in nodes:
        bodies = []
        if node.docstring is not None:
            bodies.append(node.docstring)
        if c := attached(source, groups, node):
            bodies.append(comment_body(c))
        for body in bodies:
            if _LICENCE.search(body) or is_code(description(body)) or real_words(body, node.name) < least_words:
                continue
            out.append((node.name, body.strip(), source.text[node.start : node.end].rstrip(), source.line(node.start), source.line(max(node.start, node.end - 1))))
            break
    return out


def function_pairs(chunks: DataFrame, *, least_words: int = 4) -> DataFrame:
    """``(point_id, function_name, documentation, code, start_line, end_line)`` of all documented functions of source chunks.

    The language follows from ``relative_path``; other files, null texts and null ``point_id``s give no rows. Lines count from the chunk's
    first. Repeats of a chunk give its pairs once; a name that occurs twice in a chunk gives a row each. A chunk may
    be a fragment, and its text is parsed whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (key, *pair) for key, text, suffix in zip(batch["point_id"], batch["text"], batch["suffix"]) for pair in documented(text, suffix, least_words)
            ]
            yield pd.DataFrame(rows, columns=["point_id", "function_name", "documentation", "code", "start_line", "end_line"])

    suffix = F.lower(F.regexp_extract("relative_path", r"\.([A-Za-z]+)$", 1)).alias("suffix")
    sources = chunks.select("point_id", "text", suffix).where(F.col("suffix").isin(*SCRIPTS, *PYTHONS, *SHELLS) & F.col("text").isNotNull() & F.col("point_id").isNotNull())
    pairs = sources.mapInPandas(run, "point_id string, function_name string, documentation string, code string, start_line int, end_line int")
    return pairs.distinct()
