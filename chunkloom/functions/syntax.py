"""Light syntax trees of script sources.

A source is first divided into code and what isn't code: comments, strings, templates and regular expressions. What isn't code is
blanked out, character for character, so that brackets and words that remain are real ones. Brackets then give the nesting.
All functions take fragments: a chunk may open inside a class or end inside a function.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_SCRIPT_SPAN = re.compile(
    r"(?P<block>/\*.*?(?:\*/|\Z))|(?P<line>//[^\n]*)|(?P<string>'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?)|(?P<template>`)"
    r"|(?P<slash>/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])*/[a-z]*)",
    re.S,
)
_TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
_INNER = re.compile(r"\\.|[`{}]|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|/\*.*?\*/|//[^\n]*", re.S)
#: a slash after one of these begins a regular expression, after anything else it divides
_BEFORE_REGEX = set("=(,:;!&|?{}[+-*%<>~^") | {""}
_REGEX_WORDS = re.compile(r"\b(?:return|typeof|case|in|of|void|delete|throw|new|else|do|yield|await)$")
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_BRACKET = re.compile(r"[(){}\[\]]")


@dataclass
class Comment:
    start: int
    end: int
    text: str
    block: bool


@dataclass
class Source:
    """A source whose strings and comments are blanked out in ``code``; offsets are those of ``text``."""

    text: str
    code: str
    comments: list[Comment]
    strings: list[tuple[int, int]] = field(default_factory=list)
    partner: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        open_: list[int] = []
        for m in _BRACKET.finditer(self.code):
            c = m[0]
            if c in _PAIRS:
                open_.append(m.start())
            else:
                # a closing bracket that fits none of the open ones belongs to a part that isn't here
                for back in range(len(open_) - 1, -1, -1):
                    if _PAIRS[self.code[open_[back]]] == c:
                        self.partner[open_[back]] = m.start()
                        self.partner[m.start()] = open_[back]
                        del open_[back:]
                        break
        self._lines = [0, *(m.end() for m in re.finditer(r"\n", self.text))]

    def line(self, at: int) -> int:
        """The number of the line at an offset, from 1."""
        return bisect_right(self._lines, at)

    def line_start(self, at: int) -> int:
        return self._lines[bisect_right(self._lines, at) - 1]

    def closes(self, at: int) -> int | None:
        """Where the bracket that opens at ``at`` closes; None if the source ends before."""
        return self.partner.get(at)


def _template_end(text: str, at: int) -> int:
    """The end of the template that opens at ``at``; templates nest inside ``${}``."""
    depth: list[int] = []  # braces open in each ${}
    i = at + 1
    while True:
        m = (_INNER if depth else _TEMPLATE).search(text, i)
        if not m:
            return len(text)
        i, c = m.end(), m[0]
        if not depth:
            if c == "`":
                return i
            if c == "${":
                depth.append(1)
        elif c == "`":
            i = _template_end(text, m.start())
        elif c == "{":
            depth[-1] += 1
        elif c == "}":
            depth[-1] -= 1
            if not depth[-1]:
                depth.pop()


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def script_source(text: str) -> Source:
    """A JavaScript or TypeScript source."""
    out: list[str] = []
    comments: list[Comment] = []
    strings: list[tuple[int, int]] = []
    i = 0
    while m := _SCRIPT_SPAN.search(text, i):
        start, end, kind = m.start(), m.end(), m.lastgroup
        out.append(text[i:start])
        if kind == "slash":
            before = text[max(0, start - 200) : start].rstrip()
            if before[-1:] not in _BEFORE_REGEX and not _REGEX_WORDS.search(before):
                out.append("/")
                i = start + 1
                continue
        if kind == "template":
            end = _template_end(text, start)
        if kind in ("block", "line"):
            comments.append(Comment(start, end, m[0], kind == "block"))
            out.append(_blank(text[start:end]))
        else:
            strings.append((start, end))
            body = _blank(text[start:end])
            out.append('"' + body[1:-1] + '"' if len(body) > 1 else '"')
        i = end
    out.append(text[i:])
    return Source(text, "".join(out), comments, strings)


_HASH_SPAN = re.compile(
    r"(?P<line>\#[^\n]*)|(?P<string>[rRbBuUfF]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?))", re.S
)
_SHELL_SPAN = re.compile(r"(?P<line>(?:(?<=\s)|^|(?<=;))\#[^\n]*)|(?P<skip>\\.|\$\{[^}\n]*\})|(?P<string>'[^']*'?|\"(?:\\.|[^\"\\])*\"?)", re.S | re.M)


def hash_source(text: str, shell: bool = False) -> Source:
    """A Python source or, with ``shell``, a shell script."""
    out: list[str] = []
    comments: list[Comment] = []
    strings: list[tuple[int, int]] = []
    i = 0
    for m in (_SHELL_SPAN if shell else _HASH_SPAN).finditer(text):
        out.append(text[i : m.start()])
        if m.lastgroup == "line":
            comments.append(Comment(m.start(), m.end(), m[0], False))
            out.append(_blank(m[0]))
        elif m.lastgroup == "string":
            strings.append((m.start(), m.end()))
            body = _blank(m[0])
            out.append('"' + body[1:-1] + '"' if len(body) > 1 else '"')
        else:
            out.append("_" * len(m[0]))
        i = m.end()
    out.append(text[i:])
    return Source(text, "".join(out), comments, strings)


@dataclass
class FunctionNode:
    name: str
    start: int  # of the statement, with its modifiers and decorators
    head: int  # of the statement without decorators
    body: int
    end: int
    docstring: str | None = None


_WORDS = r"(?:(?:export|default|declare|public|private|protected|static|abstract|override|readonly|async|accessor|get|set)\s+)*"
_NAME = r"(?P<{0}>\#?[A-Za-z_$][\w$]*)"
_HEAD = re.compile(
    rf"(?<![\w$.#])(?P<mods>{_WORDS})(?:"
    rf"(?:async\s+)?function\b\s*\*?\s*{_NAME.format('fn')}\s*(?=[(<])"
    rf"|(?:const|let|var)\s+{_NAME.format('bound')}\s*(?=[:=])"
    rf"|(?:\*\s*)?{_NAME.format('method')}\s*\??\s*(?=[(<])"
    rf"|{_NAME.format('field')}\s*[?!]?\s*(?=[:=](?![=>]))"
    r")"
)
_NOT_METHODS = frozenset(
    "if for while switch catch function return with new typeof await super import export const let var do else in of case throw delete void yield class extends".split()
)
_FUNCTION_VALUE = re.compile(r"\s*(?:async\s+)?function\b\s*\*?\s*(?:[\w$]+\s*)?(?=[(<])")
_ARROW_ONE = re.compile(r"\s*(?:async\s+)?[A-Za-z_$][\w$]*\s*=>")
_DECORATOR = re.compile(r"@[\w$.]+")


def _skip_type_arguments(code: str, at: int) -> int:
    """Past ``<...>`` at ``at``; -1 if it doesn't close."""
    depth = 0
    for m in re.finditer(r"=>|[<>;{}]", code[at : at + 2000]):
        if m[0] == "<":
            depth += 1
        elif m[0] == ">":
            depth -= 1
            if not depth:
                return at + m.end()
        elif m[0] == ";":
            return -1
    return -1


def _skip_type(source: Source, at: int, stops: str) -> int:
    """The offset of the first of ``stops`` after the type that begins at ``at``; -1 if there is none.

    A brace where a type is expected opens an object type, one after a type opens a body.
    """
    code, wants = source.code, True
    i, n, angle = at, len(code), 0
    while i < n:
        c = code[i]
        if c.isspace():
            if c == "\n" and not wants and not angle and not re.match(r"\s*(?:[|&=>,{]|extends\b|is\b)", code[i:i + 200]):
                return -1 if "\n" not in stops else i
            i += 1
            continue
        if code.startswith("=>", i):
            if "=>" in stops and not wants and not angle:
                return i
            wants, i = True, i + 2
            continue
        if c in stops and not angle and not (c == "{" and wants):
            return i
        if c in "([{":
            close = source.closes(i)
            if close is None:
                return -1
            i, wants = close + 1, False
        elif c in ";)]}":
            return -1
        elif c == "<":
            angle, wants, i = angle + 1, True, i + 1
        elif c == ">":
            angle, wants, i = angle - 1, False, i + 1
        elif c in "|&,?:":
            wants, i = True, i + 1
        elif m := re.compile(r"[\w$.#\"]+").match(code, i):
            wants, i = m[0] in ("keyof", "typeof", "readonly", "is", "asserts", "infer", "extends", "unique", "new"), m.end()
        else:
            i += 1
    return -1


def _after_parameters(source: Source, at: int) -> int:
    """Past the type and value parameters that begin at ``at``; -1 if these aren't parameters."""
    code = source.code
    if code[at : at + 1] == "<":
        at = _skip_type_arguments(code, at)
        while 0 <= at < len(code) and code[at].isspace():
            at += 1
    if at < 0 or code[at : at + 1] != "(":
        return -1
    close = source.closes(at)
    return -1 if close is None else close + 1


def _block(source: Source, at: int) -> tuple[int, int] | None:
    """The body ``{...}`` after parameters that end at ``at``, with an optional return type between."""
    code = source.code
    i = re.compile(r"\s*").match(code, at).end()
    if code[i : i + 1] == ":":
        i = _skip_type(source, i + 1, "{")
    if i < 0 or code[i : i + 1] != "{":
        return None
    close = source.closes(i)
    return i, len(code) if close is None else close + 1


def _value_body(source: Source, at: int) -> tuple[int, int] | None:
    """The body of the function expression or arrow function that begins at ``at``."""
    code = source.code
    if m := _FUNCTION_VALUE.match(code, at):
        end = _after_parameters(source, m.end())
        return None if end < 0 else _block(source, end)
    if m := _ARROW_ONE.match(code, at):
        arrow = m.end()
    else:
        i = re.compile(r"\s*(?:async\b\s*)?").match(code, at).end()
        end = _after_parameters(source, i)
        if end < 0:
            return None
        m = re.compile(r"\s*").match(code, end)
        i = m.end()
        if code[i : i + 1] == ":":
            i = _skip_type(source, i + 1, "=>")
            if i < 0:
                return None
        if not code.startswith("=>", i):
            return None
        arrow = i + 2
    i = re.compile(r"\s*").match(code, arrow).end()
    if i >= len(code):
        return None
    if code[i] == "{":
        close = source.closes(i)
        return i, len(code) if close is None else close + 1
    # an expression: up to the end of the statement
    j = i
    while j < len(code):
        c = code[j]
        if c in "([{":
            close = source.closes(j)
            if close is None:
                return i, len(code)
            j = close
        elif c in ";)]},":
            break
        elif c == "\n" and not re.match(r"\s*[.?:&|+\-*/%<>=,]", code[j:j + 200]) and not re.search(r"[.?:&|+\-*/%<>=,(]\s*$", code[max(i, j - 80) : j]):
            break
        j += 1
    return i, j


def _starts_statement(source: Source, at: int) -> bool:
    """Whether a declaration may begin at ``at``: after nothing, a bracket, a separator, a decorator or a line break."""
    before = source.code[:at].rstrip(" \t\r")
    if not before or before[-1] in "{};,\n":
        return before[-1:] != "\n" or not re.search(r"[=(\[.?:&|+\-*/%<>]\s*$", before[-80:])
    if before[-1] == ")" or re.match(r"[\w$]", before[-1]):
        return bool(re.search(r"@[\w$.]+$", before[-200:])) or (before[-1] == ")" and _is_decorator_call(source, len(before) - 1))
    return False


def _is_decorator_call(source: Source, close: int) -> bool:
    open_ = source.partner.get(close)
    return open_ is not None and bool(re.search(r"@[\w$.]+\s*$", source.code[max(0, open_ - 200) : open_]))


def _with_decorators(source: Source, at: int) -> int:
    """Where the decorators before ``at`` begin; ``at`` itself if there are none."""
    while True:
        before = source.code[:at].rstrip()
        m = re.search(r"@[\w$.]+$", before[-200:])
        if m:
            at = len(before) - len(m[0])
            continue
        if before.endswith(")") and _is_decorator_call(source, len(before) - 1):
            open_ = source.partner[len(before) - 1]
            at = source.code.rindex("@", 0, open_)
            continue
        return at


def script_functions(source: Source) -> list[FunctionNode]:
    """Functions and methods with a body, and functions bound to a variable or class field, in order."""
    found: list[FunctionNode] = []
    code = source.code
    seen: set[int] = set()
    at = 0
    while m := _HEAD.search(code, at):
        at = max(m.start() + 1, m.start("mods") + 1)
        kind = m.lastgroup
        name = m[kind]
        start = m.start()
        at = max(at, m.end(kind))
        if kind in ("method", "field") and (name in _NOT_METHODS or not _starts_statement(source, start)):
            at = m.start(kind) + len(name)
            continue
        if kind in ("fn", "method"):
            end = _after_parameters(source, m.end())
            body = None if end < 0 else _block(source, end)
        else:
            i = m.end()
            if code[i : i + 1] == ":":
                i = _skip_type(source, i + 1, "=")
                if i < 0:
                    continue
            body = _value_body(source, i + 1) if code[i : i + 1] == "=" and code[i + 1 : i + 2] not in ("=", ">") else None
            if kind == "fn" and body is None:
                continue
        if body is None or body[0] in seen:
            continue
        seen.add(body[0])
        found.append(FunctionNode(name, _with_decorators(source, start), start, body[0], body[1]))
    return found


_DEF = re.compile(r"^(?P<indent>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*(?=\()", re.M)


def python_functions(source: Source) -> list[FunctionNode]:
    """Functions and methods with a body of a Python source, with their docstrings."""
    found: list[FunctionNode] = []
    code, strings = source.code, {s: e for s, e in source.strings}
    for m in _DEF.finditer(code):
        close = source.closes(m.end())
        if close is None:
            continue
        colon = re.compile(r"\s*(?:->[^\n:]*(?:\[[^\]]*\][^\n:]*)?)?:").match(code, close + 1)
        if not colon:
            continue
        body = re.compile(r"[\s\\]*").match(code, colon.end()).end()
        if body >= len(code):
            continue
        width = len(m["indent"].expandtabs())
        rest = re.compile(rf"^[ \t]{{0,{len(m['indent'])}}}\S", re.M)
        after = code.find("\n", colon.end())
        stop = next((x.start() for x in rest.finditer(code, after + 1) if len(re.match(r"[ \t]*", x[0])[0].expandtabs()) <= width), len(code)) if after >= 0 else len(code)
        inline = "\n" not in code[colon.end() : body]
        if not inline and body >= stop:
            continue
        doc = None
        for prefix in range(3):  # the string may have a prefix, whose letters remain in the code
            if body + prefix in strings or body in strings:
                raw = source.text[body : strings.get(body, strings.get(body + prefix))]
                doc = re.sub(r"^[rRuUbBfF]{0,2}(?:\"\"\"|'''|\"|')|(?:\"\"\"|'''|\"|')$", "", raw)
                break
        start = m.start()
        while d := re.search(r"(?:^|\n)([ \t]*@[^\n]*)\n[ \t]*$", code[: source.line_start(start)] + "") if source.line_start(start) else None:
            start = d.start(1)
        found.append(FunctionNode(m["name"], start, m.start(), body, stop, doc))
    return found


_SHELL_DEF = re.compile(r"^[ \t]*(?:function[ \t]+(?P<a>[\w:.-]+)[ \t]*(?:\(\))?|(?P<b>[\w:.-]+)[ \t]*\(\))\s*(?=[{(])", re.M)


def shell_functions(source: Source) -> list[FunctionNode]:
    found = []
    for m in _SHELL_DEF.finditer(source.code):
        close = source.closes(m.end())
        found.append(FunctionNode(m["a"] or m["b"], m.start(), m.start(), m.end(), len(source.code) if close is None else close + 1))
    return found
