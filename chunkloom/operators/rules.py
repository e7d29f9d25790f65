"""Which files of a repository are taken up, and how each is cut into chunks."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

STRATEGIES = ("typescript", "markdown", "lineBased")

# The rules that hold where a repository brings none of its own.
DEFAULT_FILE_TYPES = {
    ".ts": "typescript",
    ".tsx": "typescript",
    ".md": "markdown",
    ".yml": "lineBased",
    ".yaml": "lineBased",
    ".txt": "lineBased",
    ".css": "lineBased",
    ".scss": "lineBased",
}
DEFAULT_EXCLUDE = (
    "node_modules/",
    "dist/",
    "build/",
    "lib/",
    "lib-commonjs/",
    "lib-esm/",
    "lib-esnext/",
    "lib-amd/",
    "lib-dts/",
    "temp/",
    ".cache/",
    ".rush/temp/",
    "common/temp/",
    "common/deploy/",
    ".docusaurus/",
    "**/*.snap",
    "**/*.test.ts",
    "**/*.spec.ts",
    "**/*.test.tsx",
    "**/*.spec.tsx",
    "**/*.js",
    "**/*.jsx",
    "**/*.cjs",
    "**/*.mjs",
    "**/*.json",
    "**/package-lock.json",
    "**/pnpm-lock.yaml",
    "**/yarn.lock",
    "**/*.lock",
    "**/*.tsbuildinfo",
)
DEFAULT_KEEP = ("src/", "test/")


class RuleError(ValueError):
    """A rule file that doesn't hold together."""


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression for whole paths.

    ``*`` and ``?`` also match ``/``; a leading ``**/`` also matches no folder at all, as does ``/**/`` in between; ``[...]`` and
    ``{a,b}`` are understood.
    """
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            close = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] in ("!", "^")))
            if close < 0:
                raise RuleError(f"unclosed character class in {pattern!r}")
            inner = pattern[i + 1 : close]
            negated = inner[:1] in ("!", "^")
            out.append(f"[{'^' if negated else ''}{re.sub(r'([&~|\[\]\\\\^])', r'\\\1', inner[negated:])}]")
            i = close
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise RuleError(f"unclosed braces in {pattern!r}")
    return f"^(?:{''.join(out)})$"


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


@dataclass(frozen=True)
class CrawlRules:
    """Suffixes with their strategies, patterns to exclude, and patterns to keep in spite of these.

    A pattern that ends in ``/`` names a folder anywhere in the path; any other is a glob for the whole path.
    """

    file_types: dict[str, str] = field(default_factory=lambda: dict(DEFAULT_FILE_TYPES))
    exclude: tuple[str, ...] = DEFAULT_EXCLUDE
    keep: tuple[str, ...] = DEFAULT_KEEP

    def __post_init__(self) -> None:
        for suffix, strategy in self.file_types.items():
            if strategy not in STRATEGIES:
                raise RuleError(f"unknown strategy {strategy!r} for {suffix!r}")
            if not suffix.startswith("."):
                raise RuleError(f"a suffix must start with '.': {suffix!r}")
        for pattern in (*self.exclude, *self.keep):
            glob_regex(pattern)

    @classmethod
    def from_json(cls, text: str) -> CrawlRules:
        """Strict: version 1, all four fields and no others."""
        data = json.loads(text)
        fields = {"version", "fileTypes", "patternsToExclude", "patternsToKeep"}
        if not isinstance(data, dict) or set(data) != fields:
            raise RuleError(f"expected exactly the fields {sorted(fields)}")
        if data["version"] != 1 or isinstance(data["version"], bool):
            raise RuleError(f"unsupported version {data['version']!r}")
        return cls(dict(data["fileTypes"]), tuple(data["patternsToExclude"]), tuple(data["patternsToKeep"]))

    @staticmethod
    def _matches(path: Column, patterns: tuple[str, ...]) -> Column:
        folders = [p for p in patterns if p.endswith("/")]
        globs = [glob_regex(p) for p in patterns if not p.endswith("/")]
        conditions = [path.rlike("(?:^|/)(?:" + "|".join(map(re.escape, folders)) + ")")] if folders else []
        if globs:
            conditions.append(path.rlike("|".join(globs)))
        return _any(conditions)

    def should_crawl(self, path: Column) -> Column:
        typed = _any([path.endswith(s) for s in self.file_types])
        return typed & (self._matches(path, self.keep) | ~self._matches(path, self.exclude))

    def strategy(self, path: Column) -> Column:
        """The strategy of the longest suffix that fits; null if none does."""
        found = F.when(F.lit(False), F.lit(""))
        for suffix in sorted(self.file_types, key=lambda s: (-len(s), s)):
            found = found.when(path.endswith(suffix), self.file_types[suffix])
        return found
