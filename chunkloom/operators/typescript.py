"""Cutting TypeScript along its syntax.

A source that is too large is cut in two where a statement, member or entry of some scope ends, as near to its middle as may be, and its halves
again. Scopes are tried from the outside in: a scope inside another is taken only if that one offers no place that leaves both halves
large enough. Where none does, the least bad place is taken; where there are no places at all, the middle line.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from chunkloom.functions.script_tree import Node, ScriptTree
from chunkloom.operators.chunking import TARGET_BYTES

# Kinds of nodes whose children may be parted, and kinds that are looked through for these.
SCOPES = frozenset(["program", "class_body", "object_type", "interface_body", "statement_block", "switch_body", "object", "jsx_element"])
CONDUITS = frozenset(
    [
        "export_statement", "class_declaration", "abstract_class_declaration", "interface_declaration", "type_alias_declaration", "enum_declaration", "function_declaration", "generator_function_declaration",
        "method_definition", "arrow_function", "function_expression", "if_statement", "try_statement", "catch_clause", "else_clause", "for_statement", "for_in_statement", "while_statement", "do_statement",
        "switch_statement", "switch_case", "return_statement", "throw_statement", "expression_statement", "lexical_declaration", "variable_declarator", "await_expression", "new_expression",
        "arguments", "call_expression", "member_expression", "as_expression", "pair", "jsx_expression",
    ]
)
_COMPLEX = frozenset(["arrow_function", "function_expression", "function_declaration", "object", "array", "jsx_element", "jsx_self_closing_element"])
_ALWAYS = frozenset(
    ["function_declaration", "class_declaration", "interface_declaration", "type_alias_declaration", "enum_declaration", "export_statement", "method_definition", "lexical_declaration", "variable_declaration", "switch_case", "jsx_element"]
)
#: least sizes in bytes from which other kinds count
_FROM = {"public_field_definition": 50, "property_signature": 100, "pair": 200, "expression_statement": 500, "if_statement": 400, "for_statement": 300, "for_in_statement": 300}
_TYPES = {
    "function_declaration": "function",
    "method_definition": "function",
    "class_declaration": "class",
    "interface_declaration": "interface",
    "type_alias_declaration": "type",
    "enum_declaration": "enum",
    "lexical_declaration": "variable",
    "variable_declaration": "variable",
    "public_field_definition": "field",
}
LEAST_SHARE = 0.2


class Cutter:
    """Cuts one source; lines count from 1 and ranges are inclusive."""

    def __init__(self, text: str, *, tsx: bool = False, limit: int = TARGET_BYTES, allow_fallback: bool = True):
        self.tree = ScriptTree(text, tsx)
        self.limit, self.least, self.allow_fallback = limit, int(limit * LEAST_SHARE), allow_fallback
        self.lines = text.split("\n")
        if self.lines[-1] == "":
            self.lines.pop()
        self.lines = [line.removesuffix("\r") for line in self.lines]
        self._sums = [0]
        for line in self.lines:
            self._sums.append(self._sums[-1] + len(line.encode("utf-8", "surrogatepass")) + 1)
        self._ascii = text.isascii()
        self._places: dict[int, list[tuple[int, int]]] = {}
        #: what was tried, for people: ``(first line, last line, kind of scope, its lines, places found)``
        self.trace: list[tuple[int, int, str, tuple[int, int], list[int]]] = []

    def size(self, first: int, last: int) -> int:
        return max(0, self._sums[last] - self._sums[first - 1] - 1)

    def text(self, first: int, last: int) -> str:
        return "\n".join(self.lines[first - 1 : last])

    # --- what counts

    def _bytes(self, node: Node, start: int | None = None) -> int:
        part = self.tree.source.text[node.start if start is None else start : node.end]
        return len(part) if self._ascii else len(part.encode("utf-8", "surrogatepass"))

    def _with_comments(self, node: Node) -> int:
        """Bytes of a node with the comments attached to it: those before it without a blank line between."""
        source, start = self.tree.source, node.start
        for c in reversed(source.comments):
            if c.end > start:
                continue
            between = source.text[c.end : start]
            if between.strip() or "\n\n" in between or "\r\n\r\n" in between:
                break
            start = c.start
        return self._bytes(node, start)

    @staticmethod
    def _complex(node: Node) -> bool:
        return any(c.kind in _COMPLEX or Cutter._complex(c) for c in node.children)

    def counts(self, node: Node) -> bool:
        """Whether a source may be cut after this node."""
        if node.kind in _ALWAYS:
            return True
        least = _FROM.get(node.kind)
        if least is None:
            return False
        if node.kind in ("pair", "property_signature"):
            if self._with_comments(node) > least:
                return True
            direct = any(c.kind in _COMPLEX or (c.kind in ("parenthesized_expression", "as_expression") and self._complex(c)) for c in node.children)
            return node.kind == "pair" and direct
        return self._bytes(node) > least or (node.kind == "expression_statement" and self._complex(node))

    def places(self, scope: Node, first: int, last: int) -> list[int]:
        """Lines of the range after which the scope may be cut: the ends of all its parts in the range but the last."""
        if id(scope) not in self._places:
            self._places[id(scope)] = [self.tree.lines(c) for c in scope.children if self.counts(c)]
        ends = [e for s, e in self._places[id(scope)] if e >= first and s <= last]
        return [e for e in ends[:-1] if first <= e < last]

    # --- where to cut

    def _halves(self, line: int, first: int, last: int) -> tuple[int, int]:
        """Estimated bytes of both halves of a range that is cut after a line."""
        whole = self.size(first, last)
        upper = whole * (line - first + 1) // (last - first + 1)
        return upper, whole - upper

    def _inside(self, node: Node, first: int, last: int) -> Node | None:
        """The first scope, outside in, at or below a node that offers a place with two halves of at least the least size."""
        if node.kind in SCOPES and any(min(self._halves(p, first, last)) >= self.least for p in self.places(node, first, last)):
            return node
        for child in self._passable(node, first, last):
            if found := self._inside(child, first, last):
                return found
        return None

    def _passable(self, node: Node, first: int, last: int) -> Iterator[Node]:
        for child in node.children:
            start, end = self.tree.lines(child)
            if end >= first and start <= last and (child.kind in SCOPES or child.kind in CONDUITS):
                yield child

    def _scopes(self, first: int, last: int) -> Iterator[Node]:
        """The source as a whole, then scopes inside it, each within the child that shares most of the range with it."""
        scope: Node | None = self.tree.root
        while scope is not None:
            yield scope

            def shared(child: Node) -> int:
                start, end = self.tree.lines(child)
                return min(end, last) - max(start, first) + (1000 if child.kind in SCOPES else 0)

            children = list(self._passable(scope, first, last))
            scope = self._inside(max(children, key=shared), first, last) if children else None

    def place(self, first: int, last: int) -> tuple[int, str] | None:
        """The line to cut a range after, and how good a place that is: ``content``, ``degraded-ast-split`` or ``fallback-split``."""
        half = self.size(first, last) // 2
        poor: list[int] = []
        for scope in self._scopes(first, last):
            found = self.places(scope, first, last)
            self.trace.append((first, last, scope.kind, self.tree.lines(scope), found))
            usable = [p for p in found if min(self._halves(p, first, last)) >= self.least]
            if usable:
                return min(usable, key=lambda p: abs(self._halves(p, first, last)[0] - half)), "content"
            poor += found
        if poor:

            def badness(line: int) -> int:
                halves = self._halves(line, first, last)
                return abs(halves[0] - half) + (10_000 if min(halves) < 500 else 5_000 if min(halves) < 1000 else 0)

            line = min(poor, key=badness)
            return line, "degraded-ast-split" if min(self._halves(line, first, last)) < self.least else "content"
        middle = first + (last - first) // 2
        return (middle, "fallback-split") if self.allow_fallback and first < middle < last else None

    def ranges(self) -> list[tuple[int, int, str]]:
        """``(first line, last line, kind)``, in order; a range's kind is that of the cut that made it."""
        out: list[tuple[int, int, str]] = []
        waiting = [(1, len(self.lines), "content")] if self.lines else []
        while waiting:
            first, last, kind = waiting.pop()
            found = self.place(first, last) if self.size(first, last) > self.limit else None
            if found is None:
                out.append((first, last, kind))
            else:
                line, how = found
                waiting += [(line + 1, last, how), (first, line, how)]
        return out

    # --- what a range is about

    def about(self, first: int, last: int) -> tuple[str, str | None]:
        """Type and name of the smallest node that counts and spans a range."""
        best: tuple[int, Node] | None = None
        waiting = [self.tree.root]
        while waiting:
            node = waiting.pop()
            start, end = self.tree.lines(node)
            if node is not self.tree.root and (start > first or end < last):
                continue
            if node is not self.tree.root and self.counts(node) and (best is None or end - start < best[0]):
                best = end - start, node
            waiting += reversed(node.children)
        if best is None:
            return "code", None
        node = best[1]
        shown = node.children[0] if node.kind == "export_statement" and node.children else node
        return _TYPES.get(shown.kind, "code"), shown.name if shown.kind not in ("operation", "identifier") else None

    def imports_end(self) -> int:
        """The last line of the leading imports; 0 without any."""
        end = 0
        for node in self.tree.root.children:
            if node.kind == "import_statement":
                end = self.tree.lines(node)[1]
            elif end:
                break
        return end


def cut_script(text: str, path: str = "", *, limit: int = TARGET_BYTES, allow_fallback: bool = True) -> list[tuple[str, int, int, str, str, str | None]]:
    """``(text, first line, last line, type, kind, name)`` of the chunks of a TypeScript source; blank ones are left out."""
    cutter = Cutter(text, tsx=path.endswith(".tsx"), limit=limit, allow_fallback=allow_fallback)
    imports = cutter.imports_end()
    out = []
    for first, last, kind in cutter.ranges():
        part = cutter.text(first, last)
        if part.strip():
            what, name = cutter.about(first, last)
            out.append((part, first, last, what, "imports" if kind == "content" and imports and last <= imports else kind, name))
    return out


def typescript_chunks(files: DataFrame, text: str = "text", path: str = "relative_path", *, limit: int = TARGET_BYTES, allow_fallback: bool = True) -> DataFrame:
    """``files`` without its text and with ``chunk_text, start_line, end_line, chunk_type, chunk_kind, symbol_name``.

    Null and blank texts have no chunks. A ``.tsx`` path turns markup on. Without ``allow_fallback`` a source that its syntax offers no
    place to cut stays in one piece.
    """
    rest = [c for c in files.columns if c != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cuts = [cut_script(t, p or "", limit=limit, allow_fallback=allow_fallback) for t, p in zip(batch[text], batch[path])]
            at = [i for i, c in enumerate(cuts) for _ in c]
            made = pd.DataFrame([x for c in cuts for x in c], columns=["chunk_text", "start_line", "end_line", "chunk_type", "chunk_kind", "symbol_name"])
            yield pd.concat([batch[rest].iloc[at].reset_index(drop=True), made], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name != text)
    schema = f"{kinds}, chunk_text string, start_line int, end_line int, chunk_type string, chunk_kind string, symbol_name string"
    return files.where(files[text].isNotNull()).mapInPandas(run, schema)
