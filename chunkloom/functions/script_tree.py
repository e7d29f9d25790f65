"""A syntax tree of TypeScript and TSX, fine enough to cut sources along it.

Statements, declarations, members and the expressions that can hold statements become nodes; operators and types don't. The parser
never fails: what it doesn't understand becomes an expression statement up to the next place where a statement may end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from chunkloom.functions.syntax import Source, _after_parameters, _block, _skip_type, _skip_type_arguments, script_source

_SPACE = re.compile(r"\s*")
_IDENT = re.compile(r"[A-Za-z_$#][\w$]*")
_MODIFIERS = re.compile(r"(?:(?:public|private|protected|static|abstract|override|readonly|async|accessor|declare)\s+(?![(:=;?!<,}]))*")
_DECLARED = re.compile(r"(?:(?:declare|abstract|async|const(?=\s+enum\b))\s+)*(function|class|interface|type|enum|namespace|module|const|let|var|global)\b")
_GOES_ON = re.compile(r"\s*(?:[.?:&|+\-*/%<>=,)\]}([]|(?:instanceof|in|as|satisfies|extends|implements)\b)")
_UNFINISHED = re.compile(r"(?:[.?:&|+\-*/%<=,([{~!]|=>|\b(?:return|typeof|new|await|in|of|instanceof|as|extends|implements|case|throw|else|void|delete))\s*$")
_OPERATOR = re.compile(r"\.\.\.|=>|\?\?=?|\?\.|[-+*/%&|^~!?:=<>,]+|\b(?:typeof|void|delete|instanceof|in|of|keyof|is|yield)\b")


@dataclass
class Node:
    kind: str
    start: int
    end: int
    children: list[Node] = field(default_factory=list)
    name: str | None = None

    def walk(self) -> Iterator[Node]:
        yield self
        for child in self.children:
            yield from child.walk()


class ScriptTree:
    """The tree of a source; ``root`` is a ``program``."""

    def __init__(self, text: str, tsx: bool = False):
        self.tsx = tsx
        self.source: Source = script_source(text)
        self.code = self.source.code
        try:
            statements = self._statements(0, len(text))
        except RecursionError:  # nested beyond reason: such a source has no syntax worth cutting along
            statements = []
        self.root = Node("program", 0, len(text), statements)

    def lines(self, node: Node) -> tuple[int, int]:
        return self.source.line(node.start), self.source.line(max(node.start, node.end - 1))

    # --- small steps

    def _skip(self, at: int, end: int) -> int:
        return min(_SPACE.match(self.code, at).end(), end)

    def _close(self, at: int, end: int) -> int:
        """Past the bracket that closes the one at ``at``."""
        close = self.source.closes(at)
        return end if close is None or close >= end else close + 1

    def _find(self, at: int, end: int, stops: str) -> int:
        """The first of ``stops`` outside brackets; ``end`` if there is none."""
        while at < end:
            c = self.code[at]
            if c in stops:
                return at
            at = self._close(at, end) if c in "([{" else at + 1
        return end

    def _statement_end(self, at: int, end: int) -> int:
        """Where a statement without a body ends: past its semicolon, or at a line end where nothing goes on."""
        start = at
        while at < end:
            c = self.code[at]
            if c == ";":
                return at + 1
            if c in "([{":
                at = self._close(at, end)
                continue
            if c == "}":
                return at
            if c == "\n" and not _GOES_ON.match(self.code, at) and not _UNFINISHED.search(self.code[max(start, at - 60) : at].rstrip()):
                return at
            at += 1
        return end

    def _trim(self, start: int, end: int) -> int:
        return start + len(self.code[start:end].rstrip())

    # --- statements

    def _statements(self, at: int, end: int) -> list[Node]:
        out: list[Node] = []
        while (at := self._skip(at, end)) < end:
            if self.code[at] in ";)]}":
                at += 1
                continue
            node = self._statement(at, end)
            out.append(node)
            at = max(node.end, at + 1)
        return out

    def _body(self, at: int, end: int) -> Node:
        """A block, or the statement in place of one."""
        return self._statement(self._skip(at, end), end)

    def _braces(self, kind: str, at: int, end: int, inside) -> Node:
        close = self._close(at, end)
        return Node(kind, at, close, inside(at + 1, close - 1 if self.source.closes(at) is not None else close))

    def _statement(self, at: int, end: int) -> Node:
        code, start = self.code, at
        if at >= end:
            return Node("empty_statement", at, at)
        if code[at] == "{":
            return self._braces("statement_block", at, end, self._statements)
        while code[at : at + 1] == "@":  # decorators
            at = self._skip(_IDENT.match(code, at + 1).end() if _IDENT.match(code, at + 1) else at + 1, end)
            while code[at : at + 1] == ".":
                m = _IDENT.match(code, at + 1)
                at = self._skip(m.end() if m else at + 1, end)
            if code[at : at + 1] == "(":
                at = self._skip(self._close(at, end), end)
        m = _IDENT.match(code, at)
        word = m[0] if m else ""
        after = self._skip(m.end(), end) if m else at
        if word == "import" and code[after : after + 1] not in ("(", "."):
            return Node("import_statement", start, self._statement_end(at, end))
        if word == "export":
            return self._export(start, after, end)
        if declared := _DECLARED.match(code, at):
            if node := self._declaration(start, declared, end):
                return node
        if word in ("if", "for", "while", "switch", "do", "try", "return", "throw") and code[after : after + 1] not in (":", "=", "."):
            return getattr(self, "_" + word)(start, after, end)
        stop = self._statement_end(at, end)
        if m and code[after : after + 1] == ":" and word not in ("default", "case"):
            body = self._body(after + 1, end)
            return Node("labeled_statement", start, body.end, [body])
        return Node("expression_statement", start, stop, self._expressions(at, self._without_semicolon(at, stop)))

    def _without_semicolon(self, at: int, end: int) -> int:
        return end - 1 if end > at and self.code[end - 1] == ";" else end

    def _export(self, start: int, at: int, end: int) -> Node:
        if m := re.compile(r"default\b\s*").match(self.code, at):
            at = m.end()
        first = self.code[at : at + 1]
        if first == "@" or _DECLARED.match(self.code, at):
            child = self._statement(at, end)
            if child.kind != "expression_statement":
                return Node("export_statement", start, child.end, [child], child.name)
        stop = self._statement_end(at, end)
        inner = [] if first in "{*=" and not m else self._expressions(at, self._without_semicolon(at, stop))
        return Node("export_statement", start, stop, inner)

    def _declaration(self, start: int, m: re.Match, end: int) -> Node | None:
        code, word, at = self.code, m[1], self._skip(m.end(), end)
        if word in ("const", "let", "var"):
            return self._variables("variable_declaration" if word == "var" else "lexical_declaration", start, at, end)
        generator = word == "function" and code[at : at + 1] == "*"
        if generator:
            at = self._skip(at + 1, end)
        named = _IDENT.match(code, at)
        name = named[0] if named else None
        at = self._skip(named.end(), end) if named else at
        if word == "function":
            after = _after_parameters(self.source, at)
            body = None if after < 0 else _block(self.source, after)
            if body is None:
                return Node("function_signature", start, self._statement_end(at, end), [], name)
            kind = "generator_function_declaration" if generator else "function_declaration"
            return Node(kind, start, min(body[1], end), [self._braces("statement_block", body[0], end, self._statements)], name)
        if word in ("namespace", "module", "global"):
            brace = self._find(at, end, "{;\n")
            if brace < end and code[brace] == "{":
                block = self._braces("statement_block", brace, end, self._statements)
                return Node("expression_statement", start, block.end, [Node("internal_module", start, block.end, [block], name)])
            return None
        if not named:
            return None
        if word == "type":
            if code[at : at + 1] not in ("=", "<"):
                return None
            stop = self._statement_end(at, end)
            return Node("type_alias_declaration", start, stop, self._types(at, stop), name)
        brace = self._heritage_end(at, end)
        if brace >= end:
            return Node("expression_statement", start, self._statement_end(at, end))
        if word == "class":
            body = self._braces("class_body", brace, end, self._members)
            kind = "abstract_class_declaration" if re.search(r"\babstract\b", code[m.start() : m.end()]) else "class_declaration"
            return Node(kind, start, body.end, [body], name)
        if word == "interface":
            body = self._braces("interface_body", brace, end, self._signatures)
            return Node("interface_declaration", start, body.end, [body], name)
        return Node("enum_declaration", start, self._close(brace, end), [], name)

    def _heritage_end(self, at: int, end: int) -> int:
        """The brace that opens a body, past type parameters and what is extended."""
        while at < end and self.code[at] != "{":
            if self.code[at] == "<":
                past = _skip_type_arguments(self.code, at)
                at = past if past > at else at + 1
            elif self.code[at] in "([":
                at = self._close(at, end)
            elif self.code[at] == ";":
                return end
            else:
                at += 1
        return at

    def _variables(self, kind: str, start: int, at: int, end: int) -> Node:
        stop = self._statement_end(at, end)
        last = self._without_semicolon(at, stop)
        equals = at
        m = _IDENT.match(self.code, at)
        past = m.end() if m else self._close(at, last) if self.code[at : at + 1] in ("{", "[") else at
        past = self._skip(past, last)
        if self.code[past : past + 1] == "!":
            past = self._skip(past + 1, last)
        if self.code[past : past + 1] == ":":
            typed = _skip_type(self.source, past + 1, "=")
            past = typed if typed >= 0 else last
        equals = past if past < last and self.code[past] == "=" else last
        values = self._expressions(equals + 1, last) if equals < last else []
        return Node(kind, start, stop, [Node("variable_declarator", at, self._trim(at, last), values)])

    def _if(self, start: int, at: int, end: int) -> Node:
        body = self._body(self._close(at, end) if self.code[at] == "(" else at, end)
        children, stop = [body], body.end
        if m := re.compile(r"[\s;]*else\b").match(self.code, stop, end):
            other = self._body(m.end(), end)
            children.append(Node("else_clause", m.end() - 4, other.end, [other]))
            stop = other.end
        return Node("if_statement", start, stop, children)

    def _for(self, start: int, at: int, end: int) -> Node:
        if m := re.compile(r"await\s*").match(self.code, at):
            at = m.end()
        close = self._close(at, end)
        body = self._body(close, end)
        kind = "for_in_statement" if re.search(r"\b(?:of|in)\b", self.code[at:close]) and ";" not in self.code[at:close] else "for_statement"
        return Node(kind, start, body.end, [body])

    def _while(self, start: int, at: int, end: int) -> Node:
        body = self._body(self._close(at, end) if self.code[at : at + 1] == "(" else at, end)
        return Node("while_statement", start, body.end, [body])

    def _do(self, start: int, at: int, end: int) -> Node:
        body = self._body(at, end)
        return Node("do_statement", start, self._statement_end(body.end, end), [body])

    def _switch(self, start: int, at: int, end: int) -> Node:
        brace = self._find(self._close(at, end), end, "{")
        body = self._braces("switch_body", brace, end, self._cases) if brace < end else Node("switch_body", end, end)
        return Node("switch_statement", start, body.end, [body])

    def _cases(self, at: int, end: int) -> list[Node]:
        heads = []
        label = re.compile(r"(?:case\b|default\s*:)")
        i = at
        while i < end:
            if (m := label.match(self.code, i)) and not re.match(r"[\w$.]", self.code[i - 1]):
                heads.append((i, m[0].startswith("case")))
                i = m.end()
            else:
                i = self._close(i, end) if self.code[i] in "([{" else i + 1
        out = []
        for n, (i, case) in enumerate(heads):
            stop = heads[n + 1][0] if n + 1 < len(heads) else end
            colon = self._find(i + 4, stop, ":") if case else self._find(i, stop, ":")
            stop = self._trim(i, stop)
            out.append(Node("switch_case" if case else "switch_default", i, stop, self._statements(colon + 1, stop)))
        return out

    def _try(self, start: int, at: int, end: int) -> Node:
        block = self._body(at, end)
        children, stop = [block], block.end
        if m := re.compile(r"\s*catch\b\s*").match(self.code, stop, end):
            after = self._close(m.end(), end) if self.code[m.end() : m.end() + 1] == "(" else m.end()
            inner = self._body(after, end)
            children.append(Node("catch_clause", m.start() + len(m[0]) - len(m[0].lstrip()), inner.end, [inner]))
            stop = inner.end
        if m := re.compile(r"\s*finally\b").match(self.code, stop, end):
            inner = self._body(m.end(), end)
            children.append(Node("finally_clause", m.end() - 7, inner.end, [inner]))
            stop = inner.end
        return Node("try_statement", start, stop, children)

    def _return(self, start: int, at: int, end: int) -> Node:
        stop = self._statement_end(at, end) if "\n" not in self.code[start:at] else start + 6
        return Node("return_statement", start, max(stop, start + 6), self._expressions(at, self._without_semicolon(at, stop)) if stop > at else [])

    def _throw(self, start: int, at: int, end: int) -> Node:
        stop = self._statement_end(at, end)
        return Node("throw_statement", start, stop, self._expressions(at, self._without_semicolon(at, stop)))

    # --- members

    def _members(self, at: int, end: int) -> list[Node]:
        out: list[Node] = []
        while (at := self._skip(at, end)) < end:
            if self.code[at] in ";,)]}":
                at += 1
                continue
            node = self._member(at, end)
            out.append(node)
            at = max(node.end, at + 1)
        return out

    def _member(self, start: int, end: int) -> Node:
        code, at = self.code, start
        while code[at : at + 1] == "@":
            at = self._skip(re.compile(r"@[\w$.]*").match(code, at).end(), end)
            if code[at : at + 1] == "(":
                at = self._skip(self._close(at, end), end)
        start = at  # decorators are siblings of what they decorate
        at = _MODIFIERS.match(code, at).end()
        if m := re.compile(r"(?:get|set)\s+(?=[\w$#\[\"])|\*\s*").match(code, at):
            at = m.end()
        if code[at : at + 1] == "{":  # a static block
            return self._braces("statement_block", at, end, self._statements)
        m = _IDENT.match(code, at)
        name = m[0] if m else None
        if m:
            after = m.end()
        elif code[at : at + 1] == "[":
            after = self._close(at, end)
        elif code[at : at + 1] == '"':
            after = code.find('"', at + 1, end) + 1 or end
        else:
            after = at + 1
        after = self._skip(after, end)
        if code[after : after + 1] in ("?", "!"):
            after = self._skip(after + 1, end)
        if code[after : after + 1] in ("(", "<"):
            past = _after_parameters(self.source, after)
            body = None if past < 0 else _block(self.source, past)
            if body is not None and body[0] < end:
                return Node("method_definition", start, min(body[1], end), [self._braces("statement_block", body[0], end, self._statements)], name)
            return Node("method_signature", start, self._without_semicolon(start, self._statement_end(after, end)), [], name)
        stop = self._without_semicolon(start, self._statement_end(after, end))
        equals = after
        if code[after : after + 1] == ":":
            typed = _skip_type(self.source, after + 1, "=")
            equals = typed if 0 <= typed < stop else stop
        values = self._expressions(equals + 1, stop) if equals < stop and code[equals] == "=" else []
        return Node("public_field_definition", start, stop, values, name)

    def _signatures(self, at: int, end: int) -> list[Node]:
        out: list[Node] = []
        while (at := self._skip(at, end)) < end:
            if self.code[at] in ";,)]}":
                at += 1
                continue
            m = re.compile(r"(?:readonly\s+|get\s+|set\s+)*").match(self.code, at)
            named = _IDENT.match(self.code, m.end())
            stop = min(self._find(at, end, ";,"), self._statement_end(at, end))
            stop = stop if stop > at else at + 1
            after = self._skip(named.end(), end) if named else at
            if self.code[after : after + 1] == "?":
                after = self._skip(after + 1, end)
            kind = "method_signature" if named and self.code[after : after + 1] in ("(", "<") else "property_signature" if named else "index_signature"
            stop = self._trim(at, self._without_semicolon(at, stop))
            out.append(Node(kind, at, stop, self._types(after, stop), named[0] if named else None))
            at = max(stop, at + 1)
        return out

    def _types(self, at: int, end: int) -> list[Node]:
        """The object types in a type."""
        out = []
        while at < end:
            c = self.code[at]
            if c == "{":
                out.append(self._braces("object_type", at, end, self._signatures))
                at = out[-1].end
            elif c in "([":
                at = self._close(at, end)
            else:
                at += 1
        return out

    # --- expressions

    def _expressions(self, at: int, end: int) -> list[Node]:
        """The expressions of a list that commas separate."""
        out: list[Node] = []
        while (at := self._skip(at, end)) < end:
            node, at = self._expression(at, end)
            if node is not None:
                out.append(node)
            at = self._skip(at, end)
            if at < end:
                at += 1  # the comma, or a sign that belongs to nothing
        return out

    def _expression(self, at: int, end: int) -> tuple[Node | None, int]:
        """One expression up to a comma; operands of operators are children of one ``operation``."""
        start, parts, operators = at, [], 0
        while (at := self._skip(at, end)) < end and self.code[at] not in ",;)]}":
            before = at
            node, at = self._operand(at, end)
            if node is not None:
                parts.append(node)
            else:
                m = _OPERATOR.match(self.code, at)
                if m and "," in m[0]:
                    at += m[0].index(",")
                    if at == before:
                        break
                else:
                    at = m.end() if m else at + 1
                operators += 1
        if not parts:
            return None, at
        if len(parts) == 1 and not operators:
            return parts[0], at
        return Node("operation", start, self._trim(start, at), parts), at

    def _operand(self, at: int, end: int) -> tuple[Node | None, int]:
        code, start = self.code, at
        c = code[at]
        m = _IDENT.match(code, at)
        if m and m[0] in ("await", "new"):
            inner_at = self._skip(m.end(), end)
            if m[0] == "await":
                node, stop = self._operand(inner_at, end) if inner_at < end else (None, inner_at)
                return Node("await_expression", start, stop, [node] if node else []), stop
            named = re.compile(r"[\w$.]*").match(code, inner_at)
            stop = self._skip(named.end(), end)
            if code[stop : stop + 1] == "<":
                past = _skip_type_arguments(code, stop)
                stop = self._skip(past, end) if past > 0 else stop
            children = []
            if code[stop : stop + 1] == "(":
                children.append(self._arguments(stop, end))
                stop = children[0].end
            return self._chain(Node("new_expression", start, stop, children), end)
        if m and m[0] in ("function", "class") or re.compile(r"async\s+function\b").match(code, at):
            return self._value_declaration(start, end)
        arrow = self._arrow(at, end)
        if arrow:
            return arrow, arrow.end
        if m:
            if m[0] in ("typeof", "void", "delete", "instanceof", "in", "of", "yield", "keyof", "is"):
                return None, at
            if m[0] in ("as", "satisfies"):
                return None, at
            return self._chain(Node("identifier", start, m.end()), end)
        if c == '"' or c == "`":
            close = code.find('"', at + 1, end)
            return self._chain(Node("string", start, close + 1 if close >= 0 else end), end)
        if c.isdigit():
            return self._chain(Node("number", start, re.compile(r"[\w.]+").match(code, at).end()), end)
        if c == "(":
            stop = self._close(at, end)
            return self._chain(Node("parenthesized_expression", start, stop, self._expressions(at + 1, stop - 1)), end)
        if c == "[":
            stop = self._close(at, end)
            return self._chain(Node("array", start, stop, self._expressions(at + 1, stop - 1)), end)
        if c == "{":
            return self._chain(self._braces("object", at, end, self._pairs), end)
        if c == "<" and self.tsx:
            node = self._jsx(at, end)
            if node:
                return node, node.end
        return None, at

    def _value_declaration(self, start: int, end: int) -> tuple[Node, int]:
        m = re.compile(r"(?:async\s+)?(function|class)\b\s*\*?\s*").match(self.code, start)
        named = None if re.compile(r"extends\b|implements\b").match(self.code, m.end()) else _IDENT.match(self.code, m.end())
        at = self._skip(named.end() if named else m.end(), end)
        if m[1] == "class":
            brace = self._heritage_end(at, end)
            body = self._braces("class_body", brace, end, self._members) if brace < end else Node("class_body", end, end)
            return self._chain(Node("class", start, body.end, [body]), end)
        after = _after_parameters(self.source, at)
        body = None if after < 0 else _block(self.source, after)
        if body is None:
            return Node("function_expression", start, at), max(at, start + 1)
        return self._chain(Node("function_expression", start, min(body[1], end), [self._braces("statement_block", body[0], end, self._statements)], named[0] if named else None), end)

    def _arrow(self, at: int, end: int) -> Node | None:
        code, start = self.code, at
        if m := re.compile(r"async\b\s*(?=[(<A-Za-z_$])").match(code, at):
            at = m.end()
        if m := re.compile(r"[A-Za-z_$][\w$]*\s*=>").match(code, at):
            arrow = m.end()
        elif code[at : at + 1] in ("(", "<"):
            past = _after_parameters(self.source, at)
            if past < 0 or past > end:
                return None
            i = self._skip(past, end)
            if code[i : i + 1] == ":":
                i = _skip_type(self.source, i + 1, "=>")
                if i < 0:
                    return None
            if not code.startswith("=>", i):
                return None
            arrow = i + 2
        else:
            return None
        i = self._skip(arrow, end)
        if code[i : i + 1] == "{":
            body = self._braces("statement_block", i, end, self._statements)
            return Node("arrow_function", start, body.end, [body])
        node, stop = self._expression(i, end) if i < end else (None, i)
        return Node("arrow_function", start, node.end if node else stop, [node] if node else [])

    def _arguments(self, at: int, end: int) -> Node:
        stop = self._close(at, end)
        return Node("arguments", at, stop, self._expressions(at + 1, stop - 1))

    def _chain(self, node: Node, end: int) -> tuple[Node, int]:
        """Calls, members and casts that follow an operand; each wraps what is before it."""
        code, start = self.code, node.start
        while True:
            at = self._skip(node.end, end)
            if at >= end:
                return node, node.end
            if m := re.compile(r"\??\.\s*(?=[A-Za-z_$#])").match(code, at):
                node = Node("member_expression", start, _IDENT.match(code, m.end()).end(), [node])
            elif code.startswith("?.(", at) or code[at] == "(" and "\n" not in code[node.end : at]:
                arguments = self._arguments(code.index("(", at), end)
                node = Node("call_expression", start, arguments.end, [node, arguments])
            elif code[at] == "[" and "\n" not in code[node.end : at] or code.startswith("?.[", at):
                stop = self._close(code.index("[", at), end)
                node = Node("subscript_expression", start, stop, [node])
            elif code[at] == "<" and (past := _skip_type_arguments(code, at)) > 0 and code[past : past + 1] == "(" and past < end:
                arguments = self._arguments(past, end)
                node = Node("call_expression", start, arguments.end, [node, arguments])
            elif code[at] == "!" and code[at + 1 : at + 2] not in ("=", ""):
                node = Node("non_null_expression", start, at + 1, [node])
            elif m := re.compile(r"(?:as|satisfies)\s+").match(code, at):
                stop = m.end()
                while stop < end and code[stop] not in ",;)]}\n=":
                    stop = self._close(stop, end) if code[stop] in "([{" else stop + 1
                node = Node("as_expression", start, self._trim(start, stop), [node])
            else:
                return node, node.end

    def _pairs(self, at: int, end: int) -> list[Node]:
        out: list[Node] = []
        while (at := self._skip(at, end)) < end:
            if self.code[at] == ",":
                at += 1
                continue
            m = re.compile(r"(?:\"[^\"]*\"|[\w$#]+)\s*:").match(self.code, at)
            if m or (self.code[at] == "[" and self.code[self._skip(self._close(at, end), end) : self._skip(self._close(at, end), end) + 1] == ":"):
                value_at = m.end() if m else self._skip(self._close(at, end), end) + 1
                node, stop = self._expression(value_at, end)
                key = _IDENT.match(self.code, at)
                out.append(Node("pair", at, node.end if node else self._trim(at, stop), [node] if node else [], key[0] if key else None))
                at = max(stop, out[-1].end, at + 1)
            elif re.compile(r"(?:async\s+|get\s+|set\s+|\*\s*)*(?:[\w$#]+|\"[^\"]*\")\s*[(<]").match(self.code, at):
                node = self._member(at, end)
                out.append(node)
                at = max(node.end, at + 1)
            else:
                node, stop = self._expression(at, end)
                if node is not None:
                    out.append(Node("shorthand", at, node.end, [node]))
                at = max(stop, at + 1)
        return out

    def _jsx(self, at: int, end: int) -> Node | None:
        code, start = self.code, at
        opened = re.compile(r"<(?:([A-Za-z_$][\w$.:-]*)|(?=>))").match(code, at)
        if not opened:
            return None
        i, children = opened.end(), []
        while i < end and code[i] != ">":  # attributes
            if code.startswith("/>", i):
                return Node("jsx_self_closing_element", start, i + 2, children)
            if code[i] == "{":
                children.append(self._braces("jsx_expression", i, end, self._expressions))
                i = children[-1].end
            elif code[i] == "<" or code[i] in ";":
                return None
            else:
                i += 1
        i += 1
        while i < end:
            if code.startswith("</", i):
                close = code.find(">", i, end)
                return Node("jsx_element", start, close + 1 if close >= 0 else end, children)
            if code[i] == "<":
                inner = self._jsx(i, end)
                if inner is None:
                    i += 1
                    continue
                children.append(inner)
                i = inner.end
            elif code[i] == "{":
                children.append(self._braces("jsx_expression", i, end, self._expressions))
                i = children[-1].end
            else:
                i += 1
        return None
