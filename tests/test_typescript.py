import random

import pytest

from chunkloom.functions.script_tree import ScriptTree
from chunkloom.operators.typescript import Cutter, cut_script, typescript_chunks


def kinds(text, **how):
    return [(n.kind, n.name) for n in ScriptTree(text, **how).root.children]


def test_statements():
    text = """import { a } from 'a';
import b, * as c from "b";
export default class D<T extends { x: number }> extends E<T> implements F { m() {} }
export const f = async <T>(x: T): Promise<{ a: T }> => { return x; };
export interface G { a: string; b?(): void }
type H = { a: string } | undefined;
enum I { A = 1, B }
declare function j(a: number): void;
export function* k(): Iterable<string> {}
abstract class L { abstract m(): void; }
const n = 1, o = { p: () => {} }
if (a) b(); else { c(); }
for (const x of y) { z(); }
switch (a) { case 1: b(); break; default: c(); }
try { a(); } catch (e) { b(); } finally { c(); }
a.b(() => { c(); }).d();
export { a, b };
export * from 'c';
label: while (a) { break label; }
do { a(); } while (b);
throw new Error(`x ${a ? `y ${b}` : ''}`);
namespace N { const q = 1; }
"""
    assert [k for k, _ in kinds(text)] == [
        "import_statement", "import_statement", "export_statement", "export_statement", "export_statement", "type_alias_declaration", "enum_declaration", "function_signature", "export_statement",
        "abstract_class_declaration", "lexical_declaration", "if_statement", "for_in_statement", "switch_statement", "try_statement", "expression_statement", "export_statement", "export_statement",
        "labeled_statement", "do_statement", "throw_statement", "expression_statement",
    ]


def test_members_and_names():
    text = "class A {\n  @dec() private readonly a: Map<string, () => void> = new Map();\n  static b = (x) => { x(); };\n  constructor(private c: string) { super(); }\n  get d(): number { return 1; }\n  async *e<T>(x: T) {}\n  [f]() {}\n  g?: string\n  h(): void;\n}"
    body = ScriptTree(text).root.children[0].children[0]
    assert [(n.kind.split("_")[0], n.name) for n in body.children] == [
        ("public", "a"), ("public", "b"), ("method", "constructor"), ("method", "d"), ("method", "e"), ("method", None), ("public", "g"), ("method", "h"),
    ]


def test_markup():
    tree = ScriptTree("const a = (\n  <div className={x}>\n    <b>text</b>\n    {y.map((z) => <i key={z} />)}\n  </div>\n);", tsx=True)
    found = [n.kind for n in tree.root.walk()]
    assert found.count("jsx_element") == 2 and "jsx_self_closing_element" in found and "arrow_function" in found


def check(text, **how):
    chunks = cut_script(text, **how)
    lines = text.split("\n")
    covered = [i for _, a, b, *_ in chunks for i in range(a, b + 1)]
    assert covered == sorted(set(covered))
    assert all(lines[i - 1].strip() == "" for i in set(range(1, len(lines) + 1)) - set(covered))
    assert all(part == "\n".join(lines[a - 1 : b]) for part, a, b, *_ in chunks)
    return chunks


def test_small_sources_stay_whole():
    assert [c[1:] for c in check("export function f() {\n  return 1;\n}\n")] == [(1, 3, "function", "content", "f")]
    assert [c[1:] for c in check("import a from 'a';\nimport b from 'b';\n")] == [(1, 2, "code", "imports", None)]
    assert check("") == [] and check("\n \n") == []


def test_cuts_lie_between_members():
    r = random.Random(1)
    methods = "\n".join(f"  public m{i}(a: number): void {{\n" + "".join(f"    call{j}(a, {r.randint(0, 99)});\n" for j in range(12)) + "  }\n" for i in range(30))
    chunks = check("export class Big {\n" + methods + "}\n", limit=2000)
    assert all(len(part) <= 2000 for part, *_ in chunks)
    assert all(part.rstrip().endswith("}") for part, *_ in chunks)
    assert all(kind == "content" for *_, kind, _ in chunks) and chunks[1][3:] == ("class", "content", "Big")


def test_without_syntax():
    text = "const s = `" + "line of text\n" * 1000 + "`;\n"
    assert {c[4] for c in check(text)} == {"fallback-split"}
    assert len(check(text, allow_fallback=False)) == 1


@pytest.mark.parametrize("text", ["{" * 3000, "(" * 3000, "a<" * 3000, "`${" * 300, "<div>" * 2000, "x=>" * 2000, "a.b(" * 1500, "/*", "'", "export default " * 300, "class " * 300, "\0\r\n ", "if(" * 500, "}" * 500])
def test_anything_is_cut(text):
    for source in (text, text.replace("x", "\n") * 3):
        check(source.replace("\r", ""), path="x.tsx", limit=500)


def test_estimates_use_integer_shares_of_lines():
    cutter = Cutter("\n".join("x" * 9 for _ in range(10)), limit=50)
    assert cutter.size(1, 10) == 99 and cutter._halves(3, 1, 10) == (29, 70)


def test_rows(spark):
    rows = [("a.ts", "export const a = 1;\n", 1), ("b.tsx", None, 2), (None, "let b = 2;", 3), ("c.ts", "", 4)]
    got = typescript_chunks(spark.createDataFrame(rows, "relative_path string, text string, start int")).collect()
    assert sorted((r.start, r.chunk_text, r.start_line, r.end_line, r.chunk_type) for r in got) == [(1, "export const a = 1;", 1, 1, "variable"), (3, "let b = 2;", 1, 1, "variable")]
