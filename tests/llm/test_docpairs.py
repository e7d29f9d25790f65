import pytest

from chunkloom.llm.docpairs import documented, function_pairs, real_words

DOC = "Reads every slot and hands the rest to the next one."


def names(text, suffix="ts"):
    return [p[0] for p in documented(text, suffix)]


@pytest.mark.parametrize(
    "text, expected",
    [
        (f"/** {DOC} */\nfunction f(a: number): void {{ return; }}", ["f"]),
        (f"// {DOC}\nexport default async function g() {{}}", ["g"]),
        (f"/// {DOC}\nexport const h = async (x: string[]): Promise<Map<string, A>> => {{ go(); }};", ["h"]),
        (f"/** {DOC} */\nconst k = x => x + 1;", ["k"]),
        (f"/** {DOC} */\nlet m: (a: number) => void = function (a) {{}};", ["m"]),
        (f"class A {{\n  /** {DOC} */\n  @dec({{ a: 1 }})\n  // eslint-disable-next-line\n  private static async *n<T>(a: T): T[] {{ }}\n}}", ["n"]),
        (f"  /** {DOC} */\n  get value(): number {{ return 1; }}\n\n  /** {DOC} */\n  handler = (e: Event) => {{}};", ["value", "handler"]),
        (f"/** {DOC} */\nfoo(a, b): {{ x: number }} {{ return a; }}", ["foo"]),
        (f"/** {DOC} */\nabstract run(): void;\n/** {DOC} */\nfunction over(a: string): void;", []),
        (f"interface I {{\n  /** {DOC} */\n  m(a: string): void;\n}}", []),
        (f"/** {DOC} */\nclass C {{ m() {{}} }}", []),
        (f"/** {DOC} */\n\nfunction apart() {{}}", []),
        (f"/** {DOC} */\n// ----------\nfunction divided() {{}}", []),
        ("/** @param a the first of all the numbers\n * @returns what is left of it */\nfunction tags(a) {}", []),
        ("/** Does read the slot. */\nfunction readTheSlot() {}", []),
        ("// Copyright of the people who wrote it. See LICENSE there.\nfunction licensed() {}", []),
        ("// const a = b.map((c) => c.d);\n// if (a.length > 3) return go(a);\nfunction dead() {}", []),
        (f"const s = `\n/** {DOC} */\nfunction inside() {{}}\n`;", []),
        (f"const s = '/** {DOC} */ function inside() {{}}';", []),
        (f"foo(); // {DOC}\nfunction trailing() {{}}", []),
        (f"/** {DOC} */\r\nfunction crlf() {{\r\n}}", ["crlf"]),
        (f"const r = /\\/\\*'/g;\n/** {DOC} */\nfunction afterRegex() {{}}", ["afterRegex"]),
        (f"if (a) {{\n  // {DOC}\n  while (b) {{ c(); }}\n}}", []),
        (f"/** {DOC} */\nfunction cut(a: number", []),
        ("/** */\nfunction none() {}", []),
    ],
)
def test_scripts(text, expected):
    assert names(text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        (f'def f(a, b=None):\n    """{DOC}"""\n    return a\n', ["f"]),
        (f"# {DOC}\n@decorated(1)\nasync def g(a) -> dict[str, int]:\n    return a\n", ["g"]),
        (f"    def method(self):\n        '''{DOC}'''\n        pass\n", ["method"]),
        ('def h():\n    """TODO"""\n', []),
        (f'x = """\n# {DOC}\ndef inside():\n    pass\n"""\n', []),
        (f"# {DOC}\n\ndef apart():\n    pass\n", []),
        (f"# {DOC}\n# type: ignore\ndef directive():\n    pass\n", ["directive"]),
        ("def cut(a,\n", []),
        (f"# {DOC}\ndef bare(a):\n", []),
    ],
)
def test_python(text, expected):
    assert names(text, "py") == expected


def test_shell():
    assert names(f"# {DOC}\nrun_all() {{\n  echo '#x'\n}}\n# short\nfunction two {{\n  :\n}}\n", "sh") == ["run_all"]


def test_exact_range_and_words():
    (name, doc, code, first, last), *_ = documented(f"let a = 1;\n/** {DOC} */\nexport function f() {{\n  return 1;\n}}\nlet b;", "js")
    assert (name, doc, code, first, last) == ("f", DOC, "export function f() {\n  return 1;\n}", 3, 5)
    assert real_words("Does {@link Foo} rename the big file quickly.\n@param a many more words here", "renameFile") == 4


def test_rows(spark):
    text = f"/** {DOC} */\nfunction f() {{}}"
    rows = [("a", text, "x/y.ts"), ("a", text, "x/y.ts"), ("b", text, "x/y.md"), ("c", None, "x.ts"), (None, text, "x.ts"), ("d", text, None), ("e", "", "x.TSX"), ("f", "// " + "x" * 500_000 + "\n" + text, "z.JS")]
    df = spark.createDataFrame(rows, "point_id string, text string, relative_path string").selectExpr("*", "'s' as suffix", "1 as code")
    got = {(r.point_id, r.function_name) for r in function_pairs(df).collect()}
    assert got == {("a", "f"), ("f", "f")}
    assert function_pairs(df).count() == 2 and function_pairs(df.limit(0)).count() == 0
