import random

import pytest

from chunkloom.llm.grammars import Grammar, literal_share, long_runs, tokens
from chunkloom.llm.handwritten import classify_files, notice

NAMES = [a + b for a in ("north", "south", "green", "iron", "paper", "quiet") for b in ("Gate", "House", "Light", "Stone", "River")]
R = random.Random(4)


def pick():
    return R.choice(NAMES)


FORMS = [
    lambda: f"const {pick()} = {pick()}.map((entry) => {pick()}(entry.{pick()}));",
    lambda: f"if ({pick()}.{pick()} > {R.randint(1, 99)}) {{ return {pick()}; }}",
    lambda: f"this.{pick()}.push({pick()}({pick()}.{pick()}, '{pick()} {pick()}'));",
    lambda: f"// {pick()} first, because {pick()} waits for {pick()}",
    lambda: f"throw new Error('{pick()} lost: ' + {pick()}.{pick()});",
    lambda: f"await {pick()}({pick()}, {R.randint(1, 9999)});",
]
HAND = "\n".join("  " + R.choice(FORMS)() for _ in range(60))
GENERATED = "\n".join(f'export const Field_{i:04d}_{pick()} = {{ id: {i}, wire: {R.randint(0, 5)}, name: "{pick()}" }};' for i in range(50))
MINIFIED = "".join(f"function {R.choice('abcxyz')}{i}(e,t){{return e.q?t(e):void 0}}!function(n){{n.{R.choice('klm')}=!0}}({R.choice('abc')});" for i in range(40))
BLOB = 'export const data = "' + "".join(R.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(3000)) + '";'
NUMBERS = "module.exports = [\n" + "\n".join("  " + ", ".join(f"0x{R.randint(0, 255):02x}" for _ in range(16)) + "," for _ in range(40)) + "\n];"
WORDLIST = HAND + "\nexport const words = '" + "|".join(pick() for _ in range(900)) + "';"


def grammar(text):
    g = Grammar([tokens(text)])
    return g.size[0] / g.length[0], g.covered[0] / g.length[0]


def test_grammar_sizes():
    assert grammar(GENERATED)[0] < 0.46 and grammar(GENERATED)[1] > 0.78
    assert grammar(NUMBERS)[0] < 0.2
    assert grammar(HAND)[0] > 0.55
    assert Grammar([[], ["a"]]).size.tolist() == [0, 1]


def test_grammars_do_not_depend_on_the_batch():
    alone = [Grammar([tokens(t)]).size[0] for t in (HAND, GENERATED, NUMBERS)]
    assert Grammar([tokens(t) for t in (HAND, GENERATED, NUMBERS)]).size.tolist() == alone


def test_literals():
    inside, size = literal_share(BLOB)
    assert inside > 0.9 * size
    assert literal_share(WORDLIST)[0] == 0 and literal_share("") == (0, 0)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("// Code generated by tool. DO NOT EDIT.\nx", (True, False)),
        ("/**\n * This file was produced by the x compiler from y.\n * Manual edits are overwritten.\n */\nx", (True, False)),
        ("// The generated file next to this one is rebuilt; do not edit it.\nx", (False, False)),
        ("const B = '// Code generated by x. DO NOT EDIT.';", (False, False)),
        ("x();\n// Code generated by tool. DO NOT EDIT.\n", (False, False)),
        ("/*!\n * Foo.js v1.2.3\n * (c) the Foo authors, released under a licence\n */\nx", (False, True)),
        ("// Copyright of the maintainers. See LICENSE in the repository root.\nx", (False, False)),
    ],
)
def test_notices(text, expected):
    assert notice(text) == expected


def test_files(spark):
    files = {
        "hand": ("src/a/hand.ts", HAND),
        "gen": ("src/a/plain.ts", GENERATED),
        "min": ("src/a/thing.js", MINIFIED),
        "blob": ("src/a/blob.ts", BLOB),
        "numbers": ("src/a/numbers.js", NUMBERS),
        "words": ("src/a/words.ts", WORDLIST),
        "vendor": ("src/vendor/thing.ts", HAND),
        "release": ("lib/thing-1.7.9/x.js", HAND),
        "portal": ("src/vendor-portal/x.ts", HAND),
        "doc": ("docs/x.md", GENERATED),
        "notice": ("src/n.ts", "// @generated by x\n" + HAND),
    }
    rows = []
    for name, (path, text) in files.items():
        half = len(text) // 2
        for i, part in enumerate((text[:half], text[half:]), 1):
            rows += [(name, f"r{i % 2}", path, i, part)] * (2 if i == 1 else 1)
    rows += [("null", "r", None, 1, None), (None, "r", "vendor/x", 1, HAND), ("empty", None, "src/e.ts", None, "")]
    schema = "file_id string, catalog string, relative_path string, chunk_ordinal int, text string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as tokens", "'x' as rules", "true as foreign")
    got = {r.file_id: r.kind for r in classify_files(df).collect()}
    assert got == {
        "hand": "written", "gen": "generated", "min": "minified", "blob": "data", "numbers": "data", "words": "written", "vendor": "vendored",
        "release": "vendored", "portal": "written", "doc": "written", "notice": "generated", "null": "written", "empty": "written",
    }
    assert classify_files(df.limit(0)).count() == 0


def test_long_runs():
    own = [tokens(HAND), [], tokens("a b c"), tokens("x y z\n" + HAND)]
    owner, runs, widths = long_runs(own)
    assert [int(widths[owner == i].sum()) for i in range(4)] == [len(own[0]), 0, 0, len(own[3])]
    assert len(set(runs[owner == 3]) - set(runs[owner == 0])) <= 3
    assert [len(x) for x in long_runs([[]])] == [0, 0, 0]


def test_a_file_copied_into_two_repositories(spark):
    # nothing in it repeats, and neither path nor notice tells anything
    licence = "// " + " ".join(pick() for _ in range(400)) + "\n"
    own = ["\n".join("  " + R.choice(FORMS)() for _ in range(20)) for _ in range(4)]
    rows = [
        ("a", "r1", "src/a/parse.ts", 1, HAND), ("b", "r2", "lib/x/tools.ts", 1, HAND[: len(HAND) // 3]), ("b", "r2", "lib/x/tools.ts", 2, HAND[len(HAND) // 3 :]),
        ("c", "r1", "src/c.ts", 1, licence + own[0]), ("d", "r2", "src/d.ts", 1, licence + own[1]),
        ("e", "r1", "src/e.ts", 1, own[2]), ("f", "r1", "src/f.ts", 1, own[2]), ("g", "r2", "src/g.ts", 1, own[3] + "\n" + own[2][:300]),
    ]
    df = spark.createDataFrame(rows, "file_id string, catalog string, relative_path string, chunk_ordinal int, text string")
    got = {r.file_id: r.kind for r in classify_files(df).collect()}
    assert got == {"a": "vendored", "b": "vendored"} | dict.fromkeys("cdefg", "written")


def test_rules_go_on_to_the_end():
    # 2 ** 16 equal halves: a rule may be as wide as it takes, and pairs that occur twice are rules too
    g = Grammar([["a", "b"] * 2**15, ["x", "y", "z", "x", "y", "q"]])
    assert g.size[0] < 60 and g.covered[0] == 2**16
    assert g.covered[1] == 4


def test_notices_after_a_long_licence_and_repeated_points(spark):
    licence = "\n".join(f" * {pick()} {pick()} grants {pick()} without {pick()}, part {i}" for i in range(200))
    text = f"/*\n{licence}\n * Code generated by a tool. DO NOT EDIT.\n */\n{HAND}"
    assert notice(text) == (True, False)
    rows = [("p1", "f", "r", "src/f.ts", 1, HAND)] + [("p2", "f", "r", "src/f.ts", 2, GENERATED[:1500])] * 40 + [("p3", "g", "r", "src/g.ts", 1, text)]
    df = spark.createDataFrame(rows, "point_id string, file_id string, catalog string, relative_path string, chunk_ordinal int, text string")
    got = {r.file_id: r for r in classify_files(df).collect()}
    assert {k: r.kind for k, r in got.items()} == {"f": "written", "g": "generated"}
    assert got["f"].tokens == len(tokens(HAND)) + len(tokens(GENERATED[:1500]))
