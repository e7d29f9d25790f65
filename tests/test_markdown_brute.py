"""Markdown chunks against a plain reading of the rules, on random documents."""

import random

from chunkloom.operators.chunking import markdown_chunks


def plain(text, limit):
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    starts, code = [], False
    for i, line in enumerate(lines):
        code ^= line.strip().startswith("```")
        if not code and line.strip().startswith("#"):
            starts.append(i)
    if not starts:
        return [(1, len(lines), "markdown", None, None, None)] if text.strip() else []
    out = []
    for a, b in zip(starts, [*starts[1:], len(lines)]):
        part = lines[a:b]
        heading = part[0].strip().lstrip("#").strip() or None
        if len("\n".join(part).encode()) <= limit:
            out.append((a + 1, b, "section", heading, None, None))
            continue
        cuts = _cuts(part, limit, natural=True)
        kind = "section"
        if len(cuts) == 1:
            cuts, kind = _cuts(part, limit, natural=False), "markdown"
        for n, (x, y) in enumerate(cuts, 1):
            if "\n".join(part[x:y]).strip():
                out.append((a + 1 + x, a + y, kind, None, n, len(cuts)))
    return out


def _cuts(part, limit, natural):
    cuts, begin, size, code = [], 0, 0, False
    for i, line in enumerate(part):
        code ^= line.strip().startswith("```")
        own = len(line.encode()) + 1
        place = not natural or (not code and (not line.strip() or line.strip().startswith(("```", ">", "-", "*"))))
        if size + own > limit and size and place:
            cuts.append((begin, i))
            begin, size = i, 0
        size += own
    return [*cuts, (begin, len(part))]


def test_random_documents(spark):
    r = random.Random(11)
    forms = ["# head {}", "  ## sub {}", "#", "```", "```ts", "plain words number {}", "- entry {}", "> quote {}", "* star {}", "", "   ", "é" * 30, "x" * 70]
    texts = ["\n".join(r.choice(forms).format(r.randint(0, 99)) for _ in range(r.randint(0, 60))) + r.choice(["", "\n"]) for _ in range(300)]
    rows = markdown_chunks(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), limit=120).collect()
    got = {}
    for x in rows:
        got.setdefault(x.k, []).append((x.start_line, x.end_line, x.chunk_type, x.symbol_name, x.split_part_ordinal, x.split_part_count))
    for k, t in enumerate(texts):
        assert sorted(got.get(k, []), key=lambda x: x[:2]) == plain(t, 120), t
        for x in rows:
            if x.k == k:
                assert x.chunk_text == "\n".join(t.split("\n")[x.start_line - 1 : x.end_line])
