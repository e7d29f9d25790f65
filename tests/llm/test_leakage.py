import numpy as np
import pytest

from hypothesis import given
from hypothesis import strategies as st

from chunkloom.llm.leakage import ItemIndex, _candidates, extent, leaked_items, passages, plain_words, words_of

PASSAGE = (
    "the quick harbour master counted seven grey boats before sunrise and wrote their names into a long ledger that nobody ever opened again "
    "because the winter storms had already taken the pier"
)
CODE = "function alpha(one, two) {\n  const three = one.map((x) => beta(x.gamma));\n  if (three.delta > 42) return epsilon;\n  zeta.push(eta(three));\n  theta += iota * 9;\n  return kappa(three);\n}"
STOCK = "please read the handbook of this project before you open an issue here"
ALSO = "larger changes are discussed by all of us on the list beforehand"


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "1 as id", "'x' as item", "2 as runs")


def items(spark, texts):
    return spark.createDataFrame([(100 + i, "s", t) for i, t in enumerate(texts)], "item_id long, suite string, text string")


def found(spark, texts, held, **how):
    return {(r.doc_id, r.item_id) for r in leaked_items(docs(spark, texts), items(spark, held), **how).collect()}


def test_words_keep_their_places():
    text = "The &ldquo;Café&rdquo; so­ft **bold**_x_ R&D"
    assert [w for w, _, _ in words_of(text)] == ["the", "café", "soft", "bold", "x", "r", "d"]
    assert [text[a:b] for _, a, b in words_of(text)][:2] == ["The", "Café"]


@given(st.text(st.characters(codec="utf-8") | st.sampled_from("ab &;_-ßİﬁＡ\u00ad\n"), max_size=60))
def test_both_ways_find_the_same_words(text):
    plain = plain_words(text)
    assert plain is None or plain == [w for w, _, _ in words_of(text)]


def test_ways_of_setting_a_passage(spark):
    words = PASSAGE.split()
    quoted = "> " + "\n> ".join(" ".join(words[i : i + 6]) for i in range(0, len(words), 6))
    replaced = " ".join("other" if i % 9 == 4 else w for i, w in enumerate(words))
    bold = " ".join(f"**{w}**" if i % 3 == 0 else w for i, w in enumerate(words))
    texts = [
        "before. " + PASSAGE + " after.",
        PASSAGE.upper(),
        quoted,
        replaced,
        bold,
        "x " + " ".join(words[3:26]) + " y",
        " ".join(words[3:14]),
        "nothing of it",
        "\ta = " + CODE.replace("  ", "\t").replace(";", ""),
    ]
    got = found(spark, texts, [PASSAGE + "\n\nWhich boats?", CODE, PASSAGE + " And why?"])
    assert got == {(i, k) for i in range(6) for k in (100, 102)} | {(8, 101)}


def test_stock_phrases_alone_are_no_case(spark):
    # unrelated items have the stock sentences too, so these belong to none of them
    filler = "somebody else may write about entirely different matters in this place number "
    texts = [f"{STOCK} {ALSO} {filler} {i}" for i in range(60)]
    unrelated = [f"a wholly unrelated item about lamps and ropes {STOCK} which nobody mends at night", f"{ALSO} but the people of the harbour sang about it for years"]
    assert found(spark, texts, [f"{STOCK} {ALSO} what then?", *unrelated]) == set()
    # of a single item nobody can know that they are stock: they are a passage of it
    assert len(found(spark, texts, [f"{STOCK} {ALSO} what then?"])) == 60


def test_offsets_point_into_the_original(spark):
    text = "Intro, with commas.\n\n" + PASSAGE.title() + "\nEnd."
    r = leaked_items(docs(spark, [text]), items(spark, [PASSAGE])).head()
    assert text[r.start : r.end].lower() == PASSAGE and r.words == len(PASSAGE.split())


def test_edges(spark):
    assert found(spark, [None, "", " ", PASSAGE, PASSAGE], [None, "", "short", PASSAGE]) == {(3, 103), (4, 103)}
    assert found(spark, [PASSAGE * 300], [PASSAGE]) == {(0, 100)}
    assert leaked_items(docs(spark, [PASSAGE]).limit(0), items(spark, [PASSAGE])).count() == 0
    assert leaked_items(docs(spark, [PASSAGE]), items(spark, [PASSAGE]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        leaked_items(docs(spark, [PASSAGE]), items(spark, [PASSAGE]), most_item_bytes=10)


def test_a_passage_that_leaked_everywhere_stays_a_case(spark):
    filler = "somebody else may write about entirely different matters in this place number "
    assert found(spark, [f"{filler} {i} {PASSAGE}" for i in range(60)], [PASSAGE]) == {(i, 100) for i in range(60)}
    assert found(spark, [PASSAGE] * 60, [PASSAGE]) == {(i, 100) for i in range(60)}


def test_extent_counts_and_lines_of_code(spark):
    words = PASSAGE.split()[:20]
    replaced = [" ".join("other" if i in at else w for i, w in enumerate(words)) for at in ([9], [9, 14], [2], [17])]
    short = " ".join(words[:19])
    six = "a = b;\nfoo(c);\nd = e + f;\ng();\nh = i;\nj(k, l);"
    five = "\n".join(six.split("\n")[:5])
    got = found(spark, [*replaced, short, "x\n" + six + "\ny", "x\n" + five + "\ny"], [PASSAGE, six + "\nWhat then?"])
    assert got == {(i, 100) for i in range(4)} | {(5, 101)}


def test_a_shorter_passage_beside_stock_is_found(spark):
    filler = "somebody else may write about entirely different matters in this place number "
    texts = [f"{STOCK} {filler} {i}" for i in range(60)] + [f"{STOCK} {ALSO} {STOCK} {filler} " + " ".join(PASSAGE.split()[:21])]
    held = [f"{STOCK} {ALSO} {STOCK} what then? " + PASSAGE, f"the lamps of the pier were {STOCK} lit", f"{ALSO} but nobody came"]
    assert found(spark, texts, held) == {(60, 100)}


def test_what_other_documents_hold_changes_nothing(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    for n in (1, 10, 15, 200):
        assert len(found(spark, [f"{passage} number {i}" for i in range(n)], [passage])) == n


def test_six_short_lines_of_code(spark):
    for code in ("a = b;\nc = d;\ne = f;\ng = h;\ni = j;\nk = l;", "begin(a);\nb();\nc();\nd();\ne();\nf();"):
        assert found(spark, ["x\n" + code + "\ny", "x\n" + code.rsplit("\n", 1)[0] + "\ny"], [code + "\nWhat?"]) == {(0, 100)}


@given(st.lists(st.sampled_from("a b c d e f g h".split()), min_size=5, max_size=60), st.lists(st.lists(st.sampled_from("a b c d e f g h x y".split()), max_size=70), min_size=1, max_size=4), st.integers(3, 25))
def test_the_bound_loses_no_passage(item, documents, least):
    index = ItemIndex([(1, " ".join(item))], 3)
    whole = [[(d, k, r) for d in range(len(words) - 2) for run in [" " + " ".join(words[d : d + 3]) + " "] for r in [index.runs.get(run)] if r is not None for _, k in index.places[r]] for words in documents]
    codes, hits, base = [], [], 0
    for at, words in enumerate(documents):
        hits += sorted({(at, base + d, r) for d, _, r in whole[at]})
        codes += [index.codes.get(w, 0) for w in words] + [-1]
        base += len(words) + 1
    if not hits:
        return
    doc, word, run = (np.array(x, np.int64) for x in zip(*hits))
    kept = {int(doc[h]) for h, _ in _candidates(index, doc, word, run, np.array(codes, np.int32), 8, 2, least, 6)}
    for at, words in enumerate(documents):
        if any(extent(c, words, item, 3)[4] >= least for c in passages([(d, k) for d, k, _ in whole[at]], 3, 8, 2)):
            assert at in kept
