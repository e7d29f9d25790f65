import random

import pytest

from chunkloom.llm.prose import STATISTICS, dominant_language, statistics
from chunkloom.llm.textstats import classify

EN = "The harbour was quiet when the boats came back, and nobody had written down which of them was late. "
PROSE = [
    EN * 4,
    ("It is not clear to us why the gate was left open, but it has been closed since then. " * 3).lower(),
    "Der Hafen war still, als die Boote wieder kamen, und niemand hat aufgeschrieben, welches von ihnen zu spät war. " * 3,
    "Le port est calme quand les bateaux sont de retour, et il ne faut pas oublier que la nuit est longue pour eux. " * 3,
    "El puerto está en calma cuando los barcos vuelven, y no se sabe por qué la noche es tan larga para todos. " * 3,
    "\n".join(EN.split(" ")[i] + " " + " ".join(EN.split(" ")[i + 1 : i + 6]) for i in range(0, 18, 6)) * 1 + "\n" + EN * 3,
    EN * 3 + "\n\n- first thing\n- second thing\n\n" + EN,
    EN * 3 + "\n```js\nconst x = a.map((b) => b.c);\n```\n" + EN,
]
LISTS = [
    "\n".join(f"- {w} gate" for w in "red blue green iron paper salt quiet rapid north south".split()),
    "\n".join(f"{i}. {w} house" for i, w in enumerate("red blue green iron paper salt quiet rapid north south".split(), 1)),
    "\n".join(f"{w} stone river" for w in "red blue green iron paper salt quiet rapid north south".split()),
    EN + "\n" + "\n".join(f"[x] {w} light field" for w in "red blue green iron paper salt quiet rapid north south east west".split() * 2),
]
TABLES = [
    EN + "\n\n" + "\n".join(f"{i}\tn{i}\t-" for i in range(9)),
    "\n".join(f"| {i} | name{i} | {i * 7}.5 |" for i in range(12)),
    "\n".join(f"{i},name{i},{i * 7}.5" for i in range(12)),
    "\n".join(f"{i}\tname{i}\t{i * 7}.5" for i in range(12)),
    "\n".join(f"name{i:<18}{i * 7:<14}value{i}" for i in range(12)),
    "\n".join(f"<tr><td>{i}</td><td>x{i}</td></tr>" for i in range(12)),
]
JUNK = [
    "kq8Zp3Vt/" * 60,
    "loading\n" * 40,
    "click here to continue\n" * 40,
    "\n".join(f"2025-01-{i:02d}T10:00:00Z INFO k={i * 37} v=a{i}f" for i in range(1, 20)),
    "gate house light stone river field tower iron paper quiet rapid salt north south east " * 8,
    "%&$ )(=? ;:_ <>| #+* ~^ " * 20,
]


@pytest.fixture(scope="module")
def classified(spark):
    texts = PROSE * 15 + LISTS + TABLES + JUNK + [None, "", " \n "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'x' as key", "1.0 as prose")
    return texts, {r.doc_id: r for r in classify(df).collect()}


def test_kinds(classified):
    texts, got = classified
    wanted = ["prose"] * len(PROSE) * 15 + ["list"] * len(LISTS) + ["table"] * len(TABLES) + ["junk"] * len(JUNK) + ["empty"] * 3
    assert {i: (got[i].kind, texts[i]) for i in got if got[i].kind != wanted[i]} == {}


def test_contributions_add_up(classified):
    _, got = classified
    for r in got.values():
        if r.kind == "empty":
            assert r.distance is None and r.contributions is None and r.log_words is None
        else:
            assert sum(r.contributions.values()) == pytest.approx(r.distance, rel=1e-6, abs=1e-6)
            assert set(r.contributions) == set(STATISTICS)


def test_statistics_of_a_small_text():
    stats, shares, lang = statistics("The cat is here.\n\n* one\n")
    assert lang == "en" and stats["line_end_share"] == 0.5
    assert stats["word_length"] == pytest.approx((3 + 3 + 2 + 4 + 3) / 5)
    assert shares["item"] > 0 and shares["prose"] > 0
    assert dominant_language([]) == "en" and dominant_language(["und", "nicht"]) == "de"


def test_edges(spark):
    df = spark.createDataFrame([(1, "x" * 300_000), (None, "a" * 5), (1, "x" * 300_000)], "doc_id long, text string")
    rows = classify(df).collect()
    assert len(rows) == 3 and {r.kind for r in rows} <= {"junk", "list", "prose", "table"}
    assert classify(df.limit(0)).count() == 0


FOREIGN = {
    "it": "Il mercato della piazza apre ogni mattina alle sette, quando i primi venditori sistemano le cassette di frutta e la gente del quartiere scende a prendere il caffè. Oggi piove, ma nessuno sembra preoccuparsene.",
    "nl": "De boot vertrok om zes uur uit de haven, en toen we de vuurtoren voorbij waren, begon het zachtjes te regenen. Mijn broer had brood en kaas meegenomen, maar niemand had honger.",
    "ru": "Утром мы вышли из дома раньше обычного, потому что автобус в город ходит только два раза в день. Дорога была мокрая, но небо понемногу светлело.",
    "fi": "Aamulla lähdimme kotoa aikaisemmin kuin tavallisesti, koska bussi kulkee kaupunkiin vain kaksi kertaa päivässä. Tie oli märkä, mutta taivas kirkastui vähitellen.",
    "zh": "早上我们比平时更早离开家，因为去城里的公共汽车每天只有两班。车站已经站着几个提着篮子的人，一位老太太讲起她年轻时怎样走路穿过树林。路是湿的，但是天慢慢亮了。",
    "ar": "خرجنا من البيت في الصباح أبكر من المعتاد لأن الحافلة إلى المدينة لا تأتي إلا مرتين في اليوم. كان في الموقف ناس يحملون السلال.",
}


def made_up(seed, words=120):
    r = random.Random(seed)
    said = [("".join(r.choice("bdfgklmnprstvz") + r.choice("aeo") for _ in range(r.randint(1, 4)))) for _ in range(words)]
    return " ".join(w.capitalize() + "" if i % 9 == 0 else w + ("." if i % 9 == 8 else "") for i, w in enumerate(said))


@pytest.mark.parametrize("beside", [0, 60])
def test_prose_of_any_language(spark, beside):
    texts = [*FOREIGN.values(), *(made_up(i) for i in range(5)), *([EN * 4] * beside)]
    got = {r.doc_id: r for r in classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].kind for i in range(len(FOREIGN))] == ["prose"] * len(FOREIGN)
    assert [got[len(FOREIGN) + i].kind for i in range(5)] == ["junk"] * 5
    assert {got[i].language for i in range(len(FOREIGN))} == {"other"}


def test_the_distance_decides(spark, monkeypatch):
    from chunkloom.llm import textstats

    df = spark.createDataFrame(list(enumerate(PROSE + LISTS + TABLES + JUNK)), "doc_id long, text string")
    rows = classify(df).collect()
    lead = {"list_share": "list", "table_share": "table", "other_share": "junk"}
    for r in rows:
        assert r.kind == ("prose" if r.distance <= 32.909 else lead[max(lead, key=r.contributions.get)])
    monkeypatch.setattr(textstats.ProseModel, "contributions", lambda self, lang, x: 0.0 * x)
    assert {r.kind for r in classify(df).collect()} == {"prose"}


def test_the_estimate_is_robust(spark):
    # two fifths of the texts that are in a language by their words are mostly rows
    rows = [EN * 2 + "\n" + "\n".join(f"| {w} | {i * 7}.5 | {i}{i}{i}-{i * 13}-{i * 101} | {i * 999983} |" for i, w in enumerate("red blue green iron paper salt quiet rapid north south east west".split()))]
    texts = [EN * (3 + i % 4) for i in range(60)] + rows * 40
    got = {r.doc_id: r.kind for r in classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(100)] == ["prose"] * 60 + ["table"] * 40
