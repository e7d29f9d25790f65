import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.llm.splitting import gap_depths, split_oversized, split_text


def check(text, limit=6000, low=200, high=400):
    pieces = split_text(text, limit, (low, high))
    parts = [text[a:b] for a, b in pieces]
    assert all(len(p.encode()) <= limit for p in parts)
    joined = parts[0]
    for (_, end), (opens, _), part in zip(pieces, pieces[1:], parts[1:]):
        shared = text[opens:end]
        assert low <= len(shared.encode()) <= high
        assert joined.endswith(shared) and part.startswith(shared)
        joined += part[len(shared) :]
    assert joined == text
    return parts


@pytest.mark.parametrize(
    "text",
    ["", "short", "x" * 20_000, "é" * 9_000, "𝄞" * 3_000, "\n" * 9_000, "a b " * 5_000, "one line; " * 3_000, ("word " * 30 + "\n") * 200, "x" * 6000, "x" * 6001],
)
def test_pieces_join_to_the_text(text):
    parts = check(text)
    assert (len(parts) > 1) == (len(text.encode()) > 6000)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(min_size=0, max_size=120), min_size=1, max_size=200).map("\n".join))
def test_any_text(text):
    check(text * 3, 800, 40, 90)


def test_cuts_where_the_topic_changes():
    a = "\n".join(f"cats purr softly and cats sleep long {i}" for i in range(60)) + "\n"
    b = "\n".join(f"engines roar loudly while pistons turn {i}" for i in range(60)) + "\n"
    pieces = split_text(a + b, 3600, (50, 100))
    assert pieces[0][1] == len(a)


def test_no_gaps():
    assert len(gap_depths([])) == 0 and len(gap_depths(["one"])) == 0


def test_rows(spark):
    rows = [("a", "x " * 4000, 7), ("b", "small", 7), ("c", None, 7), (None, "y\n" * 4000, 7), ("a", "x " * 4000, 7)]
    df = spark.createDataFrame(rows, "point_id string, text string, split_part_count int")
    got = split_oversized(df, "point_id").collect()
    assert {r.point_id for r in got} == {"a", None}
    one = sorted((r.split_part_ordinal, r.split_part_count) for r in got if r.point_id is None)
    assert one == [(1, 2), (2, 2)]
    assert sum(r.point_id == "a" for r in got) == 4
    assert split_oversized(df.limit(0), "point_id").count() == 0
