import random
import re

import numpy as np
import pytest

from chunkloom.llm.fingerprints import Bloom, WordArrays, class_of, kept_share, line_hashes, winnow, word_lines
from chunkloom.llm.history import History, screen_batches
from chunkloom.runtime import Scratch

CHUNKS = "point_id string, text string, active_label_ids array<string>, id long, fp long"
INCOMING = "incoming_id long, batch_no int, text string, active_label_ids array<string>, key string"
WORDS = [a + b for a in ("north", "south", "green", "iron", "paper", "quiet", "rapid", "salt") for b in ("Gate", "House", "Light", "Stone", "River", "Field", "Tower")]


def chunk(seed, lines=12):
    r = random.Random(seed)
    return "\n".join(f"  const {r.choice(WORDS)} = {r.choice(WORDS)}.{r.choice(WORDS)}({r.choice(WORDS)}, {r.randint(0, 9999)});" for _ in range(lines))


def edited(text, change):
    lines = text.split("\n")
    for i in change:
        lines[i] = f"  totally(different, line{i}, here);"
    return "\n".join(lines)


def shares(a, b):
    return kept_share(*line_hashes([word_lines(a), word_lines(b)]))


def run(spark, held, incoming, **how):
    chunks = spark.createDataFrame([(f"c{i:03d}", t, ["cat:a"], 1, 2) for i, t in enumerate(held)], CHUNKS)
    rows = spark.createDataFrame([(i, b, t, ["cat:a", f"cat:{i}"], "x") for i, b, t in incoming], INCOMING)
    return {r.incoming_id: r for r in screen_batches(chunks, rows, **how).collect()}


def test_winnowing_guarantee():
    r = random.Random(3)
    for _ in range(30):
        common = [f"w{r.randint(0, 10**6)}" for _ in range(12)]
        a, b = ([f"{k}{r.randint(0, 10**6)}" for _ in range(r.randint(0, 30))] for k in "ab")
        texts = [[" ".join(a + common + b)], [" ".join(b[::-1] + common + a[::-1])]]
        owner, fps = winnow(texts)
        assert set(fps[owner == 0]) & set(fps[owner == 1])


def test_winnow_edges():
    owner, fps = winnow([[], ["one"], ["one"], ["a b c"]])
    assert list(owner) == [1, 2, 3] and fps[0] == fps[1]
    assert len(winnow([])[0]) == 0


def test_fingerprints_do_not_depend_on_the_batch():
    a, b, c = (word_lines(chunk(i)) for i in range(3))
    owner, fps = winnow([a, b, c])
    alone = winnow([b])[1]
    assert set(alone) == set(fps[owner == 1])


def test_bloom_has_no_false_negatives():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 2**63, 5000).astype(np.uint64)
    bloom = Bloom(5000 * 12)
    bloom.add(fps)
    again = Bloom(5000 * 12, bloom.data.tobytes())
    assert again.holds(fps).all()
    assert again.holds(rng.integers(0, 2**63, 20_000).astype(np.uint64)).mean() < 0.02


def test_kept_share():
    t = chunk(1)
    assert shares(t, t.replace("  ", "\t").replace(";", "").replace("\n", "\r\n")) == 1.0
    assert shares(t, edited(t, [0, 1, 2])) == pytest.approx(9 / 12)
    renamed = "\n".join(f"use({w}, someName);" for w in WORDS[:10])
    assert shares(renamed, renamed.replace("someName", "otherName")) == 1.0
    twice = "\n".join(line.replace("someName", "otherName") if i % 2 else line.replace("use", "call") for i, line in enumerate(renamed.split("\n")))
    assert shares(renamed, twice) == pytest.approx(0.5)
    assert shares(renamed, chunk(2)) == 0.0
    assert shares("", "") == 0.0


def test_against_brute_force(spark):
    held = [chunk(i) for i in range(60)] + [chunk(5)]
    r = random.Random(9)
    incoming = []
    for i in range(1, 61):
        kind = i % 6
        base = chunk(r.randrange(60))
        text = [base, edited(base, r.sample(range(12), 3)), chunk(1000 + i), edited(base, r.sample(range(12), 9)), incoming[-1][2] if incoming else chunk(2000), base.upper() if False else base.replace(" = ", "=")][kind]
        incoming.append((i, 1 + i // 25, text))
    got = run(spark, held, incoming)
    everything = [(f"c{i:03d}", -1, t) for i, t in enumerate(held)] + [(str(i), i, t) for i, _, t in incoming]
    for i, _, text in incoming:
        best = max(shares(text, t) for _, s, t in everything if s < i)
        if best >= 0.6 or best < 0.4:  # nothing that matters lies between
            assert (i in got) == (best >= 0.6), (i, best)
        if i in got:
            assert 0.5 <= got[i].share <= best + 1e-9
            assert best < 1.0 or got[i].share == 1.0
            assert got[i].gained == ["cat:" + str(i)] or got[i].held_seq > 0


def test_stock_lines_hide_nothing(spark):
    stock = "\n".join(f"// every file of this repository opens with the very same long notice number {i}" for i in range(8))
    held = [stock + "\n" + chunk(i, 6) for i in range(40)]
    new = [(1, 1, stock + "\n" + edited(chunk(33, 6), [2])), (2, 1, chunk(777)), (3, 2, stock + "\n" + chunk(888, 30))]
    got = run(spark, held, new, head=4)
    assert set(got) == {1} and got[1].held_key == "c033"


def test_edges(spark):
    got = run(spark, ["", None, "...", chunk(1), "tiny text"], [(1, None, chunk(1)), (2, 1, None), (3, 1, ""), (4, 1, "!!"), (5, 2, "tiny  text"), (6, 1, "tiny text ")])
    assert set(got) == {1, 5, 6}
    assert run(spark, [], [(1, 1, chunk(1)), (2, 1, chunk(1))]).keys() == {2}
    assert run(spark, [chunk(1)], []) == {}
    assert set(run(spark, [chunk(1, 4000)], [(1, 1, edited(chunk(1, 4000), range(500)))])) == {1}
    assert class_of(word_lines("a b\nc")) == class_of(word_lines("a\nb  c;"))


def short_lines(seed, words, every, name, lines=24):
    r = random.Random(seed)
    return [" ".join([name] * (i % every == 0) + [f"{r.choice(WORDS)}{r.randint(0, 99)}" for _ in range(words - (i % every == 0))]) for i in range(lines)]


@pytest.mark.parametrize("words, every", [(3, 2), (3, 3), (4, 1)])
def test_short_lines_with_a_frequent_changed_name(spark, words, every):
    held = ["\n".join(short_lines(i, words, every, "someName")) for i in range(30)]
    r = random.Random(words)
    new = []
    for i in range(30):
        lines = short_lines(i, words, every, "otherName")
        for k in r.sample(range(24), 9):
            lines[k] = f"another{k} line{i} altogether{k}"
        new.append((i + 1, 1, "\n".join(lines)))
    assert all(shares(held[i - 1], t) >= 0.5 for i, _, t in new)
    got = run(spark, held, new, head=4)
    assert {i: got[i].held_key for i in got} == {i + 1: f"c{i:03d}" for i in range(30)}


def test_lines_broken_elsewhere(spark):
    assert set(run(spark, [chunk(1)], [(1, 1, chunk(1).replace(" ", "\n"))])) == {1}


def test_changed_names_in_long_texts_and_repeated_lines():
    long = [f"{w} someName{i % 3} x{i}" for i, w in enumerate(WORDS * 45)]
    new = [line.replace("someName0", "otherName") if i % 3 == 0 else f"use(someName, {i})" for i, line in enumerate(long)]
    renamed = [f"call(someName, {line})" for line in long]
    assert len(long) ** 2 > 4_000_000
    assert shares("\n".join(renamed), "\n".join(renamed).replace("someName,", "otherName,")) == 1.0
    assert shares("\n".join(long), "\n".join(new)) == pytest.approx(840 / 2520)
    often = [f"plain {w}" for w in WORDS[:20]] + [f"{w} someName" for w in WORDS[:8]] * 5
    assert shares("\n".join(often), "\n".join(often).replace("someName", "otherName")) == 1.0
    # one line that is another one, however often, is no changed name
    assert shares("same\n" + "one\n" * 9, "same\n" + "two\n" * 9) == pytest.approx(0.1)


def test_a_changed_name_however_often_in_a_line():
    lines = [f"{w} " + " ".join(["someName"] * (1 + i % 9)) + f" x{i}" for i, w in enumerate(WORDS[:40])]
    text = "\n".join(lines)
    assert shares(text, text.replace("someName", "otherName")) == 1.0
    assert shares(text.replace("someName", "otherName"), text) == 1.0


def frames(spark, held, rows):
    chunks = spark.createDataFrame([(f"c{i:03d}", t, ["cat:a"], 1, 2) for i, t in enumerate(held)], CHUNKS)
    return chunks, spark.createDataFrame([(i, b, t, ["cat:a"], "x") for i, b, t in rows], INCOMING)


def test_the_store_persists(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    chunks, first = frames(spark, [chunk(i) for i in range(30)], [(1, 1, edited(chunk(3), [0])), (2, 1, chunk(500))])
    assert {r.incoming_id for r in screen_batches(chunks, first, path=path, part_rows=100).collect()} == {1}
    # opened again, it holds the history, which isn't read, and the first batch
    _, second = frames(spark, [], [(3, 2, edited(chunk(500), [1])), (4, 2, chunk(7)), (5, 2, chunk(600))])
    got = {r.incoming_id: r.held_key for r in screen_batches(chunks.where("assert_true(false) is not null"), second, path=path).collect()}
    assert got == {3: "2", 4: "c007"}
    with pytest.raises(FileNotFoundError):
        History.open(spark, f"file://{tmp_path}/nothing")


def test_a_batch_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    chunks, batch = frames(spark, [chunk(i) for i in range(10)], [(1, 1, chunk(500)), (2, 1, edited(chunk(500), [0]))])
    store = History(spark, path)
    store.found(chunks)
    monkeypatch.setattr(History, "_commit", lambda self, **changed: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.screen(batch)
    monkeypatch.undo()
    store = History.open(spark, path)
    assert {r.key: r.held_key for r in store.screen(batch).collect()} == {"2": "1"}
    store.close()
    assert {r.key for r in History.open(spark, path).screen(batch).collect()} == {"1", "2"}


def test_only_the_parts_of_a_batch_are_read_and_parts_split_when_full(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    chunks, batch = frames(spark, [chunk(i) for i in range(60)], [(1, 1, chunk(7))])
    store = History(spark, path, part_rows=60, most_versions=2)
    store.found(chunks)
    parts = store.state["parts"]
    assert parts >= 16
    wanted = spark.createDataFrame([(5 << 17,)], "fp long")
    some, _ = store._in_parts(store._table("postings", store.state["postings"], "fp long, id long, seq long, fresh boolean, v int, tier int, part int"), wanted, "fp", parts)
    assert {r.part for r in some.select("part").distinct().collect()} == {5}
    assert some.select("fp").count() < 3 * store.state["rows"] / parts and re.search(r"PartitionFilters: .*part#\d+ = 5", some._jdf.queryExecution().executedPlan().toString())
    for n in range(1, 4):
        _, more = frames(spark, [], [(n * 100 + i, n, chunk(n * 1000 + i)) for i in range(30)])
        assert store.screen(more).count() == 0
    assert store.state["parts"] > parts and len(store.state["postings"]) <= 3
    _, again = frames(spark, [], [(9000, 9, edited(chunk(2005), [2])), (9001, 9, chunk(12)), (9002, 9, chunk(99999))])
    assert {r.key: r.held_key for r in store.screen(again).collect()} == {"9000": "205", "9001": "c012"}


def test_hashes_find_candidates_but_prove_nothing(spark):
    schema = "point_id string, text string, active_label_ids array<string>, content_hash string, blob_id string, chunk_ordinal int"
    rows = [("a", chunk(1), ["c:x"], "sha256:" + "AB" * 32, "cd" * 20, 1), ("b", chunk(2), ["c:x"], None, "", 1), ("c", chunk(3), None, "zz", "ef" * 20, None)]
    new = [(1, 1, chunk(50), ["c:x"], "ab" * 32, "cd" * 20, 1), (2, 1, edited(chunk(1), [1]), ["c:y"], "AB" * 32 + " ", None, 1), (3, 1, chunk(2), [], None, "", 1)]
    got = screen_batches(spark.createDataFrame(rows, schema), spark.createDataFrame(new, "incoming_id long, batch_no int, text string, active_label_ids array<string>, content_hash string, blob_id string, chunk_ordinal int"))
    assert {r.incoming_id: (r.held_key, list(r.gained)) for r in got.collect()} == {2: ("a", ["c:y"]), 3: ("b", [])}


def test_shared_lines_of_a_match_are_never_fewer_than_the_bound(spark):
    """Texts that keep half of their lines but for one changed name, of few words, so that names are frequent in some and not in others."""
    r = random.Random(4)
    bound = History(spark, Scratch(spark, "bound").path)
    pairs = []
    for _ in range(3000):
        names, n = [f"n{i}" for i in range(6)], r.randint(2, 16)
        own = [" ".join([f"w{r.randint(0, 12)}"] + [r.choice(names)] * r.randint(0, 2) + [r.choice(names)]) for _ in range(n)]
        kept = [" ".join("changed" if w == "n0" else w for w in line.split()) for line in r.sample(own, r.randint(1, n))]
        held = kept + [f"other{r.randint(0, 99)} n{r.randint(0, 5)}" for _ in range(r.randint(0, n))]
        if len(kept) >= 0.5 * max(n, len(held)) and kept_share(*line_hashes([own, held])) >= 0.5:
            words = WordArrays([own, held])
            owner, fps, place = words.placed_line_prints(0.25)
            of_held = set(fps[owner == 1])
            shared = [(int(p), f) for o, f, p in zip(owner, fps, place) if o == 0 and f in of_held]
            plain_owner, plain = words.line_prints(0.25)
            assert {f for _, f in shared} == set(plain[plain_owner == 0]) & of_held
            pairs.append((n, len({p for p, _ in shared if p >= 0}), len({max(p, ~p) for p, _ in shared})))
    assert len(pairs) > 500
    rows = spark.createDataFrame(pairs, "n int, whole int, covered int")
    assert rows.where(~bound._may_match(rows["whole"], rows["covered"])).count() == 0


def test_texts_that_share_few_stock_lines_are_not_compared_with_all_holders(spark, monkeypatch):
    stock = "every file opens with someName\nand it ends with someName"
    held = [stock + "\n" + chunk(i, 6) for i in range(60)]
    own = [f"keep someName as {w}" for w in WORDS[:12]]
    # of the last texts more lines are stock, so all holders are met, with a changed name too
    held += ["\n".join(own[:9]) + f"\nrest {i} a\nrest {i} b\nrest {i} c" for i in range(30)]
    new = [(i + 1, 1, stock + "\n" + chunk(1000 + i, 6)) for i in range(5)] + [(6, 1, "\n".join(own[:7]).replace("someName", "otherName") + "\nrest 25 a\nrest 25 b\nrest 25 c")]
    compared = {}
    verified = History._verified

    def counted(self, pairs, distinct, write, name):
        compared[name] = compared.get(name, 0) + pairs.count()
        return verified(self, pairs, distinct, write, name)

    monkeypatch.setattr(History, "_verified", counted)
    got = run(spark, held, new, head=2)
    assert set(got) == {6} and got[6].share >= 0.5
    assert compared.get("far", 0) <= 30


def test_matches_behind_lines_that_many_hold_against_brute_force(spark):
    r = random.Random(12)
    pool = [f"{w} someName {WORDS[(7 * i) % 56]}" if i % 3 else f"{w} {WORDS[(5 * i) % 56]} x" for i, w in enumerate(WORDS[:30])]
    held = ["\n".join(r.sample(pool, 10)) for _ in range(60)]
    new = []
    for i in range(40):
        lines = r.choice(held).split("\n") if i % 2 else r.sample(pool, 10)
        lines = [line.replace("someName", "otherName") if i % 4 > 1 else line for line in lines]
        for k in r.sample(range(10), 4):
            lines[k] = f"own {i} line {k}"
        new.append((i + 1, 1, "\n".join(lines)))
    got = run(spark, held, new, head=1)
    best = {i: max(shares(text, t) for t in held + [t for j, _, t in new if j < i]) for i, _, text in new}
    assert set(got) == {i for i, share in best.items() if share >= 0.5} and 10 < len(got) < 40


def test_jobs_do_not_multiply_with_the_batches(spark, monkeypatch):
    """The plans and broadcasts of every round stay with the driver for a while."""
    written, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name, **how: written.append(name) or write(self, df, name, **how))
    held, new = [chunk(i) for i in range(10)], [chunk(100 + i) for i in range(6)] + [edited(chunk(3), [0])]
    assert set(run(spark, held, [(i + 1, 1, t) for i, t in enumerate(new)])) == {7}
    one = len(written)
    written.clear()
    assert set(run(spark, held, [(i + 1, i, t) for i, t in enumerate(new)])) == {7}
    assert len(written) == one


@pytest.mark.parametrize("part_rows", [500_000, 60])
def test_batches_of_one_round_are_held_in_their_order(spark, tmp_path, part_rows):
    """Against brute force and batches one by one: numbers that run against the batches, copies in several, other line breaks, rows without a batch."""
    r = random.Random(part_rows)
    held = ["stock line\n" + chunk(i, 8) for i in range(12)]
    seen, rows = list(held), []
    for b in (1, 2, 3, 4, None):
        for i in range(7):
            text = "stock line\n" + chunk(f"{b} {i}", 8) if i < 3 else r.choice(seen)
            if i in (3, 4):
                text = edited(text, r.sample(range(1, 9), 2 + i // 4))
            elif i == 5:
                text = text.replace(" = ", "\n= ") if r.random() < 0.7 else text
            rows.append((1000 - 100 * (b or 5) + i, b, text))
            seen.append(text)
    rows += [(5, 4, chunk("4 0", 8).replace(" = ", "\n= ")), (6, 2, edited(chunk("1 1", 8), [1]) + "\nstock line")]
    rows.sort(key=lambda x: (x[1] or 5, x[0]))
    best = {}
    for k, (i, b, text) in enumerate(rows):
        before = held + [t for _, _, t in rows[:k]]
        best[i] = max(1.0 if class_of(word_lines(t)) == class_of(word_lines(text)) else shares(text, t) for t in before)
    wanted = {i: pytest.approx(share) for i, share in best.items() if share >= 0.5}
    assert 15 < len(wanted) < len(rows) - 10
    got = run(spark, held, r.sample(rows, len(rows)), head=2, part_rows=part_rows)
    assert {i: x.share for i, x in got.items()} == wanted
    assert {i: x.batch for i, x in got.items()} == {i: b for i, b, _ in rows if i in wanted}
    chunks, _ = frames(spark, held, rows[:1])
    store, alone = History(spark, f"file://{tmp_path}/store", head=2, part_rows=part_rows), {}
    store.found(chunks)
    for b in (1, 2, 3, 4, None):
        _, batch = frames(spark, [], [x for x in rows if x[1] == b])
        alone |= {int(x.key): x.share for x in store.screen(batch).collect()}
    assert alone == wanted
