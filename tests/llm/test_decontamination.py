import random

import pytest

from parlance.llm import decontamination


def stretch(item, text):
    """Least edit distance of `item` to any stretch of `text`, by the plain table."""
    row = [0] * (len(text) + 1)
    for x in item:
        new = [row[0] + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_best_stretch():
    dice = random.Random(1)
    for _ in range(200):
        item = [dice.randint(1, 4) for _ in range(dice.randint(1, 90))]
        text = [dice.randint(1, 4) for _ in range(dice.randint(0, 60))]
        assert decontamination.best_stretch(item, text)[0] == stretch(item, text)


def corpus():
    dice = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["the"] * 60
    some = lambda n: [dice.choice(words) for _ in range(n)]
    items = [(i, " ".join(some(dice.choice([5, 6, 9, 15, 30, 59, 80])))) for i in range(40)]
    docs = []
    for n in range(150):
        text = some(dice.choice([3, 40, 300, 2000]))
        for _ in range(dice.randint(0, 2)):
            held = dice.choice(items)[1].split()
            for _ in range(dice.randint(0, len(held) // 5)):
                held[dice.randrange(len(held))] = dice.choice(words)
            at = dice.randint(0, len(text))
            text[at:at] = held
        docs.append((n, " ".join(text).upper() if n % 3 == 0 else ", ".join(text)))
    return items, docs


def brute(items, docs):
    out = set()
    for d, text in docs:
        words = decontamination.words_of(text)
        for i, item in items:
            own = decontamination.words_of(item)
            if own and stretch(own, words) <= 0.2 * len(own):
                out.add((d, i))
    return out


def test_against_brute_force(spark):
    items, docs = corpus()
    want = brute(items, docs)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 7):
        rows = decontamination.find(df, bench, block=block).collect()
        found = {(r["doc_id"], r["item_id"]) for r in rows}
        assert len(rows) == len(found) and found <= want and len(found) >= 0.97 * len(want)
    kept = {r["doc_id"] for r in decontamination.drop_contaminated(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in found}


def test_odd_rows(spark):
    item = "one two three four five six seven"
    docs = [(1, None), (2, ""), (None, item), (3, item), (3, item), (4, item[:-5])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (None, item), (8, None), (7, "a b")], "item_id long, text string")
    found = sorted((str(r["doc_id"]), str(r["item_id"]), r["distance"]) for r in decontamination.find(df, bench).collect())
    assert found == sorted((d, i, n) for d, n in (("3", 0), ("3", 0), ("None", 0), ("4", 1)) for i in ("9", "None"))
    assert decontamination.find(df, bench.where("item_id = 0")).count() == 0
    assert decontamination.find(df.where("doc_id = 0"), bench).count() == 0
    assert sorted(str(r["doc_id"]) for r in decontamination.drop_contaminated(df, bench).collect()) == ["1", "2"]


def test_rows_are_decided_one_by_one(spark):
    """A clean row stays beside a contaminated one of the same id, and a row without an id can go."""
    item = "one two three four five six seven"
    df = spark.createDataFrame([(3, item, "x"), (3, "clean", "x"), (None, item, "x"), (None, None, "x")], "doc_id long, text string, item_id string")
    kept = decontamination.drop_contaminated(df, spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert kept.columns == df.columns and sorted(str(r["text"]) for r in kept.collect()) == ["None", "clean"]


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_short_items_match_exactly(spark, n):
    dice = random.Random(n)
    words = [f"w{i}" for i in range(9)]
    items = [(i, " ".join(dice.choices(words, k=n))) for i in range(6)] + [(6, "a longer item of six words"), (7, ". , ;")]
    docs = [(d, " ".join(dice.choices(words, k=dice.randint(0, 12)))) for d in range(60)]
    found = decontamination.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = [(r["doc_id"], r["item_id"]) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(items, docs)


def test_ties_and_a_very_long_text():
    item = [f"x{i}" for i in range(20)]
    text = ["y"] * 9000 + item + ["y"] * 2000 + item + ["y"] * 9000
    items = decontamination.prepare([1], [" ".join(item)])
    assert list(decontamination.matches([" ".join(text)], items)) == [(0, 0, 0, 9020)]


def test_walks_reach_over_the_item_and_follow_the_target():
    dice = random.Random(2)
    texts = [" ".join(dice.choices([f"w{i}" for i in range(300)], k=n)) for n in (6, 15, 20, 45, 60) * 8]
    items = decontamination.prepare(list(range(40)), texts)
    assert items.far == 120 and max(j for own in items.steps for s in own for j in s) >= 90
    assert decontamination.trial_recall(items) >= 0.98
    with pytest.raises(ValueError, match="walks find"):
        decontamination.prepare([1], ["a b c d e f"], target=2.0)


def edited(dice, held, how):
    """`held` with a fifth of its words edited, all that its budget allows."""
    budget = len(held) // 5
    if how == "start dropped":
        return held[budget:]
    if how == "end dropped":
        return held[: len(held) - budget]
    places = {"start replaced": range(budget), "end replaced": range(len(held) - budget, len(held)), "anywhere": dice.sample(range(len(held)), budget)}[how]
    return [f"new{dice.randint(0, 9)}" if i in places else w for i, w in enumerate(held)]


def recall(size, how, n=50):
    dice = random.Random(f"{size} {how}")
    words = [f"w{i}" for i in range(400)] + ["the"] * 60
    some = lambda k: [dice.choice(words) for _ in range(k)]
    texts = [some(size) for _ in range(n)]
    items = decontamination.prepare(list(range(n)), [" ".join(t) for t in texts])
    docs = [" ".join([*some(30), *edited(dice, t, how), *some(30)]) for t in texts]
    return sum(d == i for d, i, _, _ in decontamination.matches(docs, items)) / n


@pytest.mark.parametrize("size", [5, 11, 12, 15, 18, 23, 24, 36, 80])
def test_recall_by_length(size):
    found = {how: recall(size, how) for how in ("start dropped", "start replaced", "end dropped", "end replaced", "anywhere")}
    assert min(found.values()) >= 0.98, found
