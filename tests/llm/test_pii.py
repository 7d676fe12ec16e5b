import hashlib
import random
import re

import numpy as np
import pytest
from parlance.llm import pii


def plain(text):
    """The base patterns as they are stated, by a regular expression engine alone."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), m.end(), 0))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append((m.start(), m.end(), 2))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_against_the_stated_patterns():
    dice = random.Random(7)
    pieces = ["a@b.c", "@", ".", "..", "+1", "+", " ", "-", "(", ")", "1.2.3.4", "256.1.1.1", "001.2.3.4", "4111 1111 1111 1111", "4111111111111111", "x", "é", "_", "%", "a-b", "12", "5", "0", "+1 (415) 555-0199", "@@", "\n", "m.n@o-p.q.r", "123456789012"]
    for _ in range(4000):
        text = "".join(dice.choice(pieces) for _ in range(dice.randint(0, 12)))
        assert pii.base_spans(text) == plain(text), text


@pytest.mark.parametrize("text", ["1" * 60000, "1." * 30000, "a" * 60000 + "@", "@" * 60000, "+" * 60000, "+1" + " " * 60000, "1 " * 60000, "[at]" * 5000, "a:" * 30000])
def test_long_texts_take_linear_time(text):
    import time

    began = time.time()
    pii.loose_spans(text, pii.base_spans(text))
    assert time.time() - began < 3


def test_reliabilities_are_estimated():
    random_ = np.random.default_rng(1)
    truth = random_.random(20000) < 0.4
    right = np.array([0.95, 0.8, 0.7, 0.9, 0.6])
    cast = np.where(random_.random((20000, 5)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    posterior, table = pii.expectation_maximisation(np.zeros(20000, int), cast, np.ones(20000))
    assert np.abs(table[:, 1, 2] - right).max() < 0.03 and ((posterior > 0.5) == truth).mean() > 0.95


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.train(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    added = 0
    for r in pii.find(docs, model).collect():
        base = plain(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for _, _, k in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii.written(base).encode()).hexdigest()
        every = r["spans"].split(",") if r["spans"] else []
        assert set(pii.written(base).split(",")) - {""} <= set(every)
        added += len(every) - len(base)
    assert added > 10  # secrets
    clean = pii.redact(docs, model)
    assert all(not plain(t) for (t,) in clean.select("text").collect())


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a@b.co"), (3, "a@b.co"), (3, "a@b.co"), (4, "password = deadbeef0123456789 and x [at] mail [dot] com")]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, spans string")
    model = pii.train(df)
    found = sorted((str(r["doc_id"]), r["n_email"], r["spans"]) for r in pii.find(df, model).collect())
    assert found[:4] == [("1", 0, ""), ("2", 0, ""), ("3", 1, "email:0:6"), ("3", 1, "email:0:6")] and found[-1] == ("None", 1, "email:0:6")
    assert pii.train(df.where("doc_id = 9")) is None and pii.find(df.where("doc_id = 9"), None).count() == 0
    assert {r["text"] for r in pii.redact(df, None).collect()} >= {None, "", "<EMAIL>"}


def test_overlaps_against_all_pairs():
    dice = random.Random(3)
    span = lambda: (a := dice.randint(0, 400), a + dice.randint(1, 12), dice.randint(0, 4))
    for _ in range(50):
        base = [span() for _ in range(dice.randint(0, 40))]
        taken, kept = pii.Taken(base), list(base)
        for own in (span() for _ in range(60)):
            free = not any(s < own[1] and own[0] < e for s, e, _ in kept)
            assert taken.free(own) == free
            if free:
                taken.add(own)
                kept.append(own)
