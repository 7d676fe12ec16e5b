import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from parlance.llm import simhash


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """{position: smallest id reachable} by comparing all pairs."""
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return [(d, f"{fps[i]:016x}", min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "ONE two", "Éa b É c \x85 d e f", "a b c " * 200, "x" * 50000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_join_tries_finds_all_pairs():
    random = np.random.default_rng(3)
    centres = random.integers(0, 2**63, 60, dtype=np.int64).view(np.uint64)
    values = centres[random.integers(0, 60, 900)]
    for _ in range(3):
        values = np.where(random.random(900) < 0.6, values ^ (np.uint64(1) << random.integers(0, 64, 900).astype(np.uint64)), values)
    values = np.unique(values)
    i, j = np.triu_indices(len(values), 1)
    near = np.bitwise_count(values[i] ^ values[j]) <= 2
    found = {p for a, b in simhash.join_tries(values, values, 0, 2, True, leaf=32) for p in zip(a.tolist(), b.tolist())}
    assert found == set(zip(i[near].tolist(), j[near].tolist()))


def documents():
    random = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(40):
        base = list(random.choice(words, 120))
        for k in range(int(random.integers(1, 6))):
            copy = list(base)
            for _ in range(k // 2):
                copy[int(random.integers(0, len(copy)))] = "new"
            rows.append((n * 7 % 1009, " ".join(copy)))
            n += 1
    return rows + [(2000, None), (2001, ""), (5, "One"), (6, "one"), (None, "one"), (None, "nothing like it at all"), (7, rows[0][1]), (7, rows[0][1])]


@pytest.mark.parametrize("subtree, most", [(1024, 4096), (2, 4096), (2, 3)])
def test_components_against_all_pairs(spark, subtree, most):
    rows = documents()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    found = [tuple(r) for r in simhash.near_duplicates(docs, subtree=subtree, most=most).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(found, key=key) == sorted(plain_components(rows), key=key)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_first(spark):
    rows = documents()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, score string")
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_first(docs).collect()]
    want = {(d, t) for (d, t), (_, _, c) in zip(rows, plain_components(rows)) if d == c}
    assert sorted(map(str, kept)) == sorted(map(str, want))  # equal rows once; rows without an id also where none has one
    again = [(r["doc_id"], r["text"]) for r in simhash.keep_first(docs, listed=0).collect()]
    assert sorted(map(str, again)) == sorted(map(str, kept))


def test_copies_without_ids_and_rows_of_one_id(spark):
    some = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"thing{i}" for i in range(40))
    rows = [(None, some), (None, some), (3, other), (3, other), (3, some + " end"), (4, None), (None, "")]
    kept = [tuple(r) for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(None, some), (3, other), (3, some + " end"), (4, None)]))


@pytest.mark.parametrize("large", [10, 10**9])
def test_one_text_a_hundred_thousand_times(spark, large):
    """Many copies of one text, many rows of one id: the same whether told by the broadcast or by the join."""
    docs = spark.range(100_000).selectExpr("if(id < 50000, id, 60000) AS doc_id", "if(id % 3 = 0, 'the same text for all', concat('text ', id, ' of ', id * id, ' and ', hash(id))) AS text")
    found = simhash.near_duplicates(docs, large=large)
    assert found.count() == 100_000 and found.where("fingerprint = '0000000000000000'").count() == 0
    same = found.groupBy("fingerprint").count().orderBy("count", ascending=False).first()
    assert same["count"] >= 33_334 and found.where(found.fingerprint == same["fingerprint"]).agg({"component_id": "max"}).first()[0] == 0
