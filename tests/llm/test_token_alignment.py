import hashlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from parlance.llm import queries, token_alignment, tokens
from parlance.llm.common import tokenizer
from tokenizers import Tokenizer

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
TEXTS = [
    "Hello world, hello!", "", None, "   leading and trailing  ", "a▁b", "<|endoftext|> is text <s> </s> <unk>", "éè \U0001f600 你好 \x00\t\r\n x", "Hello world, hello!",
    "x" * 300, " ".join(f"w{i}" for i in range(400)), "▁", " ", "<0x41> byte", "ﬁ ｆull", "a  b   c\n\n\nd",
]


@cache
def libraries():
    a, b = Tokenizer.from_file(tokenizer(A)), sentencepiece.SentencePieceProcessor(model_file=tokenizer(B))
    a.encode_special_tokens = True
    return a, b


@cache
def byte_level_bytes(token):
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in keep)}
    return bytes(table[c] for c in token)


def brute(texts):
    """The contract's columns with plain loops over the libraries' output."""
    a_model, b_model = libraries()
    docs = []
    for text in texts:
        groups = []
        if text:
            whole = (" " + text).encode()
            a = [(i, byte_level_bytes(a_model.id_to_token(i))) for i in a_model.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()) for i in b_model.encode(text)]
            if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
                own_a, own_b = [], []
                at_a = at_b = 0
                while a or b or own_a:
                    if at_a <= at_b and a:
                        i, x = a.pop(0)
                        own_a, at_a = [*own_a, i], at_a + len(x)
                    else:
                        i, x = b.pop(0)
                        own_b, at_b = [*own_b, i], at_b + len(x)
                    if at_a == at_b:
                        groups.append((own_a, own_b))
                        own_a, own_b = [], []
        docs.append(groups)
    counts = Counter(p for groups in docs for p in {(i, j) for x, y in groups for i in x for j in y})
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for groups in docs:
        links = [(i, j) for x, y in groups for i in x for j in y]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("block", [1 << 23, 50])
def test_against_plain_loops(spark, block):
    df = spark.createDataFrame([(i if i % 5 else None, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, block string, a int")
    found = token_alignment.digest(df.repartition(3), tokenizer(A), tokenizer(B), block).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in found) == sorted(brute(TEXTS))
    assert Counter(r["doc_id"] for r in found) == Counter(i if i % 5 else None for i in range(len(TEXTS)))


def test_small_steps_of_links_and_long_texts(spark, monkeypatch):
    long = "y" * 700 + " " + " ".join(f"word{i} été, " for i in range(300))
    one = token_alignment.Aligned([long, "z z"], tokenizer(A), tokenizer(B))
    whole = one.pairs()
    monkeypatch.setattr(token_alignment, "LINKS", 7)
    assert all((x == y).all() for x, y in zip(whole, one.pairs()))
    monkeypatch.setattr(tokens, "LONG", 50)
    monkeypatch.setattr(tokens.parts, "__defaults__", (50,))
    parts = token_alignment.Aligned([long, "z z"], tokenizer(A), tokenizer(B))
    assert len(tokens.parts(long)) > 10 and (parts.a == one.a).all() and (parts.b == one.b).all()


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.digest(empty, tokenizer(A), tokenizer(B)).collect() == []
    assert token_alignment.align(empty, tokenizer(A), tokenizer(B)).collect() == []


def test_groups_give_back_the_texts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    a = tokens.byte_level(tokenizer(A))
    for r in token_alignment.align(df, tokenizer(A), tokenizer(B)).collect():
        assert (sum(r["a_sizes"]), sum(r["b_sizes"])) == (len(r["a_ids"]), len(r["b_ids"]))
        if r["a_ids"]:
            assert b"".join(a.bytes[i] for i in r["a_ids"]).decode() == " " + TEXTS[r["doc_id"]]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    found = queries.op12_bitset_alignment(spark, sf).toPandas().sort_values("doc_id")
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert found["doc_id"].tolist() == [r[0] for r in rows]
    assert [tuple(r) for r in found[COLUMNS].itertuples(index=False)] == brute([r[1] for r in rows])


def test_ids_are_the_library_s():
    """Every code point by both ways of encoding."""
    own, library = tokens.ByteLevel(tokenizer(A)), libraries()[0]
    assert own.engine is not None
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    # 64 points a text, each beside letters, digits, spaces and its neighbour
    texts = ["".join(f"a{chr(c)}b1 {chr(c)}" for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    assert all(x.tolist() == e.ids for x, e in zip(own(texts), library.encode_batch_fast(texts, add_special_tokens=False)))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab Z9'sté你\n\t <|endoftext|>!▁"), max_size=60))
def test_any_text_has_the_library_s_ids(text):
    own, library = tokens.byte_level(tokenizer(A)), libraries()[0]
    assert own([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bitsets():
    marked = np.sort(np.random.default_rng(1).choice(1000, 300, replace=False))
    bits = token_alignment.Bits.marking(marked, 1000)
    assert (bits.places() == marked).all()
    assert (bits.rank(np.arange(1000)) == np.searchsorted(marked, np.arange(1000), "right")).all()


def test_decimals():
    shown, width = token_alignment.decimals(12345)
    assert all(bytes(shown[i, : width[i]]).decode() == str(i) for i in (0, 9, 10, 99, 100, 999, 1000, 12344))
