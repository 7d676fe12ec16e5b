import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest
from parlance.llm import binary_packing, queries
from parlance.llm.common import tokenizer
from tokenizers import Tokenizer

PATH = "byte_bpe_50k.json"


@cache
def library():
    found = Tokenizer.from_file(tokenizer(PATH))
    found.encode_special_tokens = True
    return found


def ids_of(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, capacity):
    """Pieces of one document: whole, in order, of lengths that are powers of two, alone in their sequences."""
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at and r["offset"] == 0 and r["length"] <= capacity and bin(r["length"]).count("1") == 1
        assert 1 << (r["sequence_id"] & 31) == r["length"] == 1 << (r["batch_id"] & 31)
        at += r["length"]
    total = rows[0]["doc_tokens"]
    assert at == total and len(rows) == total // capacity + bin(total % capacity).count("1")


@pytest.mark.parametrize("capacity", [1, 8, 1024])
def test_pieces_give_back_every_id(spark, capacity):
    texts = ["", None, "one", "two words here", "<|endoftext|> " * 40, "é" * 1500, "same", "same"]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, start string, length int")
    found = binary_packing.pack(df.repartition(3), tokenizer(PATH), capacity, batch_tokens=16).collect()
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
    for i, text in enumerate(texts):
        check(by_doc[i], capacity)
        assert b"".join(bytes(r["tokens"]) for r in sorted(by_doc[i], key=lambda r: r["start"])) == np.array(ids_of(text), "<u4").tobytes()
    assert len({r["sequence_id"] for r in found}) == len(found)
    batches = defaultdict(list)
    for r in found:
        batches[r["batch_id"]].append(r["length"])
    assert all(len(set(own)) == 1 and (sum(own) <= 16 or len(own) == 1) for own in batches.values())


def test_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "x"), (None, None)], "doc_id long, text string")
    found = binary_packing.pack(df, tokenizer(PATH)).collect()
    assert sorted((r["doc_id"] or 0, r["start"], r["length"]) for r in found) == [(0, 0, 1), (0, 0, 2), (1, 0, 4), (1, 0, 4)]
    assert binary_packing.pack(df.where("false"), tokenizer(PATH)).collect() == []
    with pytest.raises(ValueError):
        binary_packing.pack(df, tokenizer(PATH), 1000)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    by_doc = defaultdict(list)
    for r in queries.op13_binary_packing(spark, sf).collect():
        by_doc[r["doc_id"]].append(r)
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(by_doc) == len(rows)
    for doc_id, text in rows:
        ids = np.array(ids_of(text), "<u4")
        check(by_doc[doc_id], 1024)
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in by_doc[doc_id])
