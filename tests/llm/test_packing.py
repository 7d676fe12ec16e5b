import random

from pyspark.sql import functions as F

from parlance.llm import packing


def plain(pieces, capacity):
    """The tightest compatible bin by looking at every bin; ties to the older one."""
    bins, out = [], []
    for length, source, cluster in pieces:
        fit = [(b["free"], i) for i, b in enumerate(bins) if b["free"] >= length and not (source and source in b["s"]) and not (cluster and cluster in b["c"])]
        if fit:
            i = min(fit)[1]
        else:
            i = len(bins)
            bins.append({"free": capacity, "s": set(), "c": set()})
        bins[i]["free"] -= length
        bins[i]["s"].add(source)
        bins[i]["c"].add(cluster)
        out.append(i)
    return out


def test_place_against_all_bins():
    dice = random.Random(2)
    for _ in range(40):
        pieces = sorted([(dice.randint(0, 60), 1 << dice.choice([0, 0, 0, 1, 2, 3]), dice.choice([0, 0, 1, 2, 4])) for _ in range(200)], reverse=True)
        assert packing.place(pieces, 100) == plain(pieces, 100)


def check(rows, docs, capacity):
    by_bin, by_doc = {}, {}
    for r in rows:
        by_bin.setdefault(r["bin_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    info = {d: (len((t or "").split()), s, (t or "").lower().split()) for d, t, s in docs}
    for own in by_bin.values():
        assert sum(r["end"] - r["start"] for r in own) == own[0]["bin_words"] <= capacity
        assert sorted(r["position"] for r in own) == list(range(len(own)))
        named = [info[r["doc_id"]] for r in own]
        sources = [s for _, s, _ in named if s is not None]
        assert len(sources) == len(set(sources))
        texts = [tuple(w) for _, _, w in named if w]
        assert len(texts) == len(set(texts))
    for d, (n, _, _) in info.items():
        spans = sorted(by_doc[d])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_pack_keeps_every_word_once_and_no_conflict(spark):
    dice = random.Random(3)
    docs = [(i, " ".join(["W" if i % 2 else "w"] * dice.choice([0, 1, 5, 20, 30, 50, 130])) + f" x{i % 90}", dice.choice(["hot", "hot", "a", "b", "c", None])) for i in range(400)]
    docs += [(1000, None, "a"), (1001, "", None), (1002, "long " * 1000, "b")]
    df = spark.createDataFrame([(d, t, s, "z") for d, t, s in docs], "doc_id long, text string, source string, bin_id string")
    for shard in (4096, 50):
        check(packing.pack(df, capacity=64, shard=shard).collect(), docs, 64)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b", "s"), (None, "a b", "s"), (1, "c", "s"), (1, "c", "s")], "doc_id long, text string, source string")
    rows = packing.pack(df, capacity=8).collect()
    assert len(rows) == 4 and len({r["bin_id"] for r in rows}) == 4
    assert packing.pack(df.where("doc_id = 5")).count() == 0


def test_one_row_a_hundred_thousand_times(spark):
    """Equal rows, with and without an id, are dealt over all shards and all placed."""
    docs = spark.range(100_000).selectExpr("if(id % 2 = 0, 5L, NULL) AS doc_id", "'some words here' AS text", "NULL AS source")
    bins = packing.pack(docs, shard=1000)
    assert bins.count() == 100_000
    shards = bins.groupBy(F.substring_index("bin_id", "-", 1).alias("s")).count()
    assert shards.count() == 100 and shards.agg(F.max("count")).first()[0] <= 1100
