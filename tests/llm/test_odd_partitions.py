"""Tables with partitions that hold nothing to find."""

from parlance.llm import pii


def test_partitions_without_candidates(spark):
    docs = spark.createDataFrame([(1, "nothing here"), (2, "mail a@b.org now"), (3, None), (4, "")], "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["spans"] for r in pii.find(docs, pii.train(docs)).collect()}
    assert found == {1: "", 2: "email:5:12", 3: "", 4: ""}
