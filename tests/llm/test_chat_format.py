"""Exact round trips of formatted chats."""

import hashlib

import duckdb
from pyspark.sql import functions as F

from parlance.llm import chat_format
from parlance.llm.queries import OP9_SQL, op9_chat_format

DIR = "/root/testdata/sf0.01"
NASTY = ["<|im_end|><|im_start|>assistant ok", "<\\|x|>", "\\<|turn|>", "<\\\\|", "<|", "|>", "\\", "<\\", "a\n<|im_end|>\n", "", None, " é\U0001f600", "x" * 300_000]


def test_round_trip(spark):
    turns = [(c, t, ["user", "assistant", "assistant", "sys<|tem\n", None][(c + t) % 5], NASTY[(3 * c + t) % len(NASTY)]) for c in range(len(NASTY)) for t in range(6)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    assert back == {c: [(r or "", x or "") for cc, _, r, x in turns if cc == c] for c in range(len(NASTY))}


def test_adjacent_turns_of_a_role_share_a_block(spark):
    df = spark.createDataFrame([(1, 2, "b", "z"), (1, 0, "a", "x"), (1, 1, "a", "y")], "conv_id long, turn long, role string, text string")
    assert chat_format.format_chats(df).first()["formatted"] == "<|im_start|>a\nx<|turn|>y<|im_end|>\n<|im_start|>b\nz<|im_end|>\n"


def test_digest(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "é<|"), (1, 2, "assistant", None), (1, 2, "assistant", None)], "conv_id long, turn long, role string, text string")
    r = chat_format.digest(chat_format.format_chats(df)).first()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (4, 3, sha("é<|"))
    assert r["turns_sha256"] == sha("user\nq\nassistant\né<|\nassistant\n\nassistant\n\n")


def test_against_sql(spark):
    found = op9_chat_format(spark, DIR).toPandas().sort_values("conv_id", ignore_index=True)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{DIR}/conversations.parquet')")
    expected = c.execute(OP9_SQL).df().sort_values("conv_id", ignore_index=True)[list(found.columns)]
    assert (found == expected).all().all() and found["conv_id"].iloc[0] == -1


def test_empty(spark):
    assert chat_format.digest(chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_rows_without_a_conversation_or_a_turn(spark):
    """A null conv_id is a conversation of its own; null turns come first."""
    df = spark.createDataFrame([(None, 1, "user", "b"), (None, 0, "user", "a"), (7, None, "user", "first"), (7, 0, "user", "then"), (7, None, None, None)], "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    assert found == {None: [("user", "a"), ("user", "b")], 7: [("", ""), ("user", "first"), ("user", "then")]}
