"""Chat formatting: round trips, escapes, ties, nulls."""

import hashlib
import itertools

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mosaiq.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string"
PARTS = ["<", "s>", "</s>", "[INST]", "[/INST]", "\\", "[NEXT]", "[ROLE]", "[/ROLE]", "<s>", "[", "INST]", "x", " ", "\n", "/", "é"]


def back(spark, rows):
    out = cf.format_conversations(spark.createDataFrame(rows, SCHEMA))
    got = out.select("conv_id", "formatted", cf.parse_formatted(F.col("formatted")).alias("t"), F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: cf.unescape(s["piece"])).alias("l"), F.array_join(F.col("segments")["piece"], "").alias("j"))
    return {r["conv_id"]: r for r in got.collect()}


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "[NEXT]", "", "a\\b<s>"]), st.lists(st.sampled_from(PARTS), max_size=6).map("".join)), min_size=1, max_size=6))
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_round_trip(spark, turns):
    r = back(spark, [(1, i, role, text) for i, (role, text) in enumerate(turns)])[1]
    assert [tuple(x) for x in r["t"]] == turns
    assert r["l"] == [t for role, t in turns if role == "assistant"]
    assert r["j"] == r["formatted"]


def test_all_pairs_of_control_strings(spark):
    rows = [(k, i, "assistant", a + b) for k, (a, b) in enumerate(itertools.product(PARTS, PARTS)) for i in range(2)]
    for k, r in back(spark, rows).items():
        assert [x["text"] for x in r["t"]] == r["l"] == [rows[2 * k][3]] * 2


def test_nulls_ties_repeats(spark):
    rows = [(1, 5, "user", None), (1, 5, "assistant", "b"), (1, 5, "assistant", "a"), (1, None, None, "first"), (1, 7, "user", "x"), (1, 7, "user", "x"), (None, 0, "user", "n")]
    got = back(spark, rows)
    assert [tuple(x) for x in got[1]["t"]] == [("", "first"), ("assistant", "a"), ("assistant", "b"), ("user", ""), ("user", "x"), ("user", "x")]
    assert got[1]["formatted"].count("[INST]") == 1
    assert [tuple(x) for x in got[None]["t"]] == [("user", "n")]


def test_digest(spark):
    df = spark.createDataFrame([(3, 1, "assistant", "two", "e"), (3, 0, "user", "one", "e")], SCHEMA + ", formatted string")
    got = {r["conv_id"]: r for r in cf.digest(df).collect()}
    assert set(got) == {3, -1}
    assert got[3]["turns_sha256"] == hashlib.sha256(b"user\none\nassistant\ntwo\n").hexdigest()
    assert (got[3]["n_turns"], got[3]["loss_chars"], got[3]["loss_sha256"]) == (2, 3, hashlib.sha256(b"two").hexdigest())
    assert got[-1]["loss_chars"] == len("</s>[INST] ok [/INST]")
    assert set(r["conv_id"] for r in cf.digest(df.limit(0)).collect()) == {-1}


def test_a_conversation_of_many_turns(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"t{i}") for i in range(3000)]
    r = back(spark, rows)[1]
    assert len(r["t"]) == 3000 and len(r["l"]) == 1000
