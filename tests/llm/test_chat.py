import hashlib
import random

from pyspark.sql import functions as F

from glosswork.llm import chat


def test_round_trip(spark):
    rng = random.Random(2)
    pieces = ["\\", "###", "#", "</turn>", " </turn>\n", "### User: ", "\\h", "\\t", "\\\\", "a", "\n", "é", ": ", "<", "😀"]
    rows, want = [], {}
    for conv in range(200):
        turns = []
        for k in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", "User", "tool: x\\c", ""])
            text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 12)))
            turns.append((role, text))
            rows.append((conv, k, role, text))
        want[conv] = turns
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = chat.format_conversations(df).select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.trained_text(F.col("segments")).alias("trained"), chat.read_trained(F.col("formatted"), F.col("loss_spans")).alias("back")).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in out} == want
    assert all(r.trained == r.back == "".join(t for role, t in want[r.conv_id] if role == "assistant") for r in out)


def test_machine(spark):
    roles = {1: ["user", "assistant"], 2: ["system", "user", "assistant", "user"], 3: ["assistant", "user"], 4: ["user", "user", "assistant"], 5: ["user", "system", "user", "assistant"]}
    df = spark.createDataFrame([(c, i, r, "x") for c, rs in roles.items() for i, r in enumerate(rs)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.violation for r in chat.format_conversations(df).collect()}
    assert got == {1: None, 2: 4, 3: 0, 4: 1, 5: 1}


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, segments int"
    rows = [(1, None, None, None, "", 0), (1, 0, "user", "b", "", 0), (1, 0, "user", "b", "", 0), (None, 5, "assistant", "z" * 100_000, "", 0)]
    out = {r.conv_id: r for r in chat.digests(spark.createDataFrame(rows, schema)).collect()}
    assert out[1].n_turns == 3 and out[1].loss_chars == 0 and out[None].loss_chars == 100_000
    assert out[1].turns_sha256 == hashlib.sha256(b"\n\nuser\nb\nuser\nb\n").hexdigest()
    assert chat.digests(spark.createDataFrame([], schema)).count() == 0


def test_native_plan(spark, sf):
    plan = chat.op3_chat(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))
