import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glosswork.operators import inference, rank


def pairs(spark, n, parts=1):
    return spark.range(0, n, 1, parts).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("id"), F.lit("q").alias("query"), F.expr("repeat('x', CAST(id % 200 AS INT))").alias("text"))


def plain(queries, texts):
    return [len(q) + 2.0 * len(t) for q, t in zip(queries, texts, strict=True)]


def test_batches_equal_single_calls(spark):
    """Full batches are of 32 pairs of like length, each task's rest is cut after them; scores are those of single calls; keys, repeats, nulls and extra columns."""
    rows = pairs(spark, 1000, 3).unionByName(spark.createDataFrame([(None, 1, None, None), (5, 2, "q", "same"), (5, 2, "q", "same")], "doc_id long, id int, query string, text string")).withColumn("score", F.lit("clash"))
    got = inference.scored_pairs(rows, lambda: plain, ["doc_id", "id"]).collect()
    want = Counter((r.doc_id, r.id, plain([r["query"] or ""], [r.text or ""])[0]) for r in rows.collect())
    assert Counter((r.doc_id, r.id, r.score) for r in got) == want
    assert {r.status for r in got} == {"batch"} and max(r.batch_size for r in got) == 32
    one = inference.scored_pairs(pairs(spark, 1000), lambda: plain, ["doc_id"]).collect()
    assert Counter(r.batch_size for r in one) == {32: 992, 8: 8}
    assert inference.scored_pairs(pairs(spark, 0), lambda: plain, ["doc_id"]).count() == 0


@pytest.mark.parametrize("how", ["raises", "short", "nan"])
def test_failing_batches_are_asked_by_pair(spark, how):
    def model(queries, texts):
        bad = [len(t) == 77 for t in texts]
        if any(bad) and how == "raises":
            raise ValueError
        scores = [float("nan") if b and how == "nan" else s for s, b in zip(plain(queries, texts), bad, strict=True)]
        return scores[:-1] if any(bad) and how == "short" else scores

    got = inference.scored_pairs(pairs(spark, 400), lambda: model, ["doc_id", "id"]).collect()
    failed = {r.doc_id for r in got if r.score is None}
    assert failed == {77, 277} == {r.doc_id for r in got if r.status == "failed"}
    assert all(r.status in ("batch", "single") and r.score == 1 + 2.0 * (r.doc_id % 200) for r in got if r.doc_id not in failed)
    assert any(r.status == "single" for r in got)


def test_late_models_are_given_up(spark):
    """Late calls are counted, then no more are made; the documents fall to the local ranking. So they do without a model."""

    def slow(queries, texts):
        time.sleep(3 if len(texts[0]) > 127 else 0)
        return plain(queries, texts)

    rows = pairs(spark, 400).withColumn("doc_id", F.floor(F.col("doc_id") / 200).cast("long"))
    scored = inference.scored_pairs(rows, lambda: slow, ["doc_id", "id"], seconds=0.5, patience=2).collect()
    counts = Counter(r.status for r in scored)
    assert counts["late"] == 64 and counts["given_up"] + counts["batch"] == 336 and counts["given_up"] > 0
    none = inference.scored_pairs(pairs(spark, 40), lambda: 1 / 0, ["doc_id"])
    assert {(r.status, r.score) for r in none.collect()} == {("given_up", None)}
    own = pairs(spark, 10).withColumn("id", F.lit(1))
    some = inference.scored_pairs(own, lambda: lambda q, t: plain(q, t) if len(t) == 1 and len(t[0]) < 5 else 1 / 0, ["doc_id", "id"])
    kept = rank.usable_neural(own, some.filter("score IS NOT NULL"), "doc_id", "id").collect()
    assert {r.doc_id: r.neural_score for r in kept} == {i: 1 + 2.0 * i if i < 5 else None for i in range(10)}


def test_answers():
    """Repeats after 429, 5xx and exceptions only; pauses grow."""
    pauses = []
    policy = inference.Policy(sleep=pauses.append)
    ok = '{"choices":[{"message":{"content":"yes"}}]}'

    def client(*answers):
        left = list(answers)

        def call(prompt, seconds):
            a = left.pop(0)
            if a is None:
                raise OSError
            return a

        return call

    assert inference.answered(client(None, (503, ""), (200, ok)), "p", policy) == ("ok", 3, "yes") and 1 <= pauses[0] < 1.5 and 2 <= pauses[1] < 2.5
    assert inference.answered(client((429, ""), (500, ""), None), "p", policy) == ("exhausted", 3, None)
    assert inference.answered(client((404, "")), "p", policy) == ("refused", 1, None)
    assert inference.answered(client((200, "")), "p", policy) == ("empty", 1, None)


def test_rate_is_kept(spark, tmp_path):
    """The gate's times by a clock of its own; prompts in lanes with few requests at once, each asked once though the answers are read twice."""
    now, waits = [0.0], []
    gate = inference._Gate(2.0, lambda: now[0], waits.append)
    for _ in range(3):
        gate.passed()
    now[0] = 10.0
    gate.passed()
    assert waits == [0.5, 1.0]
    log = str(tmp_path / "calls")

    def connect():
        import threading

        open_, most, lock = [0], [0], threading.Lock()

        def client(prompt, seconds):
            with lock:
                open_[0] += 1
                most[0] = max(most[0], open_[0])
            time.sleep(0.02)
            with lock:
                open_[0] -= 1
            with open(log, "a") as out:
                out.write(f"{prompt} {time.time()} {most[0]}\n")
            return 200, '{"choices":[{"message":{"content":"Sure: {\\"a\\":1}"}}]}'

        return client

    prompts = spark.range(40).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("prompt"))
    got = inference.asked(prompts, connect, inference.Policy(per_second=40.0, lanes=4, at_once=3))
    assert sorted((r.doc_id, r.status, r.calls, r.json) for r in got.collect()) == [(i, "ok", 1, '{"a":1}') for i in range(40)] and got.count() == 40
    calls = [line.split() for line in open(log)]
    assert sorted(int(p) for p, _, _ in calls) == list(range(40)) and max(int(m) for _, _, m in calls) <= 3
    times = [float(t) for _, t, _ in calls]
    assert max(times) - min(times) > 0.5
    assert inference.asked(prompts.limit(0), connect).count() == 0


def test_ruled_out(spark):
    short = spark.createDataFrame([(1, "P1-C1", 1, "claim")], "doc_id long, id string, rank int, reason string")
    row = inference.ranked_by_service(short, short, lambda: 1 / 0, api_key=" ").first()
    assert (row.backend, row.status, row.calls) == ("local", "skipped", 0)
