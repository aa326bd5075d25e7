"""Models and services that score texts: pairs in batches on workers, and prompts answered by a client.

Both are functions to plug in. A factory is called once in a worker process for a model and once in a task for a client, so neither
is sent with each row. What fails is marked row by row and falls back on the local ranking; it never fails the job.
"""

from __future__ import annotations

import math
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.operators import responses
from glosswork.session import shared_folder

Model = Callable[[list[str], list[str]], list[float]]
Client = Callable[[str, float], tuple[int, str]]
OUT_ROWS = 1024

#: The worker's model with its factory's token; another one replaces it, so a worker holds one at a time.
_model: list[tuple[str, Model]] = []


def _loaded(token: str, factory: Callable[[], Model]) -> Model:
    if not _model or _model[0][0] != token:
        _model[:] = [(token, factory())]
    return _model[0][1]


class Late(Exception):
    pass


def _within(seconds: float, call: Callable[[], list[float]]) -> list[float]:
    """The call's result; Late if it takes longer. Such a call is left to end in its own thread, which holds nobody up."""
    got: list = []

    def run() -> None:
        try:
            got.append((True, call()))
        except Exception as failed:
            got.append((False, failed))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not got:
        raise Late
    fine, value = got[0]
    if not fine:
        raise value
    return value


class _Scorer:
    """Scores of batches in one task. A batch that fails is asked again pair by pair; after some late calls no more are made."""

    def __init__(self, token: str, factory: Callable[[], Model], seconds: float, patience: int):
        self.token, self.factory, self.seconds, self.patience = token, factory, seconds, patience
        try:
            _loaded(token, factory)
        except Exception:
            # Without a model nothing is asked.
            self.patience = 0

    def call(self, pairs: list[tuple[str, str]]) -> list[float]:
        model = _loaded(self.token, self.factory)
        scores = [float(x) for x in _within(self.seconds, lambda: model([q for q, _ in pairs], [t for _, t in pairs]))]
        if len(scores) != len(pairs) or not all(map(math.isfinite, scores)):
            raise ValueError("a score for each pair was asked")
        return scores

    def late(self) -> None:
        self.patience -= 1
        # The late call may still use the model.
        _model.clear()

    def scored(self, pairs: list[tuple[str, str]]) -> list[tuple[float | None, str]]:
        if self.patience <= 0:
            return [(None, "given_up")] * len(pairs)
        try:
            return [(s, "batch") for s in self.call(pairs)]
        except Late:
            self.late()
            return [(None, "late")] * len(pairs)
        except Exception:
            return [self.single(p) for p in pairs]

    def single(self, pair: tuple[str, str]) -> tuple[float | None, str]:
        if self.patience <= 0:
            return None, "given_up"
        try:
            return self.call([pair])[0], "single"
        except Late:
            self.late()
            return None, "late"
        except Exception:
            return None, "failed"


def scored_pairs(pairs: DataFrame, factory: Callable[[], Model], keys: list[str], batch: int = 32, seconds: float = 8.0, patience: int = 3) -> DataFrame:
    """keys, score, status, batch_size of pairs (keys, query, text; null texts are empty), one row each.

    Batches are cut across keys from pairs of like length (powers of two), so little padding is wasted; a task holds fewer than `batch` pairs
    of each length. What is left at a task's end is cut in the order of length. Nothing is shuffled, so a key with very many
    pairs costs no more than others. status: batch, single (its batch failed), failed, late (over so many seconds), given_up (after
    `patience` late calls in the task, or where the model can't be loaded, which the time limit doesn't count). Scores other than "batch" and "single" are null; rank.usable_neural then leaves that key to the local ranking.
    """
    token = uuid.uuid4().hex
    rows = pairs.select(*keys, F.coalesce("query", F.lit("")).alias("query"), F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys), "score double, status string, batch_size int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(token, factory, seconds, patience)
        waiting: dict[int, list[tuple[tuple, str, str]]] = {}
        types: list[pa.Field] = []
        done: list[tuple] = []

        def answer(some: list[tuple[tuple, str, str]]) -> None:
            for (key, _, _), (score, status) in zip(some, scorer.scored([(q, t) for _, q, t in some]), strict=True):
                done.append((*key, score, status, len(some)))

        def out() -> pa.RecordBatch:
            fields = [*types, pa.field("score", pa.float64()), pa.field("status", pa.string()), pa.field("batch_size", pa.int32())]
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], f.type) for k, f in enumerate(fields)], schema=pa.schema(fields))
            done.clear()
            return made

        for found in batches:
            types = [found.schema.field(k) for k in keys]
            columns = [found.column(k).to_pylist() for k in keys]
            for *key, q, t in zip(*columns, found.column("query").to_pylist(), found.column("text").to_pylist(), strict=True):
                same = waiting.setdefault((len(q) + len(t)).bit_length(), [])
                same.append((tuple(key), q, t))
                if len(same) == batch:
                    answer(same)
                    same.clear()
                    if len(done) >= OUT_ROWS:
                        yield out()
        rest = [p for _, same in sorted(waiting.items()) for p in same]
        for k in range(0, len(rest), batch):
            answer(rest[k : k + batch])
            if len(done) >= OUT_ROWS:
                yield out()
        if done:
            yield out()

    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Policy:
    """How a service is asked: attempts with growing pauses and jitter, so many requests at once in a task, so many a second in all tasks together."""

    attempts: int = 3
    base: float = 1.0
    seconds: float = 45.0
    at_once: int = 4
    per_second: float | None = None
    lanes: int = 8
    sleep: Callable[[float], None] = time.sleep


class _Gate:
    """Lets calls of a task's threads pass at a rate."""

    def __init__(self, per_second: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.lock, self.free = (1 / per_second if per_second else 0.0), clock, sleep, threading.Lock(), 0.0

    def passed(self) -> None:
        if not self.gap:
            return
        with self.lock:
            now = self.clock()
            start = max(now, self.free)
            self.free = start + self.gap
        if start > now:
            self.sleep(start - now)


def answered(client: Client, prompt: str, policy: Policy, gate: _Gate | None = None) -> tuple[str, int, str | None]:
    """Status, number of calls and content: ok; empty (an answer without content); refused (an error that no repeat mends); exhausted (each attempt failed, be it by an exception)."""
    seen: list[int] = []

    def call() -> tuple[int, str]:
        if gate is not None:
            gate.passed()
        try:
            status, body = client(prompt, policy.seconds)
        except Exception:
            status, body = 599, ""
        seen.append(status)
        return status, body

    content = responses.retried(call, policy.attempts, policy.base, policy.sleep)
    last = seen[-1] if seen else 599
    return "ok" if content else "empty" if last < 400 else "exhausted" if last == 429 or last >= 500 else "refused", len(seen), content


def asked(prompts: DataFrame, factory: Callable[[], Client], policy: Policy = Policy(), key: str = "doc_id") -> DataFrame:
    """key, status, calls, json of prompts (key, prompt), asked once and kept: they are written to the shared folder before anything reads them, so only a lost task asks again.

    A rate is shared by dealing the prompts to lanes, each with its part of it: however many of them run at once, the sum stays below
    it. Answers come out in the order of prompts, and a task holds no more than twice its requests at once.
    """
    rows = prompts.select(key, "prompt")
    if policy.per_second:
        rows = rows.repartition(policy.lanes, key)
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, status string, calls int, json string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, gate = factory(), _Gate(policy.per_second / policy.lanes if policy.per_second else None)
        open_: deque = deque()
        made: pa.Schema | None = None

        def first() -> pa.RecordBatch:
            name, future = open_.popleft()
            status, calls, content = future.result()
            return pa.RecordBatch.from_pylist([{key: name, "status": status, "calls": calls, "json": responses.salvage(content) if content else None}], made)

        with ThreadPoolExecutor(policy.at_once) as pool:
            for found in batches:
                made = made or pa.schema([found.schema.field(key), pa.field("status", pa.string()), pa.field("calls", pa.int32()), pa.field("json", pa.string())])
                for name, prompt in zip(found.column(key).to_pylist(), found.column("prompt").to_pylist(), strict=True):
                    open_.append((name, pool.submit(answered, client, prompt or "", policy, gate)))
                    if len(open_) >= 2 * policy.at_once:
                        yield first()
            while open_:
                yield first()

    spark = prompts.sparkSession
    path = shared_folder(spark, "answers")
    rows.mapInArrow(run, schema).write.parquet(path)
    return spark.read.parquet(path)


def ranked_by_service(short: DataFrame, local: DataFrame, factory: Callable[[], Client], mode: str = "llm-first", api_key: str | None = None, titles: DataFrame | None = None, budgets: DataFrame | None = None, policy: Policy = Policy()) -> DataFrame:
    """doc_id, id, rank, reason, backend, status, calls: what the service chose from a document's shortlist, or the local ranking (doc_id, id, rank, reason).

    A document is the service's if its answer names at least one candidate of its own; all others are local, with the status
    and number of calls that led there. With a policy or key that rules the service out nothing is asked (status skipped).
    """
    plain = local.select("doc_id", "id", "rank", "reason")
    if responses.backend(mode, api_key) == "local":
        return plain.withColumns({"backend": F.lit("local"), "status": F.lit("skipped"), "calls": F.lit(0)})
    answers = asked(responses.ranking_prompts(short, titles, budgets), factory, policy)
    reasons = short.select("doc_id", "id", F.col("reason").alias("own"))
    chosen = responses.selections(answers.filter("json IS NOT NULL"), short).join(reasons, ["doc_id", "id"])
    chosen = chosen.select("doc_id", "id", "rank", F.coalesce(F.when(F.col("reason") != "", F.col("reason")), "own").alias("reason"), F.lit("external").alias("backend"))
    every = responses.with_fallback(chosen, plain.withColumn("backend", F.lit("local")))
    return every.join(answers.select("doc_id", "status", "calls"), "doc_id", "left").withColumns({"status": F.coalesce("status", F.lit("skipped")), "calls": F.coalesce("calls", F.lit(0))})
