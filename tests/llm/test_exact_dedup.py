import hashlib
import random

import numpy as np
import pytest

from glosswork.llm import exact_dedup as ed


def test_filters_merge_losslessly():
    rng = random.Random(1)
    values = [rng.getrandbits(64) for _ in range(3000)]
    rows = values + [rng.choice(values) for _ in range(5000)] + [0, 0, 2**64 - 1]
    parts = [np.array(rows[i::7], np.uint64) for i in range(7)]
    merged = ed.CountingQuotientFilter.of(parts[0])
    for p in parts[1:]:
        merged = merged.merge(ed.CountingQuotientFilter.loads(ed.CountingQuotientFilter.of(p).dumps()))
    want, counts = np.unique(np.array(rows, np.uint64), return_counts=True)
    assert all((x == y).all() for x, y in zip(merged.sorted(), (want, counts), strict=True))
    assert merged.count(0) == 2 and merged.count(12345) == 0
    assert all(merged.count(int(v)) == n for v, n in zip(want, counts, strict=True))


@pytest.mark.parametrize("bits", [3, 8, 12, 40])
def test_crowded_filters(bits):
    """Long clusters, runs at both ends of the table, every fingerprint of a small range."""
    rng = np.random.default_rng(bits)
    for n in (0, 1, 2, 7, 200, 3000):
        rows = np.minimum((rng.random(n) ** 8 * (1 << bits)).astype(np.uint64), np.uint64((1 << bits) - 1))
        one = ed.CountingQuotientFilter.loads(ed.CountingQuotientFilter.of(rows[: n // 3], bits).dumps())
        both = one.merge(ed.CountingQuotientFilter.of(rows[n // 3 :], bits))
        want, counts = np.unique(rows, return_counts=True)
        assert all((x == y).all() for x, y in zip(both.sorted(), (want, counts), strict=True))
        assert all(both.count(v) == n for v, n in zip(want.tolist(), counts, strict=True))
        assert both.remainders.max(initial=0) < 1 << (bits - both.quotient_bits)
        assert not (both.continuation & (both.counts == 0)).any() and both.occupied.sum() == ((both.counts > 0) & ~both.continuation).sum()


def test_blocks_and_joins_without_broadcasts(spark, sf, monkeypatch):
    """Many blocks, and every join shuffled: the same rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(tuple, ed.exact_duplicates(docs).collect()))
    kept = sorted(r.doc_id for r in ed.drop_duplicates(docs).collect())
    monkeypatch.setattr(ed, "PER_BLOCK", 1)
    monkeypatch.setattr(ed, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ed, "HOT", 1)
    assert sorted(map(tuple, ed.exact_duplicates(docs).collect())) == want
    assert sorted(r.doc_id for r in ed.drop_duplicates(docs).collect()) == kept == [i for i, *_, k, _ in want if k]


def brute(rows):
    norm = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "") for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, norm, strict=True):
        groups.setdefault(t, []).append(i)
    return sorted((i, max(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm, strict=True))


def test_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = ed.op2_exact_dedup(spark, sf).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out)


def test_edges_and_hot_group(spark):
    rows = [(i, "Same Text" if i % 3 else f"own {i}") for i in range(300)] + [(1000, None), (1001, ""), (1002, "É"), (1003, "é"), (1004, "x" * 200_000), (1005, "X" * 200_000)]
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, rid int, kept string")
    out = ed.exact_duplicates(df).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == brute(rows)
    assert sorted(r.doc_id for r in ed.drop_duplicates(df).collect()) == sorted({k for _, k, _, _ in brute(rows)})
    again = spark.createDataFrame([(5, "a"), (5, "A"), (5, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    got = ed.exact_duplicates(again).collect()
    assert sum(r.kept for r in got) == 2 and all(r.keep_id == 5 for r in got if r.group_size == 4)
    assert ed.drop_duplicates(again).count() == 2
    assert ed.exact_duplicates(df.limit(0)).count() == 0
