import random

import numpy as np
import pytest

from glosswork.llm import bpe, packing


def plain_best_fit(sizes, width):
    """Every open row looked at for each piece; the fullest with room, the latest of equal ones."""
    free, rows = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in range(len(rows)) if free[r] >= sizes[i]]
        if fits:
            r = min(fits, key=lambda r: free[r])
        else:
            r = len(rows)
            rows.append([])
            free.append(width)
        rows[r].append(i)
        free[r] -= sizes[i]
    return sorted(free)


@pytest.mark.parametrize("width", [1, 7, 64, 100])
def test_best_fit(width):
    rng = random.Random(width)
    for _ in range(40):
        sizes = np.array([rng.randrange(1, width + 1) for _ in range(rng.randrange(1, 200))])
        rows = packing.best_fit_decreasing(sizes, width)
        assert sorted(i for row in rows for i in row) == list(range(len(sizes)))
        assert sorted(width - int(sizes[row].sum()) for row in rows) == plain_best_fit(sizes.tolist(), width)


def check(rows, want, width, end):
    """Documents put together again from packed rows."""
    parts = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == width and r.cu_seqlens[-1] == r.n_tokens <= width and (ids[r.n_tokens :] == end).all()
        assert r.position_resets == r.cu_seqlens[:-1] and np.flatnonzero(packing.position_ids(r.cu_seqlens) == 0).tolist() == r.position_resets
        for k, (doc, offset) in enumerate(zip(r.doc_ids, r.doc_offsets, strict=True)):
            parts.setdefault(doc, []).append((offset, ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()))
    assert {d: [t for _, p in sorted(x) for t in p] for d, x in parts.items()} == want


def test_query_is_lossless(spark, sf):
    codec = bpe.Codec(open(bpe.default_tokenizer(), encoding="utf-8").read())
    want = {r.doc_id: [*codec.encode(r.text or ""), 50256] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = packing.op1_packing(spark, sf).collect()
    check(rows, want, packing.WIDTH, 50256)
    assert sum(r.n_tokens for r in rows) > 0.97 * packing.WIDTH * (len(rows) - 4)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "hello world " * 50, 0)], "doc_id long, text string, ids int").coalesce(1)
    rows = packing.pack_documents(df, bpe.default_tokenizer(), width=16, block_tokens=40).collect()
    codec = bpe.Codec(open(bpe.default_tokenizer(), encoding="utf-8").read())
    check(rows, {1: [50256], 2: [50256], None: [*codec.encode("hello world " * 50), 50256]}, 16, 50256)
    assert len({r.pack_id for r in rows}) == len(rows)
    assert packing.pack_documents(df.limit(0), bpe.default_tokenizer()).count() == 0


def test_writer_and_manifest(spark, sf, tmp_path):
    packs = packing.op1_packing(spark, sf)
    manifest = packing.write_packs(packs, str(tmp_path / "out")).collect()
    back = spark.read.parquet(str(tmp_path / "out" / "packs"))
    rows = packs.agg({"n_tokens": "sum", "*": "count", "n_segments": "sum"}).first()
    assert sum(m.rows for m in manifest) == back.count() == rows["count(1)"]
    assert sum(m.tokens for m in manifest) == rows["sum(n_tokens)"] and sum(m.segments for m in manifest) == rows["sum(n_segments)"]
    assert all(m.width == packing.WIDTH and m.id_bytes == 2 for m in manifest) and len({m.shard for m in manifest}) == len(manifest)
