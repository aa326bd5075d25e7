import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from glosswork.llm import bloom, phrases

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def brute(rows, least=10, top=2000, percent=50):
    counts, out = {}, []
    for lang, text in rows:
        f = counts.setdefault("und" if lang is None else lang, collections.Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = tuple(re.findall("[^ \t]+", piece))
            f.update(words[i : i + k] for k in (1, 2, 3) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        many = {p: v for p, v in f.items() if len(p) > 1 and v >= least}
        longer = collections.Counter()
        for p, v in many.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], v)
        scored = []
        for p, a in many.items():
            if len(p) == 2 and 100 * longer[p] >= percent * a and longer[p]:
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def texts(seed, n):
    """Words of Zipf's law with fixed phrases, odd blanks and signs, and words that hold characters below the blank."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["a\x01", "a", "É", "é", "(x)", "\u00a0", "'s", "ΑΒΓ", "x" * 300]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    for _ in range(n):
        words = rng.choices(vocabulary, weights, k=rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words) + 1) : 0] = rng.choice([["New", "York", "City"], ["new", "york"], ["a\x01", "b"], ["a", "b"], ["la", "la", "la", "la"]])
        yield rng.choice(["en", "en", "fr", None, "und", ""]), "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n"]) for w in words)


def found(docs, **options):
    return sorted(map(tuple, phrases.collocations(docs, **options).collect()))


@pytest.fixture(scope="module")
def rows():
    return [*texts(1, 500), (None, None), ("en", ""), ("en", "..."), ("de", "solo"), ("xx", "go " * 20_000)]


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame([(lang, text, 1, "k") for lang, text in rows], "lang string, text string, f long, part string").repartition(5)


@pytest.mark.parametrize("options", [{}, {"least": 2, "top": 7}, {"least": 3, "percent": 90}])
def test_against_brute_force(docs, rows, options):
    assert found(docs, **options) == brute(rows, **options)
    assert found(docs.limit(0)) == []


@pytest.mark.parametrize("limit", [0, 1, 25])
def test_large_dictionaries(docs, rows, limit, monkeypatch):
    """Most words and bigrams above the bound: ids by a join, trigrams by a Bloom filter, the same rows."""
    assert found(docs, least=3, limit=limit) == brute(rows, least=3)
    monkeypatch.setattr(phrases, "FILTER_KEYS", 3)  # an overfull filter lets more through, which is then counted
    assert found(docs, least=3, limit=limit) == brute(rows, least=3)


def test_slices(docs, rows, monkeypatch):
    """Long texts are cut where pieces end; short chunks of ids change nothing."""
    monkeypatch.setattr(phrases, "SLICE", 50)
    body, offsets = np.frombuffer(("a b" * 100 + "." + "c d. e" * 50).encode(), np.uint8), np.array([0, 601])
    parts = [bytes(b) for b, *_ in phrases.cut(body, offsets)]
    assert b"".join(parts) == bytes(body) and len(parts) > 3 and all(p.endswith(b".") for p in parts[:-1])


def test_runs_of_wide_ids():
    rng = np.random.default_rng(1)
    for high in (5, 1 << 30):
        keys = [rng.integers(1, high, 3000) for _ in range(3)]
        keys = [np.concatenate([k, k[:1000]]) for k in keys]
        parts, counts = phrases.runs(keys)
        want = collections.Counter(zip(*(k.tolist() for k in keys), strict=True))
        assert list(zip(*(p.tolist() for p in parts), strict=True)) == sorted(want) and counts.tolist() == [want[k] for k in sorted(want)]
        assert [bytes(x) for x in phrases.packed(parts)] == sorted(bytes(x) for x in phrases.packed(parts))


def test_run_lengths_over_batches():
    """Runs that cross batches, single rows and empty batches."""
    keys = [bytes([0] * 11 + [k]) for k in (1, 1, 2, 3, 3, 3, 3, 9)]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i:j], pa.binary()), pa.array([4] * (j - i), pa.int64())], ["key", "f"]) for i, j in ((0, 1), (1, 1), (1, 4), (4, 5), (5, 8))]
    out = [tuple(r.values()) for b in phrases._run_lengths(8)(iter(batches)) for r in b.to_pylist()]
    assert out == [(0, 0, 1, 8), (0, 0, 3, 16)]


def test_scores_past_64_bits(spark):
    """a * a * 10**6 of counts above 2**32."""
    a, left, right = 5_000_000_000, 6_000_000_000, 7_000_000_001
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").selectExpr("cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * cast(1000000 as decimal(7,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) AS s").first()
    assert row.s == 10**6 * a * a // (left * right)
    assert bloom.shape(phrases.FILTER_KEYS, 0.02)[0] <= bloom.MOST_BITS * 1.1
