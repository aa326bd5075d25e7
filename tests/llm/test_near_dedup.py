import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glosswork.llm import near_dedup as nd


def bag(text):
    words = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").lower())
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def alike(a, b):
    shared = sum((a & b).values())
    return bool(a) and bool(b) and 5 * shared >= 4 * (sum(a.values()) + sum(b.values()) - shared)


def brute(rows):
    """Class (smallest id) of each row by holding every row against every other."""
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and alike(bags[i], bags[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, least[find(i)]) for i, (k, _) in enumerate(rows))


def test_signature_is_unbiased():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = [rng.choice(vocabulary) for _ in range(300)]
    base += base[:150]
    texts = [" ".join(base)]
    for k in (3, 12, 30):
        other = list(base)
        for _ in range(k):
            other[rng.randrange(len(other))] = rng.choice(vocabulary)
        texts.append(" ".join(other))
    hashes, counts, bounds = nd.multisets(*nd.lowered(pa.array(texts)))
    signatures = nd.bag_minhash(hashes, counts, bounds, 3000)
    bags = [bag(t) for t in texts]
    for i in range(1, 4):
        true = sum((bags[0] & bags[i]).values()) / sum((bags[0] | bags[i]).values())
        assert abs((signatures[0] == signatures[i]).mean() - true) < 0.04


@pytest.mark.parametrize("pivots", [1, 64])
def test_against_brute_force(spark, pivots):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 160))]
        for _ in range(rng.choice([1, 2, 3, 25])):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            base = words if rng.random() < 0.3 else base  # chains, whose ends are unlike
            rows.append((len(rows), " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1003, "One, two!"), (1004, "one two three"), (1005, "?!"), (1006, "te " * 4000), (1007, "te " * 4100)]
    df = spark.createDataFrame([(a, b, 0, "x") for a, b in rows], "doc_id long, text string, rid int, bands string")
    out = nd.near_duplicates(df, pivots=pivots).collect()
    assert sorted((r.doc_id, r.class_id) for r in out) == brute(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in out)


def test_edges(spark):
    schema = "doc_id long, text string, extra string"
    df = spark.createDataFrame([(1, "a b c d e f g", "p"), (1, "a b c d e f g", "q"), (2, "A b c d e f g!", "r"), (None, "z y x w v", "s"), (3, None, "t")], schema)
    out = nd.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.kept) for r in out) == [("1", "1", False), ("1", "1", True), ("2", "1", False), ("3", "3", True), ("None", "None", True)]
    left = nd.drop_near_duplicates(df).collect()
    assert sorted(str(r.doc_id) for r in left) == ["1", "3", "None"] and left[0].__fields__ == ["doc_id", "text", "extra"]
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.class_id) for r in nd.op6_near_dedup(spark, sf).collect()) == brute(rows)
    assert np.unique([k for _, k in brute(rows)]).size < len(rows)


def test_components(spark):
    rng = random.Random(8)
    for n, m, parts in ((60, 40, 5), (300, 290, 7), (5, 0, 2), (500, 499, 9)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if m != 499 else [(i, i + 1) for i in range(499)]
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        df = spark.createDataFrame(edges, "a long, b long").repartition(parts)
        assert {r.node: r.comp for r in nd.components(df).collect()} == {x: find(x) for e in edges for x in e}


def test_dropping_tells_texts_of_an_id_apart(spark):
    long = " ".join(f"w{i}" for i in range(60))
    near, other, third = long + " end", " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    rows = [(2, long), (5, other), (5, near), (None, third), (None, third + " end"), (None, "a b c d e f"), (7, third), (8, ""), (8, ""), (9, other + " 9 9"), (9, other + " 9 9")]
    left = nd.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted(((r.doc_id or 0), r.text) for r in left)
    assert len(found) == 6 and {(0, "a b c d e f"), (2, long), (5, other), (8, "")} <= set(found) and found.count((8, "")) == 2
    assert [t in (third, third + " end") for i, t in found if i == 0].count(True) == 1
    same = spark.createDataFrame([(3, long), (3, long), (3, other), (4, near)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in nd.drop_near_duplicates(same).collect()) == sorted([(3, long), (3, other)])


def test_repeated_rows_send_one_text(spark):
    """300 equal rows with a null id and one near copy are two nodes with one text each."""
    plain = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, plain)] * 300 + [(7, plain + " more")], "doc_id long, text string").repartition(6)
    rows = nd.near_duplicates(docs)
    assert rows.filter("kept").count() == 1 and {r.class_size for r in rows.collect()} == {301}
    texts = []
    real = nd.verify
    try:
        nd.verify = lambda pairs, some, *a: texts.append(some.count()) or real(pairs, some, *a)
        nd.near_duplicates(docs).count()
    finally:
        nd.verify = real
    assert texts and set(texts) == {2}


def test_nothing_is_left_but_the_result(spark, sf):
    """Tables of the rounds are dropped; the result's goes when it is cleared."""
    from glosswork.llm import common

    common.cleared()
    rows = nd.op6_near_dedup(spark, sf)
    folder = spark.sql(f"DESCRIBE DATABASE {common._database(spark)}").filter("info_name = 'Location'").first()[1].removeprefix("file:")
    assert len(os.listdir(folder)) == 1 and rows.count() > 0
    common.cleared()
    assert os.listdir(folder) == []
