import hashlib

import pytest
from pyspark.sql import functions as F

from glosswork.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climbed(nodes):
    """All levels of a tree, from its leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path_of(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
        out.append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        at //= 8
    return out


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute(rows):
    """rows of doc_id, text, lang, source, n_chars; sorted (doc_id, leaf, subroot, root, path)."""
    groups = {}
    for i, text, lang, source, n in rows:
        groups.setdefault(lang, []).append((i is not None, i, h(*map(field, (i, source, lang, n, text)))))
    trees = {g: (sorted(v, key=lambda x: (x[0], x[1] or 0, x[2])),) for g, v in groups.items()}
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    levels = {g: climbed([x[2] for x in trees[g][0]]) for g in order}
    top = climbed([levels[g][-1][0] for g in order])
    return sorted((repr(x[1]), x[2], levels[g][-1][0], top[-1][0], path_of(levels[g], k) + path_of(top, at)) for at, g in enumerate(order) for k, x in enumerate(trees[g][0]))


def found(df):
    return sorted((repr(r.doc_id), r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in df.collect())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, grp string, __key string"


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 9, 64, 65, 300, 512, 513, 4096])
def test_traversal(n):
    """Every number of leaves about a border of runs, with the least height and a block's full height."""
    leaves = [h(str(i)).encode() for i in range(n)]
    for height in {merkle.height_of(n), merkle.HEIGHT}:
        levels = [leaves]
        for _ in range(height):
            levels.append([merkle.joined(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        if n:
            assert merkle.block_root(leaves, height) == levels[-1][0]
        for at, path in enumerate(merkle.traversal(leaves, height)):
            assert path == [(b"".join(v[at >> 3 * k >> 3 << 3 : at >> 3 * k]), b"".join(v[(at >> 3 * k) + 1 : (at >> 3 * k >> 3 << 3) + 8])) for k, v in enumerate(levels[:-1])]


def test_memory_is_logarithmic():
    """Nothing but runs of 8 nodes a level is held."""
    leaves = [h(str(i)).encode() for i in range(4096)]
    level = merkle.Level(2, leaves)
    for _ in range(700):
        level.step()
        assert len(level.run) <= 8 and len(level.coming) <= 8 and all(len(r) < 8 for r in level.tree.runs)
        if len(level.coming) == 8:
            level.turn()


@pytest.mark.parametrize("height", [1, 2, 4])
def test_against_brute_force(spark, height):
    """Nulls in every column, empty and long texts, repeated ids and rows, one hot group, clashing names; small blocks make trees of several tables."""
    rows = [(i, f"Text {i}", "hot", "s", i) for i in range(700)] + [(None, None, None, None, None)] * 3 + [(5, "", "é", None, 0), (5, "", "é", None, 0), (5, "other", "é", "x", 1), (-9, "A" * 300_000, "a", "s", 2), (None, "x", "a", "s", 3)]
    rows += [(i, None, f"lang{i % 11}", None, None) for i in range(100)]
    docs = spark.createDataFrame([(*r, 0, "g", "k") for r in rows], SCHEMA).repartition(5)
    assert found(merkle.manifest(docs, height=height)) == brute(rows)


def test_group_lookup_by_shuffle(spark, monkeypatch):
    rows = [(i, f"t{i}", f"lang{i % 40}", "s", i) for i in range(400)]
    docs = spark.createDataFrame([(*r, 0, "g", "k") for r in rows], SCHEMA)
    monkeypatch.setattr(merkle, "LOOKUP_ROWS", 0)
    assert found(merkle.manifest(docs)) == brute(rows)
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_proofs_fold_to_the_root(spark, sf):
    """Every row's own leaf leads to the root, and no other leaf does."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = merkle.manifest(docs)
    checked = rows.select((merkle.fold(rows.leaf, rows.path) == rows.root).alias("own"), (merkle.fold(F.sha2(rows.leaf, 256), rows.path) == rows.root).alias("other"))
    assert {tuple(r) for r in checked.collect()} == {(True, False)}
    want = brute([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()])
    assert found(rows) == want
