"""Every registered query with SQL gives the SQL's rows; the engine stands without the training-data subpackage."""

import os
import subprocess
import sys

import duckdb
import pytest

from glosswork import queries as engine
from glosswork.operators import neural

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_equal_to_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(engine.ORACLE_SQL[name])
    want = rows_of([c[0] for c in found.description], found.fetchall())
    df = engine.QUERIES[name](spark, sf)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
    spark.catalog.clearCache()


def test_without_the_subpackage():
    code = """
import importlib.abc, sys
class No(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[0] == 'corpus_pipeline' or name.startswith('glosswork.llm'):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, No())
import __spark_entry__ as e
names = e.queries()
assert names and not any(n.startswith('op') or n == 'pipeline' for n in names) and set(e.oracle_sql()) <= set(names)
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_pairs_hold_whole_passages(spark, size):
    letters = [*"abcdefghijklmnopqrstuvwxyz.,"]
    vocabulary = {t: 4 + i for i, t in enumerate([*letters[:26], *("##" + c for c in letters[:26]), *letters[26:]])} | {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3}
    sf_dir = f"/root/testdata/{size}"
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    rows = engine.QUERIES["pair_encoding"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        whole = [p for w in neural.basic_tokens(texts[r.item_id] or "") for p in neural.pieces(w, vocabulary)]
        assert len(r.input_ids) == 512 and sum(r.token_type_ids) == len(whole) + 1
