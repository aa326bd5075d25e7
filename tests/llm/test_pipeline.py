"""The pipeline's stages take effect, keep the columns of documents, and hold against plain versions."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest

from glosswork.llm import bpe


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("p") / name)
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    ids = [[r.doc_id for r in s.select("doc_id").collect()] for s in stages]
    assert all(set(b) <= set(a) for a, b in zip(ids, ids[1:], strict=False))
    assert 0.7 * len(ids[0]) < len(ids[1])  # clean documents stay
    texts = [r.text for r in stages[2].collect()]
    assert len({(t or "").translate({c: c + 32 for c in range(65, 91)}) for t in texts}) == len(texts)
    assert len(ids[3]) == len(set(ids[3])) and max(map(ids[4].count, set(ids[4]))) <= 2
    assert sorted(ids[4]) == sorted(ids[5])


def test_encoding_is_of_whole_texts(stages):
    codec = bpe.Codec(open(bpe.default_tokenizer(), encoding="utf-8").read())
    text = {r.doc_id: r.text for r in stages[4].collect()}
    for r in stages[5].collect():
        assert codec.decode(np.frombuffer(r.ids, "<u4")) == (text[r.doc_id] or "") and r.n_tokens * 4 == len(r.ids)


def test_stage_decodes(stages):
    text = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert rows and all(r.decoded_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest() for r in rows)


EDGE = "doc_id long, text string, lang string, source string, n_chars long, __id long, __sha string, kept boolean"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, tmp_path, name):
    """Nulls in every column, empty and very long texts, repeated ids and rows, clashing names, empty tables: each stage gives its defined result."""
    stage = dict(corpus_pipeline.STAGES)[name]
    (tmp_path / "labels.parquet").parent.mkdir(exist_ok=True)
    spark.createDataFrame([(3, 1, 0), (4, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    plain = " ".join(f"word{i}" for i in range(40))
    rows = [
        (None, None, None, None), (None, None, None, None), (1, "", "en", "a"), (1, plain, "en", "a"), (1, plain, "en", "a"), (2, plain.upper(), None, "b"),
        (3, plain + " more", "fr", None), (4, "long " * 60_000, "de", "a"), (5, "?!", "xx", "é"), (6, " ".join(f"x{i}" for i in range(30)), "en", "b"),
    ]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 7, "s", None) for r in rows], EDGE)
    out = stage(spark, docs, str(tmp_path))
    found = sorted(((r.doc_id or 0) for r in out.collect()))
    want = {
        "toxicity": [0, 0, 1, 1, 1, 2, 3, 4, 5, 6],  # too few labels: the prior rejects none
        "exact_dedup": [1, 2, 3, 4, 5, 6],
        "near_dedup": [0, 0, 1, 1, 4, 5, 6],
        "bpe": [0, 0, 1, 1, 1, 2, 3, 4, 5, 6],
        # Words by source: a 60,080, b 70, e-acute 1, null 41, so a budget of 90,288. All but a come to their bound, twice their own, and a gets the rest,
        # 90,064: all once, and of its second round the two texts of 40 words but not the one of 60,000, of which the border is in the first half.
        "mixing": [0, 0, 0, 0, 1, 1, 1, 1, 1, 2, 2, 3, 3, 4, 5, 5, 6, 6],
    }[name]
    assert found == want
    if name != "bpe":
        assert out.columns == docs.columns
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run_leaves_one_table(spark, sf, tmp_path):
    """The whole run: the tables of earlier stages are gone, only the last one that is read is there."""
    import os

    from glosswork.llm import common

    common.cleared()
    rows = corpus_pipeline.run(spark, sf)
    folder = spark.sql(f"DESCRIBE DATABASE {common._database(spark)}").filter("info_name = 'Location'").first()[1].removeprefix("file:")
    assert rows.count() > 0 and len(os.listdir(folder)) == 1
    common.cleared()
    assert os.listdir(folder) == []
