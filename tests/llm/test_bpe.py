import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from glosswork.llm import bpe


@pytest.fixture(scope="module")
def both():
    path = bpe.default_tokenizer()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return bpe.Codec(open(path, encoding="utf-8").read(), leaf_chars=5, long_bytes=64, leaf_bytes=16), library


TEXTS = [
    "", " ", "a", "x" * 5000, "ab" * 3000, " " * 3000 + "x" + "\n" * 999, "<|endoftext|>", "a<|endoftext|> b" * 40, "'s" * 400,
    "é" * 777, "𝔸b" * 500, "漢字" * 900, "!?" * 700 + "'ll" * 90, "thequickbrownfox" * 300 + " end. " + "12345" * 500, "  " * 200,
]


@pytest.mark.parametrize("text", TEXTS)
def test_equal_to_library(both, text):
    codec, library = both
    ids = codec.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_random_runs(both):
    codec, library = both
    rng = random.Random(3)
    for _ in range(150):
        letters = rng.choice(["ab", "a 'sl\n", "é \u00a0\x1c.l'", "etaoinshr", "abcdefghijklmnopqrstuvwxyz", "éèàü", "0123456789", "  \n\t", "-=*'"])
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 1500)))
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "x")]
    df = spark.createDataFrame([(a, b, "?") for a, b in rows], "doc_id long, text string, ids string")
    out = bpe.encode_documents(df, bpe.default_tokenizer()).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in out) == [(0, 1, "x"), (1, 0, ""), (2, 0, ""), (3, 2, "hello world"), (3, 2, "hello world")]
    assert np.frombuffer(out[2].ids, "<u4").tolist() == [31373, 995]
    assert bpe.encode_digests(df.limit(0), bpe.default_tokenizer()).count() == 0


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_cuts_anywhere(both, leaf):
    _, library = both
    codec = bpe.Codec(open(bpe.default_tokenizer(), encoding="utf-8").read(), leaf_chars=leaf)
    text = "It's what they'll've said:  \n\n we're (not) -- 3,14 %, d'accord?\tl'é\u00e9t\u0065\u0301 漢字 𝔸𝔹 " * 7 + "\n" * 9 + "'" * 5 + "ll" * 5
    for k in range(40):
        assert codec.encode(text[k:]) == library.encode(text[k:], add_special_tokens=False).ids


def test_every_document_through_the_tree(spark, monkeypatch):
    """The query's digests on all of sf0.01 are those of the library; each text above the size of a leaf is joined from parts."""
    path, sf = bpe.default_tokenizer(), "/root/testdata/sf0.01"
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = []
    for i, t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.op7_bpe(spark, sf).collect())) == sorted(want)
    codec, joins, join = bpe.Codec(open(path, encoding="utf-8").read()), [], bpe.Codec.join
    monkeypatch.setattr(bpe.Codec, "join", lambda *x: joins.append(1) or join(*x))
    long = [t for _, t in texts if len(t) > bpe.LEAF_CHARS]
    for t in long:
        before = len(joins)
        codec.encode(t)
        assert len(joins) > before
    assert len(long) > 300


def test_tasks_hold_slices(spark):
    """A batch of many rows is encoded in slices of bounded bytes, a row of more bytes on its own; ids and texts are those of one pass."""
    import pyarrow as pa

    from glosswork.llm import bpe

    rows = spark.createDataFrame([(i, None if i == 3 else f"word{i} " * (150_000 if i == 5 else 20_000)) for i in range(12)], "doc_id long, text string").coalesce(1)
    encoded = bpe.encode_documents(rows, bpe.default_tokenizer())

    own = bpe.codec(open(bpe.default_tokenizer(), encoding="utf-8").read(), bpe.LEAF_CHARS, bpe.LONG_BYTES, bpe.LEAF_BYTES)
    for r in encoded.collect():
        text = "" if r.doc_id == 3 else f"word{r.doc_id} " * (150_000 if r.doc_id == 5 else 20_000)
        assert r.decoded == text and r.n_tokens == len(r.ids) // 4
    texts = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["x" * 300_000] * 8 + [None])], ["doc_id", "text"])
    cut = [j - i for i, j in bpe.slices(bpe.text_buffers(texts.column(1))[1], bpe.SLICE)]
    assert sum(cut) == 9 and max(cut) <= 4  # three texts of 300 KB, an empty one with them
    assert bpe._encoded(own, texts.slice(7, 2), True).column(2).to_pylist()[1] == 0
