import random

from glosswork import queries as engine
from glosswork.operators import align, passages


def test_shared_bytes_share_a_fingerprint():
    """Any 16 bytes in common, wherever they stand."""
    rng = random.Random(2)
    for _ in range(500):
        common = rng.randbytes(16)
        a, b = (rng.randbytes(rng.randrange(40)) + common + rng.randbytes(rng.randrange(40)) for _ in range(2))
        assert set(passages.fingerprints(common, 16).tolist()) <= set(passages.fingerprints(a, 16).tolist()) & set(passages.fingerprints(b, 16).tolist())


PAGES = [(1, 0, "Some words, and more words. " * 9), (1, 1, ""), (2, 0, "naïve Words (in part) only; the end​."), (3, 0, "naïve   Words ( in part ) only; the end."), (3, 1, "a"), (4, 0, "é" * 50), (5, 0, None), (None, 0, "a word"), (4, 1, "x" * 5000)]
ITEMS = [(0, ""), (1, None), (2, "a"), (3, "é"), (4, "words"), (5, "and more words. Some"), (6, "in part) only"), (7, "x" * 300), (8, "é" * 9), (9, "nowhere at all, this one"), (10, " "), (10, "the end"), (11, "Some words, and more words. " * 9)]


def test_exact(spark):
    """Passages of all sizes against all pages; empty and null ones are nowhere; no pair of tables is held against each other as a whole."""
    pages = spark.createDataFrame(PAGES, "doc_id long, page_index int, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, s string")
    rows = passages.occurrences(pages, items)
    want = sorted((repr(d), p, i, s) for d, p, t in PAGES for i, s in ITEMS if s and t and s in t)
    assert sorted((repr(r.doc_id), r.page_index, r.item_id, r.s) for r in rows.collect()) == want
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert passages.occurrences(pages, items.limit(0)).count() == passages.occurrences(pages.limit(0), items).count() == 0


def test_normal_form(spark):
    texts = [t for *_, t in PAGES if t] + ["( a )  b ,c", " \t x\x1cy ", "[ ]", "a\n(\nb", "", "! a ( ! )", "{ ( x", "a  ) )"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", passages.normal_form(rows.t).alias("n")).collect():
        assert r.n == align.normalised(r.t).text, r.t


def test_changed(spark):
    """Blanks and the middle changed: what a search of all pairs finds."""
    rng = random.Random(7)
    words = [f"wörd{i}" if i % 9 == 0 else f"word{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(5, 120))) for _ in range(30)]
    pages = [(i, 0, t) for i, t in enumerate(texts)] + PAGES
    items = [*ITEMS]
    for k in range(40):
        t = rng.choice(texts).split(" ")
        a = rng.randrange(len(t))
        part = t[a : a + rng.randrange(1, 60)]
        if rng.random() < 0.6:
            part.insert(len(part) // 2, "@@ new @@")
        items.append((100 + k, ("  " if rng.random() < 0.5 else " ").join(part)))
    out = passages.aligned(spark.createDataFrame(pages, "doc_id long, page_index int, text string"), spark.createDataFrame(items, "item_id long, s string"))
    want = []
    for d, p, t in pages:
        for i, s in items:
            if t and s and align.normalised(s).text:
                m = align.match(t, s)
                at = align.map_span(m, s, 0, len(s)) if m else None
                if at:
                    want.append((d, p, i, m.mode, *at))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr) and {w[3] for w in want} == {"exact", "normalized", "anchored"}


def test_query_against_all_pairs(spark, sf):
    """Every benchmark passage, changed, against every page of the table."""
    got = {tuple(r) for r in engine.QUERIES["passage_alignment"](spark, sf).collect()}
    pages = [(r.doc_id, r.page_index, r.text, align.normalised(r.text).text) for r in engine._pages(spark, sf).collect()]
    items = [(r.item_id, r.s) for r in engine.changed_passages(spark, sf).collect()]
    want = set()
    for i, s in items:
        n = align.normalised(s).text
        a = align.anchor_length(len(n))
        for d, p, t, whole in pages:
            if n[:a] in whole and n[-a:] in whole:  # else nothing can match
                m = align.match(t, s)
                if m:
                    want.add((d, p, i, m.mode, *align.map_span(m, s, 0, len(s))))
    assert got == want and len({w[2] for w in want}) >= 3
