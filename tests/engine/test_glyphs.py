import os

import pytest
from pyspark.sql import functions as F

from glosswork.sources import glyphs

G, I = f"array<{glyphs.GLYPH}>", f"array<{glyphs.ITEM}>"


def g(u, x, **more):
    return {"u": u, "rect": [x, 0.0, x + 1, 2.0]} | more


def item(text, n=None, **more):
    return {"str": text, "transform": [1.0, 0.0, 0.0, 1.0, 5.0, 8.0], "width": 4.0, "height": 4.0, "chars": [{} for _ in range(len(text) if n is None else n)]} | more


def layer(spark, path, kind, rows):
    schema = glyphs.SCHEMAS[kind]
    names = [c.name for c in spark.createDataFrame([], schema).schema[-1].dataType.elementType]
    full = lambda x: None if x is None else tuple([(c.get("transform"), c.get("width")) for c in v] if n == "chars" and (v := x.get(n)) is not None else x.get(n) for n in names)
    glyphs.write_layer(spark.createDataFrame([(d, p, None if v is None else [full(x) for x in v]) for d, p, v in rows], schema), path, kind)


def test_layers(spark, tmp_path):
    """The first layer with characters; empty, null and unusable pages fall through; a page that no layer has; a page dumped twice; a null key."""
    root = f"file://{tmp_path}/r"
    layer(spark, f"{root}/cached", "chars", [(1, 0, [g("ab", 0.0, space_after=True), g("c", 3.0, line_break_after=True), {"c": "d"}]), (1, 1, []), (1, 2, None), (None, 3, [g("n", 0.0)]), (4, 0, [g("x", 0.0)])])
    layer(spark, f"{root}/cached", "chars", [(4, 0, [g("xyz", 0.0)])])
    layer(spark, f"{root}/page_data", "chars", [(1, 0, [g("no", 0.0)]), (1, 1, [g("pd", 1.0, rotation=90, inline_rect=[0.0, 9.0, 7.0, 9.5])])])
    layer(spark, f"{root}/text", "items", [(1, 2, [item("hi", has_eol=True), item("", 0), item("q", height=None)]), (2, 0, [item("hi"), item("abc", 2)]), (2, 1, [item("a", width=0.0)])])
    wanted = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0), (4, 0), (4, 0), (None, 3)], "doc_id long, page_index int")
    got = {(r.doc_id, r.page_index): (r.source, [(u.char, u.rect, u.at) for u in r.units]) for r in glyphs.page_glyphs(wanted, root).collect()}
    zero = [0.0] * 4
    ab = [0.0, 0.0, 1.0, 2.0]
    assert got == {
        (1, 0): ("cached", [("a", ab, 0), ("b", ab, 0), (" ", zero, 0), ("c", [3.0, 0.0, 4.0, 2.0], 1), ("\n", zero, 1), ("d", zero, 2)]),
        (1, 1): ("page_data", [(c, [0.0, 0.0, 7.0, 2.0], 0) for c in "pd"]),
        (1, 2): ("text", [("h", [5.0, 7.0, 7.0, 11.0], 0), ("i", [5.0, 7.0, 7.0, 11.0], 0), ("\n", zero, 0), ("q", [5.0, 7.75, 9.0, 8.75], 2)]),
        (2, 0): (None, []), (2, 1): (None, []), (3, 0): (None, []),
        (4, 0): ("cached", [(c, ab, 0) for c in "xyz"]),
    }
    runs = {(r.doc_id, r.page_index): r for r in glyphs.page_glyphs(wanted, root, by_run=True).select("*", glyphs.spread(F.col("runs")).alias("units")).collect()}
    assert {k: (r.source, [(u.char, u.rect, u.at) for u in r.units]) for k, r in runs.items()} == got
    assert [(x.text, x.rect, x.at) for x in runs[1, 0].runs] == [("ab", ab, 0), (" ", zero, 0), ("c", [3.0, 0.0, 4.0, 2.0], 1), ("\n", zero, 1), ("d", zero, 2)]
    near = glyphs.page_glyphs(wanted, root, within={"doc_id": [(2, 3)]})
    assert sorted((r.doc_id, r.page_index) for r in near.collect()) == [(2, 0), (2, 1), (3, 0)]
    flat = glyphs.page_glyphs(wanted.filter("doc_id = 1"), root, ["page_data", "cached"], line_breaks=False).filter("page_index = 0").first()
    assert flat.source == "page_data" and [u.char for u in flat.units] == ["n", "o"]


def test_files_are_pruned(spark, tmp_path, monkeypatch):
    """Ranges of the keys choose files by the index, and rows; long lines and several batches come back as they were."""
    path = str(tmp_path / "l")
    rows = spark.range(0, 400, 1, 4).select(F.col("id").alias("doc_id"), F.lit(0).alias("page_index"), F.array(F.struct(F.lit(None).cast("string").alias("c"), F.expr("repeat('é', IF(id = 7, 3000000, 3))").alias("u"), *[F.lit(None).cast(t).alias(n) for n, t in (
        ("rect", "array<double>"), ("inline_rect", "array<double>"), ("rotation", "int"), ("space_after", "boolean"), ("line_break_after", "boolean"), ("paragraph_break_after", "boolean"))])).alias("chars"))
    for part in (F.col("doc_id") < 100, F.col("doc_id").between(100, 299), F.col("doc_id") > 299):
        glyphs.write_layer(rows.filter(part), path, "chars")
    every = glyphs._entries(path)
    assert len(every) >= 3
    read = glyphs.read_layer(spark, path, "chars")
    assert read.agg(F.count("*"), F.sum("doc_id"), F.sum(F.length(F.col("chars")[0]["u"]))).first() == (400, 79800, 399 * 3 + 3000000)
    few = glyphs.read_layer(spark, path, "chars", {"doc_id": [(3, 3), (399, 500)], "page_index": [(0, 9)]})
    assert sorted(r.doc_id for r in few.collect()) == [3, 399]
    assert (few.filter("doc_id < 5").count(), few.filter("doc_id > 5").count(), read.filter("doc_id < 5 OR doc_id > 398").count()) == (1, 1, 6)
    assert glyphs.read_layer(spark, path, "chars", {"doc_id": []}).count() == 0
    with pytest.raises(ValueError):
        glyphs.read_layer(spark, path, "chars", {"text": [(1, 2)]})
    monkeypatch.setattr(glyphs, "FILE_BYTES", 1)
    planned = lambda within: [p.files for p in glyphs.GlyphReader(path, read.schema, within).partitions()]
    assert sorted(planned({})) == sorted((e["file"],) for e in every)
    assert planned({"doc_id": [[3, 3]]}) == [(e["file"],) for e in every if e["doc_id"][0] <= 3 <= e["doc_id"][1]] and len(planned({"doc_id": [[3, 3]]})) == 1
    assert planned({"doc_id": [[3, 3]], "page_index": [[1, 1]]}) == planned({"doc_id": [[500, 900]]}) == [()]


def test_failed_writes_are_not_seen(spark, tmp_path):
    path = str(tmp_path / "l")
    layer(spark, path, "chars", [(1, 0, [g("a", 0.0)])])
    bad = spark.range(0, 40, 1, 4).select(F.col("id").alias("doc_id"), F.lit(0).alias("page_index"), F.when(F.col("id") == 39, F.raise_error(F.lit("stop")).cast(G)).alias("chars"))
    with pytest.raises(Exception, match="stop"):
        glyphs.write_layer(bad, path, "chars")
    assert [r.doc_id for r in glyphs.read_layer(spark, path, "chars").collect()] == [1]
    assert len(os.listdir(f"{path}/data")) == 1


def test_pages_dealt_before_are_not_shuffled_again(spark, tmp_path):
    """Pages in ranges are written as they are dealt, in one pass: each row is made once, files hold narrow ranges, and the layer reads as one dealt by the write."""
    seen = spark.sparkContext.accumulator(0)
    told = F.udf(lambda n: seen.add(1) or n, "long").asNondeterministic()
    ids = spark.range(0, 200, 1, 4).select(F.col("id").alias("doc_id"), F.lit(0).alias("page_index"))
    of = lambda rows: rows.select("doc_id", "page_index", F.array(F.struct(F.lit(None).cast("string").alias("c"), told("doc_id").cast("string").alias("u"), *[F.lit(None).cast(t).alias(n) for n, t in (
        ("rect", "array<double>"), ("inline_rect", "array<double>"), ("rotation", "int"), ("space_after", "boolean"), ("line_break_after", "boolean"), ("paragraph_break_after", "boolean"))])).alias("chars"))
    glyphs.write_layer(of(glyphs.in_ranges(ids)), f"{tmp_path}/a", "chars", dealt=True)
    assert seen.value == 200
    glyphs.write_layer(of(ids), f"{tmp_path}/b", "chars")
    read = [sorted((r.doc_id, r.chars[0].u) for r in glyphs.read_layer(spark, f"{tmp_path}/{x}", "chars").collect()) for x in "ab"]
    assert read[0] == read[1] == [(i, str(i)) for i in range(200)]
    spans = sorted(e["doc_id"] for e in glyphs._entries(f"{tmp_path}/a"))
    assert all(a[1] < b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))
