import pytest
from pyspark.sql import functions as F

from glosswork.llm import mixing


def fill(sizes, weights, share=1.5, most=2.0):
    """Sharing again and again by weight, source by source, until none is above its cap."""
    budget = share * sum(sizes)
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        level = budget / sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * level > most * sizes[i]}
        if not over:
            for i in open_:
                target[i] = weights[i] * level
            break
        for i in over:
            target[i] = most * sizes[i]
            budget -= target[i]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 3], [100, 1, 1, 50, 7, 900], [5], [0, 4]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size long")
    got = [r.target for r in mixing.targets(df).orderBy("source").collect()]
    assert got == pytest.approx(fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))]))


def test_takes_come_near(spark, sf):
    rows = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    for of in by.values():
        assert abs(sum(r.taken for r in of) - of[0].target) <= max(r.size for r in of) / 2


def test_edges(spark):
    schema = "doc_id long, text string, source string, size string, key string"
    df = spark.createDataFrame([(1, "a b c", None, "", ""), (1, "a b c", None, "", ""), (2, None, "x", "", ""), (None, "d e\tf g", "y", "", ""), (4, "h " * 5000, "y", "", "")], schema)
    out = mixing.mix(df).collect()
    assert sorted((r.source or "~", r.size) for r in out) == [("x", 0), ("y", 4), ("y", 5000), ("~", 3), ("~", 3)]
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and sorted(mixed.select("text").distinct().collect())
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.mix(df.limit(0)).count() == 0


def test_native_plan(spark, sf):
    plan = mixing.op4_mixing(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


def test_rows_of_one_id(spark):
    """Exact copies and other texts under one id: each text is given as often as the mix takes it, copies alike as evenly as it goes."""
    rows = [(i % 7, " ".join(["w"] * (1 + i % 5)) + f" {i % 11}", f"s{i % 3}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row int")
    want = {}
    for r in mixing.mix(df).collect():
        want[r.doc_id, r.source, r.mark] = want.get((r.doc_id, r.source, r.mark), 0) + r.copies
    got, each = {}, {}
    for r in mixing.mixed_documents(df).selectExpr("*", "xxhash64(text) AS mark").collect():
        got[r.doc_id, r.source, r.mark] = got.get((r.doc_id, r.source, r.mark), 0) + 1
        each[r.row] = each.get(r.row, 0) + 1
    assert got == {k: n for k, n in want.items() if n} and max(each.values()) <= 2
    assert sum(got.values()) != 400


def test_many_sources_in_ranges(spark):
    """The running sums of ranges are those of the whole order."""
    sizes = [(i * 7919) % 1000 for i in range(3000)]
    df = spark.createDataFrame([(f"s{i:05d}", n) for i, n in enumerate(sizes)], "source string, size long")
    got = [r.target for r in mixing.targets(df).orderBy("source").collect()]
    assert got == pytest.approx(fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))]))


@pytest.mark.parametrize("weight", [1e-6, 0.001, 0.1, 1.0, 10.0])
def test_weights_of_any_size(spark, weight):
    """Sampling does not depend on the scale of weights, and no range of keys holds half of a source."""
    df = spark.createDataFrame([(i, "w " * (1 + i % 4), "big" if i % 10 else "small", weight * (1 + i % 3)) for i in range(4000)], "doc_id long, text string, source string, w double")
    got = {r.doc_id: r.copies for r in mixing.mix(df, weight="w").collect()}
    assert got == {r.doc_id: r.copies for r in mixing.mix(df.withColumn("w", df.w / weight), weight="w").collect()}
    dealt = df.select("source", (-F.log(F.rand(1)) / df.w).alias("key")).repartitionByRange(8, "source", "key").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) < 4000 / 4


def test_equal_rows_are_parted(spark):
    """Thousands of equal rows are many rows of a range each, and the mix still comes near its targets."""
    df = spark.createDataFrame([(1, "a b", "x")] * 3000 + [(2, "c", "y")] * 500, "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    for source in "xy":
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
