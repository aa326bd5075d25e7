import os

import pytest
from pyspark.sql import functions as F

from glosswork.sources import keyed

SCHEMA = "id long, x string, rects array<array<double>>"


def rows(spark, ids, x):
    return spark.createDataFrame([(i, x, [[float(i or 0), 1.0]]) for i in ids], SCHEMA)


def got(spark, path):
    return sorted((repr(r.id), r.x) for r in keyed.read(spark, path, ["id"], SCHEMA).collect())


def test_rows_replace_older_ones(spark, tmp_path):
    """Known keys are replaced, null is a key, repeats in a write count once, an empty write changes nothing, an overwrite leaves its own rows only."""
    path = str(tmp_path / "t")
    assert got(spark, path) == []
    keyed.replace(rows(spark, [1, 2, 3, None, 3], "a").repartition(3), path)
    keyed.replace(rows(spark, [2, None, 9], "b"), path)
    keyed.replace(rows(spark, [], "c"), path)
    assert got(spark, path) == [("1", "a"), ("2", "b"), ("3", "a"), ("9", "b"), ("None", "b")]
    assert keyed.read(spark, "file://" + path, ["id"], SCHEMA).filter("id = 9").first().rects == [[9.0, 1.0]]
    keyed.replace(rows(spark, [5], "d"), path, overwrite=True)
    assert got(spark, path) == [("5", "d")]


def test_failed_and_repeated_writes_leave_nothing(spark, tmp_path):
    """A task that fails after other tasks have written, a task that runs twice, a commit that comes second."""
    path = str(tmp_path / "t")
    keyed.replace(rows(spark, [1, 2], "a"), path)
    bad = rows(spark, range(50), "b").repartition(4).withColumn("x", F.when(F.col("id") == 49, F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="stop"):
        keyed.replace(bad, path)
    assert got(spark, path) == [("1", "a"), ("2", "a")]
    assert [f for f in os.listdir(f"{path}/data") if f.startswith("0000000001")] == []
    batch = rows(spark, [1], "twice").toArrow().to_batches()
    writer, rival = keyed.KeyedWriter(path, False), keyed.KeyedWriter(path, False)
    writer.write(iter(batch))  # the first try of a task, of which nobody heard
    message = writer.write(iter(batch))
    writer.commit([message])
    assert got(spark, path) == [("1", "twice"), ("2", "a")]
    with pytest.raises(RuntimeError):
        rival.commit([rival.write(iter(rows(spark, [1], "late").toArrow().to_batches()))])
    assert got(spark, path) == [("1", "twice"), ("2", "a")]
