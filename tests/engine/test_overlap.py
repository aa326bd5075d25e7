import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glosswork.operators import overlap

RECT = [("x1", "x2"), ("y1", "y2")]


def boxes(spark, rows):
    return spark.createDataFrame(rows, "page int, id int, x1 double, y1 double, x2 double, y2 double")


def brute(a, b, tolerance, touching):
    out = Counter()
    for p in a:
        for q in b:
            ends = [v for r in (p, q) for v in r[2:]]
            if p[0] is None or p[0] != q[0] or any(v is None or v != v or abs(v) == float("inf") for v in ends):
                continue
            fine = True
            for d in (2, 3):
                pl, ph, ql, qh = min(p[d], p[d + 2]) - tolerance, max(p[d], p[d + 2]) + tolerance, min(q[d], q[d + 2]), max(q[d], q[d + 2])
                fine &= (pl <= qh and ql <= ph) if touching else (pl < qh and ql < ph)
            out[p[1], q[1]] += fine
    return +out


@pytest.mark.parametrize("tolerance,touching,hot", [(0.0, True, 4096), (2.0, True, 7), (0.0, False, 3)])
def test_rects_equal_brute_force(spark, tolerance, touching, hot):
    """Sizes from points to whole pages, ends out of order, negative places, touching edges, repeated rows, unusable ends, null keys; hot cells split."""
    rng = random.Random(5)

    def some(n):
        out = []
        for i in range(n):
            x, y, w, h = rng.randint(-50, 200), rng.randint(-50, 200), rng.choice([0, 1, 4, 16, 300]), rng.choice([0, 1, 4, 16, 5000])
            out.append((rng.choice([1, 1, 1, 2, None]), i, float(x + w), float(y), float(x), float(y + h)))
        return [*out, *out[:5], (1, 9001, None, 0.0, 1.0, 1.0), (1, 9002, float("nan"), 0.0, 1.0, 1.0), (1, 9003, float("inf"), 0.0, 1.0, 1.0)]

    a, b = some(150), some(120)
    got = overlap.overlap_join(boxes(spark, a), boxes(spark, b), ["page"], RECT, 4.0, tolerance, touching, hot)
    assert Counter((r.l.id, r.r.id) for r in got.collect()) == brute(a, b, tolerance, touching)
    assert overlap.overlap_join(boxes(spark, a), boxes(spark, []), ["page"], RECT, 4.0).count() == 0


def test_intervals(spark):
    """One dimension: nested and touching intervals; no nested loops and no cross join in the plan."""
    spans = spark.createDataFrame([(1, 0, 10), (1, 3, 4), (1, 10, 12), (1, 20, 20)], "d int, s int, e int").withColumn("l", F.lit("clash"))
    got = overlap.overlap_join(spans, spans, ["d"], [("s", "e")], 2.0)
    assert sorted((r.l.s, r.r.s) for r in got.collect()) == [(0, 0), (0, 3), (0, 10), (3, 0), (3, 3), (10, 0), (10, 10), (20, 20)]
    strict = overlap.overlap_join(spans, spans, ["d"], [("s", "e")], 2.0, touching=False)
    assert sorted((r.l.s, r.r.s) for r in strict.collect()) == [(0, 0), (0, 3), (3, 0), (3, 3), (10, 10)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
