"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes: a rotation learned on a bounded sample by alternating between signs and the best orthogonal map to
them (iterative quantisation) gives one sign bit a principal axis, several rotations together `tables` times 16
bits. Index: every vector's code, cut into substrings of 16 bits, each with a bucket table of its own, dealt to
cells by table and top bits of the substring. Search: by the pigeonhole principle a code within Hamming radius r
of the query's agrees with it in some substring up to about r / tables bits, so a query goes to the cells whose top
bits are that near, and there probes each bucket that is that near. All codes within the radius are found, each
in the first table that gives it, and are ranked by the cosine of the original vectors where they are found.

The radius follows the data. It begins at what the sample says of distances at this number of rows; a query is
done when the radius covers its k-th smallest distance found and a slack, learned on the sample, by which nearest
vectors have farther codes than others; the queries that are not done go on with a radius that covers what they
have found, or, with too little found, a wider one.

Equal vectors are one entry with their smallest ids, so a vector that many rows share makes no large
bucket, and a cell with many entries is dealt in parts, each of which its queries visit.

Defined results: vectors that are null, all zero, or hold null or non-finite components take no part,
nor do rows without an id; vectors of different lengths are not compared; rows that repeat an
id and a vector are one row; queries with fewer than k candidates get all of them; ties go to the
smaller vec_id. An empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glosswork.llm.common import stable

SAMPLE = 8192  # rows that the rotations, the slack and the first radius are learned on
TABLES, WIDTH = 4, 16
CELL = 4096  # entries to a cell, about
SURE = 0.97  # share of the sample's nearest vectors whose codes are within the slack
RESULT = "query_id long, rank int, vec_id long, score double"


@dataclass
class Coder:
    mean: np.ndarray
    maps: list[np.ndarray]  # one for each rotation; the last one may give fewer bits
    bits: int
    slack: int = 0
    near: int = 0  # the usual distance of a k-th nearest code at the number of rows

    def signs(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.concatenate([(unit - self.mean) @ m > 0 for m in self.maps], axis=1)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """One 16-bit number for each table."""
        return np.packbits(self.signs(vectors), axis=1, bitorder="little").view("<u2")


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, which is exact, so that squares neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    return np.ldexp(vectors, -exponent)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all codes of a and all codes of b."""
    out = np.zeros((len(a), len(b)), np.int32)
    for j in range(a.shape[1]):
        out += np.bitwise_count(a[:, None, j] ^ b[None, :, j])
    return out


def fit(vectors: np.ndarray, k: int, rows: int, tables: int = TABLES, seed: int = 3) -> Coder:
    """Rotations, slack and the first distance for the k nearest of so many rows, from a sample."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    mean = unit.mean(0)
    rng = np.random.default_rng(seed)
    values, axes = np.linalg.eigh(np.cov((unit - mean).T).reshape(unit.shape[1], -1) if len(unit) > 1 else np.eye(unit.shape[1]))
    bits = tables * WIDTH
    axes = axes[:, np.argsort(-values)][:, :bits]
    projected = (unit - mean) @ axes
    maps, missing = [], bits
    while missing > 0:
        turn = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(20):
            u, _, vt = np.linalg.svd(np.sign(projected @ turn).T @ projected)
            turn = (u @ vt).T
        maps.append((axes @ turn)[:, :missing])
        missing -= maps[-1].shape[1]
    coder = Coder(mean, maps, bits)
    some = rng.permutation(len(unit))[:512]
    codes = coder.codes(vectors)
    far = hamming(codes[some], codes)
    near = unit[some] @ unit.T
    far[np.arange(len(some)), some] = 1 << 14
    near[np.arange(len(some)), some] = -2
    k = min(k, len(unit) - 1)
    if k > 0:
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        kth = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
        coder.slack = max(0, int(np.quantile(np.take_along_axis(far, best, 1) - kth, SURE)))
        # Among more rows than the sample has, the k-th smallest distance is a smaller quantile of a vector's distances.
        coder.near = int(np.median(np.quantile(far, min(1.0, k / rows), axis=1, method="lower")))
    return coder


def budgets(radius: int, tables: int) -> list[int]:
    """How far each table's substrings are probed, -1 for not at all: a code that is farther in all of them is beyond the radius."""
    each, more = divmod(radius, tables)
    return [each if j <= more else each - 1 for j in range(tables)]


@lru_cache
def masks(width: int, radius: int) -> np.ndarray:
    """All numbers of so many bits with at most radius ones."""
    every = np.arange(1 << width, dtype=np.uint32)
    return every[np.bitwise_count(every) <= radius]


class Cell:
    """The entries of one table whose substrings share their top bits, by buckets of the other bits."""

    def __init__(self, codes: np.ndarray, table: int, low: int):
        self.codes, self.table, self.low = codes, table, low
        self.rest = (codes[:, table] & np.uint16((1 << low) - 1)).astype(np.uint32)
        self.order = np.argsort(self.rest, kind="stable")
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.rest, minlength=1 << low))])

    def probe(self, code: np.ndarray, radius: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
        """The entries within the radius that this table gives and none before it, and their distances."""
        own, each = int(code[self.table]), np.array(budgets(radius, self.codes.shape[1]))
        left = int(each[self.table]) - ((own >> self.low) ^ prefix).bit_count()
        if left < 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.uint32(own & ((1 << self.low) - 1)) ^ masks(self.low, min(left, self.low))
        first, sizes = self.starts[at], self.starts[at + 1] - self.starts[at]
        full = sizes > 0
        first, sizes = first[full], sizes[full]
        ends = np.cumsum(sizes)
        found = self.order[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)]
        apart = np.bitwise_count(self.codes[found] ^ code)
        far = apart.sum(1, dtype=np.int64)
        new = (far <= radius) & (apart[:, : self.table] > each[: self.table]).all(1)
        return found[new], far[new]


def _visited(coder: Coder, k: int, radius: int, top: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Of a cell's part and its queries: each query's best entries by score and by distance."""

    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame({name: pd.Series([], dtype=object) for name in ("query", "score", "far", "ids")})
        vectors, asked = (scaled(np.stack(x["vector"]).astype(np.float64)) for x in (index, queries))
        norms, asked_norms = np.linalg.norm(vectors, axis=1), np.linalg.norm(asked, axis=1)
        first = np.array([x[0] for x in index["ids"]], np.int64)
        table, prefix = int(index["table"].iloc[0]), int(index["prefix"].iloc[0])
        cell = Cell(coder.codes(vectors), table, WIDTH - top)
        query, place, score, distance = [], [], [], []
        for i, code in enumerate(coder.codes(asked)):
            found, far = cell.probe(code, radius, prefix)
            s = vectors[found] @ asked[i] / (norms[found] * asked_norms[i])
            keep = np.unique(np.concatenate([np.lexsort((first[found], -s))[:k], np.argsort(far, kind="stable")[:k]]))
            query += [queries["query"].iloc[i]] * len(keep)
            place.append(found[keep])
            score.append(s[keep])
            distance.append(far[keep])
        place = np.concatenate(place)
        return pd.DataFrame({"query": pd.Series(query, dtype=object), "score": np.concatenate(score), "far": np.concatenate(distance), "ids": index["ids"].to_numpy()[place]})

    return run


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _coded(rows: DataFrame, coder: Coder, columns: list[str]) -> DataFrame:
    """The columns of rows, and for each table its substring of the vector's code."""

    @F.pandas_udf("array<int>")
    def code(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(coder.codes(scaled(np.stack(vectors).astype(np.float64))).astype(np.int32))) if len(vectors) else pd.Series([], dtype=object)

    return rows.select(*columns, F.posexplode(code("vector")).alias("table", "sub"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", tables: int = TABLES, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row for which is_query, an expression of vec_id, holds."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    lengths = [r["n"] for r in rows.select(F.size("vector").alias("n")).distinct().orderBy("n").collect()]  # of a table's vectors, one as a rule
    found = [_nearest(rows.filter(F.size("vector") == n), is_query, k, tables, cell, sample) for n in lengths]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], RESULT)


def _nearest(rows: DataFrame, is_query: Column, k: int, tables: int, size: int, sample: int) -> DataFrame:
    rows = rows.withColumn("key", F.struct(F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(1), "vector").alias("b"))).dropDuplicates(["vec_id", "key"])
    learn = rows.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()

    # Of equal vectors the k + 1 smallest ids will do: one of them may be the query's own.
    smallest = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    entries = stable(smallest.groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector")))
    n = entries.count()
    coder = fit(scaled(np.stack(learn["vector"]).astype(np.float64)), k + 1, n, tables)
    top = min(WIDTH, max(0, (n // size).bit_length()))  # of a substring's bits, those that name its cell

    prefix = F.shiftright("sub", WIDTH - top).alias("prefix")
    index = _coded(entries, coder, ["ids", "vector"]).select("ids", "vector", "table", prefix)
    parts = stable(index.groupBy("table", "prefix").agg(F.ceil(F.count("*") / size).cast("int").alias("parts")))  # at most tables * 2**top rows
    index = stable(index.join(F.broadcast(parts), ["table", "prefix"]).withColumn("part", F.pmod(F.xxhash64("ids"), F.col("parts")).cast("int")).drop("parts"))

    asked = stable(rows.filter(is_query).select("vec_id", "key"))
    queries = stable(rows.filter(is_query).select(F.to_json("key").alias("query"), "vector").dropDuplicates(["query"]))
    done, todo, radius = None, queries, min(coder.bits, coder.near + coder.slack)
    while True:
        probed = budgets(radius, tables)
        flips = [F.filter(F.split(F.lit(",".join(map(str, masks(top, min(each, top)).tolist()))), ","), lambda x: x != "").cast("array<int>") for each in probed]
        flips = F.element_at(F.array(*flips), F.col("table") + 1)
        visits = _coded(todo, coder, ["query", "vector"]).select("query", "vector", "table", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.shiftright("sub", WIDTH - top)))).alias("prefix"))
        visits = visits.join(F.broadcast(parts), ["table", "prefix"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        by = ["table", "prefix", "part"]
        found = stable(index.groupBy(*by).cogroup(visits.groupBy(*by)).applyInPandas(_visited(coder, k + 1, radius, top), "query string, score double, far int, ids array<long>"))
        # Bounded: k + 1 by score and k + 1 by distance from each cell that a query visits.
        kth = found.groupBy("query").agg(F.array_sort(F.collect_list("far")).alias("far")).select("query", F.try_element_at("far", F.lit(min(k + 1, n))).alias("kth"))
        ended = stable(kth.withColumn("needs", F.col("kth") + coder.slack))
        over = F.lit(radius >= coder.bits) | (F.col("needs") <= radius)
        mine = found.join(ended.filter(over).select("query"), "query", "left_semi").select("query", "score", "ids")
        done = mine if done is None else done.unionByName(mine)
        todo = stable(todo.join(ended.filter(over).select("query"), "query", "left_anti"))
        if radius >= coder.bits or todo.isEmpty():
            break
        # The next radius ends what has found k; the others widen it further in the rounds after that.
        needs = ended.filter(~over).agg(F.max("needs")).first()[0]
        radius = min(coder.bits, max(radius + 1, needs if needs is not None else 0, radius + radius // 4 if needs is None else 0))
    by_rank = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    best = done.withColumn("n", F.row_number().over(by_rank)).filter(F.col("n") <= k + 1).select("query", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1)
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    out = asked.select(F.col("vec_id").alias("query_id"), F.to_json("key").alias("query")).join(lists, "query")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return out.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
