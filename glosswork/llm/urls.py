"""URL filters by a Bloom filter cascade over the corpus's complete key universe.

A cascade holds a set of listed keys exactly, for the keys of a known universe, without a join. Its first
filter encodes the listed keys; some keys that are not listed pass it by chance, and since the universe is
known they can be found: the second filter encodes them. The listed keys that pass the second filter go
into the third, and so on until a filter has no false positive. A key's answer is the side of the last
filter that holds it. Keys are pairs of 64-bit hashes of strings (128 bits tell them apart).

Everything that is asked of the table is asked of one cascade: a key is a kind (a rule that blocks, one
that allows, a listed host) and a string. A URL's candidates are those of its host's suffixes and
path's prefixes that are as long as some rule, and its host. All candidates of all rows, each once, are the
universe, which is gathered with partial aggregation, so a hot host counts once a task.

The filters are broadcast: their size is computed from the number of listed and other keys, and when it is above
`bloom.MOST_BITS`, keys are parted by hash and the rows pass one cascade after another.

Defined results: the host follows the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; the path
follows the host up to `?`, `#` or the end; a null URL, or one without `://`, has an empty host and an empty path.
A rule (host, path) fits its host and all subdomains if the path starts with the rule's; the longest rule wins, of
equally long ones the one with the longer host, and a rule given to both sides blocks. Without a rule, a listed host is blocked and
any other is allowed; an empty host is never listed. Repeated rows are judged alike; an empty table gives no rows; other columns are kept,
but for those named like the four that are added.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.llm import bloom
from glosswork.llm.common import U64, stable, unused, written

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LATER = 1 / 8  # false-positive rate of all filters but the first
TRACKING = "[?&]utm_"
SHARE, LEAST = 5, 3


def host_of(url: Column) -> Column:
    """Host of a URL, with A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to a query, a fragment or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Cascade:
    """Filters in turn of listed keys and of keys that are not; exact on the universe that it was built over."""

    filters: tuple[bloom.Bloom, ...]

    @property
    def bits(self) -> int:
        return sum(f.bits for f in self.filters)

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        left = np.arange(len(a))
        for level, one in enumerate(self.filters):
            hit = one.holds(a[left], b[left])
            out[left[~hit]] = level % 2 == 1
            left = left[hit]
        out[left] = len(self.filters) % 2 == 1
        return out


def first_rate(listed: int, others: int) -> float:
    """The first filter's false-positive rate, by which about as many other keys pass as keys are listed."""
    return min(0.5, max(2.0**-30, math.sqrt(0.5) * listed / max(others, 1)))


def bits_needed(listed: int, others: int) -> int:
    """An upper estimate of a cascade's size: the first filter, and a shrinking row of later ones."""
    return bloom.shape(listed, first_rate(listed, others))[0] + 4 * bloom.shape(2 * listed, LATER)[0]


def cascade(universe: DataFrame, most_levels: int = 64) -> Cascade:
    """The cascade of a universe (a long, b long, listed boolean), of which each key is one row."""
    sizes = {r.listed: r.n for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}  # two rows
    encoded, other = universe.filter("listed").select("a", "b"), universe.filter("not listed").select("a", "b")
    n, rate, filters = sizes.get(True, 0), first_rate(sizes.get(True, 0), sizes.get(False, 0)), []
    while n:
        if len(filters) == most_levels:
            raise ValueError("two keys of the universe have one hash of 128 bits")
        one = bloom.built(encoded, n, rate, len(filters))
        filters.append(one)
        # The other side's keys that pass are encoded next, and what was encoded now is what may pass those.
        encoded, other, rate = stable(other.filter(_passes(one)("a", "b"))), encoded, LATER
        n = encoded.count()
    return Cascade(tuple(filters))


def _passes(one: bloom.Bloom) -> Callable[..., Column]:
    @F.arrow_udf(T.BooleanType())
    def holds(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(one.holds(a.to_numpy().view(U64), b.to_numpy().view(U64)))

    return holds


def _asked(some: Cascade) -> Callable[..., Column]:
    """Whether each key of an array is listed."""

    @F.arrow_udf(T.ArrayType(T.BooleanType()))
    def holds(a: pa.Array, b: pa.Array) -> pa.Array:
        found = some.holds(a.flatten().to_numpy().view(U64), b.flatten().to_numpy().view(U64))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(a.value_lengths().to_numpy())]).astype(np.int32)), pa.array(found))

    return holds


def _key(kind: str | Column, text: Column) -> tuple[Column, Column]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.xxhash64(kind, text), F.xxhash64(text, kind, F.lit(1))


def _candidates(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Host suffixes and path prefixes of the lengths that rules have, longest first: structs of host and path."""
    lengths = sorted({(h.count(".") + 1, len(p)) for h, p, _ in rules})
    labels = F.split(host, r"\.", -1)

    def fitting(dots: int, width: int) -> Column:
        # The last `dots` labels; null where there are fewer, or where the path is shorter than the prefix.
        suffix = F.substring_index(host, ".", -dots)
        return F.when((F.size(labels) >= dots) & (F.length(path) >= width) & (host != ""), F.struct(suffix.alias("host"), F.substring(path, 1, width).alias("path")))

    every = F.filter(F.array(*[fitting(d, w) for d, w in lengths]), lambda c: c.isNotNull()) if lengths else F.array().cast("array<struct<host:string,path:string>>")

    def longer(x: Column, y: Column) -> Column:
        size = lambda c: F.length(c["host"]) + F.length(c["path"])
        return F.when(size(x) != size(y), size(y) - size(x)).otherwise(F.length(y["host"]) - F.length(x["host"]))

    return F.array_sort(every, longer)


def judged(pages: DataFrame, listed_hosts: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """The rows of pages with host, path, rule and verdict; listed_hosts has one column, of lower-cased hosts."""
    p = unused(pages)
    name = lambda x: f"{p}{x}"
    rows = pages.withColumns({name("host"): host_of(F.col(url)), name("path"): path_of(F.col(url))})
    rows = rows.withColumn(name("found"), _candidates(F.col(name("host")), F.col(name("path")), rules))

    def keys(host: Column, found: Column, half: int) -> Column:
        def of(kind: str) -> Column:
            return F.transform(found, lambda c: _key(kind, F.concat(c["host"], c["path"]))[half])

        return F.concat(of("block"), of("allow"), F.array(_key("host", host)[half]))

    host, found = F.col(name("host")), F.col(name("found"))
    rows = rows.withColumns({name("a"): keys(host, found, 0), name("b"): keys(host, found, 1), name("in"): F.array().cast("array<boolean>")})
    asked = rows.select(F.explode(F.arrays_zip(F.col(name("a")).alias("a"), F.col(name("b")).alias("b"))).alias("k")).select("k.a", "k.b", F.lit(False).alias("listed"))
    spark = pages.sparkSession
    of_rules = spark.createDataFrame([(v, h + t) for h, t, v in rules], "kind string, text string").select(*_key(F.col("kind"), F.col("text")), F.lit(True))
    hosts = listed_hosts.toDF("text").filter("text <> ''").select(*_key("host", F.col("text")), F.lit(True))
    # Listed keys that no row asks for need no place: a key is in the universe if some row has it.
    whole = asked.withColumn("asked", F.lit(True)).union(of_rules.toDF("a", "b", "listed").withColumn("asked", F.lit(False))).union(hosts.toDF("a", "b", "listed").withColumn("asked", F.lit(False)))
    universe = written(whole.groupBy("a", "b").agg(F.bool_or("listed").alias("listed"), F.bool_or("asked").alias("asked")).filter("asked").drop("asked"))
    sizes = universe.agg(F.count_if("listed").alias("listed"), F.count_if(~F.col("listed")).alias("others")).first()
    parts = math.ceil(bits_needed(sizes.listed, sizes.others) / bloom.MOST_BITS)
    for part in range(parts):
        own = universe.filter(F.pmod("a", F.lit(parts)) == part) if parts > 1 else universe
        said = _asked(cascade(own))(name("a"), name("b"))
        if parts == 1:
            rows = rows.withColumn(name("in"), said)
            break
        mine = F.transform(F.arrays_zip(said.alias("said"), F.col(name("a")).alias("a")), lambda k: k["said"] & (F.pmod(k["a"], F.lit(parts)) == part))
        before = F.col(name("in"))
        rows = written(rows.withColumn(name("now"), mine).withColumn(name("in"), F.when(F.size(before) == 0, F.col(name("now"))).otherwise(F.zip_with(before, name("now"), lambda x, y: x | y))).drop(name("now")))
    count, inside = F.size(found), F.col(name("in"))
    rows = rows.withColumn(name("blocks"), F.slice(inside, F.lit(1), count)).withColumn(name("allows"), F.slice(inside, count + 1, count))
    first = F.array_position(F.zip_with(name("blocks"), name("allows"), lambda x, y: x | y), F.lit(True)).cast("int")
    rows = rows.withColumn(name("at"), first)
    at, some = F.col(name("at")), F.col(name("at")) > 0
    best = F.element_at(found, F.greatest(at, F.lit(1)))
    verdict = F.when(some, F.when(F.element_at(F.col(name("blocks")), F.greatest(at, F.lit(1))), "block").otherwise("allow")).when((host != "") & F.element_at(inside, -1), "block").otherwise("allow")
    return rows.select(*[c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")], host.alias("host"), F.col(name("path")).alias("path"), F.when(some, F.concat(best["host"], best["path"])).alias("rule"), verdict.alias("verdict"))


def tracking_hosts(pages: DataFrame, url: str = "url", share: int = SHARE, least: int = LEAST) -> DataFrame:
    """Hosts with at least `least` URLs of which more than one in `share` carries a campaign parameter."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.coalesce(F.col(url).rlike(TRACKING), F.lit(False)).cast("long").alias("tracking"))
    return rows.groupBy("host").agg(F.sum("tracking").alias("t"), F.count("*").alias("n")).filter((F.col("n") >= least) & (F.col("t") * share > F.col("n"))).select("host")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judged(pages, tracking_hosts(pages)).drop("url")


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS mark FROM pages
), p AS (
  SELECT page_id, url, CASE WHEN mark = 0 THEN '' ELSE substr(url, mark + 3) END AS rest FROM u
), h AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), l AS (
  SELECT host FROM h WHERE host <> '' GROUP BY host HAVING count(*) >= 3 AND 5 * count(*) FILTER (WHERE regexp_matches(url, '[?&]utm_')) > count(*)
), r(rhost, rpath, says) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), j AS (
  SELECT h.page_id, max({'n': length(rhost || rpath), 'rule': rhost || rpath, 'says': says}) AS best
  FROM h JOIN r ON (h.host = rhost OR ends_with(h.host, '.' || rhost)) AND starts_with(h.path, rpath) GROUP BY h.page_id
)
SELECT h.page_id, h.host, h.path, j.best.rule AS rule,
  coalesce(j.best.says, CASE WHEN h.host IN (SELECT host FROM l) THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN j USING (page_id)
"""
