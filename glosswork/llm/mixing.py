"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Sources share a budget by weight; a source's target stops at a multiple of its size and the excess is
shared again among the rest, which settles at one level: target = least(cap, weight * level). Complete
epochs of a source come first. The rest of its target is a weighted sample without replacement: each
document has an exponential key -ln(u) / weight, u from a hash of its id and the seed, documents in
order of their keys are summed up to the budget, and the document at the border is taken if that
comes nearer to the target.

The prefix sums need no sort of a whole source: rows are dealt by ranges of source and key, whose borders
follow the rows, each range is summed on its own, and only the sums of ranges are ordered as wholes. So a
source with a third of all rows is spread over many tasks, whatever its weights.

Defined results: null text has size 0; sources go by code point, null last; rows of one id and size are
taken in no particular order among themselves, as they are alike; sizes of 0 are taken with the
epochs only; rows of one id, source and text share what is taken of them as evenly as it goes; a weight that is null, not finite or below 1e-6 counts as 1e-6; an empty table gives no rows.
Other columns take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glosswork.llm.common import documents, running, unused, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
LOOKUP_ROWS = 100_000  # sources that are broadcast; more are joined by a shuffle
SEED = 20


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """A document's weight in sampling, from 0.25 to 1.5: more for words of plausible length, and more the fewer of its lines repeat."""
    whole = F.coalesce(text, F.lit(""))
    mean = F.length(whole) / F.greatest(size, F.lit(1))
    lines = F.split(whole, "\n", -1)
    plausible = F.when(mean.between(3, 12), 1.0).otherwise(1.0 / (1.0 + F.abs(mean - 7.5)))
    return F.lit(0.25) + plausible * (F.lit(0.25) + F.size(F.array_distinct(lines)) / F.size(lines))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Each source's size and target; one row a source.

    The level at which caps and budget meet is found by prefix sums over the sources in order of the
    level at which each is full, so it needs no iteration, and no task holds all sources.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Strings compare by UTF-8 bytes, which is the order of code points.
    ranked = running(sources, [F.col("source").asc_nulls_last()], k=F.lit(1))
    weighed = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("k"), F.lit(len(weights))) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("w"))
    filled = written(running(weighed, [F.col("full_at"), F.col("k")], caps=F.col("cap"), ws=F.col("w")))
    # If all sources before this one are full, the others share what is left at this level. The first that is not full
    # at its level settles it; from there on levels only fall.
    whole = F.broadcast(filled.agg((F.lit(float(share)) * F.sum("source_size")).alias("budget"), F.sum("w").alias("all_w")))  # one row
    level = filled.join(whole).withColumn("level", (F.col("budget") - F.col("caps")) / (F.col("all_w") - F.col("ws")))
    settled = F.broadcast(level.agg(F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).alias("at")))  # one row
    return filled.join(settled).select("source", "source_size", F.least("cap", F.col("w") * F.coalesce("at", F.lit(float("inf")))).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, mark (a hash of the text), source_size, target, copies, taken for each row of docs."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"), (F.col(weight).cast("double") if weight else F.lit(None).cast("double")).alias("weight")).withColumn("size", word_count(F.col("text")))
    # Texts are read and counted once; from here on rows are narrow.
    sized = written(sized.select("doc_id", "source", "size", F.xxhash64("text").alias("mark"), F.col("weight") if weight else quality_weight(F.col("text"), F.col("size")).alias("weight")).withColumn("rid", F.monotonically_increasing_id()))
    sized = sized.withColumn("weight", F.when(F.isnan("weight") | F.col("weight").isNull() | (F.col("weight") < 1e-6) | (F.col("weight") == float("inf")), F.lit(1e-6)).otherwise(F.col("weight")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) * F.lit(2.0**-52)
    keyed = sized.withColumn("key", -F.log(u) / F.col("weight"))
    # rid only tells equal rows apart, so that ranges can part them.
    ordered = written(running(keyed, [F.col("source").asc_nulls_last(), *map(F.col, ("key", "doc_id", "size", "mark", "rid"))], before=F.col("size")))
    sources = written(ordered.groupBy("source").agg(F.sum("size").alias("size"), F.min("before").alias("start")))
    budget = targets(sources.select("source", "size"), weights, share, most)
    starts = written(sources.join(budget, sources["source"].eqNullSafe(budget["source"])).select(sources["source"].alias("s"), "start", "source_size", "target"))
    starts = F.broadcast(starts) if starts.count() <= LOOKUP_ROWS else starts
    rows = ordered.join(starts, ordered["source"].eqNullSafe(F.col("s"))).drop("s")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    until = F.col("before") - F.col("start") + F.col("size")
    rows = rows.withColumn("epochs", epochs).withColumn("until", until)
    extra = (F.col("size") > 0) & (F.col("until") - rest <= F.col("size") / 2.0) & (rest > 0) & (F.col("epochs") < F.lit(float(most)))
    return rows.withColumn("copies", (F.col("epochs") + extra.cast("long")).cast("long")).select("doc_id", "source", "size", "mark", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, with their columns."""
    taken = mix(docs, doc_id, text, source, **options)
    p, keys = unused(docs), ["doc_id", "source", "mark"]
    total = written(taken.groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).select(*[F.col(k).alias(f"{p}{k}") for k in keys], F.col("copies").alias(f"{p}copies"), F.col("rows").alias(f"{p}rows")).filter(F.col(f"{p}copies") > 0))
    own = {"doc_id": docs[doc_id], "source": docs[source], "mark": F.xxhash64(docs[text])}
    same = reduce(lambda a, b: a & b, [own[k].eqNullSafe(F.col(f"{p}{k}")) for k in keys])
    many = total.filter(F.col(f"{p}rows") > 1)

    def copied(rows: DataFrame, n: Column) -> DataFrame:
        return rows.withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1).cast("long"), n))).select(*docs.columns)

    alone = copied(docs.join(total.filter(F.col(f"{p}rows") == 1), same), F.col(f"{p}copies"))
    if many.isEmpty():
        return alone
    # Rows alike in id, source and text share their copies: the first ones, in no particular order, get one more where they can't be parted evenly.
    place = F.row_number().over(Window.partitionBy(*[f"{p}{k}" for k in keys]).orderBy(F.lit(0)))
    share = F.floor(F.col(f"{p}copies") / F.col(f"{p}rows")) + (F.col(f"{p}place") <= F.col(f"{p}copies") % F.col(f"{p}rows")).cast("long")
    shared = docs.join(many, same).withColumn(f"{p}place", place).withColumn(f"{p}n", share).filter(F.col(f"{p}n") > 0)
    return alone.unionByName(copied(shared, F.col(f"{p}n")))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), k AS (
  SELECT doc_id, source, size,
    -ln((CAST(CAST('0x' || substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) * pow(2::DOUBLE, -52))
      / (0.25::DOUBLE + CASE WHEN length(t) / greatest(size, 1)::DOUBLE BETWEEN 3 AND 12 THEN 1::DOUBLE
                             ELSE 1::DOUBLE / (1::DOUBLE + abs(length(t) / greatest(size, 1)::DOUBLE - 7.5::DOUBLE)) END
           * (0.25::DOUBLE + len(list_distinct(string_split(t, chr(10)))) / len(string_split(t, chr(10)))::DOUBLE)) AS key
  FROM d
), s AS (
  SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source
), w AS (
  SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS w, 2::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, cap / w AS full_at, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), b AS (
  SELECT source, source_size, least(cap, w * (max(CASE WHEN level <= full_at THEN level END) OVER ())) AS target FROM l
), r AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, CASE WHEN b.source_size > 0 THEN floor(b.target / b.source_size) ELSE 0 END AS epochs,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING)::DOUBLE AS until
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * (epochs + CASE WHEN size > 0 AND target - epochs * source_size > 0 AND epochs < 2 AND until - (target - epochs * source_size) <= size / 2.0::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
