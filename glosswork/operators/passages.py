"""Finding the pages that hold passages, exactly or changed in the middle, by an index of winnowed fingerprints.

Texts are hashed by grams of eight bytes; of each nine grams in a row the smallest hash is a fingerprint. Any
16 bytes that two texts share have a fingerprint in common, wherever they stand, so a page that
holds a passage's first characters has the fingerprints of these. Of a passage's fingerprints the one that
the fewest pages have is looked up, so a frequent phrase is no hot key as long as the passage holds anything rarer,
and only pages found in this way are fetched and compared. Passages of fewer bytes go by grams of eight, four or one byte, which all
pages index only if there are such passages.

Defined results: null and empty passages, and in changed form those without a visible character, are on no page; repeated rows of pages or passages
are found each; ties of frequency go to the smaller fingerprint; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.operators import align
from glosswork.session import kept

GRAM, WINDOW = 8, 9
SURE = GRAM + WINDOW - 1
_PLAIN = "^[\\x00-\\x7f]*$"


def _class(size: Column) -> Column:
    """The kind of keys that a passage of so many bytes has: winnowed grams, or all grams of a size."""
    return F.when(size >= SURE, SURE).when(size >= 8, 8).when(size >= 4, 4).otherwise(1)


def _hashed(body: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` bytes."""
    n = len(body) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out |= body[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    out = (out ^ np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def fingerprints(text: bytes, kind: int) -> np.ndarray:
    """A text's keys of one kind, each once."""
    grams = _hashed(np.frombuffer(text, np.uint8), min(kind, GRAM))
    if kind < SURE:
        return np.unique(grams)
    if len(grams) < WINDOW:
        return grams[:0]
    least = grams[: len(grams) - WINDOW + 1].copy()
    for k in range(1, WINDOW):
        np.minimum(least, grams[k : k + len(least)], out=least)
    return np.unique(least)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _keys(texts: pa.Array, kinds: pa.Array) -> pa.Array:
    """The keys of each text, of each of the kinds in its row."""
    out = [np.concatenate([np.empty(0, np.uint64), *(fingerprints((t or "").encode("utf-8", "surrogatepass"), k) for k in ks or ())]).view(np.int64) for t, ks in zip(texts.to_pylist(), kinds.to_pylist(), strict=True)]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int64), *out])))


def normal_form(text: Column) -> Column:
    """The text that is compared in changed form; that of ASCII text stays in the JVM."""
    closed = F.regexp_replace(F.regexp_replace(text, "[\\t-\\r\\x1c-\\x20]+", " "), " (?=[)\\]},.;:!?])|(?<=[(\\[{]) ", "")
    plain = text.rlike(_PLAIN)
    return F.when(plain, F.trim(closed)).otherwise(align.normal_text(F.when(~plain, text))["text"])


def _name(text: Column) -> Column:
    """What tells passages apart: rows of one text are one passage, rows of one id may be several."""
    return F.sha2(text.cast("binary"), 256)


def found(pages: DataFrame, items: DataFrame, parts: Column) -> DataFrame:
    """doc_id, page_index, name of the pages (doc_id, page_index, key_text) that may hold passages (s): all that have
    each of the passage's `parts`, an array of texts, and some others."""
    parted = items.select(_name(F.col("s")).alias("name"), F.explode(parts).alias("part")).filter("part <> ''").distinct()
    parted = kept(parted.withColumn("kind", _class(F.octet_length("part"))))
    options = kept(parted.select("name", F.explode(_keys("part", F.array("kind"))).alias("key")).distinct())
    kinds = sorted(r.kind for r in parted.select("kind").distinct().collect())  # four at most
    asked = options.select("key").distinct()
    hits = pages.select("doc_id", "page_index", F.explode(_keys("key_text", F.array(*map(F.lit, kinds)) if kinds else F.array().cast("array<int>"))).alias("key"))
    hits = kept(hits.join(asked, "key", "left_semi").distinct())
    pages_of = hits.groupBy("key").agg(F.count("*").alias("pages"))
    # A key that no page has is the rarest: such an item is on no page, and drops out of the join.
    rarest = options.join(pages_of, "key", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("pages", F.lit(0)).alias("pages"), "key")).alias("best"))
    return hits.join(kept(rarest.filter("best.pages > 0").select("name", F.col("best.key").alias("key"))), "key").select("doc_id", "page_index", "name")


def _fetched(pages: DataFrame, items: DataFrame, at: DataFrame, text: str) -> DataFrame:
    """Pages and passages side by side, where they were found."""
    named = at.distinct().withColumnsRenamed({"doc_id": "__doc", "page_index": "__page"})
    rows = pages.join(named, pages["doc_id"].eqNullSafe(F.col("__doc")) & pages["page_index"].eqNullSafe(F.col("__page")))
    return rows.join(items.withColumn("name", _name(F.col(text))), "name")


def occurrences(pages: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of pages (doc_id, page_index, text) and of items (item_id, s) where s occurs in the text."""
    at = found(pages.withColumn("key_text", F.col("text")), items.withColumn("key_text", F.col("s")), F.array("s"))
    columns = [*pages.columns, *[c for c in items.columns if c not in pages.columns]]
    return _fetched(pages, items, at, "s").filter((F.col("s") != "") & F.contains("text", F.col("s"))).select(*columns)


def aligned(pages: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, page_index, item_id, mode, start, end of the passages (item_id, s) on the pages: as they are, in normal form, or between their first and last characters."""
    normal = items.withColumn("key_text", normal_form(F.col("s")))
    size = F.length("key_text")
    anchor = F.when(size < 24, size).otherwise(F.least(F.lit(48), F.greatest(F.lit(16), F.floor(size / 6)))).cast("int")
    parts = F.array(F.substr(F.col("key_text"), F.lit(1), anchor), F.substr(F.col("key_text"), size - anchor + 1, anchor))
    at = found(pages.withColumn("key_text", normal_form(F.col("text"))), normal, parts)
    rows = _fetched(pages.select("doc_id", "page_index", F.col("text").alias("page_text")), items.select("item_id", F.col("s").alias("selection_text")), at, "selection_text")
    rows = align.align(rows.withColumns({"start": F.lit(0), "end": F.length("selection_text")})).filter(F.col("at").isNotNull())
    return rows.select("doc_id", "page_index", "item_id", "at.mode", F.col("at.start").alias("start"), F.col("at.end").alias("end"))
