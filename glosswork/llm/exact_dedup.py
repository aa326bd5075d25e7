"""Exact dedup by counting quotient filters.

Each partition's 64-bit fingerprints go into counting quotient filters, one for each block of the
fingerprint range: the top bits of a fingerprint within its block (the quotient) name a slot, the rest (the
remainder) is stored in the run of that quotient, sorted, with a counter; three bits a slot tell where runs
are. Quotient and remainder together are the whole fingerprint, so the filters of a block merge without
loss by merging their sorted remainders and adding counters. The number of blocks follows the number
of rows, so a block's filter has a bounded size. Rows whose fingerprint was counted once leave here; only
the others are grouped, by their bytes, which is the verification.

Defined results: null text is the empty text; texts are equal when identical after lower-casing A-Z
only; empty texts are equal to one another. Of equal texts the row with the largest doc_id stays (a
null doc_id is smaller than any other; of wholly equal rows exactly one stays). An empty table gives
no rows. Other columns of the input take no part and may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.llm.common import documents, stable, text_buffers, unused

PER_BLOCK = 1 << 18  # rows to a block of fingerprints, about
HOT = 1000  # a group of over 1 / HOT of all rows is hot
BROADCAST_ROWS = 1_000_000  # of (fingerprint) or (digest, id), 60 MB at most; more are joined by a shuffle
U64 = np.uint64


class CountingQuotientFilter:
    """Slots of remainders with counters and three bits each, over fingerprints of `bits` bits.

    A remainder stands in the slot of its quotient or, shifted, in a later one; remainders of one quotient are a run,
    sorted. `occupied` says that a slot's own quotient has a run somewhere, `continuation` that a slot goes on with
    the run of the slot before, `shifted` that its remainder does not stand in its own slot. Empty slots have none.
    """

    def __init__(self, bits: int, quotient_bits: int, slots: int):
        self.bits, self.quotient_bits, self.slots = bits, quotient_bits, slots
        self.occupied, self.continuation, self.shifted = (np.zeros(slots, bool) for _ in range(3))
        self.remainders, self.counts = np.zeros(slots, U64), np.zeros(slots, np.int64)

    @classmethod
    def of_sorted(cls, values: np.ndarray, counts: np.ndarray, bits: int = 64) -> CountingQuotientFilter:
        """Of distinct fingerprints in order: each run begins in its own slot or, if that is taken, right after the run before."""
        quotient_bits = min(bits, max(3, (max(1, len(values)) * 4 // 3).bit_length()))
        shift = U64(bits - quotient_bits)
        quotients = (values >> shift).astype(np.int64) if bits > quotient_bits else values.astype(np.int64)
        places = np.arange(len(values))
        slot = places + np.maximum.accumulate(quotients - places) if len(values) else places
        out = cls(bits, quotient_bits, max(1 << quotient_bits, int(slot[-1]) + 1 if len(slot) else 0))
        out.occupied[quotients] = True
        out.continuation[slot[1:]] = quotients[1:] == quotients[:-1]
        out.shifted[slot] = slot != quotients
        out.remainders[slot] = values & ((U64(1) << shift) - U64(1))
        out.counts[slot] = counts
        return out

    @classmethod
    def of(cls, fingerprints: np.ndarray, bits: int = 64) -> CountingQuotientFilter:
        return cls.of_sorted(*np.unique(fingerprints.astype(U64), return_counts=True), bits)

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints in order and their counters: the k-th run belongs to the k-th occupied quotient."""
        used = np.flatnonzero(self.counts)
        run = np.cumsum(~self.continuation[used]) - 1
        quotients = np.flatnonzero(self.occupied)[run]
        return (quotients.astype(U64) << U64(self.bits - self.quotient_bits)) | self.remainders[used], self.counts[used]

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """The filter of both inputs' rows: two sorted sequences are merged, equal fingerprints add their counters."""
        (a, m), (b, n) = self.sorted(), other.sorted()
        at = np.searchsorted(a, b)
        known = (at < len(a)) & (a[np.minimum(at, len(a) - 1)] == b) if len(a) else np.zeros(len(b), bool)
        m = m.copy()
        m[at[known]] += n[known]
        return self.of_sorted(np.insert(a, at[~known], b[~known]), np.insert(m, at[~known], n[~known]), self.bits)

    def count(self, fingerprint: int) -> int:
        """Back to the beginning of the cluster, then run by run to the quotient's own."""
        low = self.bits - self.quotient_bits
        quotient, remainder = fingerprint >> low, fingerprint & ((1 << low) - 1)
        if not self.occupied[quotient]:
            return 0
        start = quotient
        while self.shifted[start]:
            start -= 1
        for _ in range(int(self.occupied[start:quotient].sum())):  # the runs of the cluster before this one
            start += 1
            while self.continuation[start]:
                start += 1
        while True:
            if int(self.remainders[start]) == remainder:
                return int(self.counts[start])
            start += 1
            if start == self.slots or not self.continuation[start]:
                return 0

    def dumps(self) -> bytes:
        """Slots in use only: their bits, remainders in as few bytes as hold them, and counters."""
        used = np.flatnonzero(self.counts)
        wide = -(-(self.bits - self.quotient_bits) // 8)
        marks = np.concatenate([np.packbits(x) for x in (self.occupied, self.counts > 0, self.continuation, self.shifted)])
        body = self.remainders[used].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]
        most = int(self.counts.max(initial=0))
        counter = np.uint8 if most < 1 << 8 else np.uint32 if most < 1 << 32 else np.uint64
        head = np.array([self.bits, self.quotient_bits, self.slots, len(used), np.dtype(counter).itemsize], np.int64)
        return b"".join(x.tobytes() for x in (head, marks, np.ascontiguousarray(body), self.counts[used].astype(counter)))

    @classmethod
    def loads(cls, data: bytes) -> CountingQuotientFilter:
        bits, quotient_bits, slots, n, counter = (int(x) for x in np.frombuffer(data, np.int64, 5))
        out = cls(bits, quotient_bits, slots)
        at, row = 40, -(-slots // 8)
        out.occupied, used, out.continuation, out.shifted = (np.unpackbits(np.frombuffer(data, np.uint8, row, at + k * row), count=slots).astype(bool) for k in range(4))
        at, wide = at + 4 * row, -(-(bits - quotient_bits) // 8)
        body = np.zeros((n, 8), np.uint8)
        body[:, :wide] = np.frombuffer(data, np.uint8, n * wide, at).reshape(n, wide)
        out.remainders[used] = body.view("<u8")[:, 0]
        out.counts[used] = np.frombuffer(data, f"u{counter}", n, at + n * wide)
        return out


def block_bits(rows: int) -> int:
    """So many top bits of a fingerprint are its block that a block has about PER_BLOCK rows, and a few blocks keep a cluster busy."""
    return min(40, max(5, (rows // PER_BLOCK).bit_length()))


def _rows(column: pa.Array) -> Iterator[bytes]:
    """Normalised texts in UTF-8: bytes.lower() changes A-Z only."""
    body, ends = text_buffers(column)
    data = memoryview(body)
    for i in range(len(column)):
        yield bytes(data[ends[i] : ends[i + 1]]).lower()


@F.arrow_udf(T.StructType([T.StructField("fp", T.LongType()), T.StructField("sha", T.BinaryType())]))
def digest(texts: pa.Array) -> pa.Array:
    """Fingerprint and SHA-256 of normalised texts."""
    prints, digests = [], []
    for text in _rows(texts):
        prints.append(xxhash.xxh3_64_intdigest(text))
        digests.append(hashlib.sha256(text).digest())
    return pa.StructArray.from_arrays([pa.array(np.array(prints, U64).view(np.int64), pa.int64()), pa.array(digests, pa.binary())], ["fp", "sha"])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = list(_rows(batch.column(1)))
        prints = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], U64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "fp", "body"])


def _filters(top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition's filters, one a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [batch.column(0).to_numpy(zero_copy_only=False) for batch in batches]
        values, counts = np.unique(np.concatenate([*parts, np.empty(0, np.int64)]).view(U64), return_counts=True)
        block = (values >> U64(64 - top)).astype(np.int64)
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        own = values & U64((1 << (64 - top)) - 1)
        ends = np.append(starts[1:], len(values))
        for k in range(0, len(starts), 1024):
            some = list(zip(starts[k : k + 1024], ends[k : k + 1024], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(block[[i for i, _ in some]]), pa.array([CountingQuotientFilter.of_sorted(own[i:j], counts[i:j], 64 - top).dumps() for i, j in some], pa.binary())], ["block", "filter"])

    return run


def _repeated(top: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Merges a block's filters, in pairs; returns the fingerprints that were counted more than once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        filters = [CountingQuotientFilter.loads(x) for x in pdf["filter"]]
        while len(filters) > 1:
            filters = [a.merge(b) for a, b in zip(filters[::2], filters[1::2], strict=False)] + (filters[-1:] if len(filters) % 2 else [])
        values, counts = filters[0].sorted()
        found = values[counts > 1] | U64(int(pdf["block"].iloc[0]) << (64 - top))
        return pd.DataFrame({"fp": found.view(np.int64)})

    return run


def _small(table: DataFrame, rows: int) -> DataFrame:
    """With a hint to broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def _grouped(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """doc_id, fp, sha, rid of each row; the fingerprints counted twice and more; and the groups: sha, keep_id, n."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keys = stable(texts.select("doc_id", digest("text").alias("k")).select("doc_id", "k.fp", "k.sha", F.monotonically_increasing_id().alias("rid")))
    rows = keys.count()
    top = block_bits(rows)
    filters = keys.select("fp").mapInArrow(_filters(top), "block long, filter binary")
    repeated = stable(filters.groupBy("block").applyInPandas(_repeated(top), "fp long"))
    repeated = _small(repeated, repeated.count())
    # Grouping by the bytes themselves is the verification: partial sums are kept map-side, so a hot group sends a row a task.
    bodies = texts.mapInArrow(_bodies, "doc_id long, fp long, body binary").join(repeated, "fp", "left_semi")
    classes = bodies.groupBy("body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1").select(F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "n")
    # One text to a digest, or no result.
    one = F.when(F.count("*") == 1, F.max("keep_id")).otherwise(F.raise_error(F.lit("two texts with one SHA-256")).cast("long"))
    return keys, repeated, stable(classes.groupBy("sha").agg(one.alias("keep_id"), F.max("n").alias("n"))), rows


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs."""
    keys, repeated, groups, rows = _grouped(docs, doc_id, text)
    # Rows with a fingerprint of their own are done; they are not shuffled if the others' fingerprints can be broadcast.
    single = keys.join(repeated, "fp", "left_anti").select("doc_id", "sha", "rid", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"), F.col("rid").alias("last"))
    shared = keys.join(repeated, "fp", "left_semi").select("doc_id", "sha", "rid")
    last = shared.join(_small(groups, groups.count()), "sha").filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("sha").agg(F.max("rid").alias("last"))
    decided = stable(groups.join(last, "sha"))
    # Groups of over a thousandth of all rows are a thousand at most: they are broadcast, and no key left to shuffle is hot.
    hot = F.broadcast(decided.filter(F.col("n") * HOT > rows))
    cold = decided.filter(F.col("n") * HOT <= rows)
    joined = shared.join(hot, "sha").unionByName(shared.join(hot, "sha", "left_anti").join(cold, "sha", "left"))
    lone = F.col("n").isNull()  # two texts of one fingerprint, as the bytes say
    joined = joined.select("doc_id", "sha", "rid", F.when(lone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("n"), F.coalesce("last", "rid").alias("last"))
    return single.unionByName(joined).select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("rid") == F.col("last")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns; no text is shuffled if the groups can be broadcast."""
    keys, repeated, groups, _ = _grouped(docs, doc_id, text)
    p = unused(docs)
    groups = _small(groups, groups.count())
    firsts = keys.join(repeated, "fp", "left_semi").join(groups, "sha").filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("sha").count()
    tied = stable(firsts.filter("count > 1").select(F.col("sha").alias(f"{p}sha")))
    named = groups.select(F.col("sha").alias(f"{p}sha"), F.col("keep_id").alias(f"{p}keep"), F.lit(True).alias(f"{p}shared"))
    keyed = docs.withColumns({f"{p}sha": digest(F.coalesce(F.col(text).cast("string"), F.lit("")))["sha"], f"{p}id": F.col(doc_id).cast("long")})
    stay = F.col(f"{p}shared").isNull() | F.col(f"{p}id").eqNullSafe(F.col(f"{p}keep"))
    if tied.isEmpty():
        return keyed.join(named, f"{p}sha", "left").filter(stay).select(*docs.columns)
    # Where rows repeat the id that stays, one of them does.
    tied = _small(tied, tied.count())
    alone = keyed.join(tied, f"{p}sha", "left_anti").join(named, f"{p}sha", "left").filter(stay)
    again = keyed.join(tied, f"{p}sha", "left_semi").join(named, f"{p}sha").filter(stay).dropDuplicates([f"{p}sha"])
    return alone.select(*docs.columns).unionByName(again.select(*docs.columns))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
