"""Token ids packed into matrices of fixed width by best-fit decreasing.

Each document is encoded and closed with an end token. A document longer than a row is split, without
loss, into pieces of a row's width and a rest. The pieces of a block of tokens are dealt to rows in
decreasing order, each to the fullest row that still has room, which a segment tree over free
capacities finds in log(width) steps. A row holds its ids as little-endian binary, padded to the width, the
cumulative lengths of its segments, the places where position ids start again from 0, and for each
segment the document and the token offset in it, from which documents can be put together again.

Blocks bound a task's memory and are packed where their documents are read: nothing is shuffled.

Defined results: null text is the empty text; an empty document is a segment of its end token alone;
equal pieces keep the order of reading; repeated rows are packed as often as they occur; an empty table
gives no rows; other columns take no part. Which documents share a row depends on how the input is
split, as it does not matter to training; what a row holds for a document does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm.bpe import codec, default_tokenizer
from glosswork.llm.common import documents

WIDTH = 4096
BLOCK_TOKENS = 4 << 20
SCHEMA = "pack_id long, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_offsets array<long>"


class CapacityTree:
    """A segment tree over capacities 0 to width: how many open rows have each, summed by halves."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.sums[at] += n
            at >>= 1

    def smallest(self, least: int) -> int | None:
        """The smallest capacity of an open row that is at least `least`."""
        at = least + self.leaves
        if self.sums[at]:
            return least
        while at > 1:  # up, until a right neighbour has rows, then down its left edge
            if not at & 1 and self.sums[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_decreasing(sizes: np.ndarray, width: int) -> list[list[int]]:
    """Rows of indices of sizes, each at most width in sum."""
    tree = CapacityTree(width)
    open_rows: dict[int, list[int]] = {}
    rows: list[list[int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        capacity = tree.smallest(size) if size < width else None
        if capacity is None:
            row, capacity = len(rows), width
            rows.append([])
        else:
            row = open_rows[capacity].pop()
            tree.add(capacity, -1)
        rows[row].append(i)
        if capacity > size:
            tree.add(capacity - size, 1)
            open_rows.setdefault(capacity - size, []).append(row)
    return rows


def pieces(length: int, width: int) -> list[tuple[int, int]]:
    """Offset and size of the parts of a document."""
    return [(i, min(width, length - i)) for i in range(0, length, width)]


def packed(docs: list[tuple[int | None, np.ndarray]], width: int, pad: int) -> Iterator[tuple]:
    """Rows of one block of documents given as ids."""
    parts = [(k, offset, size) for k, (_, ids) in enumerate(docs) for offset, size in pieces(len(ids), width)]
    for row in best_fit_decreasing(np.array([p[2] for p in parts], np.int64), width):
        segments = [parts[i] for i in row]
        out = np.full(width, pad, docs[0][1].dtype)
        ends = np.cumsum([size for _, _, size in segments])
        for (k, offset, size), end in zip(segments, ends, strict=True):
            out[end - size : end] = docs[k][1][offset : offset + size]
        yield int(ends[-1]), len(segments), out.tobytes(), [0, *ends.tolist()], [0, *ends[:-1].tolist()], [docs[k][0] for k, _, _ in segments], [offset for _, offset, _ in segments]


def pack_documents(docs: DataFrame, tokenizer_path: str, end_token: str = "<|endoftext|>", width: int = WIDTH, block_tokens: int = BLOCK_TOKENS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed rows of the encoded documents; see SCHEMA. Ids take two bytes if the vocabulary allows, else four."""
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary.value)
        end = own.core.encode_single_token(end_token)
        kind = np.dtype("<u2" if own.core.n_vocab <= 1 << 16 else "<u4")
        serial, block, held = TaskContext.get().partitionId() << 40, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal serial
            rows = []
            for row in packed(block, width, end):
                rows.append((serial, *row))
                serial += 1
                if len(rows) == 256:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(own.encode(body or ""), end).astype(kind)
                block.append((name, ids))
                held += len(ids)
                if held >= block_tokens:
                    yield from close()
                    block, held = [], 0
        if block:
            yield from close()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def write_packs(packs: DataFrame, path: str, width: int = WIDTH) -> DataFrame:
    """Writes packs as Parquet shards under path/packs, and path/manifest, one JSON line a shard; returns the manifest.

    A manifest's row has the shard's name, rows, tokens, segments, the width, the bytes of an id and a checksum of the id matrices.
    """
    packs.write.parquet(f"{path}/packs")
    back = packs.sparkSession.read.parquet(f"{path}/packs").withColumn("shard", F.regexp_extract(F.input_file_name(), "[^/]+$", 0))
    shards = back.groupBy("shard").agg(
        F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"), F.sum("n_segments").alias("segments"), (F.max(F.octet_length("ids")) / width).cast("int").alias("id_bytes"), F.bit_xor(F.xxhash64("pack_id", "ids")).alias("checksum"),
    )
    shards.withColumn("width", F.lit(width)).write.json(f"{path}/manifest")
    return packs.sparkSession.read.json(f"{path}/manifest")


def position_ids(cu_seqlens: list[int]) -> np.ndarray:
    """0, 1, ... within each segment of a row."""
    bounds = np.asarray(cu_seqlens)
    return np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), default_tokenizer())
