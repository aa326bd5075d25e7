"""Byte-level BPE encoding and decoding by tree concatenation.

The vocabulary is read from a tokenizers JSON file named by a parameter. A text is cut in halves, whatever
stands there, down to leaves of at most `leaf_chars` characters; the leaves are encoded, in parallel in long
texts, and joined level by level. At each join a growing window of text around it is encoded again
until the new tokens agree exactly with the old ones at both ends of the window. A window begins and ends
where a blank follows another character, which is a cut in any context; the tokens within it then depend on
nothing outside it, and those outside are cut off from what changed, so the ids equal those of one pass.

A piece with more than `long_bytes` bytes (a run that the pre-tokenizer does not cut) holds no such places and
is joined by bytes instead: windows of tokens around the join grow until the new tokens agree with the old ones
at both ends. Neighbouring tokens then are everywhere pairs of a valid encoding, and a sequence of tokens
whose neighbours all are such pairs is the encoding of the whole.

Defined results: null text is the empty text, which has no ids and decodes to the empty text; strings
of special tokens in a text become their ids, as the tokenizers library does by default; repeated rows
get equal results; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm.common import documents, frugal, released, slices, text_buffers

# Fixed: the pattern of the byte-level pre-tokenizer with use_regex.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF_CHARS = 1024
LONG_BYTES = 4_096
LEAF_BYTES = 1_024
SLICE = 1 << 20  # bytes of text whose ids and decoded texts a task holds at once, one row at least
PARALLEL = 64  # leaves from which on they are encoded by several threads


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the other bytes as U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of a byte-level BPE vocabulary given as the text of its JSON file."""

    def __init__(self, definition: str, leaf_chars: int = LEAF_CHARS, long_bytes: int = LONG_BYTES, leaf_bytes: int = LEAF_BYTES, threads: int = 2):
        spec = json.loads(definition)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if spec.get("normalizer") or spec["model"]["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level BPE without a normalizer is supported")
        chars = _byte_of_char()
        # Merges make tokens in the order of their ids, so an id serves as its rank.
        ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.core = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = special
        self.leaf_chars, self.long_bytes, self.leaf_bytes = max(1, leaf_chars), long_bytes, max(1, leaf_bytes)
        self.threads = threads
        self.sizes = {i: len(b) for b, i in ranks.items()}
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.run = regex.compile(r"\s{%d}" % max(1, long_bytes // 4))

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not any(x in text for x in self.special):
            return self._part(text)
        out: list[int] = []
        for part in self.cut.split(text):
            out += [self.special[part]] if part in self.special else self._part(part)
        return out

    def _part(self, text: str) -> list[int]:
        """The ids of a text without special tokens."""
        return self._with_long_pieces(text) if len(text) * 4 > self.long_bytes and self._unsplit(text) else self.tree(text)

    def _unsplit(self, text: str) -> bool:
        """Whether a piece may be longer than long_bytes: a character has four bytes at most."""
        least = self.long_bytes // 4
        return max(map(len, text.split()), default=0) >= least or self.run.search(text) is not None

    def _with_long_pieces(self, text: str) -> list[int]:
        out: list[int] = []
        done, blank = 0, []  # where the open part begins, and its last pieces if they are blank
        for m in self.pattern.finditer(text):
            piece = m[0]
            if len(piece) * 4 > self.long_bytes and len(data := piece.encode()) > self.long_bytes:
                # Blanks before the piece were cut with it in sight, so they are not cut again without it.
                out += self.tree(text[done : m.start() - sum(map(len, blank))])
                for b in blank:
                    out += self.core._encode_single_piece(b.encode())
                out += self.piece_tree(data)
                done, blank = m.end(), []
            else:
                blank = [*blank, piece] if piece.isspace() else []
        return out + self.tree(text[done:])

    def _map(self, f, items: list, pool: ThreadPoolExecutor | None) -> list:
        return list(map(f, items) if pool is None else pool.map(f, items))

    def tree(self, text: str) -> list[int]:
        """The ids of a text without special tokens: leaves, then joins, level by level."""
        n = 1
        while len(text) > n * self.leaf_chars:
            n *= 2
        if n == 1:
            return self.core.encode_ordinary(text)
        bounds = [len(text) * i // n for i in range(n + 1)]
        with ThreadPoolExecutor(self.threads) if n >= PARALLEL else nullcontext() as pool:
            parts = self._map(lambda i: self.core.encode_ordinary(text[bounds[i] : bounds[i + 1]]), range(n), pool)
            while len(parts) > 1:
                half = [(text, bounds[i], bounds[i + 1], bounds[i + 2], parts[i], parts[i + 1]) for i in range(0, len(parts), 2)]
                parts, bounds = self._map(lambda x: self.join(*x), half, pool), bounds[::2]
        return parts[0]

    def join(self, text: str, start: int, cut: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[start:end] from those of its parts before and after cut."""
        w = 8
        while True:
            a, b = _sure(text, start, cut - w, -1), _sure(text, cut + w, end, 1)
            again = self.core.encode_ordinary(text[a:b])
            k = len(left) - self._tokens(reversed(left), text[a:cut])
            m = self._tokens(right, text[cut:b])
            if (a == start or again[0] == left[k]) and (b == end or again[-1] == right[m - 1]):
                return left[:k] + again + right[m:]
            w *= 2

    def _tokens(self, ids: Iterable[int], text: str) -> int:
        """How many of the ids, from the first on, make up a text of which they hold the cut at its end."""
        left, n = len(text.encode()), 0
        for i in ids:
            if left <= 0:
                break
            left -= self.sizes[i]
            n += 1
        return n

    def decode(self, ids: list[int]) -> str:
        return self.core.decode_bytes(ids).decode("utf-8", errors="replace")

    def piece_tree(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        n = max(1, -(-len(data) // self.leaf_bytes))
        bounds = [len(data) * i // n for i in range(n + 1)]
        with ThreadPoolExecutor(self.threads) if n >= PARALLEL else nullcontext() as pool:
            parts = self._map(lambda i: self.core._encode_single_piece(data[bounds[i] : bounds[i + 1]]), range(n), pool)
            while len(parts) > 1:
                pairs = self._map(lambda i: self.join_pieces(parts[i], parts[i + 1]), range(0, len(parts) - 1, 2), pool)
                parts = pairs + parts[2 * len(pairs) :]
        return parts[0]

    def join_pieces(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded byte strings, one after the other."""
        w = 2
        while True:
            a, b = left[-w:], right[:w]
            again = self.core._encode_single_piece(self.core.decode_bytes(a + b))
            left_agrees = len(a) == len(left) or again[0] == a[0]
            right_agrees = len(b) == len(right) or again[-1] == b[-1]
            # A window of one token agrees with itself on one side only if it holds more than the edge token.
            if left_agrees and right_agrees and (len(again) > 1 or (len(a) == len(left) and len(b) == len(right))):
                return left[: len(left) - len(a)] + again + right[len(b) :]
            w *= 2


def _sure(text: str, low: int, high: int, way: int) -> int:
    """The last (way -1) or first place from low to high where a blank follows a character that is none: the pre-tokenizer cuts there in any context. Else low or high."""
    if way < 0:
        at = text.rfind(" ", low + 1, max(low, high) + 1)
        while at > low and text[at - 1].isspace():
            at = text.rfind(" ", low + 1, at)
        return max(at, low)
    at = text.find(" ", min(low, high), high)
    while at >= 0 and text[at - 1].isspace():
        at = text.find(" ", at + 1, high)
    return high if at < 0 else at


_codecs: dict[tuple, Codec] = {}


def codec(definition: str, *options: int) -> Codec:
    """The process's codec for a vocabulary, made once."""
    key = (hash(definition), len(definition), *options)
    if key not in _codecs:
        _codecs[key] = Codec(definition, *options)
        released()  # what parsing the vocabulary took
    return _codecs[key]


def _encoded(own: Codec, batch: pa.RecordBatch, decode: bool) -> pa.RecordBatch:
    """doc_id, ids, n_tokens, decoded of rows (doc_id, text)."""
    ids, sizes, back = [], [], []
    for text in batch.column(1):
        encoded = own.encode(text.as_py() or "")
        ids.append(np.array(encoded, "<u4").tobytes())
        sizes.append(len(encoded))
        back.append(own.decode(encoded) if decode else None)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(back, pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])


def encode_documents(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", leaf_chars: int = LEAF_CHARS, long_bytes: int = LONG_BYTES, leaf_bytes: int = LEAF_BYTES, decode: bool = True) -> DataFrame:
    """doc_id, ids (little-endian uint32), n_tokens, decoded (if asked for) for each row of docs.

    The vocabulary file is read on the driver and broadcast: its size does not depend on the data.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary.value, leaf_chars, long_bytes, leaf_bytes)
        for batch in batches:
            for i, j in slices(text_buffers(batch.column(1))[1], SLICE):
                yield _encoded(own, batch.slice(i, j - i), decode)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, ids binary, n_tokens long, decoded string")


def encode_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text that they decode to."""
    return encode_documents(docs, tokenizer_path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir), default_tokenizer())
