"""Phrase collocations: words are encoded by a dictionary, n-grams of ids are sorted and run lengths counted.

1. Words are counted by language, a row for each word and chunk of a task, summed map-side. Words that occur
   `least` times get dense ids by prefix counts, ordered by language and word, so an id tells its language.
2. Texts become id arrays. Pieces break at other words too, as no phrase with such a word can count. The dictionary
   is broadcast as 20 bytes a word; of more than DICTIONARY words the most frequent ones are, and occurrences of the rest,
   which are rare, get their ids by a join.
3. Bigrams of ids, then trigrams whose two bigrams both count, become keys of fixed width, twelve bytes, big-endian.
   A task sorts its keys and counts runs, and keys are range-partitioned, sorted by Spark's radix sort and run-length
   counted, so a hot phrase is a row a task. Which trigrams to count is looked up in the sorted bigrams if these are
   DICTIONARY at most, else in a Bloom filter of fixed size: what passes by chance is counted and falls below `least`.
4. Counts of parts come by equi-joins; scores are decimals of 38 digits, so products past 64 bits are exact.

Defined results: null text is the empty text; null languages count as `und`, with that language's own rows; A-Z are lower-cased; pieces
end at `.,;:!?` and U+000A to U+000D, words at space and tab; repeated rows count each; ties go by phrase in UTF-8 byte order,
and no two rows of a language have one phrase; an empty table gives no rows; other columns take no part. Words are told apart by hashes of 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glosswork.llm import bloom
from glosswork.llm.common import GOLDEN, U64, documents, frugal, mix, released, running, slices, text_buffers, written
from glosswork.llm.words import inverse_powers, prefix_sums

LEAST = 10
TOP = 2000
PERCENT = 50
DICTIONARY = 4_000_000
SLICE = 1 << 20  # bytes of text at once, at least one text or the part of one up to the end of a piece
CHUNK = 1 << 20  # ids at once
PARTS = 16  # of a language, in which its best phrases are chosen first
FILTER_KEYS = bloom.MOST_BITS // 8  # keys that a filter of MOST_BITS holds at a false-positive rate of 2 %

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 0 of a word, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_BYTE = mix(np.arange(1, 257, dtype=U64))  # a second alphabet, for the second hash


def _lang_salt(lang: str) -> np.uint64:
    return U64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def word_places(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and pieces of the words of texts; pieces of different rows differ."""
    kind = _KIND[body]
    word = kind == 0
    first = np.zeros(len(body) + 1, bool)
    first[offsets] = True
    start, last = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | first[1:-1]
    last[:-1] &= ~word[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows, np.cumsum(kind == 2)[starts] + rows


def hashes_of(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word and its language."""
    down, size = inverse_powers(starts, len(body)), (ends - starts).astype(U64) * GOLDEN
    sums = prefix_sums(body)
    a = mix((sums[ends] - sums[starts]) * down + size + salts)
    # The second one sums other numbers for the bytes, over 16-bit halves that prefix_sums can take.
    sums = prefix_sums((_BYTE[body] >> U64(48)).astype(np.uint16))
    return a, mix((sums[ends] - sums[starts]) * down - size ^ salts)


def cut(body: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts, A-Z lower-cased, in slices that end with a text, or within a long one with a piece: bytes, offsets and the rows that these begin."""
    for i, j in slices(offsets, SLICE):
        begin, end = int(offsets[i]), int(offsets[j])
        if end - begin <= 2 * SLICE:
            yield _LOWER[body[begin:end]], offsets[i : j + 1] - begin, np.arange(i, j)
            continue
        while begin < end:  # one long text
            until = min(end, begin + SLICE)
            while until < end:
                ahead = np.flatnonzero(_KIND[body[until : until + 4096]] == 2)
                if len(ahead):
                    until += int(ahead[0]) + 1
                    break
                until = min(end, until + 4096)
            yield _LOWER[body[begin:until]], np.array([0, until - begin]), np.array([i])
            begin = until


def texts_at(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(body[at].tobytes()))


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Of rows of lang and text, slice by slice: bytes, starts, ends, language of each word, pieces and two hashes."""
    langs = batch.column(0).dictionary_encode()
    names = langs.dictionary.to_pylist()
    salts = np.array([_lang_salt(x) for x in names] or [0], U64)
    codes = langs.indices.to_numpy()
    for body, offsets, rows in cut(*text_buffers(batch.column(1))):
        starts, ends, of, pieces = word_places(body, offsets)
        if len(starts):
            lang = codes[rows[of]]
            yield body, starts, ends, lang, names, pieces, *hashes_of(body, starts, ends, salts[lang])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for body, starts, ends, lang, names, _, a, b in _tokens(batch):
            order = np.argsort(a, kind="stable")
            new = np.flatnonzero(np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)]))
            at = order[new]
            counts = np.diff(np.append(new, len(order)))
            yield pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(pa.array(lang[at], pa.int32()), pa.array(names, pa.string())).cast(pa.string()), texts_at(body, starts[at], ends[at]), pa.array(counts), pa.array(a[at].view(np.int64)), pa.array(b[at].view(np.int64))], ["lang", "word", "f", "a", "b"])


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, f, a, b (its hashes) of texts (lang, text)."""
    return texts.mapInArrow(frugal(_counted), "lang string, word string, f long, a long, b long").groupBy("lang", "word").agg(F.sum("f").alias("f"), F.min("a").alias("a"), F.min("b").alias("b"))


class Ids:
    """Words' ids by hash; 0 for words that are not in it."""

    def __init__(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(a)
        self.a, self.b, self.ids = a[order], b[order], ids[order]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.a):
            return np.zeros(len(a), np.int32)
        order = np.argsort(a)  # neighbours in the dictionary are found in the processor's cache
        at = np.minimum(np.searchsorted(self.a, a[order]), len(self.a) - 1)
        out = np.empty(len(a), np.int32)
        out[order] = np.where((self.a[at] == a[order]) & (self.b[at] == b[order]), self.ids[at], 0)
        return out


def broken(ids: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """The ids with a 0 between pieces; runs of 0 become one."""
    where = np.flatnonzero(np.diff(pieces)) + 1
    out = np.concatenate([np.insert(ids, where, 0), np.zeros(1, ids.dtype)])
    return out[(out != 0) | (np.concatenate([[0], out[:-1]]) != 0)]


def _encoded(known: Ids) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, pieces, a, b in _tokens(batch):
                yield pa.RecordBatch.from_arrays([pa.array([broken(known.of(a, b), pieces).tobytes()], pa.binary())], ["ids"])
            released()

    return run


def _placed(known: Ids) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row a word: its slice, its place (places of different pieces are no neighbours), its id or, where that is 0, its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            for _, starts, *_, pieces, a, b in _tokens(batch):
                place = np.arange(len(starts)) + pieces
                part += 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), part)), pa.array(place), pa.array(known.of(a, b)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["part", "place", "id", "a", "b"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of rows sorted by part and place, with a 0 wherever places are no neighbours."""
    last = None
    for batch in batches:
        part, place, ids = (batch.column(k).to_numpy() for k in range(3))
        if not len(ids):
            continue
        apart = np.concatenate([[True], (np.diff(part) != 0) | (np.diff(place) != 1)])
        if last is not None:  # the last two words go before, so that no phrase is lost between batches
            part, place, ids = (np.concatenate([x, y]) for x, y in zip(last, (part, place, ids), strict=True))
            apart = np.concatenate([[True], (np.diff(part) != 0) | (np.diff(place) != 1)])
        yield pa.RecordBatch.from_arrays([pa.array([np.insert(ids, np.flatnonzero(apart), 0).astype(np.int32).tobytes()], pa.binary()), pa.array([0 if last is None else len(last[0])], pa.int32())], ["ids", "again"])
        last = part[-2:], place[-2:], ids[-2:]


def frequent_words(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The dictionary (id, lang, word, f, a, b), ids from 1 by language and word, and lang, n: all word occurrences."""
    counts = written(word_counts(texts))
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    ranked = running(counts.filter(F.col("f") >= least), [F.col("lang"), F.col("word")], before=F.lit(1).cast("long"))
    return written(ranked.select((F.col("before") + 1).alias("id"), "lang", "word", "f", "a", "b")), written(totals)


def _held(rows: DataFrame) -> Ids:
    table = rows.select("a", "b", "id").toArrow()
    return Ids(*(table.column(c).to_numpy().view(U64) for c in ("a", "b")), table.column("id").to_numpy().astype(np.int32))


def encoded(texts: DataFrame, words: DataFrame, limit: int) -> DataFrame:
    """Arrays of ids (int32 in little-endian bytes), 0 between pieces; phrases within an array's first `again` words stand in another one, too."""
    size = words.count()
    if size >= 1 << 31:
        raise ValueError("ids have 31 bits")
    if size <= limit:
        return written(texts.mapInArrow(frugal(_encoded(_held(words))), "ids binary").withColumn("again", F.lit(0)))
    # As many words as occur most often; the number of words of each count is known, so none is cut at random.
    sums = Window.orderBy(F.col("f").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    floor = words.groupBy("f").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(sums)).filter(F.col("upto") <= limit).agg(F.min("f")).first()[0]
    head = words.filter(F.col("f") >= floor) if floor is not None else words.limit(0)
    tail = words.join(head.select("id"), "id", "left_anti").select("a", "b", F.col("id").alias("other"))
    placed = written(texts.mapInArrow(frugal(_placed(_held(head))), "part long, place long, id int, a long, b long"))
    rare = placed.filter("id = 0").join(tail, ["a", "b"]).select("part", "place", F.col("other").cast("int").alias("id"))
    both = placed.filter("id <> 0").select("part", "place", "id").unionByName(rare)
    return written(both.repartition("part").sortWithinPartitions("part", "place").mapInArrow(frugal(_gathered), "ids binary, again int"))


def packed(ids: list[np.ndarray]) -> np.ndarray:
    """Keys of three ids each, 12 bytes, big-endian; the order of the bytes is that of the ids."""
    out = np.zeros((len(ids[0]), 3), ">u4")
    for k, column in enumerate(ids):
        out[:, k] = column
    return out


def grams_of(ids: np.ndarray, again: int, size: int, known: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> list[np.ndarray]:
    """The columns of all n-grams of an id array that hold no 0; `known` tells which bigrams count."""
    ids = ids.astype(np.int64)
    spans = [ids[k : len(ids) - size + 1 + k] for k in range(size)]
    fit = np.logical_and.reduce([s != 0 for s in spans])
    if again:
        words = np.cumsum(ids != 0)
        fit &= words[size - 1 :] > again  # else the phrase was counted with the array before
    at = np.flatnonzero(fit)
    if known is not None and len(at):
        at = at[known(ids[at], ids[at + 1])]
        at = at[known(ids[at + 1], ids[at + 2])]
    return [s[at].astype(np.int32) for s in spans]


def runs(keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys in their order, and their counts."""
    if not len(keys[0]):
        return keys, np.zeros(0, np.int64)
    bits = max(1, int(max(int(k.max()) for k in keys)).bit_length())
    if bits * len(keys) <= 63:  # one number a key
        whole = keys[0].astype(np.int64)
        for k in keys[1:]:
            whole = whole << bits | k
        whole.sort()
        new = np.flatnonzero(np.concatenate([[True], np.diff(whole) != 0]))
        parts = [whole[new] >> bits * (len(keys) - 1 - k) & ((1 << bits) - 1) for k in range(len(keys))]
        return parts, np.diff(np.append(new, len(whole)))
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([np.diff(k) != 0 for k in keys])]))
    return [k[new] for k in keys], np.diff(np.append(new, len(order)))


def _grams(size: int, known: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            keys, counts = runs(whole)
            del whole
            for i in range(0, len(counts), 1 << 16):
                rows = packed([k[i : i + (1 << 16)] for k in keys])
                yield pa.RecordBatch.from_arrays([pa.FixedSizeBinaryArray.from_buffers(pa.binary(12), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary()), pa.array(counts[i : i + (1 << 16)])], ["key", "f"])

        for batch in batches:
            for ids, again in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                held.append(grams_of(np.frombuffer(ids.as_buffer(), np.int32), again, size, known))
                if sum(len(h[0]) for h in held) >= CHUNK:
                    yield from flushed()
                    released()
        if held:
            yield from flushed()

    return run


def _run_lengths(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over runs of equal keys of sorted rows; the run that a batch ends with is carried on."""

    def columns(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        rows = keys.view(">u4").reshape(-1, 3).astype(np.int64)
        return pa.RecordBatch.from_arrays([*(pa.array(rows[:, k]) for k in range(3)), pa.array(sums)], ["id1", "id2", "id3", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_sum = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _fixed(batch.column(0))
            f = batch.column(1).to_numpy()
            words = keys.view("V12").reshape(-1)
            new = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            sums = np.add.reduceat(f, new)
            if open_key is not None and words[0].tobytes() == open_key:
                sums[0] += open_sum
            elif open_key is not None and open_sum >= least:
                yield columns(np.frombuffer(open_key, np.uint8), np.array([open_sum]))
            open_key, open_sum = words[new[-1]].tobytes(), int(sums[-1])
            done = new[:-1][sums[:-1] >= least]
            if len(done):
                yield columns(np.ascontiguousarray(keys.reshape(-1, 12)[done]).reshape(-1), sums[:-1][sums[:-1] >= least])
        if open_key is not None and open_sum >= least:
            yield columns(np.frombuffer(open_key, np.uint8), np.array([open_sum]))

    return run


def _fixed(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column whose values have 12 bytes each."""
    body, ends = column.buffers()[2], np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(body, np.uint8)[ends[0] : ends[-1]]


def gram_counts(arrays: DataFrame, size: int, least: int, known: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """id1, id2, id3 (0 in bigrams), f of all n-grams that occur `least` times."""
    keys = written(arrays.mapInArrow(frugal(_grams(size, known)), "key binary, f long"))
    return written(keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(frugal(_run_lengths(least)), "id1 long, id2 long, id3 long, f long"))


def bigram_test(bigrams: DataFrame, limit: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Tells which bigrams count: exactly if they are `limit` at most, else all of them and some others."""
    n = bigrams.count()
    if n <= limit:
        table = bigrams.select("id1", "id2").toArrow()
        keys = np.sort(table.column("id1").to_numpy() << 32 | table.column("id2").to_numpy())

        def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.zeros(len(x), bool)
            asked = x << 32 | y
            order = np.argsort(asked)
            out = np.empty(len(x), bool)
            at = np.minimum(np.searchsorted(keys, asked[order]), len(keys) - 1)
            out[order] = keys[at] == asked[order]
            return out

        return exact
    # A filter that more keys than FILTER_KEYS share is fuller and lets more through, never less.
    held = bloom.built(bigrams.select("id1", "id2"), min(n, FILTER_KEYS), 0.02)
    return lambda x, y: held.holds(x.astype(U64), y.astype(U64))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, percent: int = PERCENT, limit: int = DICTIONARY) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of two and three words."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    words, totals = frequent_words(texts, least)
    arrays = encoded(texts, words, limit)
    two = gram_counts(arrays, 2, least).select("id1", "id2", "f")
    three = gram_counts(arrays, 3, least, bigram_test(two, limit))

    # A bigram goes if a trigram around it is frequent enough; of these the most frequent one decides.
    inner = three.select("f", F.explode(F.array(F.struct("id1", "id2"), F.struct(F.col("id2").alias("id1"), F.col("id3").alias("id2")))).alias("k")).groupBy("k.id1", "k.id2").agg(F.max("f").alias("longer"))
    pairs = two.join(inner, ["id1", "id2"], "left").filter(F.coalesce(100 * F.col("longer") < percent * F.col("f"), F.lit(True)))
    pairs = pairs.select("id1", "id2", F.lit(0).cast("long").alias("id3"), F.col("id2").alias("end"), F.col("f").alias("a"), F.lit(None).cast("long").alias("head"), F.lit(None).cast("long").alias("tail"))
    triples = three.join(two.select("id1", "id2", F.col("f").alias("head")), ["id1", "id2"]).join(two.select(F.col("id1").alias("id2"), F.col("id2").alias("id3"), F.col("f").alias("tail")), ["id2", "id3"])
    triples = triples.select("id1", "id2", "id3", F.col("id3").alias("end"), F.col("f").alias("a"), "head", "tail")
    phrases = written(pairs.unionByName(triples))
    first = words.select(F.col("id").alias("id1"), "lang", F.col("word").alias("w1"), F.col("f").alias("f1"))
    last = words.select(F.col("id").alias("end"), F.col("word").alias("w3"), F.col("f").alias("f3"))
    middle = words.select(F.col("id").alias("id2"), F.col("word").alias("w2"))
    whole = phrases.join(first, "id1").join(last, "end").join(middle, "id2")

    def part(k: int, left: str, right: str) -> Column:
        # 10**6 * a * a has 38 digits at most for counts below 10**16; beyond, Spark raises an error.
        score = F.expr(f"cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * cast(1000000 as decimal(7,0)) div (cast({left} as decimal(18,0)) * cast({right} as decimal(18,0)))")
        return F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    best = F.when(F.col("id3") == 0, part(1, "f1", "f3")).otherwise(F.least(part(1, "f1", "tail"), part(2, "head", "f3")))
    named = whole.withColumn("best", best).select("lang", F.when(F.col("id3") == 0, F.concat_ws(" ", "w1", "w3")).otherwise(F.concat_ws(" ", "w1", "w2", "w3")).alias("phrase"), "a", "best.l", "best.r", "best.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # First the best of parts of a language, so that no task orders all of a language's phrases.
    some = named.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("at") <= top).drop("part", "at")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM d
), g AS (
  SELECT lang, 1 AS k, unnest(ws) AS phrase, NULL AS x, NULL AS y FROM p
  UNION ALL
  SELECT lang, 2, s[1] || ' ' || s[2], s[1], s[2] FROM (SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i:i + 1])) AS s FROM p)
  UNION ALL
  SELECT lang, 3, s[1] || ' ' || s[2] || ' ' || s[3], s[1] || ' ' || s[2], s[2] || ' ' || s[3] FROM (SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2])) AS s FROM p)
), c AS (
  SELECT lang, k, phrase, any_value(x) AS x, any_value(y) AS y, count(*) AS f FROM g GROUP BY lang, k, phrase
), n AS (
  SELECT lang, sum(f) AS n FROM c WHERE k = 1 GROUP BY lang
), cand AS (
  SELECT * FROM c WHERE k > 1 AND f >= 10
), gone AS (
  SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, x AS phrase, f FROM cand WHERE k = 3 UNION ALL SELECT lang, y, f FROM cand WHERE k = 3) GROUP BY lang, phrase
), stay AS (
  SELECT cand.* FROM cand LEFT JOIN gone USING (lang, phrase) WHERE k = 3 OR longer IS NULL OR 100 * longer < 50 * f
), cuts AS (
  SELECT lang, phrase, f AS a, 1 AS cut, split_part(phrase, ' ', 1) AS lp, CASE WHEN k = 2 THEN y ELSE y END AS rp FROM stay
  UNION ALL
  SELECT lang, phrase, f, 2, x, split_part(phrase, ' ', 3) FROM stay WHERE k = 3
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, cut, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts JOIN c l ON l.lang = cuts.lang AND l.phrase = cuts.lp AND l.k = CASE WHEN cut = 1 THEN 1 ELSE 2 END
  JOIN c r ON r.lang = cuts.lang AND r.phrase = cuts.rp AND r.k = len(string_split(cuts.rp, ' '))
), chosen AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM chosen
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
