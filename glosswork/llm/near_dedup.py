"""Near-duplicate detection by BagMinHash signatures, banding and exact multiset verification.

Texts become multisets of five-word shingles. Each shingle with weight w runs Poisson processes over
the discretised weight range (0, w], cut into dyadic intervals that form a hierarchy; a point of a
process has a time, a level within its interval, which thins it to the weights that reach it, and a
register. The earliest point of each register is the signature, and two signatures agree in a register
with the probability of the weighted Jaccard similarity of the multisets. Points are made in order of
time and only up to the time by which all registers are filled, so the work is about one draw a shingle
and m (ln m + 3) a text.

Rows of one multiset are one node. Nodes that share a band form buckets. A bucket is not expanded into
all its pairs: first its members are verified against one pivot, the member whose bands are shared most;
then, as long as a bucket still holds several components, up to `pivots` of its members outside its
largest component are verified against members of other components. Two bounds that lose nothing keep
these pairs few: sizes alone limit the similarity, and so do sketches, the counts of shingles by class
without those that occur in one node only, which no other node can share. When no member is left to try, every pair of a bucket is connected, verified or
excluded by a bound, so no link is lost and no size of bucket is cut off. Verification is exact:
5 * overlap >= 4 * union over shingle counts.

Defined results: null text is the empty text; words are runs of letters, digits and non-ASCII
characters after lower-casing; texts of one to four words have one shingle of all their words; texts
without words are like no other text, each its own class; a class is a connected component; class_id is
its smallest doc_id (null is smallest) and that row is kept, one only if rows repeat. An empty table
gives no rows. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glosswork.llm.common import GOLDEN, U64, documents, frugal, mix, salt, scratch, slices, unit, unused, written
from glosswork.llm.words import lowered, shingles, word_hashes

WORDS = 5
BANDS, ROWS = 25, 5  # a pair of similarity 0.8 shares a band with probability 1 - 5e-5
REGISTERS = BANDS * ROWS
SLICE = 1 << 19  # bytes of text at once; a worker's temporaries are some 60 times that
CLASSES = 64  # of shingles, in the sketches that bound overlaps
BROADCAST_ROWS = 1_000_000  # of ids and digests of rows that go, 60 MB at most; more are joined by a shuffle
PARTS = 16  # of a bucket, in which the members to try next are chosen


def multisets(body: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes, sorted, their counts, and the rows' offsets."""
    every, bounds = shingles(*word_hashes(body, offsets), k)
    every = every.copy()
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        every[i:j].sort()
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    at = np.flatnonzero(new)
    return every[at], np.diff(np.append(at, len(every))), np.searchsorted(at, bounds)


def bag_minhash(hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Signatures (rows by m) of weighted sets; rows without elements get zeros."""
    n = len(bounds) - 1
    rows = np.repeat(np.arange(n), np.diff(bounds))
    total = np.bincount(rows, weights, n)
    # Interval 0 is (0, 1], interval k is (2**(k - 1), 2**k]; an element enters those that begin below its weight.
    seeds, owner, length, base, reach = [mix(hashes)], [rows], [np.ones(len(rows))], [np.zeros(len(rows))], [weights.astype(np.float64)]
    k, rest = 1, np.flatnonzero(weights > 1)
    while len(rest):
        low = float(1 << (k - 1))
        seeds.append(mix(hashes[rest] + salt(k)))
        owner.append(rows[rest])
        length.append(np.full(len(rest), low))
        base.append(np.full(len(rest), low))
        reach.append(weights[rest].astype(np.float64))
        k += 1
        rest = rest[weights[rest] > 1 << (k - 1)]
    seeds, owner, length, base, reach = map(np.concatenate, (seeds, owner, length, base, reach))
    ids = np.zeros((n, m), U64)
    with np.errstate(divide="ignore"):
        horizon = (np.log(m) + 3) / total
    todo = total > 0
    while todo.any():
        active = np.flatnonzero(todo[owner])
        time, draw = np.zeros(len(active)), 0
        best = np.full(n * m, np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(active):
            draw += 1
            point = mix(seeds[active] + salt(draw))
            time = time - np.log(unit(point)) / (m * length[active])
            on = time <= horizon[owner[active]]
            active, time, point = active[on], time[on], point[on]
            other = mix(point ^ GOLDEN)
            level = base[active] + 1 + np.floor((other & U64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * length[active])
            taken = level <= reach[active]
            place = owner[active[taken]] * m + (((other[taken] >> U64(32)) * U64(m)) >> U64(32)).astype(np.int64)
            np.minimum.at(best, place, time[taken])
            found.append((place, time[taken], point[taken]))
        flat = ids.reshape(-1)
        for place, when, point in found:
            first = when == best[place]
            flat[place[first]] = point[first]
        todo &= np.isinf(best.reshape(n, m)).any(axis=1)
        horizon = np.where(todo, horizon * 2, horizon)
    return ids


def band_keys(signatures: np.ndarray) -> np.ndarray:
    out = np.tile(np.arange(1, BANDS + 1, dtype=U64) * GOLDEN, (len(signatures), 1))
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    for r in range(ROWS):
        out = mix(out * U64(31) + parts[:, :, r])
    return out.view(np.int64)


def digests(hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each row's multiset: equal for equal multisets only, but for a chance of 2**-128."""
    out = np.zeros((len(bounds) - 1, 2), U64)
    for k in range(2):
        sums = np.concatenate([[U64(0)], np.cumsum(mix(hashes ^ salt(k + 1)) * weights.astype(U64), dtype=U64)])
        out[:, k] = sums[bounds[1:]] - sums[bounds[:-1]]
    return out.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, offsets = lowered(batch.column(1))
        for i, j in slices(offsets, SLICE):
            sets = multisets(body[offsets[i] : offsets[j]], offsets[i : j + 1])
            n = np.add.reduceat(np.append(sets[1], 0), sets[2][:-1]) * (np.diff(sets[2]) > 0)
            keys, marks = band_keys(bag_minhash(*sets)), digests(*sets)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * (j - i) + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in (0, 2, 3)), pa.array(n.astype(np.int64)), pa.array(marks[:, 0]), pa.array(marks[:, 1]), bands], ["doc_id", "mark", "sha", "n", "f1", "f2", "bands"])


def _own_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows that share a doc_id, those whose text is the node's."""
    for batch in batches:
        body, offsets = lowered(batch.column(1))
        for i, j in slices(offsets, SLICE):
            marks = digests(*multisets(body[offsets[i] : offsets[j]], offsets[i : j + 1]))
            same = (marks[:, 0] == batch.column(2).slice(i, j - i).to_numpy()) & (marks[:, 1] == batch.column(3).slice(i, j - i).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(k).slice(i, j - i).filter(pa.array(same)) for k in (0, 1)], ["node", "text"])


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Size of the intersection of two multisets, each sorted hashes and counts."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    return int(np.minimum(a[1][same], b[1][at[same]]).sum())


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    shared = overlap(a, b)
    return 5 * shared >= 4 * (int(a[1].sum()) + int(b[1].sum()) - shared)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, salt, b), a's own text first (b null), then the texts to hold against it."""
    group, lead = None, None
    for batch in batches:
        a, salt, b = (batch.column(k).to_pylist() for k in (0, 1, 2))
        body, offsets = lowered(batch.column(3))
        left, right = [], []
        for i, j in slices(offsets, SLICE):
            hashes, counts, bounds = multisets(body[offsets[i] : offsets[j]], offsets[i : j + 1])
            for r in range(i, j):
                own = hashes[bounds[r - i] : bounds[r - i + 1]], counts[bounds[r - i] : bounds[r - i + 1]]
                if b[r] is None:
                    group, lead = (a[r], salt[r]), own
                elif group == (a[r], salt[r]) and similar(lead, own):
                    left.append(a[r])
                    right.append(b[r])
            if lead is not None:
                lead = lead[0].copy(), lead[1].copy()
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def verify(pairs: DataFrame, texts: DataFrame, group: int = 200) -> DataFrame:
    """The similar ones of pairs (a, b). A node with many partners is dealt to several groups, so that none is large."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / group).alias("parts"))
    dealt = pairs.join(degree, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("salt"), "b")
    leads = degree.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt")).join(texts.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    rest = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "text")
    return leads.union(rest).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(frugal(_verified), "a long, b long").distinct()


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, offsets = lowered(batch.column(1))
        for i, j in slices(offsets, SLICE):
            hashes, counts, bounds = multisets(body[offsets[i] : offsets[j]], offsets[i : j + 1])
            node = np.repeat(batch.column(0).slice(i, j - i).to_numpy(), np.diff(bounds))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(node), pa.array(counts)], ["shingle", "node", "w"])


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, offsets = lowered(batch.column(1))
        for i, j in slices(offsets, SLICE):
            hashes, counts, bounds = multisets(body[offsets[i] : offsets[j]], offsets[i : j + 1])
            place = np.repeat(np.arange(j - i), np.diff(bounds)) * CLASSES + (hashes % U64(CLASSES)).astype(np.int64)
            totals = np.bincount(place, counts, CLASSES * (j - i)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(np.arange(0, CLASSES * (j - i) + 1, CLASSES, dtype=np.int32)), pa.array(totals))], ["node", "totals"])


def _sketches(texts: DataFrame) -> DataFrame:
    """node, sketch: how much of each node's multiset other nodes of these may share, by class of shingle."""
    rows = texts.mapInArrow(frugal(_shingle_rows), "shingle long, node long, w long")
    alone = rows.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last"), F.max("w").alias("w")).filter("node = last")
    unshared = alone.groupBy("node", F.pmod("shingle", F.lit(CLASSES)).cast("int").alias("class")).agg(F.sum("w").cast("int").alias("w"))
    unshared = unshared.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("class", "w"))).alias("unshared"))
    totals = texts.mapInArrow(frugal(_class_counts), "node long, totals array<int>")
    rest = F.transform("totals", lambda t, k: t - F.coalesce(F.try_element_at("unshared", k), F.lit(0)))
    return totals.join(unshared, "node", "left").select("node", F.when(F.col("unshared").isNull(), F.col("totals")).otherwise(rest).alias("sketch"))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest node that each node of a partition's edges is connected with in that partition."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    if parent:
        nodes = np.fromiter(parent, np.int64, len(parent))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([find(x) for x in nodes.tolist()], pa.int64())], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """node, comp (its component's smallest node) of the nodes of edges (a, b).

    Each partition reduces its edges to trees. A node in trees of several partitions links their roots; these
    links are a graph of fewer nodes, whose components are found in the same way until there are none.
    """
    with scratch() as kept:
        trees = written(edges.select("a", "b").mapInArrow(_forest, "node long, root long"))
        # A node is in one tree of a partition at most, so no node is hot.
        placed = trees.withColumn("comp", F.min("root").over(Window.partitionBy("node")))
        labels = placed.select("node", "comp").dropDuplicates(["node"])
        links = written(placed.filter("root <> comp").select(F.col("root").alias("a"), F.col("comp").alias("b")).distinct())
        if links.isEmpty():
            return kept(labels)
        merged = components(links).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        return kept(labels.join(merged, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pivots: int = 512, digest: bool = False) -> DataFrame:
    """doc_id, class_id, class_size, kept and sha, with digest the SHA-256 of the text, for each row of docs; rid tells repeated rows apart."""
    with scratch() as kept:
        return kept(_near_duplicates(docs, doc_id, text, pivots, digest))


def _near_duplicates(docs: DataFrame, doc_id: str, text: str, pivots: int, digest: bool) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    sha = F.unhex(F.sha2("text", 256)) if digest else F.lit(None).cast("binary")
    signed = written(rows.withColumn("sha", sha).mapInArrow(frugal(_signed), "doc_id long, mark long, sha binary, n long, f1 long, f2 long, bands array<long>").withColumn("rid", F.monotonically_increasing_id()))
    content = ["f1", "f2", "n"]
    groups = written(signed.filter("n > 0").groupBy(*content).agg(F.min(F.struct("doc_id", "rid", "mark")).alias("lead"), F.count("*").alias("size")).withColumn("node", F.col("lead.rid")))
    with scratch() as kept:
        buckets, texts = (kept(x) for x in _buckets(rows, signed, groups))
    sizes = groups.select("node", "n")
    with scratch() as kept:
        pairs = buckets.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"), F.col("n").alias("b_n")).distinct()
        pairs = pairs.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("a_n")), "a")
        tested = written(pairs.filter("5 * least(a_n, b_n) >= 4 * greatest(a_n, b_n)").select("a", "b"))
        labels = kept(components(verify(tested, texts)))
        known = kept(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    # Only buckets that hold several components go into a round, and components only merge, so a bucket once left out stays out.
    live, own, used = buckets.select("key", "node", "n"), None, None
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        with scratch() as kept:
            open_ = _open(live, labels)
            if own is None:
                free = F.aggregate("sketch", F.lit(0), lambda s, x: s + x)
                own = kept(_sketches(texts.join(open_.select("node").distinct(), "node", "left_semi")).withColumn("free", free))
            live = kept(open_.select("key", "node", "n"))
            chosen = kept(_chosen(open_.join(own, "node"), used, pivots))
            if chosen.isEmpty():
                break
            used = chosen.select("key", "node") if used is None else used.union(chosen.select("key", "node")).coalesce(partitions)
            fresh = kept(_crossing(chosen, open_.join(own, "node")).join(known, ["a", "b"], "left_anti"))
            known = known.union(fresh).coalesce(partitions)  # read together, not written anew
            labels = _merged(labels, verify(fresh, texts), kept)

    placed = groups.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    classes = placed.groupBy("comp").agg(F.min("lead").alias("first"), F.sum("size").alias("class_size"))
    # Both sides of the last joins are aggregates but for the rows themselves, which skew handling may split.
    of_content = placed.join(classes, "comp").select(*content, "first", "class_size")
    return signed.join(of_content, content, "left").select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce(F.col("rid") == F.col("first.rid"), F.lit(True)).alias("kept"),
        "f1", "f2", "n", "sha",
    )


def _buckets(rows: DataFrame, signed: DataFrame, groups: DataFrame) -> Iterator[DataFrame]:
    """key, node, n, pivot of the bands that several nodes share, then node, text of these nodes."""
    nodes = signed.join(groups.select("node"), F.col("rid") == F.col("node"), "left_semi")
    keyed = nodes.select(F.explode("bands").alias("key"), F.col("rid").alias("node"), "n")
    # Tables of one row a key are written before they are joined, so that of both sides plain rows are shuffled, and skew handling may split a hot key.
    full = written(keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"))
    shared = written(keyed.join(full, "key"))
    central = shared.groupBy("node").agg(F.sum("members").alias("weight"))
    heads = written(shared.join(central, "node").groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("node"))).alias("head")).select("key", (-F.col("head.node")).alias("pivot")))
    yield shared.join(heads, "key").select("key", "node", "n", "pivot")
    texts = groups.join(shared.select("node").distinct(), "node", "left_semi").select("node", "f1", "f2", F.col("lead.doc_id").alias("doc_id"), F.col("lead.mark").alias("mark"))
    texts = rows.join(texts, rows.doc_id.eqNullSafe(texts.doc_id) & (rows.mark == texts.mark)).select("node", "text", "f1", "f2")
    # Rows may repeat a node's own; one text of each node is enough, and repeats go before the shuffle.
    yield texts.mapInArrow(frugal(_own_texts), "node long, text string").dropDuplicates(["node"])


def _open(live: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, n, comp, main (its bucket's largest component) of the buckets that hold several components."""
    seen = written(live.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    parts = seen.groupBy("key", "comp").agg(F.count("*").alias("k"))
    most = parts.groupBy("key").agg(F.max("k").alias("k"), F.count("*").alias("comps")).filter("comps > 1")
    largest = written(parts.join(most, ["key", "k"]).groupBy("key").agg(F.min("comp").alias("main")))
    return written(seen.join(largest, "key"))


def _chosen(open_: DataFrame, used: DataFrame | None, pivots: int) -> DataFrame:
    """The members to try in a round: up to `pivots` a bucket, dealt to parts so that no task orders a large bucket; the next rounds take the rest."""
    outside = open_.filter("comp <> main and 5 * free >= 4 * n").select("key", "node", "n", "comp", "free", "sketch")
    if used is not None:
        outside = outside.join(used, ["key", "node"], "left_anti")
    part = F.pmod(F.xxhash64("node"), F.lit(PARTS))
    return outside.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("key", "part").orderBy("node"))).filter(F.col("rank") <= max(1, pivots // PARTS)).drop("rank", "part")


def _crossing(chosen: DataFrame, open_: DataFrame) -> DataFrame:
    """The pairs (a, b) of members of one bucket and several components that the bounds allow, each once."""
    left, right = chosen.alias("l"), open_.alias("r")
    # The overlap is at most what the sketches allow, class by class; 5 * overlap >= 4 * union is 9 * overlap >= 4 * (n + n).
    most_shared = "aggregate(zip_with(l.sketch, r.sketch, (x, y) -> least(x, y)), 0, (s, x) -> s + x)"
    crossing = left.join(right, F.expr(f"l.key = r.key and l.comp <> r.comp and 9 * least(l.free, r.free) >= 4 * (l.n + r.n) and 9 * {most_shared} >= 4 * (l.n + r.n)"))
    return crossing.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def _merged(labels: DataFrame, links: DataFrame, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The labels after new links, which join components: these are found on the much smaller graph of components."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("a_comp")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("comp").alias("b_comp")), "b", "left")
    lifted = written(ends.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")).filter("a <> b"))
    if lifted.isEmpty():
        return labels
    merged = components(lifted).select(F.col("node").alias("from"), F.col("comp").alias("to"))
    everyone = labels.select("node", "comp").union(merged.select(F.col("from").alias("node"), F.col("from").alias("comp")).join(labels.select("node"), "node", "left_anti"))
    return kept(everyone.join(merged, F.col("comp") == F.col("from"), "left").select("node", F.coalesce("to", "comp").alias("comp")))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns: one of each class."""
    p = unused(docs)
    rows = near_duplicates(docs, doc_id, text, digest=True).filter("class_size > 1").select(F.col("doc_id").alias(f"{p}id"), F.col("class_id").alias(f"{p}class"), F.col("sha").alias(f"{p}sha"), "kept")
    # Ids may be of several texts, so rows are told apart by both. Equal rows are parted from the one that stays by counting.
    rows = written(rows)
    docs = docs.withColumn(f"{p}row_sha", F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)))
    same = docs[doc_id].cast("long").eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}row_sha") == F.col(f"{p}sha"))
    gone = rows.filter("not kept").select(f"{p}id", f"{p}sha", f"{p}class").distinct()
    small = F.broadcast if gone.count() <= BROADCAST_ROWS else lambda table: table
    alone = docs.join(small(gone.select(f"{p}id", f"{p}sha")), same, "left_anti")
    firsts = rows.filter("kept").select(F.col(f"{p}id").alias(f"{p}first"), F.col(f"{p}sha").alias(f"{p}first_sha"))
    again = gone.filter(F.col(f"{p}id").eqNullSafe(F.col(f"{p}class"))).join(firsts, F.col(f"{p}id").eqNullSafe(F.col(f"{p}first")) & (F.col(f"{p}sha") == F.col(f"{p}first_sha")), "left_semi").select(f"{p}id", f"{p}sha")
    return alone.unionByName(docs.join(small(again), same, "left_semi").dropDuplicates([doc_id, f"{p}row_sha"])).drop(f"{p}row_sha")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", F.col("class_size").cast("long").alias("class_size"), "kept")
