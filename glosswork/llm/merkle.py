"""A Merkle manifest of a dataset by scheduled tree traversal over aligned blocks.

A leaf is the hash of a row's fields. The leaves of a group ascend by id; every 8 consecutive nodes become
one node of the next level (the last run may be shorter, even a single node) until one is left, the
group's subroot; the subroots, ordered by group, become the root in the same way. A row's authentication path
has, level by level, the other nodes of its run to the left and to the right.

Positions are prefix counts over ranges, so no task holds a group. Leaves are dealt to aligned blocks of
8**4. A block is traversed leaf by leaf: each level keeps its current run of 8 nodes, and a treehash, a
stack of unfinished runs, that takes one leaf a step and has the level's next run ready when the
current one ends. So a path costs less than one hash a leaf and level, and besides the block's leaves memory
is logarithmic. The roots of the blocks are nodes of a table 4,096 times smaller, treated in the same way
until each group is one block; a block's leaves share the path above it, which is sent with the block.

H is the lowercase hex SHA-256 of the concatenated inputs, digests as hex text. A field is `-` if null, else the number of
its UTF-8 bytes, `:` and its value.

Defined results: null ids come first, a null group is a group of its own, the first; rows of one id are ordered by leaf, equal
rows are alike and each is a leaf; an empty text is `0:`; an empty table gives no rows. Columns that are no fields take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm.common import documents, frugal, running, written

ARITY = 8
HEIGHT = 4  # of a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"
LOOKUP_ROWS = 100_000  # groups, of 300 bytes and their path each, that are broadcast; more are joined by a shuffle


def joined(nodes: list[bytes]) -> bytes:
    """The node above a run."""
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


class Treehash:
    """Makes the nodes of one height from consecutive leaves, one leaf at a time, with a run of unfinished nodes a level."""

    def __init__(self, height: int) -> None:
        self.runs: list[list[bytes]] = [[] for _ in range(height)]

    def push(self, node: bytes) -> bytes | None:
        for run in self.runs:
            run.append(node)
            if len(run) < ARITY:
                return None
            node = joined(run)
            run.clear()
        return node

    def close(self) -> bytes | None:
        """The last node, of what is left; None if nothing is."""
        node = None
        for run in self.runs:
            if node is not None:
                run.append(node)
            node = joined(run) if run else None
            run.clear()
        return node


def height_of(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    height = 0
    while ARITY**height < leaves:
        height += 1
    return height


def block_root(leaves: list[bytes], height: int) -> bytes:
    tree, root = Treehash(height), None
    for leaf in leaves:
        root = tree.push(leaf) or root
    return tree.close() or root


class Level:
    """One level's current run, and the next run on its way."""

    def __init__(self, height: int, leaves: list[bytes]) -> None:
        self.height, self.leaves, self.width = height, leaves, ARITY ** (height + 1)
        self.taken = 0
        self.begin()
        while self.taken < min(self.width, len(leaves)):
            self.step()
        self.run = self.ready()
        self.begin()

    def begin(self) -> None:
        self.tree, self.coming = Treehash(self.height), []

    def step(self) -> None:
        """Takes the next leaf, if there is one."""
        if self.taken < len(self.leaves):
            node = self.tree.push(self.leaves[self.taken])
            self.taken += 1
            if node is not None:
                self.coming.append(node)

    def ready(self) -> list[bytes]:
        last = self.tree.close()
        return self.coming + ([last] if last is not None else [])

    def turn(self) -> None:
        self.run = self.ready()
        self.begin()


def traversal(leaves: list[bytes], height: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """Each leaf's path up to `height`: what stands left and right of it, level by level. The list is reused."""
    levels = [Level(h, leaves) for h in range(height)]
    path: list[tuple[bytes, bytes]] = [(b"", b"")] * height
    for at in range(len(leaves)):
        for h, level in enumerate(levels):
            if at % ARITY**h:
                break
            if at and at % level.width == 0:
                level.turn()
            own = at // ARITY**h % ARITY
            path[h] = b"".join(level.run[:own]), b"".join(level.run[own + 1 :])
        yield path
        for level in levels:
            level.step()


def _blocks(batches: Iterator[pa.RecordBatch], columns: list[int]) -> Iterator[list[tuple]]:
    """The rows of each block, from rows sorted by group and block."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in columns), strict=True):
            if rows and row[:2] != rows[-1][:2]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _roots(height: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows of grp, block, pos, node, n, one row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, [0, 1, 3, 4]):
            root = block_root([r[2].encode() for r in rows], min(height, height_of(rows[0][3])))
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.string()), pa.array([rows[0][1]], pa.int64()), pa.array([root.decode()])], ["grp", "pos", "node"])

    return run


def _paths(height: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows of grp, block, pos, node, n, rid, above, a block's own row (pos -1) with the path above it first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, [0, 1, 3, 4, 5, 6]):
            above = [(s["left"].encode(), s["right"].encode()) for s in rows[0][5]]
            paths = traversal([r[2].encode() for r in rows[1:]], min(height, height_of(rows[0][3])))
            for i in range(1, len(rows), 1024):  # a batch of paths has about 3 MB
                some = rows[i : i + 1024]
                sides: tuple[list[bytes], list[bytes]] = ([], [])
                ends = [0]
                for _ in some:
                    for pair in (*next(paths), *above):
                        sides[0].append(pair[0])
                        sides[1].append(pair[1])
                    ends.append(len(sides[0]))
                pairs = pa.StructArray.from_arrays([pa.array(s, pa.binary()).cast(pa.string()) for s in sides], ["left", "right"])
                yield pa.RecordBatch.from_arrays([pa.array([r[4] for r in some], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], ["rid", "path"])

    return run


def _looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with the columns of table, whose keys (null is one) are unique."""
    table = table.withColumnRenamed(key, "__key")
    if table.count() <= LOOKUP_ROWS:
        table = F.broadcast(table)
    return rows.join(table, rows[key].eqNullSafe(F.col("__key"))).drop("__key")


def climb(nodes: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """Of nodes (grp, pos, node, n, rid; n nodes a group, at places from 0), the groups' roots (grp, root) and each node's path (rid, path)."""
    placed = nodes.select("grp", F.floor(F.col("pos") / ARITY**height).alias("block"), "pos", "node", "n", "rid")
    dealt = placed.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
    roots = written(dealt.mapInArrow(frugal(_roots(height)), "grp string, pos long, node string"))
    counted = roots.groupBy("grp").agg(F.count("*").alias("blocks"))
    if counted.filter("blocks > 1").isEmpty():
        tops = roots.select("grp", F.col("node").alias("root"))
        above = roots.select("grp", F.col("pos").alias("block"), F.array().cast(PATH).alias("above"))
    else:
        upper = written(_looked_up(roots, counted, "grp").select("grp", "pos", "node", F.col("blocks").alias("n"), F.monotonically_increasing_id().alias("rid")))
        tops, paths = climb(upper, height)
        above = upper.join(paths, "rid").select("grp", F.col("pos").alias("block"), F.col("path").alias("above"))
    sizes = placed.groupBy("grp", "block").agg(F.max("n").alias("n"))
    leads = above.withColumnsRenamed({"grp": "g", "block": "b"}).join(sizes, F.col("g").eqNullSafe(F.col("grp")) & (F.col("b") == F.col("block")))
    leads = leads.select("grp", "block", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("node"), "n", F.lit(None).cast("long").alias("rid"), "above")
    both = leads.union(placed.withColumn("above", F.lit(None).cast(PATH)))
    paths = both.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos").mapInArrow(frugal(_paths(height)), f"rid long, path {PATH}")
    return tops, paths


def numbered(rows: DataFrame, order: list[Column], grp: str = "grp") -> DataFrame:
    """rows with pos, their place in their group, and n, its number of rows."""
    ranked = written(running(rows, [F.col(grp), *order], at=F.lit(1).cast("long")))
    groups = ranked.groupBy(F.col(grp)).agg(F.min("at").alias("begin"), F.count("*").alias("n"))
    return _looked_up(ranked, written(groups), grp).withColumn("pos", F.col("at") - F.col("begin")).drop("at", "begin")


def leaf_of(fields: Mapping[str, Column]) -> Column:
    """The hash of a row's fields, in their order."""
    return F.sha2(F.concat(*[F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string"))) for x in fields.values()]), 256)


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, node, lambda x, s: F.sha2(F.concat(s["left"], x, s["right"]).cast("binary"), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, from left to right, level by level, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(docs: DataFrame, doc_id: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, carry: Mapping[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, path for each row of docs, and the columns of `carry`, which are computed from its rows."""
    extra = {f"carry_{k}": x for k, x in enumerate((carry or {}).values())}
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(group).cast("string").alias("grp"), leaf_of({f: F.col(f) for f in fields}).alias("node"), *[x.alias(k) for k, x in extra.items()])
    # Texts are read once; from here on rows are narrow.
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()))
    leaves = written(numbered(rows, [F.col("doc_id"), F.col("node"), F.col("rid")]))
    subroots, paths = climb(leaves.select("grp", "pos", "node", "n", "rid"), height)
    # The groups' subroots are the leaves of a tree of their own, in one group.
    groups = written(subroots.select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("own"), F.col("root").alias("node")))
    groups = written(numbered(groups, [F.col("own")]).withColumn("rid", F.monotonically_increasing_id()))
    tops, over = climb(groups, height)
    over = _looked_up(groups.join(over, "rid"), tops, "grp").select(F.col("own").alias("grp"), F.col("node").alias("subroot"), "root", F.col("path").alias("over"))
    whole = _looked_up(leaves.select("rid", "doc_id", "grp", F.col("node").alias("leaf"), *extra).join(paths, "rid"), written(over), "grp")
    return whole.select("doc_id", "leaf", "subroot", "root", F.concat("path", "over").alias("path"), *[F.col(k).alias(name) for k, name in zip(extra, carry or {}, strict=True)])


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = leaf_of({f: F.col(f) for f in FIELDS} | {"text": lowered})
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = manifest(docs, carry={"presented": F.when(hit, tampered)})
    folded = fold(F.coalesce("presented", "leaf"), F.col("path"))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END) + z))) % 3 = 0 AS hit
  FROM documents
), leaves AS (
  SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS low_leaf FROM d
), t(lvl, lang, pos, node, n) AS (
  SELECT 0, lang, pos, leaf, count(*) OVER (PARTITION BY lang) FROM leaves
  UNION ALL
  SELECT lvl, lang, pos, node, count(*) OVER (PARTITION BY lang) FROM (
    SELECT lvl + 1 AS lvl, lang, pos // 8 AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM t WHERE n > 1 GROUP BY lvl, lang, pos // 8)
), subroots AS (
  SELECT lang, lvl AS height, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM t WHERE n = 1
), s(lvl, pos, node, n) AS (
  SELECT 0, pos, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT lvl, pos, node, count(*) OVER () FROM (SELECT lvl + 1 AS lvl, pos // 8 AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM s WHERE n > 1 GROUP BY lvl, pos // 8)
), steps AS (
  SELECT l.lang, l.pos AS leaf_pos, o.lvl, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos < o.pos), '') AS lft, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos > o.pos), '') AS rgt
  FROM leaves l JOIN t o ON o.lang IS NOT DISTINCT FROM l.lang AND o.n > 1 AND o.pos = l.pos // pow(8, o.lvl)::BIGINT
  JOIN t b ON b.lang IS NOT DISTINCT FROM o.lang AND b.lvl = o.lvl AND b.pos // 8 = o.pos // 8
  GROUP BY l.lang, l.pos, o.lvl, o.pos
  UNION ALL
  SELECT l.lang, l.pos, u.height + o.lvl, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos < o.pos), ''), coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos > o.pos), '')
  FROM leaves l JOIN subroots u ON u.lang IS NOT DISTINCT FROM l.lang JOIN s o ON o.n > 1 AND o.pos = u.pos // pow(8, o.lvl)::BIGINT
  JOIN s b ON b.lvl = o.lvl AND b.pos // 8 = o.pos // 8
  GROUP BY l.lang, l.pos, u.height + o.lvl, o.pos
), proofs AS (
  SELECT lang, leaf_pos, sha256(string_agg(lft || rgt, '' ORDER BY lvl)) AS proof, max(lvl) + 1 AS height FROM steps GROUP BY lang, leaf_pos
), f(lang, pos, lvl, node) AS (
  SELECT lang, pos, 0, CASE WHEN hit THEN low_leaf ELSE leaf END FROM leaves
  UNION ALL
  SELECT f.lang, f.pos, f.lvl + 1, sha256(p.lft || f.node || p.rgt) FROM f JOIN steps p ON p.lang IS NOT DISTINCT FROM f.lang AND p.leaf_pos = f.pos AND p.lvl = f.lvl
), top AS (SELECT lang, pos, max_by(node, lvl) AS folded FROM f GROUP BY lang, pos)
SELECT l.doc_id, l.leaf, u.subroot, r.node AS root, coalesce(p.proof, sha256('')) AS proof_sha256, top.folded AS folded_root, top.folded = r.node AS verified
FROM leaves l JOIN subroots u ON u.lang IS NOT DISTINCT FROM l.lang JOIN s r ON r.n = 1
JOIN top ON top.lang IS NOT DISTINCT FROM l.lang AND top.pos = l.pos
LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM l.lang AND p.leaf_pos = l.pos
"""
