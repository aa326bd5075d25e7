"""Page glyphs from several layers of dumps: glyphs that a reader has cached, page data fetched again, text items.

A layer is a folder of files with one JSON object a page and line, and an index of the files with the documents and pages in each.
The index is what a partition is planned from: files outside the asked ranges of documents or pages are never opened, small
files share a partition and large ones have their own. A write is seen once its driver has added the index entry; files of tasks that
failed or ran twice are in none.

A page takes its glyphs from the first layer that has any for it. That is decided on a catalogue of page keys and numbers of
characters, so each layer is read once, for its own pages, and glyphs are not shuffled to find out what is lacking.

The folder is any that pyarrow can open on the driver and all executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from glosswork.operators import geometry
from glosswork.session import shared_folder
from glosswork.sources.keyed import _opened
from glosswork.sources.pages import usable_transform

NAME = "glosswork_glyphs"
KEYS = ("doc_id", "page_index")
GLYPH = "struct<c:string,u:string,rect:array<double>,inline_rect:array<double>,rotation:int,space_after:boolean,line_break_after:boolean,paragraph_break_after:boolean>"
ITEM = "struct<str:string,transform:array<double>,width:double,height:double,has_eol:boolean,chars:array<struct<transform:array<double>,width:double>>>"
SCHEMAS = {"chars": f"doc_id bigint, page_index int, chars array<{GLYPH}>", "items": f"doc_id bigint, page_index int, items array<{ITEM}>"}
POSITION = "array<struct<char:string,rect:array<double>,at:int>>"
#: The same with all characters of one rect and place together.
RUN = "array<struct<text:string,rect:array<double>,at:int>>"
#: Layers in the order in which pages ask them, and what their files hold.
LAYERS = {"cached": "chars", "page_data": "chars", "text": "items"}
FILE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20


def _entries(path: str) -> list[dict]:
    """The files of all writes with the smallest and largest document and page of each."""
    store, root = _opened(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/index", allow_not_found=True))
    out = []
    for entry in sorted(e.path for e in found if e.path.endswith(".json")):
        with store.open_input_stream(entry) as stream:
            out += json.loads(stream.read())
    return out


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class GlyphWriter(DataSourceArrowWriter):
    """Files of about FILE_BYTES; a page is never split."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _opened(self.path)
        folder = f"data/{self.job}"
        store.create_dir(f"{root}/{folder}")
        files: list[dict] = []
        out = pages = None
        try:
            for batch in iterator:
                known = batch.select([*KEYS, "n_units"])
                if pages is None:
                    catalogue = f"{folder}/{uuid.uuid4().hex}.parquet"
                    pages = pq.ParquetWriter(f"{root}/{catalogue}", known.schema, filesystem=store)
                pages.write_batch(known)
                for line, *key in zip(batch.column("line").to_pylist(), *(batch.column(k).to_pylist() for k in KEYS), strict=True):
                    if out is None:
                        name = f"{folder}/{uuid.uuid4().hex}.jsonl"
                        out = store.open_output_stream(f"{root}/{name}")
                        files.append({"file": name, "catalogue": catalogue, "bytes": 0} | {k: [v, v] for k, v in zip(KEYS, key, strict=True)})
                    raw = line.encode() + b"\n"
                    out.write(raw)
                    last = files[-1]
                    last["bytes"] += len(raw)
                    for k, v in zip(KEYS, key, strict=True):
                        last[k] = [min(last[k][0], v), max(last[k][1], v)]
                    if last["bytes"] >= FILE_BYTES:
                        out.close()
                        out = None
        finally:
            for stream in (out, pages):
                if stream is not None:
                    stream.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.path)
        store.create_dir(f"{root}/index")
        if self.overwrite:
            raise ValueError("a layer of dumps is added to, not overwritten")
        files = [f for m in messages if m for f in m.files]
        with store.open_output_stream(f"{root}/index/{self.job}.part") as out:
            out.write(json.dumps(files).encode())
        store.move(f"{root}/index/{self.job}.part", f"{root}/index/{self.job}.json")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.path)
        if store.get_file_info(f"{root}/data/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/data/{self.job}")


@dataclass
class Files(InputPartition):
    files: tuple[str, ...]

    def __init__(self, files: Iterable[str]):
        self.files = tuple(files)


class GlyphReader(DataSourceReader):
    """Lines of the files that may hold pages within the inclusive ranges given for their keys."""

    def __init__(self, path: str, schema: StructType, within: dict[str, list[list[int]]]):
        self.path, self.schema, self.within = path, schema, within

    def _may_hold(self, entry: dict) -> bool:
        return all(any(low <= entry[k][1] and entry[k][0] <= high for low, high in ranges) for k, ranges in self.within.items())

    def partitions(self) -> list[Files]:
        out: list[list[str]] = []
        size = FILE_BYTES
        for entry in sorted(filter(self._may_hold, _entries(self.path)), key=lambda e: (e["doc_id"], e["file"])):
            if size + entry["bytes"] > FILE_BYTES:
                out.append([])
                size = 0
            out[-1].append(entry["file"])
            size += entry["bytes"]
        return [Files(f) for f in out] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, root = _opened(self.path)
        made = lambda lines: pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()).cast(pa.string())], names=["line"])
        lines, size = [], 0
        for name in partition.files:
            with store.open_input_stream(f"{root}/{name}") as stream:
                for line in _lines(stream):
                    lines.append(line)
                    size += len(line)
                    if size >= BATCH_BYTES:
                        yield made(lines)
                        lines, size = [], 0
        if lines:
            yield made(lines)


def _lines(stream) -> Iterator[bytes]:
    """Lines of any length; parts of one that spans blocks are put together once."""
    parts: list[bytes] = []
    while block := stream.read(1 << 20):
        first, *more = block.split(b"\n")
        parts.append(first)
        if more:
            yield b"".join(parts)
            yield from more[:-1]
            parts = [more[-1]]
    if last := b"".join(parts):
        yield last


class Glyphs(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "line string"

    def reader(self, schema: StructType) -> GlyphReader:
        return GlyphReader(self.options["path"], schema, json.loads(self.options.get("within", "{}")))

    def writer(self, schema: StructType, overwrite: bool) -> GlyphWriter:
        return GlyphWriter(self.options["path"], overwrite)


def in_ranges(pages: DataFrame) -> DataFrame:
    """Pages dealt by ranges of their keys, in order."""
    return pages.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)


def write_layer(pages: DataFrame, path: str, kind: str, dealt: bool = False) -> None:
    """Adds pages (doc_id, page_index, chars or items) to a layer, dealt by document so that files hold narrow ranges. Pages without a document or page number are left out.

    Ranges are found by a first pass over the rows. Pages that are made of less than their glyphs are better dealt with in_ranges() before that, and written as they are dealt.

    The JVM writes the JSON and counts characters; tasks only store lines, and beside them the catalogue, which the same commit makes visible.
    """
    spark = pages.sparkSession
    spark.dataSource.register(Glyphs)
    cast = [F.col(f.name).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], SCHEMAS[kind]).schema]
    rows = pages.select(*cast).dropna(subset=list(KEYS))
    rows = rows.select(*KEYS, COUNTS[kind](F.col(kind)).cast("int").alias("n_units"), F.to_json(F.struct(*rows.columns)).alias("line"))
    (rows if dealt else in_ranges(rows)).write.format(NAME).mode("append").save(path)


def _inside(within: dict[str, list[tuple[int, int]]] | None) -> Column:
    return reduce(and_, [reduce(or_, [F.col(k).between(low, high) for low, high in ranges], F.lit(False)) for k, ranges in (within or {}).items()], F.lit(True))


def read_layer(spark: SparkSession, path: str, kind: str, within: dict[str, list[tuple[int, int]]] | None = None) -> DataFrame:
    """A layer's pages, those within the inclusive ranges of doc_id or page_index only; a line that is no JSON is no page.

    The ranges are options of the read and not filters that Spark pushes: a data source in Python keeps the filters of
    the first plan made of a frame for all later plans of that frame, which would lose rows.
    """
    spark.dataSource.register(Glyphs)
    unknown = set(within or ()) - set(KEYS)
    if unknown:
        raise ValueError(f"no key of a page: {sorted(unknown)}")
    lines = spark.read.format(NAME).option("within", json.dumps(within or {})).load(path)
    rows = lines.select(F.from_json("line", SCHEMAS[kind]).alias("page")).select("page.*")
    return rows.dropna(subset=list(KEYS)).filter(_inside(within))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, page_index, n_units: pages of a layer and the most characters that a dump of each has."""
    files = sorted({e["catalogue"] for e in _entries(path)})
    schema = "doc_id bigint, page_index int, n_units int"
    rows = spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/{f}" for f in files]) if files else spark.createDataFrame([], schema)
    return rows.groupBy(*KEYS).agg(F.max("n_units").alias("n_units"))


def _positive(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (x < float("inf")) & (x > 0), x)


def _usable(transform: Column) -> Column:
    return F.coalesce(usable_transform(transform), F.lit(False))


def _blank(item: Column) -> Column:
    return F.coalesce(item["str"], F.lit("")) == ""


def _height(item: Column) -> Column:
    return F.coalesce(_positive(item["height"]), _positive(F.abs(item["transform"][3])))


def _placed(item: Column) -> Column:
    """Whether an item without text, or with a place for each character."""
    placed = _usable(item["transform"]) & _height(item).isNotNull() & _positive(item["width"]).isNotNull()
    return _blank(item) | F.coalesce(placed & (F.size(item["chars"]) == F.length(item["str"])) & F.forall(item["chars"], lambda c: c.isNotNull()), F.lit(False))


def _total(values: Column, size) -> Column:
    return F.aggregate(F.coalesce(values, F.array()), F.lit(0), lambda n, x: n + size(x).cast("int"))


def char_count(chars: Column) -> Column:
    """The size of char_units, without making them."""
    mark = lambda g: reduce(or_, [F.coalesce(g[n], F.lit(False)) for n in ("space_after", "line_break_after", "paragraph_break_after")])
    return _total(chars.cast(f"array<{GLYPH}>"), lambda g: F.length(F.coalesce(g["u"], g["c"], F.lit(""))) + mark(g).cast("int"))


def item_count(items: Column) -> Column:
    """The size of item_units with line breaks, without making them."""
    size = _total(items, lambda i: F.when(_blank(i), 0).otherwise(F.length(i["str"]) + F.coalesce(i["has_eol"], F.lit(False)).cast("int")))
    return F.when(F.forall(F.coalesce(items, F.array()), _placed), size).otherwise(0)


COUNTS = {"chars": char_count, "items": item_count}


def char_runs(chars: Column, line_breaks: bool = True) -> Column:
    """Positions of glyphs, a run for each: its text with its highlight rect and place, and a separator behind glyphs that end a word, line or paragraph. Glyphs without a usable rect, and separators, have a rect of zeros."""
    zero = F.array(*[F.lit(0.0)] * 4)
    run = lambda text, rect, at: F.array(F.struct(text.alias("text"), rect.alias("rect"), at.alias("at")))
    none = F.array().cast(RUN)

    def one(g: Column, at: Column) -> Column:
        rect = F.coalesce(geometry.highlight_rect(g["rect"], F.coalesce(g["inline_rect"], g["rect"]), g["rotation"]), zero)
        text = F.coalesce(g["u"], g["c"], F.lit(""))
        ends_line = F.coalesce(g["line_break_after"], F.lit(False)) | F.coalesce(g["paragraph_break_after"], F.lit(False))
        mark = F.when(ends_line, F.lit("\n" if line_breaks else " ")).when(g["space_after"], F.lit(" "))
        return F.concat(F.when(text != "", run(text, rect, at)).otherwise(none), F.when(mark.isNotNull(), run(mark, zero, at)).otherwise(none))

    return F.flatten(F.transform(F.coalesce(chars, F.array().cast(f"array<{GLYPH}>")), one))


def spread(runs: Column) -> Column:
    """The characters of runs, each with its run's rect and place."""
    letters = lambda r: F.filter(F.split(r["text"], ""), lambda x: x != "")
    return F.flatten(F.transform(runs, lambda r: F.transform(letters(r), lambda x: F.struct(x.alias("char"), r["rect"].alias("rect"), r["at"].alias("at")))))


def char_units(chars: Column, line_breaks: bool = True) -> Column:
    """Positions of glyphs, a character each."""
    return spread(char_runs(chars, line_breaks))


def item_units(items: Column, line_breaks: bool = True) -> Column:
    """Positions of text items that place each of their characters; none for a page with an item that doesn't.

    An item counts as usable if it has no text, or a usable transform, a height (its own or the transform's), a width and a character
    entry for each character. A character stands at its own transform, else at the item's, with its own width or its share of the item's;
    it reaches a quarter of the height below the item's baseline and three quarters above.
    """
    zero = F.array(*[F.lit(0.0)] * 4)

    def one(i: Column, at: Column) -> Column:
        letters = F.filter(F.split(i["str"], ""), lambda x: x != "")
        low, high = i["transform"][5] - 0.25 * _height(i), i["transform"][5] + 0.75 * _height(i)

        def unit(x: Column) -> Column:
            left = F.when(_usable(x["c"]["transform"]), x["c"]["transform"][4]).otherwise(i["transform"][4])
            wide = F.coalesce(_positive(x["c"]["width"]), i["width"] / F.length(i["str"]))
            return F.struct(x["x"].alias("char"), F.array(left, low, left + wide, high).alias("rect"), at.alias("at"))

        end = F.array(F.struct(F.lit("\n").alias("char"), zero.alias("rect"), at.alias("at")))
        none = F.array().cast(POSITION)
        units = F.transform(F.arrays_zip(letters.alias("x"), i["chars"].alias("c")), unit)
        return F.when(_blank(i), none).otherwise(F.concat(units, F.when(i["has_eol"], end).otherwise(none) if line_breaks else none))

    every = F.coalesce(items, F.array().cast(f"array<{ITEM}>"))
    return F.when(F.forall(every, _placed), F.flatten(F.transform(every, one))).otherwise(F.array().cast(POSITION))


#: Items place each of their characters, so their runs are single ones.
RUNS = {"chars": char_runs, "items": lambda items, line_breaks=True: item_units(items, line_breaks).cast(RUN)}
UNITS = {"chars": char_units, "items": item_units}


def sources_of(wanted: DataFrame, root: str, layers: Iterable[str] = tuple(LAYERS)) -> DataFrame:
    """doc_id, page_index, source: the first layer with characters for the page, null where none has any. Layers can be left out."""
    spark = wanted.sparkSession
    rows, source = wanted.select(*KEYS).distinct(), F.lit(None).cast("string")
    for name in reversed(list(layers)):
        known = read_catalogue(spark, f"{root}/{name}").filter("n_units > 0").select(*KEYS, F.lit(name).alias(f"in_{name}"))
        rows = rows.join(known, list(KEYS), "left")
        source = F.coalesce(F.col(f"in_{name}"), source)
    return rows.select(*KEYS, source.alias("source"))


def page_glyphs(wanted: DataFrame, root: str, layers: Iterable[str] = tuple(LAYERS), line_breaks: bool = True, within: dict[str, list[tuple[int, int]]] | None = None, by_run: bool = False) -> DataFrame:
    """doc_id, page_index, source, units (runs, where asked for by run: far less to make, and spread() gives their units) of the wanted pages (null keys go, repeated ones count once); units are empty and the source null where no layer has any.

    Each layer is read once and joined with the pages that are its to give. Of several dumps of a page that with most characters counts,
    of equal numbers the largest by value. within narrows the pages and the files that are opened.
    """
    spark, layers = wanted.sparkSession, list(layers)
    column, kind_of, made = ("runs", RUN, RUNS) if by_run else ("units", POSITION, UNITS)
    # Each layer's branch reads the choice, which is keys only: it is made once.
    path = shared_folder(spark, "sources")
    sources_of(wanted.filter(_inside(within)).dropna(subset=list(KEYS)), root, layers).write.parquet(path)
    chosen = spark.read.parquet(path)
    out = chosen.filter("source IS NULL").select(*KEYS, "source", F.array().cast(kind_of).alias(column))
    for name in layers:
        kind = LAYERS[name]
        rows = read_layer(spark, f"{root}/{name}", kind, within).withColumn("n", COUNTS[kind](F.col(kind)))
        own = rows.join(chosen.filter(F.col("source") == name).select(*KEYS), list(KEYS))
        # Characters are spread out behind the shuffle; what is shuffled is as compact as the dump.
        best = own.groupBy(*KEYS).agg(F.max(F.struct("n", kind))[kind].alias(kind))
        out = out.unionByName(best.select(*KEYS, F.lit(name).alias("source"), made[kind](F.col(kind), line_breaks).alias(column)))
    return out
