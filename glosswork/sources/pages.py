"""Sources of page text: documents by lines, and per-character tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.functions import patterns as P
from glosswork.functions import text as X

LINES = 20


SMALL_SPLIT = 64 << 20  # bytes


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def spread(docs: DataFrame) -> DataFrame:
    """docs dealt to all cores, if the input is too small to give each a split of its own: text costs far more to analyse than to move. A large input stays as its files are split."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(4 * cores) if size < cores * SMALL_SPLIT else docs


def pages_of_documents(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """doc_id, page_index, text: pages of so many lines. Arrays are cut in place, so nothing is shuffled."""
    split = X.bound(docs.select("doc_id", "text"), lines=F.split(F.coalesce("text", F.lit("")), "\n", -1)).drop("text")
    pages = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / lines).cast("int")), lambda k: F.array_join(F.slice("lines", k * lines + 1, F.lit(lines)), "\n"))
    return split.select("doc_id", F.posexplode(pages).alias("page_index", "text"))


def page_counts(pages: DataFrame) -> DataFrame:
    """doc_id, pages: pages without text other than blanks don't count."""
    return pages.filter(X.filled(F.col("text"))).groupBy("doc_id").agg(F.count("*").cast("int").alias("pages"))


def char_positions(chars: DataFrame, line_breaks: bool = True) -> DataFrame:
    """One row for each character of each glyph's text, and a separator row after glyphs that end a word, line or paragraph.

    chars: doc_id, page_index, char_index, c, u, rect, space_after, line_break_after, paragraph_break_after.
    The separator is a line break, where those are asked for, else a blank; its rect is all zero.
    """
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    ends_line = flag("line_break_after") | flag("paragraph_break_after")
    zero = F.array(*[F.lit(0.0)] * 4)
    units = F.transform(F.filter(F.split(F.coalesce("u", "c", F.lit("")), ""), lambda x: x != ""), lambda x: F.struct(x.alias("char"), F.col("rect").alias("rect")))
    mark = F.when(ends_line, F.lit("\n") if line_breaks else F.lit(" ")).otherwise(F.lit(" "))
    separator = F.when(ends_line | flag("space_after"), F.array(F.struct(mark.alias("char"), zero.alias("rect")))).otherwise(F.array().cast("array<struct<char:string,rect:array<double>>>"))
    return chars.select("doc_id", "page_index", "char_index", F.posexplode(F.concat(units, separator)).alias("unit", "x")).select("doc_id", "page_index", "char_index", "unit", "x.char", "x.rect")


def page_text(positions: DataFrame) -> DataFrame:
    """doc_id, page_index, text and the glyph index of each character, in reading order."""
    rows = positions.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("char_index", "unit", "char"))).alias("rows"))
    return rows.select("doc_id", "page_index", F.array_join("rows.char", "").alias("text"), F.col("rows.char_index").alias("char_mapping"))


def usable_transform(transform: Column) -> Column:
    return (F.size(transform) >= 6) & F.forall(F.slice(transform, 1, 6), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def item_positions(items: DataFrame) -> DataFrame:
    """Character rects of text items laid out by a transform; pages with an unusable item give none.

    items: doc_id, page_index, item_index, str, transform, width, height. The baseline is the transform's
    sixth number; glyphs reach a quarter of the height below and three quarters above it.
    """
    from pyspark.sql import Window

    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    height = F.when(finite("height") & (F.col("height") > 0), F.col("height")).otherwise(F.abs(F.col("transform")[3]))
    size = F.length("str")
    rows = items.withColumn("h", height).withColumn("ok", (size == 0) | F.coalesce(usable_transform(F.col("transform")) & (F.col("h") > 0) & finite("width") & (F.col("width") > 0), F.lit(False)))
    rows = rows.withColumn("all_ok", F.bool_and("ok").over(Window.partitionBy("doc_id", "page_index"))).filter("all_ok").filter(size > 0)
    step = F.col("width") / size
    x, base = F.col("transform")[4], F.col("transform")[5]
    rows = rows.select("doc_id", "page_index", "item_index", F.posexplode(F.filter(F.split("str", ""), lambda c: c != "")).alias("unit", "char"), x.alias("x"), base.alias("base"), "h", step.alias("step"))
    left = F.col("x") + F.col("unit") * F.col("step")
    return rows.select("doc_id", "page_index", "item_index", "unit", "char", F.array(left, F.col("base") - 0.25 * F.col("h"), left + F.col("step"), F.col("base") + 0.75 * F.col("h")).alias("rect"))


def paper_title(parent_title: Column, attachment_title: Column, *others: Column) -> Column:
    """The first title that isn't blank, trimmed."""
    full = [F.when(X.trim(c) != "", X.trim(c)) for c in (parent_title, attachment_title, *others)]
    return F.coalesce(*full)


def author_keywords(tags: Column, extra: Column) -> Column:
    """Tags of 2 to 79 characters and the entries of a Keywords line, without later ones that differ in case only."""
    # The length is that before trimming.
    own = F.filter(F.transform(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: (F.length(t) > 1) & (F.length(t) < 80)), X.trim), lambda t: t != "")
    line = F.regexp_extract(F.coalesce(extra, F.lit("")), f"(?im)^keywords?{P.SPACE}*[:：]{P.SPACE}*(.+)$", 1)
    listed = F.filter(F.transform(F.split(line, "[,;，；]"), X.trim), lambda t: t != "")
    every = F.concat(own, listed)
    return F.aggregate(every, F.array().cast("array<string>"), lambda seen, t: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(t)), seen).otherwise(F.array_append(seen, t)))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token, id of a vocabulary file: the line's number is the id; blank lines have one too but are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("id", "token"))
    return lines.select(X.trim(F.col("token")).alias("token"), "id").filter("token <> ''")


# Fixed: fields of model manifests; installed ones have those of both lists, compiled ones may have the rest.
MANIFEST = ("modelId", "assetVersion", "releaseTag", "assetFileName", "packageDirectoryName", "vocabFileName")
INSTALLED = ("zipSha256", "installedAt", "sourceUrl")
OPTIONAL = ("pluginMinVersion",)


def manifests(raw: DataFrame, column: str = "raw", installed: bool = False) -> DataFrame:
    """The fields of JSON manifests and whether they are valid: objects whose required fields are strings that are not empty."""
    v = F.try_parse_json(F.col(column))
    needed = MANIFEST + (INSTALLED if installed else ())
    value = {k: F.try_variant_get(v, f"$.{k}", "string") for k in needed + OPTIONAL}
    kind = {k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) for k in needed + OPTIONAL}
    valid = F.lit(True)
    for k in needed:
        valid = valid & (kind[k] == "STRING") & (value[k] != "")
    for k in OPTIONAL:
        valid = valid & (kind[k].isNull() | ((kind[k] == "STRING") & (value[k] != "")))
    return raw.select(*raw.columns, F.coalesce(valid, F.lit(False)).alias("valid"), *[c.alias(k) for k, c in value.items()])


def sidecar_metadata(raw: DataFrame, column: str = "raw") -> DataFrame:
    """bundled_sha256 of JSON extraction metadata; null unless it is a string that is not empty."""
    v = F.try_parse_json(F.col(column))
    found = F.try_variant_get(v, "$.bundledSha256", "variant")
    value = F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(v, "$.bundledSha256", "string"))
    return raw.select(*[c for c in raw.columns if c != column], F.when(value != "", value).alias("bundled_sha256"))
