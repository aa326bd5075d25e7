"""Segmentation: sentences, long-range splits, section headings and the as-of lookup of sections.

Pages are rows of doc_id, page_index, text. Boundaries are marked by zero-width replacements, so splitting a
page and summing lengths gives the offsets without leaving the JVM; only ranges longer than the limit
go to Python, where the greedy split is a loop.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions import patterns as P
from glosswork.functions import text as X

#: Marks of cuts and of a line break that belongs to no range; noncharacters, which in a text count as U+FFFD.
CUT, DROP = "﷐", "﷑"
LEAST = 16
_S, _START = P.SPACE, f"[{P.SENTENCE_START}]"
#: The character that a cut follows; one class is tried at each place, contexts only where it fits.
BOUNDARY = rf"[{P.ASCII_END}{P.CJK_END}\n](?:(?<=[{P.ASCII_END}])(?={_S}+{_START}|{_S}*\z)|(?<=[{P.CJK_END}])(?={_S}*{_START}|{_S}*\z)|(?<=\n)(?=[-*0-9]))"

ASCII_BOUNDARY = rf"[{P.ASCII_END}\n](?:(?<=[{P.ASCII_END}])(?={_S}+{_START}|{_S}*\z)|(?<=\n)(?=[-*0-9]))"


def _pieces(text: Column) -> Column:
    # Without other marks, classes of ASCII alone are looked up, which is faster.
    plain = X.latin_only(text) | ~text.rlike(f"[{P.CJK_END}{CUT}{DROP}]")
    marked = F.when(plain, F.regexp_replace(text, ASCII_BOUNDARY, "$0" + CUT)).otherwise(F.regexp_replace(F.translate(text, CUT + DROP, "\ufffd\ufffd"), BOUNDARY, "$0" + CUT))
    marked = F.regexp_replace(marked, rf"\n(?={CUT}?\n)", CUT + DROP)
    return F.split(marked, CUT, -1)


def ranges(pages: DataFrame, max_chars: int = 240) -> DataFrame:
    """The pages' columns but text, with piece, start, end of each sentence-like range."""
    keys = [c for c in pages.columns if c != "text"]
    out = X.bound(pages, pieces=_pieces(F.col("text"))).drop("text")
    out = out.select(*keys, F.explode(F.arrays_zip("pieces", X.prefix_sums(F.transform("pieces", lambda x: F.length(x))).alias("before"))).alias("x")).select(*keys, "x.pieces", "x.before")
    dropped = F.startswith("pieces", F.lit(DROP)).cast("int")
    out = X.bound(out.withColumn("start", F.col("before") + dropped), piece=F.when(dropped == 0, F.col("pieces")).otherwise(F.substr(F.col("pieces"), dropped + 1))).select(*keys, "piece", "start", F.length("piece").alias("n")).filter("n > 0")
    long = F.col("n") > max_chars
    cuts = F.when(long, _long_split(max_chars)(F.when(long, F.col("piece")))).otherwise(F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end"))))
    out = out.select(*keys, "piece", "start", "n", F.explode(cuts).alias("cut"))
    part = F.substr(F.col("piece"), F.col("cut.start") + 1, F.col("cut.end") - F.col("cut.start"))
    return out.select(*keys, F.when(long, part).otherwise(F.col("piece")).alias("piece"), (F.col("start") + F.col("cut.start")).alias("start"), (F.col("start") + F.col("cut.end")).alias("end"))


_SPACES = re.compile("[\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]")
_CONNECTORS = re.compile(P.SPLIT_CONNECTORS.replace(r"\s", _SPACES.pattern))


def split_long(text: str, max_chars: int, least: int = LEAST) -> list[tuple[int, int]]:
    """Parts of a long range: each ends at the last mark within the limit, or at a blank, or where the limit is; a rest under `least` is left out."""
    ends = {m.end() for m in _CONNECTORS.finditer(text)} | {i + 1 for i, c in enumerate(text) if c in P.SPLIT_MARKS}
    points = sorted(e for e in ends if e >= least)
    out, at = [], 0
    while len(text) - at > max_chars:
        fitting = [e for e in points if least <= e - at <= max_chars]
        if fitting:
            end = fitting[-1]
        else:
            stop = min(len(text), at + max_chars)
            backward = range(stop, min(len(text), at + least) - 1, -1)
            end = next((e for e in backward if text[e - 1] in P.SPLIT_MARKS or _SPACES.match(text[e - 1])), stop)
        out.append((at, end))
        at = end
    if len(text) - at >= least:
        out.append((at, len(text)))
    return out or [(0, len(text))]


def _long_split(max_chars: int):
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": a, "end": b} for a, b in split_long(t, max_chars)])

    return split


def heading_text(title: Column) -> Column:
    return X.trim(X.squeeze(F.regexp_replace(F.lower(X.nfkc(title)), P.java(P.HEADING_PREFIX, False), "")))


def section_kind(title: Column) -> Column:
    """The first group one of whose terms occurs in the title."""

    def first(normal: Column) -> Column:
        out = F.lit("other")
        for kind, terms in reversed(P.SECTION_TERMS):
            hit = F.contains(normal, F.lit(terms[0]))
            for t in terms[1:]:
                hit = hit | F.contains(normal, F.lit(t))
            out = F.when(hit, kind).otherwise(out)
        return out

    # Bound by a lambda, the normal form is computed once.
    return F.when(title.isNull(), "other").otherwise(F.get(F.transform(F.array(heading_text(title)), first), 0))


def looks_like_heading(line: Column, kind: Column) -> Column:
    """Of a trimmed line and its kind."""
    word = r"[\p{Lu}\p{N}][\p{L}\p{N}-]*"
    return (
        F.length(line).between(1, 90) & ~_ended(line) & F.regexp_count(line, F.lit(f"[^{P.SPACES}]+")).between(1, 12)
        & line.rlike(r"[\p{L}\p{N}]") & line.rlike(P.java(P.HEADING_LINE, False))
        & ((kind != "other") | line.rlike(f"^{word}(?:{P.SPACE}+{word})*$"))
    )


def _ended(line: Column) -> Column:
    """Whether a sentence ends with a trimmed line; only its last characters are looked at."""
    return F.substring(line, -2, 2).rlike(f"[{P.ASCII_END}{P.CJK_END}]$")


def headings(pages: DataFrame) -> DataFrame:
    """The pages' keys with start, end, title, kind of each heading line."""
    keys = [c for c in pages.columns if c != "text"]
    lines = X.bound(pages, lines=F.split("text", "\n", -1)).drop("text")
    starts = X.prefix_sums(F.transform("lines", lambda x: F.length(x) + 1))
    lines = lines.select(*keys, F.explode(F.arrays_zip("lines", starts.alias("start"))).alias("x")).select(*keys, "x.lines", "x.start")
    lines = lines.select(*keys, "start", (F.col("start") + F.length("lines")).alias("end"), F.col("lines").alias("line"))
    lines = X.bound(lines, title=X.trim(F.col("line"))).drop("line")
    # Most lines are ruled out before their kind is looked up.
    lines = lines.filter(F.length("title").between(1, 90) & ~_ended(F.col("title")) & F.col("title").rlike(P.java(P.HEADING_LINE, False)))
    return lines.withColumn("kind", section_kind(F.col("title"))).filter(looks_like_heading(F.col("title"), F.col("kind")))


def with_sections(rows: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """rows (with start) and the section_title, section_kind of the last heading at or before start on the same page."""
    listed = heads.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "title", "kind"))).alias("heads"))
    joined = rows.join(listed, keys, "left")
    last = F.try_element_at(F.filter("heads", lambda h: h["start"] <= F.col("start")), F.lit(-1))
    return joined.withColumn("section", last).select(*rows.columns, F.col("section.title").alias("section_title"), F.coalesce("section.kind", F.lit("other")).alias("section_kind"))
