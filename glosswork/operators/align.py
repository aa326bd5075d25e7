"""Alignment of selected text with page text: exact, normalised, then anchored at both ends.

A match keeps how offsets of the selection map to the page. All functions take one selection and one page and
run vectorised over Arrow batches in align(); windows are half-open pairs of offsets or None.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed: characters without width, quotes that count as straight ones, marks that close up with a blank.
INVISIBLE = set("\u00ad\u200b\u200c\u200d\u2060\ufeff")
QUOTES = str.maketrans({"\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"'})
OPENING, TIGHT = set("([{"), set(")]},.;:!?")
MOST_STARTS = 24
_SPACE = re.compile(r"[\s\u00a0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


@dataclass
class Normalised:
    """Text for matching; origin[i] is the raw offset of its i-th character."""

    text: str
    origin: list[int]
    raw_length: int

    def of_raw(self, offset: int) -> int:
        return bisect.bisect_left(self.origin, offset)

    def to_raw(self, boundary: int) -> int:
        if not self.text:
            return 0
        return self.origin[0] if boundary <= 0 else self.raw_length if boundary >= len(self.text) else self.origin[boundary]


def normalised(raw: str) -> Normalised:
    """Compatibility form, single blanks, straight quotes; no blank at the ends, behind an opening bracket or before a closing mark."""
    chars: list[str] = []
    origin: list[int] = []
    blank = None
    for i, char in enumerate(raw):
        for c in unicodedata.normalize("NFKC", char).translate(QUOTES):
            if c in INVISIBLE:
                continue
            if _SPACE.match(c):
                blank = i if blank is None and chars else blank
                continue
            if blank is not None and chars[-1] not in OPENING and c not in TIGHT:
                chars.append(" ")
                origin.append(blank)
            blank = None
            chars.append(c)
            origin.append(i)
    return Normalised("".join(chars), origin, len(raw))


def page_diffs(norm: Normalised) -> list[tuple[int, int]]:
    """Where the shift between normalised and raw offsets changes, and to what."""
    shifts = [i - raw for i, raw in enumerate(norm.origin)]
    return [(i, s) for i, s in enumerate(shifts) if s != (shifts[i - 1] if i else 0)]


def shift_at(diffs: Column, offset: Column) -> Column:
    """As-of look-up in an array of STRUCT<offset, shift>; entries with a null are passed over."""
    last = F.try_element_at(F.filter(diffs, lambda d: d["offset"].isNotNull() & d["shift"].isNotNull() & (d["offset"] <= offset)), F.lit(-1))
    return F.coalesce(last["shift"], F.lit(0))


def original_range(diffs: Column, start: Column, end: Column) -> Column:
    a, b = start - shift_at(diffs, start), end - shift_at(diffs, end)
    return F.when((end > start) & (b > a), F.struct(a.alias("start"), b.alias("end")))


def closeness(start: int, length: int, window: tuple[int, int] | None) -> tuple[float, float, float]:
    """Gap to the window, distance of centres, distance of starts; smaller is better."""
    if window is None:
        return (0, 0, start)
    low, high = window
    end = start + length
    gap = 0 if start < high and end > low else min(abs(end - low), abs(start - high))
    return (gap, abs((start + length / 2) - (low + (high - low) / 2)), abs(start - low))


def starts(text: str, part: str, window: tuple[int, int] | None, most: int | None = MOST_STARTS) -> list[int]:
    """Where part occurs, overlapping ones too, best first."""
    found, at = [], text.find(part) if part else -1
    while at >= 0:
        found.append(at)
        at = text.find(part, at + 1)
    return sorted(found, key=lambda s: (*closeness(s, len(part), window), s))[:most]


def best_start(text: str, part: str, window: tuple[int, int] | None) -> int:
    return next(iter(starts(text, part, window, 1)), -1)


def anchor_length(n: int) -> int:
    return 0 if n < 24 else min(48, max(16, n // 6))


def clamped(start: int, end: int, most: int) -> tuple[int, int] | None:
    a, b = (max(0, min(x, max(0, most))) for x in (start, end))
    return (a, b) if b > a else None


def anchored(page: Normalised, selection: Normalised, window: tuple[int, int] | None) -> tuple[int, int] | None:
    """The part of the page between the selection's first and last characters that fits best."""
    n = anchor_length(len(selection.text))
    if not n or len(selection.text) < 2 * n:
        return None
    near = clamped(page.of_raw(window[0]), page.of_raw(window[1]), len(page.text)) if window else None
    ranges = [(a, b + n) for a in starts(page.text, selection.text[:n], near) for b in starts(page.text, selection.text[-n:], near) if b + n > a]

    def score(r: tuple[int, int]) -> tuple:
        gap, centre, start = closeness(r[0], r[1] - r[0], near)
        return (gap, abs(r[1] - r[0] - len(selection.text)), centre, start)

    best = min(ranges, key=score, default=None)
    return best if best and best[1] - best[0] >= max(2 * n, math.floor(0.6 * len(selection.text))) else None


@dataclass
class Match:
    mode: str
    start: int  # raw for exact, else in the normalised page
    page: Normalised | None = None
    selection: Normalised | None = None
    anchors: tuple[int, int] | None = None

    def at(self, offset: int) -> int:
        """An offset of the normalised selection in the normalised page; between anchors in proportion."""
        if self.anchors is None:
            return self.start + offset
        low, high = self.anchors
        n = len(self.selection.text)
        if offset <= 0:
            return low + offset
        return high + offset - n if offset >= n else math.floor(low + (high - low) * offset / n + 0.5)


def match(page: str, selection: str, window: tuple[int, int] | None = None) -> Match | None:
    exact = best_start(page, selection, window)
    if exact >= 0:
        return Match("exact", exact)
    p, s = normalised(page), normalised(selection)
    if not p.text or not s.text:
        return None
    near = clamped(p.of_raw(window[0]), p.of_raw(window[1]), len(p.text)) if window else None
    found = best_start(p.text, s.text, near)
    if found >= 0:
        return Match("normalized", found, p, s)
    ends = anchored(p, s, window)
    return Match("anchored", ends[0], p, s, ends) if ends else None


def _between_anchors(m: Match, span: str, start: int, end: int) -> tuple[int, int] | None:
    """The span's own text near where it should be between the anchors."""
    part = normalised(span).text
    low, high = m.anchors
    if not part or high <= low:
        return None
    drift = max(len(part), abs((high - low) - len(m.selection.text)), 8)
    a, b = m.at(m.selection.of_raw(start)), m.at(m.selection.of_raw(end))
    found = best_start(m.page.text[low:high], part, clamped(a - low - drift, b - low + drift, high - low))
    return None if found < 0 else (low + found, low + found + len(part))


def map_span(m: Match, selection: str, start: int, end: int) -> tuple[int, int] | None:
    """A span of the selection as raw offsets of the page, one character at least."""
    a = max(0, min(start, len(selection)))
    b = max(a, min(end, len(selection)))
    if a == b:
        return None
    if m.mode == "exact":
        return (m.start + a, m.start + b)
    found = _between_anchors(m, selection[start:end], a, b) if m.anchors else None
    i, j = found or (m.at(m.selection.of_raw(a)), m.at(m.selection.of_raw(b)))
    low, high = m.page.to_raw(i), m.page.to_raw(j)
    return (low, max(high, low + 1))


RESULT = "struct<mode:string,start:int,end:int>"


def align(rows: DataFrame, page: str = "page_text", selection: str = "selection_text", start: str = "start", end: str = "end", window: str | None = None) -> DataFrame:
    """rows with `at`: mode and page offsets of the span start to end of the selection, or null."""

    @F.pandas_udf(RESULT)
    def run(pages: pd.Series, selections: pd.Series, a: pd.Series, b: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
        out = []
        for p, s, i, j, x, y in zip(pages, selections, a, b, low, high, strict=True):
            m = match(p, s, None if pd.isna(x) or pd.isna(y) else (int(x), int(y))) if p and s else None
            span = map_span(m, s, int(i), int(j)) if m else None
            out.append((m.mode, *span) if span else (None, None, None))
        frame = pd.DataFrame(out, columns=["mode", "start", "end"])
        return frame.astype({"start": "Int32", "end": "Int32"})

    none = F.lit(None).cast("int")
    found = run(F.col(page), F.col(selection), F.col(start), F.col(end), *((F.col(f"{window}.start"), F.col(f"{window}.end")) if window else (none, none)))
    return rows.withColumn("at", found).withColumn("at", F.when(F.col("at.mode").isNotNull(), F.col("at")))


def context(page: Column, start: Column, end: Column, size: int = 180) -> tuple[Column, Column]:
    """Up to so many characters before and after a range."""
    low = F.greatest(F.lit(0), start - size)
    return F.substr(page, low + 1, start - low), F.substr(page, end + 1, F.lit(size))


def page_label_index(label: Column) -> Column:
    """A numeric label's page, from 0; labels may go on after the number."""
    number = F.regexp_extract(F.coalesce(label, F.lit("")), r"^\s*([+-]?[0-9]+)", 1).try_cast("long")
    return F.when(number > 0, (number - 1).cast("int"))


def page_of(page_index: Column, label: Column, reader_page: Column) -> Column:
    valid = lambda c: F.when(c >= 0, c)
    return F.coalesce(valid(page_index), page_label_index(label), valid(reader_page))


def nearest_char(mapping: Column, offset: Column, forward: bool) -> Column:
    """The glyph of a text offset, or of the next offset in a direction that has one; null if none has."""
    at = F.greatest(F.lit(0), F.least(offset, F.size(mapping) - 1))
    known = lambda x: x.isNotNull()
    if forward:
        return F.get(F.filter(F.slice(mapping, at + 1, F.size(mapping)), known), 0)
    return F.try_element_at(F.filter(F.slice(mapping, F.lit(1), at + 1), known), F.lit(-1))


def text_window(mapping: Column, length: Column, window: Column) -> Column:
    """STRUCT<start, end> of the text whose glyphs are within a window of glyphs, both ends of which count; null if there is none."""
    inside = lambda x, i: F.when(x.isNotNull() & (x >= window["start"]) & (x <= window["end"]) & (i < length), i)
    hits = F.filter(F.transform(mapping, inside), lambda i: i.isNotNull())
    return F.when(window.isNotNull() & (F.size(hits) > 0), F.struct(F.array_min(hits).alias("start"), (F.array_max(hits) + 1).alias("end")))


def normal_text(text: Column) -> Column:
    """STRUCT<text, origin, diffs> of normalised()."""

    @F.pandas_udf("struct<text:string,origin:array<int>,diffs:array<struct<offset:int,shift:int>>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        every = [normalised(t or "") for t in texts]
        return pd.DataFrame({"text": [n.text for n in every], "origin": [n.origin for n in every], "diffs": [[{"offset": a, "shift": b} for a, b in page_diffs(n)] for n in every]})

    return run(text)


def substring_starts(text: Column, part: Column, low: Column, high: Column, most: int = MOST_STARTS) -> Column:
    """starts() for a window, best first."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series, parts: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([starts(t or "", p or "", (int(x), int(y)), most) for t, p, x, y in zip(texts, parts, a, b, strict=True)])

    return run(text, part, low, high)

