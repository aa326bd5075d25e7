"""Geometry of spans: character widths, proportional rects, merging, sort keys, and rect predicates.

Rects are arrays x1, y1, x2, y2. Per-row expressions stay in the JVM; merging and line allocation are folds
over the rects of one span and run on arrays.
"""

from __future__ import annotations

import itertools
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Relative widths by character, the first that holds.
NARROW, MEDIUM, AVERAGE, WIDE, EXTRA = 0.35, 0.55, 1.0, 1.3, 1.7
WIDTHS = (
    ("il1|'!.:;,", NARROW),
    ("ftjrIJ()[]{}/-", MEDIUM),
    ("mwMW@&", WIDE),
    ((0x3000, 0x9FFF), EXTRA),
    ((0xFF00, 0xFFEF), EXTRA),
    ("—…", WIDE),
    (" ", 0.5),
    ((0x30, 0x39), 0.85),
    ((0x41, 0x5A), 1.1),
)
INSET, KEPT = 0.15, 0.8
TOLERANCE, PADDING = 2, 24
SAME_LINE, GAP = 5, 10


def char_weight(char: Column) -> Column:
    """Relative width of a character."""
    out = F.lit(AVERAGE)
    for group, width in reversed(WIDTHS):
        test = F.contains(F.lit(group), char) if isinstance(group, str) else F.ascii(char).between(*group)
        out = F.when(test, width).otherwise(out)
    return out


def weight_of(char: str) -> float:
    return next((w for group, w in WIDTHS if (char in group if isinstance(group, str) else group[0] <= ord(char) <= group[1])), AVERAGE)


def widths(text: str, total: float) -> list[float]:
    weights = [weight_of(c) for c in text]
    return [total * w / sum(weights) for w in weights] if len(text) > 1 else [total] * len(text)


def inset(rect: Column) -> Column:
    """The middle of a rect's height, where the letters are."""
    height = rect[3] - rect[1]
    low = rect[1] + height * INSET
    return F.array(rect[0], low, rect[2], low + height * KEPT)


def _inset(x1: float, x2: float, rect: list[float]) -> list[float]:
    low = rect[1] + (rect[3] - rect[1]) * INSET
    return [min(x1, x2) if x1 > x2 else x1, low, max(x1, x2) if x1 > x2 else x2, low + (rect[3] - rect[1]) * KEPT]


def lines_of(text: str, rects: list[list[float]]) -> list[tuple[int, int]]:
    """The characters of each line: a line is full where the next character's middle would stand beyond the lines so far."""
    across = [abs(r[2] - r[0]) for r in rects]
    if sum(across) <= 0:
        each = -(-len(text) // len(rects))
        return [(i * each, min((i + 1) * each, len(text))) for i in range(len(rects))]
    own, reached = widths(text, sum(across)), 0.0
    out, at = [], 0
    for limit in itertools.accumulate(across[:-1]):
        first = at
        while at < len(text) and (at == first or reached + own[at] / 2 <= limit):
            reached += own[at]
            at += 1
        out.append((first, at))
    return [*out, (at, len(text))]


def span_rects(text: str, rects: list[list[float]], start: int, end: int) -> list[list[float]]:
    """Rects of the characters start to end of a text laid out in rects, by relative widths."""
    if not rects or start < 0 or end <= start or start >= len(text):
        return []
    end = min(end, len(text))
    out = []
    for (a, b), rect in zip([(0, len(text))] if len(rects) == 1 else lines_of(text, rects), rects, strict=True):
        i, j = max(start, a), min(end, b)
        if i >= j:
            continue
        if (i, j) == (a, b) and len(rects) > 1:
            out.append(_inset(rect[0], rect[2], rect) if rect[0] <= rect[2] else [rect[0], *_inset(0, 0, rect)[1:2], rect[2], _inset(0, 0, rect)[3]])
            continue
        own = widths(text[a:b], rect[2] - rect[0])
        left = rect[0] + sum(own[: i - a])
        out.append(_inset(left, left + sum(own[i - a : j - a]), rect))
    return out


def span_rects_column(text: Column, rects: Column, start: Column, end: Column) -> Column:
    @F.pandas_udf("array<array<double>>")
    def run(t: pd.Series, r: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([span_rects(x, [list(map(float, q)) for q in y], int(i), int(j)) for x, y, i, j in zip(t, r, a, b, strict=True)])

    return run(text, rects, start, end)


def single_rect(text: Column, rect: Column, start: Column, end: Column) -> Column:
    """The rect of a span within a text of one rect, in the JVM."""
    weights = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), char_weight)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    stop = F.least(end, F.length(text))
    scale = (rect[2] - rect[0]) / total(weights)
    left = rect[0] + total(F.slice(weights, F.lit(1), start)) * scale
    right = left + total(F.slice(weights, start + 1, stop - start)) * scale
    return F.when((start >= 0) & (end > start) & (start < F.length(text)), inset(F.array(F.least(left, right), rect[1], F.greatest(left, right), rect[3])))


def merge_rects(rects: Column) -> Column:
    """Neighbouring rects of a line as one: each is held against the running rect, whose right edge alone moves."""
    empty = F.array().cast("array<array<double>>")

    def step(done: Column, rect: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = (F.abs(last[1] - rect[1]) < SAME_LINE) & (F.abs(last[3] - rect[3]) < SAME_LINE) & (F.abs(rect[0] - last[2]) < GAP)
        wider = F.array(last[0], last[1], rect[2], last[3])
        return F.when(F.coalesce(joins, F.lit(False)), F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), wider)).otherwise(F.array_append(done, rect))

    return F.aggregate(rects, empty, step)


def normal_rect(rect: Column) -> Column:
    """Corners in order; null unless four finite numbers."""
    finite = (F.size(rect) >= 4) & F.forall(F.slice(rect, 1, 4), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(finite, F.lit(False)), F.array(F.least(rect[0], rect[2]), F.least(rect[1], rect[3]), F.greatest(rect[0], rect[2]), F.greatest(rect[1], rect[3])))


def canonical_rect(rect: Column) -> Column:
    """As normal_rect; null as well where a side is 0.1 or less."""
    r = normal_rect(rect)
    return F.when((r[2] - r[0] > 0.1) & (r[3] - r[1] > 0.1), r)


def overlaps(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return ~((a[0] > b[2] + tolerance) | (a[2] < b[0] - tolerance) | (a[1] > b[3] + tolerance) | (a[3] < b[1] - tolerance))


def char_window(char_rects: Column, selection_rects: Column, padding: int = PADDING) -> Column:
    """STRUCT<start, end> of the glyphs from the first to the last that a selection rect meets, widened; null if none."""
    chosen = F.filter(F.transform(selection_rects, canonical_rect), lambda r: r.isNotNull())
    hits = F.filter(F.transform(char_rects, lambda r, i: F.when(F.exists(chosen, lambda s: overlaps(canonical_rect(r), s)), i)), lambda i: i.isNotNull())
    return F.when(F.size(hits) > 0, F.struct(F.greatest(F.lit(0), F.array_min(hits) - padding).alias("start"), F.least(F.size(char_rects) - 1, F.array_max(hits) + padding).alias("end")))


def highlight_rect(rect: Column, inline: Column, rotation: Column) -> Column:
    """A glyph's rect with the inline rect's sides across the writing direction."""
    r, i = normal_rect(rect), normal_rect(inline)
    vertical = F.coalesce(rotation, F.lit(0)).isin(90, 270)
    return F.when(r.isNull() | i.isNull(), r).when(vertical, F.array(i[0], r[1], i[2], r[3])).otherwise(F.array(r[0], i[1], r[2], i[3]))


def fixed3(value: float) -> float:
    """Three decimals, halves of the exact binary value away from zero."""
    return float(Decimal(value).quantize(Decimal("0.001"), ROUND_HALF_UP))


def line_rects(glyphs: list[dict], start: int, end: int) -> list[list[float]]:
    """One rect for each line of the glyphs start to end, both inclusive; none if a glyph at a line's end has no rect."""

    def normal(r):
        return [min(r[0], r[2]), min(r[1], r[3]), max(r[0], r[2]), max(r[1], r[3])] if r is not None and len(r) >= 4 and all(x is not None and abs(x) < float("inf") for x in r[:4]) else None

    if not glyphs or start < 0 or end < start or end >= len(glyphs):
        return []
    out, first = [], start
    for k in range(start, end + 1):
        if k < end and not glyphs[k].get("line_break_after"):
            continue
        a, b = glyphs[first], glyphs[k]
        ra, rb = normal(a.get("rect")), normal(b.get("rect"))
        ia, ib = (normal(g.get("inline_rect") if g.get("inline_rect") is not None else g.get("rect")) for g in (a, b))
        if None in (ra, rb, ia, ib):
            return []
        vertical = (a.get("rotation") or 0) in (90, 270)
        out.append([fixed3(x) for x in ([ia[0], ra[1], ib[2], rb[3]] if vertical else [ra[0], ia[1], rb[2], ib[3]])])
        first = k + 1
    return out


def line_rects_column(glyphs: Column, start: Column, end: Column) -> Column:
    """line_rects of an array of glyph structs."""

    @F.pandas_udf("array<array<double>>")
    def run(texts: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([line_rects([dict(x) for x in g], int(i), int(j)) for g, i, j in zip(texts, a, b, strict=True)])

    return run(glyphs, start, end)


def padded(number: Column, width: int) -> Column:
    """With zeros in front, never cut."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def sort_index(page: Column, offset: Column, rects: Column) -> Column:
    top = F.coalesce(F.floor(F.get(F.get(rects, 0), 1)), F.lit(0)).cast("long")
    return F.concat_ws("|", padded(page, 5), padded(offset, 6), padded(top, 5))


def fallback_sort_index(base: Column, page: Column, span_offset: Column, rects: Column) -> Column:
    """The selection's own offset, if its sort index holds one, and the span's offset in it."""
    own = F.regexp_extract(F.coalesce(F.get(F.split(base, r"\|"), 1), F.lit("")), r"^\s*([+-]?[0-9]+)", 1)
    return sort_index(page, F.coalesce(own.try_cast("long"), F.lit(0)) + F.greatest(F.lit(0), span_offset), rects)


def geometry_of(layer1: Column, layer2: Column, layer3: Column) -> Column:
    """The first layer that has rects."""
    some = lambda r, k: F.when(F.size(r) > 0, F.struct(F.lit(k).alias("layer"), r.alias("rects")))
    return F.coalesce(some(layer1, 1), some(layer2, 2), some(layer3, 3))
