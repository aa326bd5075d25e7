"""Greedy selection: shortlist, final choice, span repair and validation.

The folds depend on every earlier decision, so each document's ordered rows are one array, bounded by the text of
one document, and a vectorised function over scores, places and hashes of keys, not texts, says which are taken.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork import config
from glosswork.functions import scoring as S
from glosswork.functions import text as X


def shortlist_places(pages: list[int], keys: list[str], size: int, per_page: int) -> list[int]:
    """Places taken, best first: a page's cap, then repeated or empty keys; a row that the cap stops does not claim its key."""
    taken, seen, count = [], set(), Counter()
    for i, (page, key) in enumerate(zip(pages, keys, strict=True)):
        if len(taken) == size:
            break
        if count[page] < per_page and key and key not in seen:
            seen.add(key)
            count[page] += 1
            taken.append(i)
    return taken


def final_places(pages: list[int], sections: list[str], keys: list[str], caps: list[int], budget: int, per_page: int) -> list[int]:
    taken, seen, by_page, by_section = [], set(), Counter(), Counter()
    for i, (page, section, key, cap) in enumerate(zip(pages, sections, keys, caps, strict=True)):
        if len(taken) >= budget:
            break
        if key and key not in seen and by_page[page] < per_page and by_section[section] < cap:
            seen.add(key)
            by_page[page] += 1
            by_section[section] += 1
            taken.append(i)
    return taken


def _grouped(rows: DataFrame, order: list[Column], key: str = "doc_id") -> DataFrame:
    """key and the array of its rows, ordered; what a row is ordered by comes first in its struct."""
    struct = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(struct)).alias("rows"))


def _at(places: Column) -> Column:
    """The rows of an array of places."""
    return F.transform(places, lambda k: F.get("rows", k))


FIELDS = ["id", "page_index", "start", "end", "text", "normal", "section_title", "section_kind", "reason", "heuristic_score"]


def _with_key(rows: DataFrame) -> DataFrame:
    """rows (normal) with key: 128 bits of the text's dedup key, null if that is empty. The key is made once a row."""
    return X.bound(rows, key=X.dedup_key(F.col("normal"))).withColumn("key", F.when(F.col("key") != "", F.unhex(F.md5("key"))))


def by_document(cands: DataFrame) -> DataFrame:
    """doc_id and rows: a document's candidates, best first, with the hashes of their keys; normal is null where it is the text."""
    fields = [*FIELDS, *(c for c in ("tokens",) if c in cands.columns)]
    rows = _with_key(cands.filter("section_kind <> 'references'").select("doc_id", *fields))
    rows = rows.withColumn("normal", F.when(F.col("normal") != F.col("text"), F.col("normal")))
    return _grouped(rows, [-F.col("heuristic_score"), F.col("page_index"), F.col("start")])


def with_shortlist(documents: DataFrame, density: str = "balanced") -> DataFrame:
    """documents (rows, as by_document gives them, ...) with short: the candidates taken, with rank from 1, and without rows."""
    d = config.density(density)

    @F.pandas_udf("array<int>")
    def places(pages: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([shortlist_places(list(p), list(k), d.shortlist_size, d.shortlist_per_page) for p, k in zip(pages, keys, strict=True)])

    fields = [f.name for f in documents.schema["rows"].dataType.elementType if f.name not in ("o0", "o1", "o2", "key")]
    own = lambda row, c: F.coalesce(row[c], row["text"]) if c == "normal" else row[c]
    taken = F.transform(places(F.col("rows.page_index"), F.col("rows.key")), lambda k, i: F.struct((i + 1).alias("rank"), *[own(F.get("rows", k), c).alias(c) for c in fields]))
    return documents.withColumn("short", taken).drop("rows")


def shortlist(cands: DataFrame, density: str = "balanced") -> DataFrame:
    """The candidates taken, with rank from 1."""
    return with_shortlist(by_document(cands), density).select("doc_id", F.inline("short"))


def least_score(min_confidence: float) -> int:
    return math.ceil(2 + 6 * min_confidence) if min_confidence > 0 else 0


def finalise(short: DataFrame, selected: DataFrame, pages: DataFrame, density: str = "balanced", min_confidence: float = 0.0) -> DataFrame:
    """The highlights of selected ids (doc_id, id, rank, reason): caps by page and section, no repeated text, a budget by pages (doc_id, pages).

    Reasons of the selection replace those of the candidates where given.
    """
    first = selected.groupBy("doc_id", "id").agg(F.min(F.struct("rank", F.col("reason").alias("why"))).alias("s")).select("doc_id", "id", F.col("s.rank").alias("rank"), "s.why")
    rows = short.drop("rank").join(first, ["doc_id", "id"]).withColumn("reason", F.coalesce("why", "reason"))
    return finalised(rows, pages, density, min_confidence)


def finalised(ranked: DataFrame, pages: DataFrame, density: str = "balanced", min_confidence: float = 0.0) -> DataFrame:
    """The highlights of candidates with a rank, as finalise gives them; rows that are dealt by document stay where they are."""
    d = config.density(density)

    @F.pandas_udf("array<int>")
    def places(pages: pd.Series, sections: pd.Series, keys: pd.Series, caps: pd.Series, budget: pd.Series) -> pd.Series:
        return pd.Series([final_places(list(p), list(s), list(k), list(c), b, d.max_per_page) for p, s, k, c, b in zip(pages, sections, keys, caps, budget, strict=True)])

    rows = ranked.filter("section_kind <> 'references'").filter(F.col("heuristic_score") >= least_score(min_confidence) if min_confidence > 0 else F.lit(True))
    rows = _with_key(rows.select("doc_id", "rank", *FIELDS)).join(pages.select("doc_id", d.budget_column(F.col("pages")).alias("budget")), "doc_id")
    grouped = _grouped(rows.withColumn("cap", S.section_cap(F.col("section_kind"), F.col("budget"))), [F.col("rank")])
    taken = grouped.select("doc_id", F.explode(_at(places(F.col("rows.page_index"), F.col("rows.section_kind"), F.col("rows.key"), F.col("rows.cap"), F.col("rows")[0]["budget"]))).alias("x"))
    return taken.select("doc_id", *[F.col(f"x.{c}").alias(c) for c in FIELDS])


def repaired(span_text: Column, start: Column, end: Column, source: Column) -> Column:
    """STRUCT<start, end> of a span in its source, or null: as given, within 24 characters, or where its text first occurs."""
    size = F.length(source)
    low = F.greatest(F.lit(0), F.least(start, size))
    high = F.greatest(low, F.least(end, size))
    given = F.substr(source, low + 1, high - low)
    blank = span_text.isNull() | (span_text == "")
    near_low = F.greatest(F.lit(0), low - 24)
    near = F.position(span_text, F.substr(source, near_low + 1, F.least(size, high + 24) - near_low))
    anywhere = F.position(span_text, source)
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    numbers = start.isNotNull() & end.isNotNull()
    return (
        F.when(numbers & (high > low) & (blank | (given == span_text)), span(low, high))
        .when(blank, None)
        .when(numbers & (near > 0), span(near_low + near - 1, near_low + near - 1 + F.length(span_text)))
        .when(anywhere > 0, span(anywhere - 1, anywhere - 1 + F.length(span_text)))
    )


def validated(spans: DataFrame, density: str = "balanced") -> DataFrame:
    """Spans (selection_id, rank, text, start, end, reason, confidence, source) that are readable, without repeats, up to the limit; place from 1."""
    d = config.density(density)

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series) -> pd.Series:
        return pd.Series([shortlist_places([0] * len(k), list(k), d.quick_max_highlights, d.quick_max_highlights) for k in keys])

    rows = spans.withColumn("at", repaired(F.col("text"), F.col("start"), F.col("end"), F.col("source"))).filter("at is not null")
    piece = F.substr(F.col("source"), F.col("at.start") + 1, F.col("at.end") - F.col("at.start"))
    text, begin, end = X.trimmed_range(piece, F.col("at.start"))
    rows = rows.select("selection_id", "rank", text.alias("text"), begin.alias("start"), end.alias("end"), X.trim(F.col("reason")).alias("reason"), "confidence").filter("text <> ''").withColumn("normal", X.nfkc(F.col("text")))
    rows = rows.filter(X.readable(F.col("text"), F.col("normal"), d.quick_min_chars, d.quick_max_chars, d.quick_max_words)).withColumn("key", X.dedup_key(F.col("normal")))
    grouped = rows.groupBy("selection_id").agg(F.array_sort(F.collect_list(F.struct("rank", "start", "end", "text", "reason", "confidence", "key"))).alias("rows"))
    taken = grouped.select("selection_id", "rows", F.posexplode(places(F.col("rows.key"))).alias("k", "place"))
    return taken.select("selection_id", (F.col("k") + 1).alias("place"), F.col("rows")[F.col("place")].alias("x")).select("selection_id", "place", "x.text", "x.start", "x.end", "x.reason", "x.confidence")
