"""Whole plans: highlights of documents and of selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosswork import config
from glosswork.functions import scoring as S
from glosswork.functions import text as X
from glosswork.operators import candidates, lexical, rank, segment, select
from glosswork.session import kept
from glosswork.sources.pages import page_counts


def documents(cands: DataFrame, heads: DataFrame, density: str = "balanced", papers: DataFrame | None = None) -> DataFrame:
    """One row a document: doc_id, query (its pseudo-query) and short (its shortlist). Candidates are shuffled once, by document; shortlist, leads and top terms are taken from their array."""
    rows = select.by_document(lexical.with_tokens(cands))
    leads = F.transform(F.filter("rows", lambda x: x["section_kind"].isin(*lexical.LEADS)), lambda x: x["text"])
    return select.with_shortlist(lexical.asked(rows.withColumns({"tokens": F.flatten("rows.tokens"), "leads": leads}), heads, papers), density)


def ranked(pages: DataFrame, density: str = "balanced", focus: str = "balanced", method: str = "bm25", papers: DataFrame | None = None) -> DataFrame:
    """Shortlisted candidates of pages, blended and ordered without a neural score, in one job without a cut."""
    pages = pages.filter(X.filled(F.col("text")))
    found = documents(candidates.candidates(pages, density, focus), segment.headings(pages), density, papers)
    return rank.rank_documents(rank.exploded(found), None, method)


def prepare(pages: DataFrame, density: str = "balanced", focus: str = "balanced", papers: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Candidates, shortlist, pseudo-queries and page counts of documents given as pages (doc_id, page_index, text)."""
    pages = pages.filter(X.filled(F.col("text")))
    cands = kept(lexical.with_tokens(candidates.candidates(pages, density, focus)))
    found = kept(documents(cands, segment.headings(pages), density, papers))
    return cands, found.select("doc_id", F.inline("short")), found.select("doc_id", "query"), page_counts(pages)


def highlight_documents(pages: DataFrame, density: str = "balanced", focus: str = "balanced", method: str = "bm25", min_confidence: float = 0.0, papers: DataFrame | None = None, neural: DataFrame | None = None, scorer: rank.Scorer | None = None) -> DataFrame:
    """The highlights of each document in no particular row order; order them by doc_id, page_index, start for reading."""
    if neural is None and scorer is None:
        return select.finalised(ranked(pages, density, focus, method, papers), page_counts(pages), density, min_confidence)
    _, short, queries, counts = prepare(pages, density, focus, papers)
    if neural is None:
        neural = rank.scored_by(short, queries, scorer)
    return select.finalised(rank.rank_documents(short, queries, method, neural), counts, density, min_confidence)


def reading_order(highlights: DataFrame) -> DataFrame:
    """highlights with place, from 1, in the order of pages and offsets of each document."""
    return highlights.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index", "start")))


def selection_candidates(selections: DataFrame, density: str = "balanced") -> DataFrame:
    """selection_id, id, text, normal, start, end, section_kind, reason, heuristic_score of the selections' readable sentences."""
    d = config.density(density)
    rows = selections.filter(X.filled(F.col("selection_text"))).select("selection_id", F.col("selection_text").alias("text"), segment.section_kind(F.when(F.col("section_title") != "", F.col("section_title"))).alias("section_kind"))
    rows = X.readable_rows(X.trimmed_rows(segment.ranges(rows, d.quick_max_chars)), d.quick_min_chars, d.quick_max_chars, d.quick_max_words)
    rows = S.with_phrases(rows).withColumn("heuristic_score", S.heuristic_of(F.col("section_kind"))).filter(F.col("heuristic_score") >= config.LEAST_HEURISTIC)
    return rows.withColumn("reason", S.reason(F.col("text"), F.col("section_kind"), F.col("told"))).withColumn("id", F.col("start"))


def highlight_selections(selections: DataFrame, density: str = "balanced", method: str = "bm25", neural: DataFrame | None = None, scorer: rank.Scorer | None = None) -> DataFrame:
    """The validated highlights of selections: selection_id, place, text, start, end, reason, confidence."""
    cands = selection_candidates(selections, density)
    queries = lexical.selection_queries(selections)
    if scorer is not None and neural is None:
        neural = rank.scored_by(cands, queries, scorer, "selection_id")
    ranked = rank.rank_selections(cands, queries, method, neural)
    spans = ranked.join(selections.select("selection_id", F.col("selection_text").alias("source")), "selection_id")
    return select.validated(spans.select("selection_id", "rank", "text", "start", "end", "reason", "confidence", "source"), density)
