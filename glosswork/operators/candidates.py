"""Candidates: the readable, well-scored sentences of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosswork import config
from glosswork.functions import scoring as S
from glosswork.functions import text as X
from glosswork.operators import segment


def trimmed(rows: DataFrame) -> DataFrame:
    """Ranges (piece, start, end) without outer blanks, quotes and brackets, as text, start, end, normal (NFKC)."""
    return X.bound(X.trimmed_rows(rows), normal=X.nfkc(F.col("text")))


def candidates(pages: DataFrame, density: str = "balanced", focus: str = "balanced") -> DataFrame:
    """doc_id, page_index, id, start, end, text, normal, section_title, section_kind, reason, heuristic_score.

    Narrow up to the ids: these number a page's candidates that passed every filter. Each measure is taken once a row, cheap ones first.
    """
    d = config.density(density)
    text, kind = F.col("text"), F.col("section_kind")
    rows = X.readable_rows(X.trimmed_rows(segment.ranges(pages, d.max_chars)), d.min_chars, d.max_chars, d.max_words)
    rows = segment.with_sections(rows, segment.headings(pages), ["doc_id", "page_index"]).filter("section_kind <> 'references'")
    rows = S.with_phrases(rows).withColumn("heuristic_score", S.heuristic_of(kind, focus)).filter(F.col("heuristic_score") >= config.LEAST_HEURISTIC)
    # Dealt by document, which ranking needs, and with normal forms only where they differ from the text.
    rows = rows.withColumn("reason", S.reason(text, kind, F.col("told"))).select("doc_id", "page_index", "start", "end", "text", F.when(F.col("normal") != text, F.col("normal")).alias("normal"), "section_title", "section_kind", "reason", "heuristic_score")
    order = Window.partitionBy("doc_id", "page_index").orderBy("start")
    number = F.concat(F.lit("P"), (F.col("page_index") + 1).cast("string"), F.lit("-C"), F.row_number().over(order).cast("string"))
    return rows.repartition("doc_id").withColumn("id", number).select("doc_id", "page_index", "id", "start", "end", "text", F.coalesce("normal", "text").alias("normal"), "section_title", "section_kind", "reason", "heuristic_score")
