"""Ranking: blends of heuristic, lexical and neural scores, thresholds and total orders."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork import config
from glosswork.functions import scoring as S
from glosswork.operators import lexical

Scorer = Callable[[str, list[str]], list[float] | None]


def normalised_logits(logit: Column, key: str) -> Column:
    """Logistic function, then stretched to 0..1 within the key; all 0.5 where the range is below 1e-8."""
    p = 1 / (1 + F.exp(-logit))
    w = Window.partitionBy(key)
    low, high = F.min(p).over(w), F.max(p).over(w)
    return F.when(high - low < 1e-8, 0.5).otherwise((p - low) / (high - low))


def usable_neural(rows: DataFrame, scores: DataFrame, key: str, item: str) -> DataFrame:
    """rows with neural_score; null for a whole key unless each of its items, and no other, has one score.

    A key's scores come as one array, which its rows (a shortlist) look theirs up in, so rows stay where they are.
    """
    w = Window.partitionBy(key)
    listed = scores.groupBy(key).agg(F.collect_list(F.struct(F.col(item).alias("item"), F.col("score").cast("double").alias("score"))).alias("__given"))
    place = F.array_position("__given.item", F.col(item)).cast("int") - 1
    joined = rows.join(listed, key, "left").withColumns({"neural_score": F.get("__given.score", place), "given": F.size("__given")}).drop("__given")
    complete = (F.count("neural_score").over(w) == F.count("*").over(w)) & (F.col("given") == F.count("*").over(w))
    return joined.withColumn("neural_score", F.when(complete, F.col("neural_score"))).drop("given")


def scored_by(rows: DataFrame, queries: DataFrame, scorer: Scorer, key: str = "doc_id", item: str = "id") -> DataFrame:
    """key, item, score from a pluggable function of a query and its texts; no scores where it fails or answers with another number of them."""

    @F.pandas_udf("array<double>")
    def run(query: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for q, t in zip(query, texts, strict=True):
            try:
                got = scorer(q, list(t))
            except Exception:  # a scorer's failure means the lexical blend for that document
                got = None
            out.append([float(x) for x in got] if got is not None and len(got) == len(t) else None)
        return pd.Series(out)

    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(item, "text"))).alias("rows")).join(queries, key)
    scored = listed.select(key, F.explode(F.arrays_zip(F.col(f"rows.{item}").alias(item), run(F.col("query"), F.col("rows.text")).alias("score"))).alias("x"))
    return scored.select(key, f"x.{item}", "x.score").filter("score is not null")


def blend_documents(rows: DataFrame, neural: DataFrame | None = None) -> DataFrame:
    """Candidates with lexical_score that come above the threshold, with h, neural_score, final_score and rank."""
    rows = rows.withColumn("h", lexical.normalised(F.col("heuristic_score"), "doc_id"))
    rows = rows.withColumn("neural_score", F.lit(None).cast("double")) if neural is None else usable_neural(rows, neural, "doc_id", "id")
    final = S.document_blend(F.col("h"), F.col("lexical_score"), F.col("neural_score"), S.alignment_bonus(F.col("reason"), F.col("section_kind")))
    rows = rows.withColumn("final_score", final).filter(F.col("final_score") >= config.DOCUMENT_THRESHOLD)
    # Sums may differ in their last bits by the order of partitions; ranks must not.
    even = lambda c: F.desc(F.round(c, 12))
    order = Window.partitionBy("doc_id").orderBy(even("final_score"), F.desc("heuristic_score"), even("lexical_score"), "page_index", "start")
    return rows.drop("rank").withColumn("rank", F.row_number().over(order))


def exploded(documents: DataFrame) -> DataFrame:
    """The shortlists of documents (doc_id, query, short) as rows with what lexical scores need of the whole document, taken from its array in place.

    Python functions (places, normal forms) hide from the planner how rows are dealt, so shortlists are dealt by document once more here; else each step below would be.
    """
    sizes = F.transform("short.tokens", F.size)
    rows = lexical.counted_queries(documents.select("doc_id", "query", "short")).withColumns({"n": F.size("short").cast("long"), "avgdl": F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x) / F.size("short")})
    return rows.repartition("doc_id").select("doc_id", "n", "avgdl", "qtf", "squares", F.inline("short"))


def rank_documents(short: DataFrame, queries: DataFrame | None, method: str = "bm25", neural: DataFrame | None = None) -> DataFrame:
    """The shortlist held against its documents' pseudo-queries (doc_id, query), blended and ordered."""
    rows = lexical.lexical_scores(lexical.with_tokens(short), queries, config.lexical_method(method))
    return blend_documents(rows, neural)


def rank_selections(cands: DataFrame, queries: DataFrame, method: str = "bm25", neural: DataFrame | None = None) -> DataFrame:
    """Selection candidates (selection_id, id, start, ...) above the threshold with confidence and rank."""
    key = "selection_id"
    rows = lexical.lexical_scores(lexical.with_tokens(cands), queries, config.lexical_method(method), key)
    rows = rows.withColumn("h", lexical.normalised(F.col("heuristic_score"), key))
    rows = rows.withColumn("neural_score", F.lit(None).cast("double")) if neural is None else usable_neural(rows, neural, key, "id")
    rows = rows.withColumn("final_score", S.selection_blend(F.col("h"), F.col("lexical_score"), F.col("neural_score"))).filter(F.col("final_score") >= config.SELECTION_THRESHOLD)
    order = Window.partitionBy(key).orderBy(F.desc(F.round("final_score", 12)), F.desc("heuristic_score"), "start")
    return rows.withColumn("confidence", S.clamp01(F.col("final_score"))).withColumn("rank", F.row_number().over(order))
