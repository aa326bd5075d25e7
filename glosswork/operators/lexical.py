"""Lexical ranking: term counts, BM25 and TF-IDF within each document's candidates, top terms and pseudo-queries.

Everything is keyed by a document (or selection) key; once rows are dealt by it, the aggregates, windows
and joins below need no other exchange: they are by the key, or by the key and more on one table, and rows are carried
through instead of being joined back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions import scoring as S
from glosswork.functions import text as X

K1, B = 1.2, 0.75


def with_tokens(rows: DataFrame, normal: str = "normal") -> DataFrame:
    """rows with their tokens, which are taken once: rows that have them stay as they are."""
    return rows if "tokens" in rows.columns else rows.withColumn("tokens", X.tokens(F.lower(F.col(normal))))


def term_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, tf."""
    return rows.select(*keys, F.explode("tokens").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def document_frequency(postings: DataFrame, key: str) -> DataFrame:
    """key, term, df: in how many of the key's candidates a term occurs."""
    return postings.groupBy(key, "term").agg(F.count("*").alias("df"))


def normalised(score: Column, key: str) -> Column:
    """Divided by the key's largest score; all 0 if that isn't positive."""
    most = F.max(score).over(Window.partitionBy(key))
    return F.when(most > 0, S.clamp01(score / most)).otherwise(F.lit(0.0))


def with_terms(rows: DataFrame, name: str = "terms") -> DataFrame:
    """rows with ARRAY<STRUCT<term, tf>> of their tokens: the runs of the sorted tokens, so long texts take no quadratic time."""
    rows = X.bound(rows, __sorted=F.array_sort("tokens"))
    every = F.col("__sorted")
    rows = X.bound(rows, __starts=F.filter(F.transform(every, lambda x, i: F.when((i == 0) | (x != F.get(every, i - 1)), i)), lambda i: i.isNotNull()))
    at = F.col("__starts")
    runs = F.transform(at, lambda a, j: F.struct(F.get(every, a).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(every)) - a).alias("tf")))
    return rows.withColumn(name, runs).drop("__sorted", "__starts")


def query_counts(queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, qtf (how often each term occurs, as a map) and squares (the sum of these numbers' squares) of queries given as text (key, query)."""
    return counted_queries(queries.select(key, "query")).drop("query")


def counted_queries(rows: DataFrame) -> DataFrame:
    """rows (query, ...) with qtf and squares; narrow."""
    found = with_terms(rows.withColumn("__normal", X.nfkc(F.col("query"))).withColumn("tokens", X.tokens(F.lower(F.col("__normal")))), "__terms")
    squares = F.aggregate("__terms", F.lit(0).cast("long"), lambda s, x: s + x["tf"].cast("long") * x["tf"])
    return found.withColumns({"qtf": F.map_from_entries("__terms"), "squares": squares}).drop("__normal", "__terms", "tokens")


def _postings(rows: DataFrame, queries: DataFrame | None, key: str, item: str) -> DataFrame:
    """Postings of rows (key, item, tokens, ...) with qtf, df, the number of items n, their length dl and mean length avgdl.

    An item's first posting carries its other columns (own); an item without tokens has one posting without a term. All is
    clustered by the key, so neither counts nor sums need a join back or another exchange.
    """
    if queries is not None:
        w = Window.partitionBy(key)
        rows = rows.withColumn("n", F.count("*").over(w)).withColumn("avgdl", F.avg(F.size("tokens")).over(w)).join(query_counts(queries, key), key, "left")
    known = ["n", "avgdl", "qtf", "squares"]
    others = [c for c in rows.columns if c not in (key, item, "tokens", *known)]
    sized = with_terms(rows.select(key, item, *known, "tokens", F.struct(F.size("tokens").alias("dl"), *others).alias("own"))).withColumn("dl", F.col("own.dl"))
    asked = F.transform("terms", lambda x: F.struct(x["term"].alias("term"), x["tf"].alias("tf"), F.coalesce(F.try_element_at("qtf", x["term"]), F.lit(0)).alias("qtf")))
    cut = sized.select(key, item, "dl", "n", "avgdl", "squares", "own", F.posexplode_outer(asked).alias("at", "x"))
    cut = cut.select(key, item, "dl", "n", "avgdl", "squares", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("own")).alias("own"), "x.term", "x.tf", "x.qtf")
    return cut.withColumn("df", F.count("*").over(Window.partitionBy(key, "term")))


def _summed(postings: DataFrame, key: str, item: str, **sums: Column) -> DataFrame:
    """key, item, the items' other columns and sums over their postings."""
    out = postings.groupBy(key, item).agg(F.first("own", ignorenulls=True).alias("own"), *[c.alias(name) for name, c in sums.items()])
    return out.select(key, item, "own.*", *sums).drop("dl")


def bm25(rows: DataFrame, queries: DataFrame | None, key: str = "doc_id", item: str = "id") -> DataFrame:
    """rows without tokens, with raw; a term of the query (key, query) counts as often as it occurs there; null for items that share none."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1.0))))
    return _summed(_postings(rows, queries, key, item), key, item, raw=F.sum(F.when(F.col("qtf") > 0, F.col("qtf") * idf * weight)))


def tfidf(rows: DataFrame, queries: DataFrame | None, key: str = "doc_id", item: str = "id") -> DataFrame:
    """As bm25, with the cosine of item and query under smooth weights; the query's norm includes terms that no item has."""
    idf = lambda n, df: F.log((n + 1) / (df + 1)) + 1
    own = idf(F.col("n"), F.col("df"))
    # Each term of the query that items have is counted at its first posting; the others all have the weight of a term without items.
    once = (F.row_number().over(Window.partitionBy(key, "term").orderBy(item)) == 1) & (F.col("qtf") > 0)
    p = _postings(rows, queries, key, item).withColumns({"w": F.col("tf") * own, "qw": F.col("qtf") * own, "once": once})
    w = Window.partitionBy(key)
    there = F.coalesce(F.sum(F.when(F.col("once"), F.col("qw") * F.col("qw"))).over(w), F.lit(0.0))
    rest = F.col("squares") - F.coalesce(F.sum(F.when(F.col("once"), F.col("qtf").cast("long") * F.col("qtf"))).over(w), F.lit(0))
    p = p.withColumn("qnorm", F.sqrt(there + rest * F.pow(idf(F.col("n"), F.lit(0)), 2)))
    out = _summed(p, key, item, dot=F.sum(F.when(F.col("qtf") > 0, F.col("w") * F.col("qw"))), norm=F.sqrt(F.sum(F.col("w") * F.col("w"))), qnorm=F.max("qnorm"))
    return out.withColumn("raw", F.when(F.col("dot").isNotNull(), F.col("dot") / (F.col("qnorm") * F.col("norm")))).drop("dot", "norm", "qnorm")


def lexical_scores(rows: DataFrame, queries: DataFrame | None, method: str = "bm25", key: str = "doc_id", item: str = "id") -> DataFrame:
    """rows (key, item, tokens, ...) without tokens, with lexical_score from 0 to 1; items without a term of the query (key, query) have 0.

    Without queries, rows have n, avgdl, qtf and squares of their own (see rank.exploded)."""
    raw = (tfidf if method == "tfidf" else bm25)(rows, queries, key, item).withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    return raw.withColumn("lexical_score", normalised(F.col("raw"), key)).drop("raw")


def top_terms(rows: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """key, terms: the most frequent terms of the key's rows; longer ones first among equals, then in alphabetical order."""
    counts = rows.select(key, F.explode("tokens").alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), F.desc(F.length("term")), F.collate("term", "UNICODE"), "term")
    ranked = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))


SLICE = 1 << 20  # tokens counted at once


def likely_terms(tokens: pa.ListArray, limit: int) -> pa.ListArray:
    """For each array of tokens the different ones, with their numbers, that are as frequent and long as the limit-th of them: those that the alphabet may put among the first."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat, out, i = tokens.flatten(), [], 0
    while i < len(tokens):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE, side="right")) - 1)
        words = flat.slice(ends[i], ends[j] - ends[i]).dictionary_encode()
        size = pc.utf8_length(words.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
        pair, n = np.unique(row * max(len(size), 1) + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
        row, word = np.divmod(pair, max(len(size), 1))
        order = np.lexsort((-size[word], -n, row))
        row, word, n = row[order], word[order], n[order]
        first = np.searchsorted(row, np.arange(j - i + 1))
        last = np.maximum(np.minimum(first[:-1] + limit, first[1:]) - 1, 0)  # of each row; unused for a row without tokens
        last = last[row]
        kept = (n > n[last]) | ((n == n[last]) & (size[word] >= size[word[last]]))
        terms = pa.StructArray.from_arrays([words.dictionary.take(pa.array(word[kept])), pa.array(n[kept])], ["term", "tf"])
        out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row[kept], np.arange(j - i + 1)).astype(np.int32)), terms))
        i = j
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())])))


def with_first_terms(rows: DataFrame, limit: int) -> DataFrame:
    """rows (tokens) with first, ARRAY<STRUCT<..., term, tf>>: the terms of their tokens in the order of top_terms, and without tokens.

    They are counted by numpy, a batch of arrays at once; only terms that may be among the first are compared by the alphabet.
    """
    likely = F.arrow_udf(lambda t: likely_terms(t, limit), "array<struct<term:string,tf:bigint>>")
    order = F.transform("likely", lambda x: F.struct((-x["tf"]).alias("n"), (-F.length(x["term"])).alias("size"), F.collate(x["term"], "UNICODE").alias("name"), x["term"].alias("term"), x["tf"].alias("tf")))
    return rows.withColumn("likely", likely("tokens")).drop("tokens").withColumn("first", F.slice(F.array_sort(order), 1, limit)).drop("likely")


def _joined(*parts: Column) -> Column:
    """The parts that aren't empty, with blanks between."""
    return F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda x: x != ""), " ")


LEADS = ("abstract", "introduction")


def document_queries(cands: DataFrame, heads: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """doc_id, query: keywords, title, first headings, best abstract and introduction sentences, top terms of all candidates."""
    best = F.when(F.col("section_kind").isin(*LEADS), F.struct((-F.col("heuristic_score")).alias("by"), "page_index", "start", "text"))
    listed = with_tokens(cands).groupBy("doc_id").agg(F.flatten(F.collect_list("tokens")).alias("tokens"), F.array_sort(F.collect_list(best)).alias("best"))
    return asked(listed.withColumn("leads", F.col("best.text")), heads, papers).select("doc_id", "query")


def asked(documents: DataFrame, heads: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """One row a document (doc_id, tokens of all candidates, leads: ordered texts, ...) with its query; joins are by document."""
    first = Window.partitionBy("doc_id").orderBy("page_index", "start")
    titles = heads.filter("kind <> 'references'").withColumn("k", F.row_number().over(first)).filter("k <= 12")
    titles = titles.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "title"))), lambda x: x["title"]), " ").alias("titles"))
    # The Python function comes behind the joins, as it hides how rows are dealt.
    out = documents.join(titles, "doc_id", "left")
    if papers is None:
        out = out.withColumns({"title": F.lit(None).cast("string"), "keywords": F.lit(None).cast("array<string>")})
    else:
        out = out.join(papers.select("doc_id", "title", "keywords"), "doc_id", "left")
    out = with_first_terms(out, 24)
    keywords = F.array_join(F.slice(F.coalesce("keywords", F.array().cast("array<string>")), 1, 10), " ")
    query = _joined(keywords, X.trim(F.col("title")), F.col("titles"), F.array_join(F.slice("leads", 1, 6), " "), F.array_join(F.col("first.term"), " "))
    return out.withColumn("query", query).drop("keywords", "title", "titles", "leads", "first")


def selection_queries(selections: DataFrame) -> DataFrame:
    """selection_id, query: title, section, their top terms and those of the context, keywords; else the selection's own top terms."""

    def terms(text: Column, limit: int) -> DataFrame:
        rows = selections.select("selection_id", F.lower(X.nfkc(text)).alias("normal"))
        return top_terms(with_tokens(rows), limit, "selection_id").withColumn("terms", F.array_join("terms", " "))

    blank = lambda *c: F.concat_ws(" ", *[F.coalesce(F.col(x), F.lit("")) for x in c])
    out = selections
    for name, text, limit in (("title_terms", blank("paper_title", "section_title"), 8), ("context_terms", blank("before_context", "after_context"), 8), ("own_terms", F.col("selection_text"), 10)):
        out = out.join(terms(text, limit).withColumnRenamed("terms", name), "selection_id", "left")
    keywords = F.array_join(F.slice(F.coalesce("author_keywords", F.array().cast("array<string>")), 1, 6), " ")
    main = _joined(X.trim(F.col("paper_title")), X.trim(F.col("section_title")), F.col("title_terms"), F.col("context_terms"), keywords)
    return out.select("selection_id", F.when(main != "", main).otherwise(F.coalesce("own_terms", F.lit(""))).alias("query"))
