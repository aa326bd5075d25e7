"""The whole plan held against a plain model of it, its invariants, pluggable scorers and streams."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glosswork import config
from glosswork import queries as engine
from glosswork.functions import patterns as P
from glosswork.operators import passages, rank, responses, segment
from glosswork.plans import highlights as H
from glosswork.sources import pages as G
from glosswork.streaming.documents import highlight_stream, requests_once

PAPER = [
    "Abstract\nWe propose a novel method that improves accuracy by 5 percent. However, the scope is limited to small data sets here.\nBackground of the work is a known problem in this field today.",
    "2 Methods\nOur training pipeline uses a benchmark dataset with clear protocol steps. We propose a novel method that improves accuracy by 5 percent.\nThe architecture yields significant gains, but the reasons remain unclear; more evidence is needed, and the evaluation of every single part of the system took many weeks, while the authors report that results improve with scale and that failure cases are rare, which is a finding in itself.",
    "3 Results\nResults show that our method outperforms the baseline on recall and precision. This is fine.\nReferences\n[1] A. Author, Title, 2020. We find that nothing here counts at all.",
]


def papers(spark):
    return spark.createDataFrame([(d, i, t) for d in (1, 2) for i, t in enumerate(PAPER[: d + 1])], "doc_id long, page_index int, text string")


def words(text):
    return re.findall(r"[^\W_]+(?:[-'][^\W_]+)*", text)


def terms(text):
    return [w for w in words(text.lower()) if len(w) > 1 and w not in P.STOPWORDS]


def bm25(texts, query):
    docs = [Counter(terms(t)) for t in texts]
    mean = sum(sum(d.values()) for d in docs) / len(docs)
    df = Counter(t for d in docs for t in d)
    raw = [sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * d[t] * 2.2 / (d[t] + 1.2 * (0.25 + 0.75 * sum(d.values()) / max(mean, 1))) for t in terms(query) if d[t]) for d in docs]
    return [x / max(raw) if max(raw) > 0 else 0 for x in raw]


def test_plan_against_plain_model(spark):
    cands, short, queries, counts = H.prepare(papers(spark))
    by_doc = defaultdict(list)
    for r in short.collect():
        by_doc[r.doc_id].append(r)
    text = {r.doc_id: r.query for r in queries.collect()}
    pages = {r.doc_id: r.pages for r in counts.collect()}
    want = set()
    for doc, rows in by_doc.items():
        rows.sort(key=lambda r: r.rank)
        lexical = bm25([r.text for r in rows], text[doc])
        top = max(r.heuristic_score for r in rows)
        bonus = {"result": (("results", "abstract"), 0.06), "method": (("methods",), 0.06), "caveat": (("discussion", "conclusion"), 0.05), "claim": (("abstract", "introduction", "conclusion"), 0.04), "background": (("introduction",), 0.03)}
        final = [(0.68 * max(0, r.heuristic_score / top) + 0.32 * lexical[i] + (bonus[r.reason][1] if r.section_kind in bonus[r.reason][0] else 0), r, lexical[i]) for i, r in enumerate(rows)]
        final = sorted((x for x in final if x[0] >= 0.24), key=lambda x: (-x[0], -x[1].heuristic_score, -x[2], x[1].page_index, x[1].start))
        budget = config.density("balanced").budget(pages[doc])
        seen, by_page, by_kind, taken = set(), Counter(), Counter(), 0
        for _, r, _ in final:
            key = re.sub(r"[^\w% ]|_", "", re.sub(r"\s+", " ", r.text.lower())).strip()
            limit = {"results": max(2, math.ceil(0.35 * budget)), "methods": max(1, math.ceil(0.25 * budget)), "abstract": max(1, math.ceil(0.2 * budget))}.get(r.section_kind, max(1, math.ceil(0.15 * budget)))
            if key in seen or by_page[r.page_index] >= 10 or by_kind[r.section_kind] >= limit or taken >= budget:
                continue
            seen.add(key)
            by_page[r.page_index] += 1
            by_kind[r.section_kind] += 1
            taken += 1
            want.add((doc, r.id))
    got = H.highlight_documents(papers(spark)).collect()
    assert {(r.doc_id, r.id) for r in got} == want and len(got) >= 8
    kinds = {r.section_kind for r in got}
    assert {"abstract", "methods", "results"} <= kinds and "references" not in kinds
    assert all(PAPER[r.page_index][r.start : r.end] == r.text for r in got)


@pytest.mark.parametrize("density", ["sparse", "balanced", "dense"])
def test_invariants(spark, sf, density):
    d = config.density(density)
    pages = G.pages_of_documents(G.read_documents(spark, sf).filter("doc_id < 40"))
    rows = H.highlight_documents(pages, density=density, method="tfidf").collect()
    again = H.highlight_documents(pages.repartition(3), density=density, method="tfidf").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and rows
    for key, of in _by(rows, lambda r: (r.doc_id, r.page_index)).items():
        assert len(of) <= d.max_per_page
        ends = sorted((r.start, r.end) for r in of)
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False)), key
    assert all(d.min_chars <= len(r.text) <= d.max_chars for r in rows)


def _by(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(r)
    return out


def test_confidence_and_focus(spark):
    some = H.highlight_documents(papers(spark), min_confidence=0.5).collect()
    assert some and all(r.heuristic_score >= 5 for r in some)
    methods = H.prepare(papers(spark), focus="methods-first")[0].filter("section_kind = 'methods'").agg(F.max("heuristic_score")).first()[0]
    balanced = H.prepare(papers(spark))[0].filter("section_kind = 'methods'").agg(F.max("heuristic_score")).first()[0]
    assert methods == balanced + 3


def test_scorers(spark):
    plain = {(r.doc_id, r.id) for r in H.highlight_documents(papers(spark)).collect()}
    broken = H.highlight_documents(papers(spark), scorer=lambda q, t: [0.5]).collect()
    assert {(r.doc_id, r.id) for r in broken} == plain  # a wrong number of scores means the lexical blend
    ranked = H.highlight_documents(papers(spark), scorer=lambda q, t: [float("novel" in x) for x in t]).collect()
    assert any("novel" in r.text for r in ranked)
    logits = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("b", 1.0), ("b", 1.0)], "k string, x double")
    assert sorted(r[0] for r in logits.select(rank.normalised_logits(F.col("x"), "k")).collect()) == [0.0, 0.5, 0.5, 1.0]


def test_selections(spark):
    rows = [(1, PAPER[0].split("\n")[1], "A title", "Abstract", None, None, ["accuracy"]), (2, "  ", None, None, None, None, None), (3, "Tiny.", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "selection_id long, selection_text string, paper_title string, section_title string, before_context string, after_context string, author_keywords array<string>")
    got = H.highlight_selections(df).orderBy("place").collect()
    assert {r.selection_id for r in got} == {1} and got[0].text.startswith("We propose") and all(0 <= r.confidence <= 1 for r in got)


def test_external_answers(spark):
    source = "We propose a novel method here. It is fine."
    answers = spark.createDataFrame([(1, '{"highlights":[{"text":"","start":0,"end":31,"reason":" claim ","confidence":0.9},{"text":"x","start":"0","end":3},{"start":3,"end":3}]}', source)], "selection_id long, json string, source string")
    got = responses.spans(answers).collect()
    assert [(r.text, r.start, r.end, r.confidence) for r in got] == [(source[:31], 0, 31, 0.9)]
    external = spark.createDataFrame([(1, "a")], "doc_id long, id string")
    local = spark.createDataFrame([(1, "b"), (2, "c")], "doc_id long, id string")
    assert sorted(map(tuple, responses.with_fallback(external, local).collect())) == [(1, "a"), (2, "c")]
    assert responses.backend("auto", " ") == "local" and responses.backend("auto", "k") == "external" and responses.backend("non-llm-only", "k") == "local"


def test_stream(spark, tmp_path, sf):
    docs = G.read_documents(spark, sf).filter("doc_id < 6")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    highlight_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(r.doc_id, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.doc_id, r.id) for r in H.highlight_documents(G.pages_of_documents(docs)).collect()}
    twice = spark.createDataFrame([("k", 1), ("k", 2)], "request_key string, n int")
    assert requests_once(twice).count() == 1


def test_headings_do_not_cross_pages(spark):
    df = papers(spark)
    rows = segment.with_sections(df.select("doc_id", "page_index", F.lit(0).alias("start")), segment.headings(df), ["doc_id", "page_index"]).collect()
    assert {(r.page_index, r.section_kind) for r in rows} == {(0, "abstract"), (1, "methods"), (2, "results")}


def test_passages_of_any_length(spark):
    """One- and two-word passages, parts of words at both ends, blanks inside."""
    texts = ["the quick brown fox jumps", "quickest browns", "x y", "", "a  b c"]
    parts = ["quick", "k brown", "ick brown fo", "x y", "the quick brown fox jumps", "a  b", "b c", "zzz", "y"]
    pages = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, page_index int, text string")
    items = spark.createDataFrame(list(enumerate(parts)), "item_id long, s string")
    got = sorted((r.doc_id, r.item_id) for r in passages.occurrences(pages, items).collect())
    assert got == sorted((i, k) for i, t in enumerate(texts) for k, p in enumerate(parts) if p in t)


def test_no_measure_is_taken_twice(spark, sf):
    """No phrase pattern stands more than once in the plan of candidates; the two of citations are counted as well."""
    plan = engine._candidates(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    for pattern, _ in (*P.POSITIVE, *P.NEGATIVE):
        assert plan.count(P.java(pattern)) == 1 + (pattern in (P.CITATION_SQUARE, P.CITATION_YEAR))


def test_ranking_shuffles_candidates_once(spark, sf):
    """Behind the candidates every exchange is by document alone, five at most; no rows are joined back."""
    size = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(size)
    spark.conf.set(size, "-1")
    try:
        pages = G.pages_of_documents(G.read_documents(spark, sf))
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (engine._candidates(spark, sf), H.highlight_documents(pages), H.highlight_documents(pages, method="tfidf"))]
        cands, *whole = [re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", p) for p in plans]
        for found in whole:
            behind = Counter(re.sub(r"#\w+", "", x) for x in found) - Counter(re.sub(r"#\w+", "", x) for x in cands)
            assert set(behind) == {"doc_id"} and behind["doc_id"] <= 5, behind
    finally:
        spark.conf.set(size, before)


def test_terms_and_queries_of_edge_rows(spark):
    from glosswork.operators import lexical

    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None)], "id long, tokens array<string>")
    assert {r.id: r.terms and [tuple(x) for x in r.terms] for r in lexical.with_terms(rows).collect()} == {1: [("a", 1), ("b", 2)], 2: [], 3: None}
    items = spark.createDataFrame([(1, "x", ["cat", "dog"]), (1, "y", []), (2, "z", ["cat"])], "doc_id long, id string, tokens array<string>")
    asked = spark.createDataFrame([(1, "Cat bird cat")], "doc_id long, query string")
    for method in ("bm25", "tfidf"):
        got = {(r.doc_id, r.id): r.lexical_score for r in lexical.lexical_scores(items, asked, method).collect()}
        assert got == {(1, "x"): 1.0, (1, "y"): 0.0, (2, "z"): 0.0}
    twice = spark.createDataFrame([(1, "x", 0.5), (1, "x", 0.7), (2, "z", 0.1)], "doc_id long, id string, score double")
    assert {(r.doc_id, r.id): r.neural_score for r in rank.usable_neural(items, twice, "doc_id", "id").collect()} == {(1, "x"): None, (1, "y"): None, (2, "z"): 0.1}
