"""Worked examples of segmentation, labels, text functions and geometry."""

import re
import unicodedata
from functools import reduce

import pytest
import regex
from pyspark.sql import functions as F

from glosswork import config
from glosswork.functions import patterns as P
from glosswork.functions import scoring as S
from glosswork.functions import text as X
from glosswork.operators import align, geometry, neural, prefs, responses, segment, select
from glosswork.sources import pages as G


def frame(spark, values, name="text"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, {name} string")


def column(spark, values, make):
    return [r.out for r in frame(spark, values).select("id", make(F.col("text")).alias("out")).orderBy("id").collect()]


def test_stable_text_is_its_own_normal_form():
    stable = regex.compile(X.STABLE)
    assert all(unicodedata.normalize("NFKC", chr(c)) == chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and stable.match(chr(c)))


@pytest.mark.parametrize("text, want", [
    ("Hi!! Next one. a.b c", [(0, 4), (4, 14), (14, 20)]),
    ("x。次の文", [(0, 2), (2, 5)]),
    ("a\n- b\n\nc", [(0, 2), (2, 5), (6, 8)]),
    ("One.  \n", [(0, 4), (4, 7)]),
    ("e.g. (two) et al. 2020", [(0, 4), (4, 17), (17, 22)]),
])
def test_sentences(spark, text, want):
    pages = spark.createDataFrame([(1, 0, text)], "doc_id long, page_index int, text string")
    rows = segment.ranges(pages).orderBy("start").collect()
    assert [(r.start, r.end) for r in rows] == want and all(r.piece == text[r.start : r.end] for r in rows)


def test_long_ranges(spark):
    assert segment.split_long("a" * 30, 20) == [(0, 20)]  # the rest of ten is left out
    assert segment.split_long("word " * 10, 32) == [(0, 30), (30, 50)]
    text = "first part of it, but the second goes on; third " * 3
    parts = segment.split_long(text, 60)
    assert all(16 <= b - a <= 60 for a, b in parts) and parts[0] == (0, 41)


@pytest.mark.parametrize("line, kind", [("3. Results", None), ("3 Results", "results"), ("we trained the model on data", "methods"), ("Summary of Results", "abstract"), ("参考文献", "references"), ("Plain Title Here", "other"), ("plain title here", None), ("", None)])
def test_headings(spark, line, kind):
    pages = spark.createDataFrame([(1, 0, f"x y z\n  {line}\t\nend of page here")], "doc_id long, page_index int, text string")
    assert [r.kind for r in segment.headings(pages).collect()] == ([kind] if kind else [])


def test_tokens(spark):
    texts = ["State-of-the-art can't 5 ab", "深度学习", "ab-漢", "The results of ﬁne work", "สวัสดี ok"]
    assert column(spark, texts, lambda c: X.tokens(F.lower(X.nfkc(c)))) == [["state-of-the-art", "can't", "ab"], ["深度学习"], ["ab-", "漢"], ["fine", "work"], ["สวัสดี", "ok"]]
    assert column(spark, ["a b-c, d'", "深度学习 x", ""], lambda c: X.word_count(X.nfkc(c))) == [3, 2, 0]
    assert column(spark, ["A - b", "A  b!", "50% ﬁt"], lambda c: X.dedup_key(X.nfkc(c))) == ["a  b", "a b", "50% fit"]


def test_scores(spark):
    cases = [("We propose a novel pipeline", "other", 11.0), ("This is shown in 2020", "results", 5.0)]
    df = spark.createDataFrame(cases, "text string, kind string, want double")
    assert all(r.got == r.want for r in df.select("want", S.heuristic(F.col("text"), F.col("text"), F.col("kind")).alias("got")).collect())
    assert column(spark, ["fine-tuning helps", "x fine-tun y"], lambda c: S.reason(c, F.lit("other"))) == ["background", "method"]
    assert column(spark, ["a [1] b (Foo 2020)"], X.citations) == [2]
    assert column(spark, ["the éit thing", "it is it"], X.pronouns) == [1, 2]  # words are ASCII ones


def test_trimmed(spark):
    body, start, end = X.trimmed_range(F.col("text"), F.lit(10))
    assert [tuple(r) for r in frame(spark, ['("Abc.") ', "[x]", ' "']).select(body, start, end).collect()] == [("Abc.", 12, 16), ("x", 11, 12), ("", 12, 12)]


def test_limits():
    assert [config.density("balanced").budget(p) for p in (0, 1, 4, 50)] == [20, 20, 24, 100]
    assert config.density("?") is config.DENSITIES["balanced"] and config.section_weights("?")["results"] == 5
    assert config.lexical_method("x") == "bm25"
    assert [select.least_score(c) for c in (0, 0.5, 0.51, 1)] == [0, 5, 6, 8]


def test_greedy_choices():
    # a row that a page's cap stops does not claim its text
    assert select.shortlist_places([0, 0, 1], ["a", "b", "b"], 10, 1) == [0, 2]
    assert select.final_places([0] * 5, ["other"] * 5, list("abcde"), [3] * 5, 20, 10) == [0, 1, 2]


def test_java_patterns_keep_boundaries():
    assert "%" in P.POSITIVE[6][0] and "(?<=" in P.java(P.POSITIVE[6][0])


def test_rects():
    assert geometry.span_rects("aaaa", [[0, 0, 40, 10]], 1, 3) == [[10, 1.5, 30, 9.5]]
    assert geometry.span_rects("abcdef", [], 0, 3) == [] and geometry.span_rects("abc", [[0, 0, 1, 1]], 3, 4) == []
    two = geometry.span_rects("aaaabbbb", [[0, 20, 40, 30], [0, 0, 40, 10]], 0, 8)
    assert two == [[0, 21.5, 40, 29.5], [0, 1.5, 40, 9.5]]
    assert geometry.fixed3(1.0005) == 1.0 and geometry.fixed3(-2.0015) == -2.002
    glyphs = [{"rect": [0, 0, 5, 10]}, {"rect": [5, 0, 10, 10], "line_break_after": True}, {"rect": [0, 20, 5, 30]}]
    assert geometry.line_rects(glyphs, 0, 2) == [[0, 0, 10, 10], [0, 20, 5, 30]] and geometry.line_rects(glyphs, 0, 3) == []


def test_rect_columns(spark):
    row = spark.createDataFrame([([[0.0, 0.0, 5.0, 10.0], [14.0, 1.0, 20.0, 11.0], [30.0, 0.0, 40.0, 10.0], [0.0, 30.0, 5.0, 40.0]],)], "r array<array<double>>")
    assert row.select(geometry.merge_rects(F.col("r"))).first()[0] == [[0, 0, 20, 10], [30, 0, 40, 10], [0, 30, 5, 40]]
    one = spark.range(1)
    assert one.select(geometry.sort_index(F.lit(1), F.lit(23), F.array(F.array(F.lit(0.0), F.lit(700.9))))).first()[0] == "00001|000023|00700"
    assert one.select(geometry.fallback_sort_index(F.lit("00001|000100|00001"), F.lit(2), F.lit(5), F.array(F.array(F.lit(0.0), F.lit(3.0))))).first()[0] == "00002|000105|00003"
    assert one.select(geometry.canonical_rect(F.array(F.lit(5.0), F.lit(5.0), F.lit(1.0), F.lit(1.0)))).first()[0] == [1, 1, 5, 5]
    assert one.select(geometry.canonical_rect(F.array(F.lit(5.0), F.lit(5.0), F.lit(5.1), F.lit(9.0)))).first()[0] is None


def test_alignment():
    assert align.normalised("( a  b , c )").text == "(a b, c)"
    n = align.normalised("a  ﬁb")
    assert (n.text, n.origin, [n.of_raw(k) for k in range(6)]) == ("a fib", [0, 1, 3, 3, 4], [0, 1, 2, 2, 4, 5])
    page = "Intro text. The quick brown fox jumps over the lazy dog near the river bank today. End."
    assert align.match(page, "quick brown").mode == "exact"
    m = align.match(page, "quick  brown ( fox")
    assert m is None
    m = align.match(page, "The  quick\nbrown fox")
    assert m.mode == "normalized" and align.map_span(m, "The  quick\nbrown fox", 5, 10) == (16, 21)
    changed = "The quick brown fox jumps @@ the lazy dog near the river bank today."
    m = align.match(page, changed)
    assert m.mode == "anchored" and page[slice(*align.map_span(m, changed, 0, len(changed)))].startswith("The quick")
    assert align.map_span(m, changed, 33, 41) == (page.index("lazy dog"), page.index("lazy dog") + 8)
    assert align.best_start("ab ab ab", "ab", (5, 8)) == 6 and align.anchor_length(23) == 0 and align.anchor_length(600) == 48


def test_diffs(spark):
    diffs = F.array(*[F.struct(F.lit(a).alias("offset"), F.lit(b).alias("shift")) for a, b in ((2, -1), (5, -3))])
    assert spark.range(1).select(align.shift_at(diffs, F.lit(4)), align.shift_at(diffs, F.lit(1)), align.original_range(diffs, F.lit(1), F.lit(5))).first()[:2] == (-1, 0)
    assert align.page_diffs(align.normalised("a  b")) == [(2, -1)]
    labels = column(spark, ["12a", " 3", "0", "x", "-4"], align.page_label_index)
    assert labels == [11, 2, None, None, None]


@pytest.mark.parametrize("raw, want", [
    ("```json\n{\"a\":1}\n```", '{"a":1}'), ('{"a":1})', '{"a":1}'), ('[{"a":1}]]', '{"a":1}'), ('[{"a":1}]', '[{"a":1}]'), ('[{"a":1}', '{"a":1}'), ('x {"a":"}"} y', '{"a":"}"}'), ("text ```\n[1]\n``` more", "[1]"), ("nothing", "nothing"),
])
def test_salvage(raw, want):
    assert responses.salvage(raw) == want


def test_message_content():
    assert responses.message_content('{"choices":[{"message":{"content":" a "}}]}') == "a"
    assert responses.message_content('{"choices":[{"message":{"content":[{"text":"a"},"b",{"content":"c"}]}}]}') == "abc"
    assert responses.message_content('{"output_text":"x"}') == "x" and responses.message_content("no json") == "" and responses.message_content('{"content":[{"text":"q"}]}') == "q"


def test_retries():
    answers = iter([(500, ""), (429, ""), (200, '{"output_text":"ok"}')])
    pauses = []
    assert responses.retried(lambda: next(answers), 3, sleep=pauses.append) == "ok" and len(pauses) == 2 and 1 <= pauses[0] <= 1.5 and 2 <= pauses[1] <= 2.5
    assert responses.retried(lambda: (404, ""), 3, sleep=pauses.append) is None and len(pauses) == 2


def test_versions(spark):
    order = ["1.0.0-2", "1.0.0-10", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-beta", "1.0.0", "1.0.1", "1.2.0", "10.0.0"]
    assert prefs.sorted_versions(order[::-1]) == order and prefs.compare_versions("1.0.0+a", "1.0.0") == 0 and prefs.compare_versions("x", "1.0.0") is None
    got = [r.text for r in frame(spark, [*order[::-1], "bad"]).withColumn("k", prefs.version_key(F.col("text"))).filter("k is not null").orderBy("k").collect()]
    assert got == order


def test_word_pieces():
    vocabulary = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##able", "cafe", "漢", "!", "a", "##b"])}
    assert [neural.pieces(w, vocabulary) for w in ("unable", "cafe", "xyz", "a" * 101)] == [["un", "##able"], ["cafe"], ["[UNK]"], ["[UNK]"]]
    assert neural.basic_tokens("Café漢!\tUn") == ["cafe", "漢", "!", "un"]
    ids, mask, kinds = neural.encode_pair("a a a", "ab ab ab", vocabulary, 8)
    assert (ids, sum(mask), kinds) == ([2, 9, 9, 9, 3, 9, 10, 3], 8, [0, 0, 0, 0, 0, 1, 1, 1])


def test_sources(spark, tmp_path):
    (tmp_path / "v.txt").write_text("[PAD]\n\nab\n")
    assert sorted(map(tuple, G.vocabulary(spark, str(tmp_path / "v.txt")).collect())) == [("[PAD]", 0), ("ab", 2)]
    good = '{"modelId":"m","assetVersion":"1","releaseTag":"t","assetFileName":"f","packageDirectoryName":"p","vocabFileName":"v"}'
    assert column(spark, [good, good.replace('"1"', "1"), "{", good[:-1] + ',"pluginMinVersion":""}'], lambda c: c) and [r.valid for r in G.manifests(frame(spark, [good, good.replace('"1"', "1"), "{", good[:-1] + ',"pluginMinVersion":""}']), "text").orderBy("id").collect()] == [True, False, False, False]
    items = spark.createDataFrame([(1, 0, 0, "ab", [1.0, 0.0, 0.0, 10.0, 5.0, 100.0], 8.0, 0.0), (1, 1, 0, "x", [1.0, 0.0], 8.0, 1.0), (1, 1, 1, "y", [1.0, 0.0, 0.0, 10.0, 5.0, 100.0], 8.0, 4.0)], "doc_id long, page_index int, item_index int, str string, transform array<double>, width double, height double")
    assert [(r.char, r.rect) for r in G.item_positions(items).orderBy("unit").collect()] == [("a", [5, 97.5, 9, 107.5]), ("b", [9, 97.5, 13, 107.5])]


def test_marks_in_texts_keep_offsets(spark):
    """The characters that mark cuts count as U+FFFD, one for one, so offsets stay right."""
    from glosswork.operators import segment

    text = "Abc \ufdd0def one. Two \ufdd1\ufdd1three.\n\nFour. \ufdd0"
    rows = segment.ranges(spark.createDataFrame([(1, 0, text)], "doc_id long, page_index int, text string")).orderBy("start").collect()
    clean = text.replace("\ufdd0", "\ufffd").replace("\ufdd1", "\ufffd")
    plain = segment.ranges(spark.createDataFrame([(1, 0, clean)], "doc_id long, page_index int, text string")).orderBy("start").collect()
    assert rows == plain and rows[0].piece == clean[rows[0].start : rows[0].end] == "Abc \ufffddef one."


def test_prefix_sums_beyond_their_size(spark):
    """An array that the steps do not reach across is an error, not a wrong sum."""
    import pytest
    from pyspark.sql import functions as F

    from glosswork.functions.text import prefix_sums

    rows = spark.range(1).select(F.sequence(F.lit(1), F.lit(17)).alias("x"))
    assert rows.select(prefix_sums(F.slice("x", 1, 16), 4).alias("s")).first().s == [k * (k + 1) // 2 for k in range(16)]
    with pytest.raises(Exception, match="up to 16"):
        rows.select(prefix_sums(F.col("x"), 4)).collect()


def test_constants():
    """Fixed values, written out once more."""
    from glosswork import config
    from glosswork.functions import patterns as P

    assert [s for _, s in P.POSITIVE] == [4, 4, 3, 3, 2, 2, 2, 2] and [s for _, s in P.NEGATIVE] == [-5, -2, -1, -4, -2, -2, -4]
    assert [k for k, _ in P.SECTION_TERMS] == ["abstract", "introduction", "related-work", "methods", "results", "discussion", "conclusion", "references"]
    assert [len(t) for _, t in P.SECTION_TERMS] == [6, 8, 7, 11, 12, 12, 6, 10]
    assert [k for k, _ in P.REASONS] == ["result", "method", "caveat", "claim", "background"]
    assert len(P.STOPWORDS) == 127 and len(set(P.STOPWORDS)) == 125
    assert {n: config.density(n) for n in ("balanced", "dense", "sparse")}


def test_phrases_are_looked_for_at_once(spark, sf):
    """F4 to F15: candidates took most of their time to look for phrases one Java expression at a time."""
    from glosswork.operators import candidates

    pages = spark.createDataFrame([(1, 0, "Results\n- We propose a thing that works. It fails.")], "doc_id long, page_index int, text string")
    plan = candidates.candidates(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_telling(") == 1
    assert [r.reason for r in candidates.candidates(pages).collect()] == ["claim"]


def test_telling_as_java_finds(spark):
    """Arrow's engine gives what the patterns give in Java, in texts with other cases of k and s, marks, blanks of all kinds and no text."""
    words = ["we propose", "OUTPERFORM", "result", "reſult", "tasK k", "%", "5 %", "5 4k", "12K", "[1, 2]", "[1 2]", "(x 2020)", "(2020", "((a) 1999)", "et al.", "et al", "doi", "http://", "xhttps://", "trade-off", "tradeoff", "this it", "it they", "fig", "Figure 1", "vol. 3", "p.﻿3", "no 7", "prior work", "we", " our x", "_we_", "éwe propose", "\x85results", "", None]
    texts = words + [f"{a}{c}{b}" for a, b in zip(words, words[7:-1] + words[:8]) for c in (" ", "", "-", "\n") if a and b]
    every = [p for p, _ in (*P.POSITIVE, *P.NEGATIVE)] + [p for _, p in P.REASONS] + [P.FIRST_PERSON, P.NUMERIC, P.PRONOUNS]
    want = reduce(lambda a, b: a | b, [X.matches(F.col("text"), p) for p in every])
    rows = frame(spark, texts).select("text", S.telling(F.col("text")).alias("got"), want.alias("want")).collect()
    assert len(rows) > 100 and {r.got for r in rows} == {True, False, None} and [(r.text, r.got) for r in rows] == [(r.text, r.want) for r in rows]


def test_first_terms(spark, monkeypatch):
    """F4 to F15: only terms that may be among the first are sorted by the alphabet; arrays of several slices, ties, empty ones and nulls."""
    import pyarrow as pa

    from glosswork.operators import lexical

    rows = [["b", "a", "ö", "o", "z", "a", "zz"], [], None, ["x"], [f"t{i % 7}" for i in range(50)] + ["long"] * 7 + ["é", "e"]]
    monkeypatch.setattr(lexical, "SLICE", 5)
    likely = lexical.likely_terms(pa.array(rows, pa.list_(pa.string())), 3).to_pylist()
    assert [sorted((x["term"], x["tf"]) for x in r) for r in likely] == [[("a", 2), ("b", 1), ("o", 1), ("z", 1), ("zz", 1), ("ö", 1)], [], [], [("x", 1)], [("long", 7), ("t0", 8), *((f"t{i}", 7) for i in range(1, 7))]]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, tokens array<string>")
    got = {r.id: [(x.term, x.tf) for x in r["first"] or []] for r in lexical.with_first_terms(df, 3).collect()}
    assert got == {0: [("a", 2), ("zz", 1), ("b", 1)], 1: [], 2: [], 3: [("x", 1)], 4: [("t0", 8), ("long", 7), ("t1", 7)]}


def test_latin_texts_take_the_same_results_from_tables_of_characters(spark):
    """Text below U+0100 is looked up in other classes; counts, terms, keys and normal forms are those of the general ones."""
    every = [chr(i) for i in range(256)]
    texts = [f"a{c}b" for c in every] + [f"{c}x {c}{c} -{c}'{c}" for c in every] + ["Ça  va -\tl'été d'où 5½% « x »", " ", "", "  a\n\nb  "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("n", F.lower("t"))
    space = f"{P.SPACE}+"
    general = F.filter(F.regexp_extract_all("n", F.lit(f"({P.TOKEN})"), F.lit(1)), lambda t: (F.length(t) > 1) & ~t.isin(*P.STOPWORDS))
    old_key = X.trim(F.regexp_replace(F.regexp_replace("n", space, " "), r"[^\p{L}\p{N}% ]", ""))
    pairs = {"words": (X.word_count(F.col("t")), F.regexp_count("t", F.lit(P.TOKEN))), "tokens": (X.tokens(F.col("n")), general), "key": (X.dedup_key(F.col("t")), old_key), "blanks": (X.squeeze(F.col("t")), F.regexp_replace("t", space, " "))}
    for r in rows.select("t", X.nfkc(F.col("t")).alias("normal"), *[c.alias(f"{k}{j}") for k, both in pairs.items() for j, c in enumerate(both)]).collect():
        assert r.normal == unicodedata.normalize("NFKC", r.t)
        for k in pairs:
            assert r[f"{k}0"] == r[f"{k}1"], (k, r.t)


def test_no_pattern_is_compiled_for_a_line(spark):
    """Headings count words by a fixed pattern; splitting by one compiled it for each line."""
    pages = spark.createDataFrame([(1, 0, "2 Methods\nthe plain words\nRelated Work Of Others\nEnd of it.\nA.\u0085\nResults And More Words Than Twelve Are No Heading At All Here Now")], "doc_id long, page_index int, text string")
    found = segment.headings(pages)
    assert [r.title for r in found.orderBy("start").collect()] == ["2 Methods", "Related Work Of Others"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1, plan


def test_candidates_are_dealt_by_document_once(spark, sf):
    from glosswork import queries as engine

    plan = engine.highlights_full(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" in plan
    size = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(size)
    spark.conf.set(size, "-1")
    try:
        plan = engine.highlights_full(spark, sf)._jdf.queryExecution().executedPlan().toString()
        # Sections are joined by page; numbers of candidates follow behind the exchange by document.
        assert len(re.findall(r"Exchange hashpartitioning\(doc_id#\w+, page_index#\w+, \d+\)", plan)) <= 2
        assert len(re.findall(r"Exchange hashpartitioning\(doc_id#\w+, \d+\)", plan)) <= 5
    finally:
        spark.conf.set(size, before)
