from pyspark.sql import functions as F

from glosswork.functions import patterns as P
from glosswork.functions import text as X
from glosswork.operators import annotations, segment


def test_rects_without_rows_of_characters(spark):
    """Rects made in a highlight's own row equal those of gathered positions; ends beyond the page and empty spans."""
    pages = spark.createDataFrame([(1, 0, "abcdefgh" * 30), (1, 1, "ab"), (2, 0, "")], "doc_id long, page_index int, text string")
    spans = [(1, 0, "a", 3, 9), (1, 0, "b", 70, 175), (1, 0, "c", 5, 5), (1, 1, "d", 1, 40), (1, 1, "e", 7, 9), (2, 0, "f", 0, 3)]
    rows = spark.createDataFrame(spans, "doc_id long, page_index int, id string, start int, end int")

    def glyph(at):
        x, y = (at % 80) * 6.0, 700.0 - F.floor(at / 80) * 14.0
        return F.array(x, y, x + 6.0, y + 10.0)

    made = annotations.with_rects(rows, pages, lambda places: F.transform(places, glyph))
    cut = pages.select("doc_id", "page_index", F.posexplode(F.filter(F.split("text", ""), lambda c: c != "")).alias("at", "c"))
    gathered = annotations.char_rects(rows, cut.select("doc_id", "page_index", "at", glyph(F.col("at")).alias("rect")))
    listed = lambda df: {r.id: r.rects for r in df.collect()}
    assert listed(made) == listed(gathered)
    assert listed(made)["a"] == [[18.0, 700.0, 54.0, 710.0]] and len(listed(made)["b"]) == 3 and listed(made)["f"] == []
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("Join") == 1


def test_trimmed_ends(spark):
    """Only the ends are trimmed, of all white space that counts; a next-line mark is none."""
    rows = spark.createDataFrame([(c, f"{c}a{c} b{c}{c}") for c in P.SPACE_CHARS], "c string, t string")
    assert all(r.x == f"a{r.c} b" and r.filled for r in rows.select("c", X.trim(F.col("t")).alias("x"), X.filled(F.col("t")).alias("filled")).collect())
    odd = spark.createDataFrame([("a \x85",), ("",), (" 　\n",)], "t string").select(X.trim(F.col("t")).alias("x"), X.filled(F.col("t")).alias("f")).collect()
    assert [(r.x, r.f) for r in odd] == [("a \x85", True), ("", False), ("", False)]


def test_plans_of_prefix_sums_stay_small(spark):
    """The steps are one fold, not as many nested expressions."""
    rows = spark.range(1).select(F.sequence(F.lit(1), F.lit(1000)).alias("x")).select(X.prefix_sums(F.col("x")).alias("s"))
    assert rows.first().s == [k * (k + 1) // 2 for k in range(1000)]
    assert len(rows._jdf.queryExecution().analyzed().toString()) < 4_000


def test_boundaries_and_first_letters(spark):
    """Cuts follow the same characters in texts of ASCII and others; look-aheads change no match."""
    import re

    texts = ["One. Two!  Three? four.", "e.g. a.b. C", "x\n- y\n* z\n9", "end. \n\n", "一。二！ 三；x", "é. Ok! 」。「"]
    old = rf"(?<=[{P.ASCII_END}])(?={P.SPACE}+[{P.SENTENCE_START}]|{P.SPACE}*\z)|(?<=[{P.CJK_END}])(?={P.SPACE}*[{P.SENTENCE_START}]|{P.SPACE}*\z)|(?<=\n)(?=[-*0-9])"
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select(F.split(F.regexp_replace(F.regexp_replace("t", old, segment.CUT), rf"\n(?={segment.CUT}?\n)", segment.CUT + segment.DROP), segment.CUT, -1).alias("a"), segment._pieces(F.col("t")).alias("b")).collect():
        assert r.a == r.b
    for pattern in [p for p, _ in (*P.POSITIVE, *P.NEGATIVE)] + [p for _, p in P.REASONS] + [P.PRONOUNS, P.NUMERIC, P.REFERENCE_PAGES, P.FIRST_PERSON]:
        made = P.java(pattern)
        ahead = P._first(pattern) if pattern.startswith(r"\b") else ""
        plain = made.replace(ahead, "", 1)
        words = sorted({w for w in re.findall(r"[A-Za-z0-9%-]+", pattern)})
        tried = spark.createDataFrame([(s,) for w in words for s in (w, f"a {w.upper()} b", f"x{w}", f"{w}y", f"[{w}]", f"5{w} 12")], "s string")
        a, b = F.col("s").rlike(made), F.col("s").rlike(plain)
        assert tried.filter((a != b) | (F.regexp_count("s", F.lit(made)) != F.regexp_count("s", F.lit(plain)))).count() == 0
    assert P._first(r"\b(result|yield(?:s|ed)?|f1|%)\b") == "(?=[%fry])" and P._first(r"\bdoi\b|https?") == "" and P._first(r"\b(a|[bc])\b") == ""
