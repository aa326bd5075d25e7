"""Text functions as columns: white space, words, tokens, keys, citations and readability.

All run in the JVM but nfkc(), which hands only texts to Python that compatibility normalisation may change.
Offsets and lengths count code points.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.functions import patterns as P

#: Text of these characters alone is its own NFKC form, composed letters of Latin scripts included.
STABLE = (
    r"^[\x00-\x9F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E"
    r"\u2010\u2012-\u2016\u2018\u2019\u201C\u201D\u2020-\u2022\u20AC\u3001-\u3029\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF]*$"
)
#: A character that is none of the stable ones below U+0100.
UNSTABLE_LATIN = f"[^{P.singles(''.join(c for c in P.LATIN if re.match(STABLE, c)))}]"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def ascii_only(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def latin_only(text: Column) -> Column:
    """Whether no character is above U+00FF; most texts are told by their length."""
    return ascii_only(text) | ~text.rlike(r"[^\x00-\xff]")


def bound(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once a row: the optimiser copies a projection's expressions into each use of them, but not through a generator."""
    own = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.explode(F.array(own)).alias("__bound")).select(*kept, *[F.col(f"__bound.{name}").alias(name) for name in columns])


def nfkc(text: Column) -> Column:
    """Compatibility normal form; stable text does not leave the JVM as more than a null."""
    stable = ascii_only(text) | ~text.rlike(UNSTABLE_LATIN) | text.rlike(STABLE)
    return F.when(stable, text).otherwise(_nfkc(F.when(~stable, text)))


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return text.rlike(P.java(pattern, ignore_case))


def trim(text: Column) -> Column:
    """Without white space at its ends; only these are looked at."""
    return F.trim(text, F.lit(P.SPACE_CHARS))


def filled(text: Column) -> Column:
    """Whether anything but white space is in a text; null for null."""
    return text.rlike(f"[^{P.SPACES}]")


def squeeze(text: Column) -> Column:
    # In most texts nothing is replaced: a blank alone stays.
    return F.when(latin_only(text), F.regexp_replace(text, P.LATIN_BLANKS, " ")).otherwise(F.regexp_replace(text, f"{P.SPACE}+", " "))


def word_count(normal: Column) -> Column:
    """Of text in NFKC."""
    return F.when(latin_only(normal), F.regexp_count(normal, F.lit(P.LATIN_TOKEN))).otherwise(F.regexp_count(normal, F.lit(P.TOKEN)))


def tokens(normal: Column) -> Column:
    """Terms of lower-cased NFKC text: runs of scripts without blanks as they are, words of two and more letters that are no stop words."""
    word = lambda t: (F.length(t) > 1) & ~t.isin(*P.STOPWORDS)
    plain = F.filter(F.regexp_extract_all(normal, F.lit(f"({P.LATIN_TOKEN})"), F.lit(1)), word)
    every = F.filter(F.regexp_extract_all(normal, F.lit(f"({P.TOKEN})"), F.lit(1)), lambda t: word(t) | (~ascii_only(t) & t.rlike(f"^(?:{P.RUN})$")))
    return F.when(latin_only(normal), plain).otherwise(every)


def dedup_key(normal: Column) -> Column:
    """Of text in NFKC; two blanks may stay where a mark stood between them."""
    latin = F.regexp_replace(F.regexp_replace(F.lower(normal), P.LATIN_BLANKS, " "), P.LATIN_MARKS, "")
    every = F.regexp_replace(F.regexp_replace(F.lower(normal), f"{P.SPACE}+", " "), r"[^\p{L}\p{N}% ]+", "")
    return F.trim(F.when(latin_only(normal), latin).otherwise(every))


def citations(text: Column) -> Column:
    return F.regexp_count(text, F.lit(P.java(P.CITATION_SQUARE))) + F.regexp_count(text, F.lit(P.java(P.CITATION_YEAR)))


def pronouns(text: Column) -> Column:
    return F.regexp_count(text, F.lit(P.java(P.PRONOUNS)))


def reference_like(text: Column, found: Column | None = None) -> Column:
    """Of text and its number of citations."""
    trimmed, found = trim(text), citations(text) if found is None else found
    heading = trimmed.rlike("(?iu)" + P.REFERENCE_HEADING)
    return heading | ((found >= 1) & (matches(trimmed, P.REFERENCE_ENTRY, False) | matches(text, P.REFERENCE_PAGES)))


def readable(text: Column, normal: Column, min_chars: int, max_chars: int, max_words: int) -> Column:
    """The quality filter of a candidate; cheap tests first."""
    size = F.length(trim(text))
    return (
        size.between(max(1, min_chars), max_chars)
        & text.rlike(r"[\p{L}\p{N}]")
        & (word_count(normal) <= max_words)
        & ~matches(trim(text), P.CAPTION)
        & (citations(text) < 2)
        & ~reference_like(text)
    )


def readable_rows(rows: DataFrame, min_chars: int, max_chars: int, max_words: int) -> DataFrame:
    """The rows whose text passes the same filter, with normal, words and citations. Text is trimmed already, and each measure is taken once."""
    text = F.col("text")
    rows = rows.filter(F.length(text).between(max(1, min_chars), max_chars) & text.rlike(r"[\p{L}\p{N}]") & ~matches(text, P.CAPTION))
    rows = bound(rows, citations=citations(text)).filter("citations < 2")
    heading = F.length(text).between(2, 32) & text.rlike("(?iu)" + P.REFERENCE_HEADING)
    rows = rows.filter(~heading & ~((F.col("citations") >= 1) & (matches(text, P.REFERENCE_ENTRY, False) | matches(text, P.REFERENCE_PAGES))))
    rows = bound(rows, normal=nfkc(text))
    return bound(rows, words=word_count(F.col("normal"))).filter(F.col("words") <= max_words)


def trimmed_rows(rows: DataFrame) -> DataFrame:
    """Ranges (piece, start) as text, start, end without outer blanks, quotes and brackets; opening ones in front, closing ones behind."""
    rows = bound(rows, front=F.ltrim("piece", F.lit(P.SPACE_CHARS + P.OPENING)))
    rows = bound(rows, text=F.rtrim("front", F.lit(P.SPACE_CHARS + P.CLOSING))).filter("text <> ''")
    begin = F.col("start") + F.length("piece") - F.length("front")
    kept = [c for c in rows.columns if c not in ("piece", "start", "end", "front", "text")]
    return rows.select(*kept, "text", begin.cast("int").alias("start"), (begin + F.length("text")).cast("int").alias("end"))


def prefix_sums(numbers: Column, steps: int = 24) -> Column:
    """For each element of an array of integers the sum of those before it, in doubling steps; more than 2**24 elements are an error."""

    most = 1 << steps

    def step(v: Column, k: Column) -> Column:
        d = F.call_function("shiftleft", F.lit(1), k)
        summed = F.transform(v, lambda x, i: x + F.when(i >= d, F.get(v, i - d)).otherwise(0))
        return F.when(F.size(v) > d, summed).otherwise(v)

    out = F.concat(F.array(F.lit(0)), F.slice(numbers, F.lit(1), F.greatest(F.size(numbers) - 1, F.lit(0))))
    # One fold over the steps: written out, the nested steps took the planner seconds.
    summed = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), out, step)
    return F.when(F.size(numbers) > most, F.raise_error(F.lit(f"prefix_sums takes up to {most} elements")).cast("array<int>")).otherwise(summed)


def trimmed_range(text: Column, start: Column) -> tuple[Column, Column, Column]:
    """Text, start and end without outer blanks, quotes and brackets; opening ones in front, closing ones behind."""
    front = F.ltrim(text, F.lit(P.SPACE_CHARS + P.OPENING))
    body = F.rtrim(front, F.lit(P.SPACE_CHARS + P.CLOSING))
    begin = start + F.length(text) - F.length(front)
    return body, begin.cast("int"), (begin + F.length(body)).cast("int")


def sha256(text: Column) -> Column:
    """Lower-case hex digest of a text in UTF-8."""
    return F.sha2(text.cast("binary"), 256)
