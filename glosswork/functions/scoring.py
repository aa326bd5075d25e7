"""Scores and labels of candidates as columns."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork import config
from glosswork.functions import patterns as P
from glosswork.functions import text as X


def _choose(key: Column, values: dict, otherwise: Column) -> Column:
    """A CASE over equal keys."""
    out = otherwise
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def section_weight(kind: Column, focus: str = "balanced") -> Column:
    return _choose(kind, config.section_weights(focus), F.lit(None).cast("int"))


_ANY = "|".join(P.either_case(p) for p in (*[p for p, _ in (*P.POSITIVE, *P.NEGATIVE)], *[p for _, p in P.REASONS], P.FIRST_PERSON, P.NUMERIC, P.PRONOUNS))


def _telling(texts: pa.Array) -> pa.Array:
    return pc.match_substring_regex(texts, _ANY)


def telling(text: Column) -> Column:
    """Whether any pattern of scores or reasons is in a text. Arrow looks for all of them at once, so that the few texts that have one are all that is held against each."""
    return F.arrow_udf(_telling, "boolean")(text)


def phrase_score(text: Column, words: Column, citations: Column, reference: Column, told: Column | None = None) -> Column:
    """What phrases and corrections add to a candidate's score in sections other than the references."""
    hit = lambda test, delta: F.when(test, delta).otherwise(0)
    found = [hit(X.matches(text, p), d) for p, d in (*P.POSITIVE, *P.NEGATIVE)]
    found += [hit(X.matches(text, P.FIRST_PERSON), 1), hit(X.matches(text, P.NUMERIC), 1), hit(X.pronouns(text) >= 2, -2)]
    parts = found if told is None else [hit(told, reduce(lambda a, b: a + b, found))]
    parts += [
        hit(reference, -12),
        hit(words > 30, -3),
        hit(words > 22, -1),
        hit(~text.rlike(r"[\p{L}\p{N}]"), -3),
        hit(citations >= 2, -3),
    ]
    return reduce(lambda a, b: a + b, parts)


def section_score(kind: Column, reference: Column, focus: str = "balanced") -> Column:
    """What the section adds; in the references each text counts as a reference, once."""
    return section_weight(kind, focus) + F.when((kind == "references") & ~reference, -12).otherwise(0)


def heuristic(text: Column, normal: Column, kind: Column, focus: str = "balanced") -> Column:
    """Section weight, phrase scores and corrections of a candidate."""
    found = X.citations(text)
    reference = X.reference_like(text, found)
    return (section_score(kind, reference, focus) + phrase_score(text, X.word_count(normal), found, reference)).cast("double")


def with_phrases(rows: DataFrame) -> DataFrame:
    """rows (text, normal) with phrases, reference and told, from which the score in any section follows; each measure is taken once."""
    measured = [c for c in ("words", "citations") if c not in rows.columns]
    of = {"words": lambda: X.word_count(F.col("normal")), "citations": lambda: X.citations(F.col("text"))}
    rows = X.bound(rows, **{c: of[c]() for c in measured}) if measured else rows
    rows = X.bound(rows, reference=X.reference_like(F.col("text"), F.col("citations")))
    rows = X.bound(rows, told=telling(F.col("text")))
    return X.bound(rows, phrases=phrase_score(F.col("text"), F.col("words"), F.col("citations"), F.col("reference"), F.col("told")))


def heuristic_of(kind: Column, focus: str = "balanced") -> Column:
    """The score of rows of with_phrases()."""
    return (section_score(kind, F.col("reference"), focus) + F.col("phrases")).cast("double")


def reason(text: Column, kind: Column, told: Column | None = None) -> Column:
    """The first kind of phrase that occurs, else what the section suggests."""
    suggested = out = _choose(kind, P.SECTION_REASONS, F.lit("background"))
    for name, pattern in reversed(P.REASONS):
        out = F.when(X.matches(text, pattern), name).otherwise(out)
    return out if told is None else F.when(told, out).otherwise(suggested)


# How much a reason gains in its own sections.
ALIGNMENT = {
    "result": (("results", "abstract"), 0.06),
    "method": (("methods",), 0.06),
    "caveat": (("discussion", "conclusion"), 0.05),
    "claim": (("abstract", "introduction", "conclusion"), 0.04),
    "background": (("introduction",), 0.03),
}


def alignment_bonus(why: Column, kind: Column) -> Column:
    out = F.lit(0.0)
    for name, (kinds, bonus) in ALIGNMENT.items():
        out = F.when((why == name) & kind.isin(*kinds), bonus).otherwise(out)
    return out


def section_cap(kind: Column, budget: Column) -> Column:
    share = lambda least, part: F.greatest(F.lit(least), F.ceil(budget * F.lit(part))).cast("int")
    return (
        F.when(kind == "results", share(2, 0.35)).when(kind == "methods", share(1, 0.25))
        .when(kind.isin("discussion", "abstract"), share(1, 0.2)).when(kind == "references", 0).otherwise(share(1, 0.15))
    )


# Colours by what a reason contains, first match first.
COLOURS = (("method", "#2ea8e5"), ("background", "#5fb236"), ("claim", "#ffd400"), ("result", "#ff6666"), ("caveat", "#f9a942"))
DEFAULT_COLOUR = "#ffd400"


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def document_blend(h: Column, lexical: Column, neural: Column, bonus: Column) -> Column:
    return F.when(neural.isNull(), h * 0.68 + lexical * 0.32 + bonus).otherwise(h * 0.30 + lexical * 0.10 + neural * 0.60 + bonus)


def selection_blend(h: Column, lexical: Column, neural: Column) -> Column:
    return F.when(neural.isNull(), h * 0.72 + lexical * 0.28).otherwise(h * 0.40 + lexical * 0.10 + neural * 0.50)


def colour(why: Column) -> Column:
    out = F.lit(DEFAULT_COLOUR)
    for part, value in reversed(COLOURS):
        out = F.when(F.contains(F.lower(F.coalesce(why, F.lit(""))), F.lit(part)), value).otherwise(out)
    return out


def comment(why: Column, section_title: Column | None = None) -> Column:
    """[reason], else [section title] where one is given, else nothing."""
    of = lambda x: F.when(F.length(x) > 0, F.concat(F.lit("["), x, F.lit("]")))
    return F.coalesce(of(why), *([] if section_title is None else [of(section_title)]), F.lit(""))
