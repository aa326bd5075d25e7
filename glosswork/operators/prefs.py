"""Preferences: normal values, default equivalence, migration of two branches, and version order."""

from __future__ import annotations

import re
from functools import cmp_to_key

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions import text as X

# Fixed: names, defaults and kinds. Prompts have texts of their own as defaults, given by the caller.
DEFAULTS = {
    "apiKey": "", "baseURL": "https://openrouter.ai/api/v1", "model": "meta-llama/llama-3.3-70b-instruct:free", "backendMode": "auto", "nonLlmLexicalMethod": "bm25",
    "systemPrompt": "", "globalSystemPrompt": "", "density": "balanced", "focusMode": "balanced", "minConfidence": "0.5", "neuralReranker": "true",
}
PROMPTS, BOOLEANS, BLANK_IS_DEFAULT = ("systemPrompt", "globalSystemPrompt"), ("neuralReranker",), ("minConfidence",)


def boolean(value: Column) -> Column:
    """"true"/"false" for the usual spellings, else null."""
    v = F.lower(X.trim(value))
    return F.when(v.isin("true", "1"), "true").when(v.isin("false", "0"), "false")


def default_equivalent(key: Column, value: Column, default: Column) -> Column:
    blank = X.trim(value) == ""
    return (
        F.when(key.isin(*PROMPTS), blank | (value == default))
        .when(key.isin(*BLANK_IS_DEFAULT) & blank, True)
        .when(key.isin(*BOOLEANS), F.coalesce(boolean(value) == default, F.lit(False)))
        .otherwise(value == default)
    )


def normal(key: Column, value: Column, default: Column) -> Column:
    """Null for a missing or default value and for an unreadable boolean."""
    return F.when(value.isNotNull() & ~default_equivalent(key, value, default), F.when(key.isin(*BOOLEANS), boolean(value)).otherwise(value))


def migrate(canonical: DataFrame, legacy: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """key, winner, value, reason for each key of two branches (key, value): values that aren't defaults win, in a conflict the legacy one."""
    names = DEFAULTS | (defaults or {})
    default = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    both = canonical.select("key", F.col("value").alias("c")).join(legacy.select("key", F.col("value").alias("l")), "key", "full").withColumn("d", F.coalesce(F.try_element_at(default, F.col("key")), F.lit("")))
    state = lambda v: F.when(v.isNull(), "missing").when(default_equivalent(F.col("key"), v, F.col("d")), "default").otherwise("set")
    rows = both.withColumns({"cs": state(F.col("c")), "ls": state(F.col("l")), "cn": normal(F.col("key"), F.col("c"), F.col("d")), "ln": normal(F.col("key"), F.col("l"), F.col("d"))})
    reason = (
        F.when(F.expr("cs = 'missing' and ls = 'missing'"), "both-missing").when(F.expr("cs = 'set' and ls <> 'set'"), "canonical-non-default").when(F.expr("ls = 'set' and cs <> 'set'"), "legacy-non-default")
        .when(F.expr("cs <> 'set' and ls <> 'set'"), "both-default-equivalent").when(F.expr("cn <=> ln"), "both-non-default-equal").otherwise("conflict-legacy-wins")
    )
    rows = rows.withColumn("reason", reason)
    winner = F.when(F.col("reason") == "both-missing", "default").when(F.col("reason").startswith("legacy") | F.col("reason").startswith("conflict"), "legacy").otherwise("canonical")
    value = F.when(winner == "legacy", F.col("ln")).when(F.col("reason").isin("canonical-non-default", "both-non-default-equal"), F.col("cn"))
    return rows.select("key", winner.alias("winner"), value.alias("value"), "reason")


def resolve(prefs: DataFrame, defaults: dict[str, str] | None = None) -> dict[str, str]:
    """The stored values over the defaults. Preferences are a handful of rows."""
    names = DEFAULTS | (defaults or {})
    known = prefs.filter(F.col("key").isin(*names)).limit(len(names))
    return names | {r["key"]: r["value"] for r in known.collect() if r["value"] is not None}


_VERSION = re.compile(r"(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?")


def parse_version(text: str) -> tuple | None:
    """A key that orders versions: releases after their pre-releases, numbers before words."""
    m = _VERSION.fullmatch(text.strip())
    if not m:
        return None
    parts = [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in m[4].split(".")] if m[4] else []
    return (*map(int, m.groups()[:3]), not parts, parts)


def compare_versions(a: str, b: str) -> int | None:
    x, y = parse_version(a), parse_version(b)
    return None if x is None or y is None else (x > y) - (x < y)


def sorted_versions(versions: list[str]) -> list[str]:
    return sorted(versions, key=cmp_to_key(lambda a, b: compare_versions(a, b) or 0))


def version_key(version: Column) -> Column:
    """STRUCT that orders versions in the JVM, null for what is no version."""
    m = r"^\s*(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\s*$"
    at = lambda k: F.regexp_extract(version, m, k)
    part = lambda p: F.struct((~p.rlike("^[0-9]+$")).cast("int").alias("word"), F.when(p.rlike("^[0-9]+$"), p.try_cast("decimal(38,0)")).alias("number"), F.when(~p.rlike("^[0-9]+$"), p).alias("name"))
    return F.when(version.rlike(m), F.struct(at(1).cast("long"), at(2).cast("long"), at(3).cast("long"), (at(4) == "").cast("int"), F.transform(F.filter(F.split(at(4), r"\."), lambda x: x != ""), part)))
