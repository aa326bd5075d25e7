"""Prompts for and answers from an external scorer: message content, JSON salvage, coercion, and fallback.

No service is called here; a client is a function of a prompt and can be swapped for a stub.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from random import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.functions import text as X

HARD_LIMIT = 150
# Fixed texts of the prompts.
FOCUS = {
    "results-first": "\nFOCUS ADJUSTMENT\nGive extra weight to results, evidence, and quantitative outcomes when applying the rubric.",
    "methods-first": "\nFOCUS ADJUSTMENT\nGive extra weight to method details, design decisions, and technical contributions when applying the rubric.",
    "caveats-first": "\nFOCUS ADJUSTMENT\nGive extra weight to limitations, caveats, failure cases, and scope boundaries when applying the rubric.",
}
SELECTION_RULES = (
    "Rules: spans must stay strictly inside selection_text, be self-contained, avoid long blocks, and may return none.",
    'Return JSON only: {"highlights":[{"text":"exact substring","start":0,"end":10,"reason":"claim|result|method|caveat|background","confidence":0.0}]}.',
)
RANKING_HEAD = (
    "Select the best highlights from these candidates according to the rubric.",
    'Return JSON only: {"selections":[{"id":"P1-C1","reason":"method"}]}',
    "Candidates:",
)


def _or(value: Column, otherwise: str) -> Column:
    trimmed = X.trim(F.coalesce(value, F.lit("")))
    return F.when(trimmed != "", trimmed).otherwise(F.lit(otherwise))


def selection_prompt(paper_title: Column, section_title: Column, before: Column, selection: Column, after: Column, most: int = 3) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    return F.concat_ws(
        "\n", line("paper_title", _or(paper_title, "unknown")), line("section_title", _or(section_title, "unknown")), line("before_context", _or(before, "")),
        line("selection_text", selection), line("after_context", _or(after, "")), F.lit(f"Task: return up to {most} short worth-reading spans from selection_text only."), *map(F.lit, SELECTION_RULES),
    )


def json_string(text: Column) -> Column:
    """The text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def candidate_line(identifier: Column, page: Column, title: Column, kind: Column, score: Column, text: Column) -> Column:
    number = F.when(score == F.floor(score), score.cast("long").cast("string")).otherwise(score.cast("string"))
    section = F.when(F.length(title) > 0, title).otherwise(kind)
    return F.concat(identifier, F.lit(" | page="), (page + 1).cast("string"), F.lit(" | section="), section, F.lit(" | score="), number, F.lit(" | text="), json_string(text))


def ranking_prompts(short: DataFrame, titles: DataFrame | None = None, budgets: DataFrame | None = None, most: int = 20) -> DataFrame:
    """doc_id, prompt listing a shortlist's first candidates (rank up to the hard limit)."""
    lines = short.filter(F.col("rank") <= HARD_LIMIT).withColumn("line", candidate_line(F.col("id"), F.col("page_index"), F.col("section_title"), F.col("section_kind"), F.col("heuristic_score"), F.col("text")))
    out = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    out = out.join(titles.select("doc_id", "title"), "doc_id", "left") if titles is not None else out.withColumn("title", F.lit(None).cast("string"))
    out = out.join(budgets.select("doc_id", "budget"), "doc_id", "left") if budgets is not None else out.withColumn("budget", F.lit(most))
    head = F.concat_ws("\n", F.concat(F.lit("paper_title: "), _or(F.col("title"), "unknown")), F.concat(F.lit("selection_budget: up to "), F.coalesce("budget", F.lit(most)).cast("string")), *map(F.lit, RANKING_HEAD))
    return out.select("doc_id", F.concat(head, F.lit("\n"), F.col("lines")).alias("prompt"))


def system_prompt(default: str, override: Column, focus: str = "balanced") -> Column:
    return F.when((X.trim(F.coalesce(override, F.lit(""))) != "") & (override != default), override).otherwise(F.lit(default + FOCUS.get(focus, "")))


def _part(part: object) -> str:
    if isinstance(part, str):
        return part
    for key in ("text", "content"):
        if isinstance(part, dict) and isinstance(part.get(key), str):
            return part[key]
    return ""


def message_content(response: str | None) -> str:
    """The text of a chat response, whichever of the usual shapes it has."""
    try:
        body = json.loads(response or "")
    except ValueError:
        return ""
    body = body if isinstance(body, dict) else {}
    choices = body.get("choices")
    choice = choices[0] if isinstance(choices, list) and choices and isinstance(choices[0], dict) else {}
    message = choice.get("message") if isinstance(choice.get("message"), dict) else {}
    direct = next((x for x in (message.get("content"), choice.get("text"), body.get("output_text")) if x is not None), None)
    if isinstance(direct, str):
        return direct.strip()
    if isinstance(direct, list):
        return "".join(map(_part, direct)).strip()
    if isinstance(direct, dict) and _part(direct):
        return _part(direct).strip()
    other = next((x for x in (message.get("tool_calls"), message.get("parts"), body.get("content")) if x is not None), None)
    return "".join(map(_part, other)).strip() if isinstance(other, list) else ""


_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]|"', re.DOTALL)
_CLOSES = {"}": "{", "]": "["}


def balanced_end(text: str, start: int = 0) -> int | None:
    """Where the JSON value that opens at start is closed."""
    if text[start : start + 1] not in ("{", "["):
        return None
    open_: list[str] = []
    for m in _TOKENS.finditer(text, start):
        token = m[0]
        if token == '"':
            return None  # a string that never ends
        if token in "{[":
            open_.append(token)
        elif token in _CLOSES:
            if open_.pop() != _CLOSES[token]:
                return None
            if not open_:
                return m.end()
    return None


def _value(text: str) -> str | None:
    """A leading JSON value with nothing but blanks and closing brackets behind it; of a one-element list with too many brackets, the element."""
    end = balanced_end(text)
    if end is not None and not text[end:].strip(" \t\n\r\v\f)"):
        return text[:end]
    inner = re.match(r"\[[ \n\r\t]*(?=[{\[])", text)
    if inner and (end := balanced_end(text, inner.end())) is not None and not text[end:].strip(" \t\n\r\v\f]"):
        return text[inner.end() : end]
    return text if text[:1] in ("{", "[") else None


def salvage(raw: str | None) -> str:
    """The JSON in an answer that may stand in a fence or among prose."""
    text = (raw or "").strip()
    bare = text.removeprefix("```json") if text.startswith("```json") else text.removeprefix("```")
    for candidate in (text, bare.removesuffix("```").strip()):
        if (found := _value(candidate)) is not None:
            return found
    if fence := re.search(r"```(?:json)?\s*\n?(.*?)\n?\s*```", text, re.DOTALL):
        inside = fence[1].strip()
        return _value(inside) or inside
    first, last = text.find("{"), text.rfind("}")
    return text[first : last + 1] if 0 <= first < last else text


@F.pandas_udf(T.StringType())
def message_content_column(raw: pd.Series) -> pd.Series:
    return raw.map(message_content)


@F.pandas_udf(T.StringType())
def salvage_column(raw: pd.Series) -> pd.Series:
    return raw.map(salvage)


def selections(answers: DataFrame, valid: DataFrame) -> DataFrame:
    """doc_id, id, reason, rank of JSON answers (doc_id, json): selections before selectedIds, known ids only, the first of each."""
    v = F.try_parse_json(F.col("json"))
    rich, plain = F.try_variant_get(v, "$.selections", "array<variant>"), F.try_variant_get(v, "$.selectedIds", "array<variant>")
    kind = lambda x, path: F.schema_of_variant(F.try_variant_get(x, path, "variant")) == "STRING"
    get = lambda x, path: F.when(kind(x, path), F.try_variant_get(x, path, "string"))
    entries = F.when(rich.isNotNull(), F.transform(rich, lambda x: F.struct(get(x, "$.id").alias("id"), X.trim(get(x, "$.reason")).alias("reason")))).otherwise(
        F.transform(plain, lambda x: F.struct(get(x, "$").alias("id"), F.lit("").alias("reason")))
    )
    rows = answers.select("doc_id", F.posexplode(entries).alias("rank", "x")).select("doc_id", "rank", "x.id", "x.reason").filter("id is not null").join(valid.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_semi")
    return rows.groupBy("doc_id", "id").agg(F.min(F.struct("rank", "reason")).alias("s")).select("doc_id", "id", "s.reason", "s.rank")


SPANS = "struct<highlights:array<struct<text:string,start:double,end:double,reason:string,confidence:double>>>"


def spans(answers: DataFrame) -> DataFrame:
    """selection_id, rank, text, start, end, reason, confidence of JSON answers (selection_id, json, source); blank texts are filled from the source."""
    v = F.try_parse_json(F.col("json"))
    kind = lambda x, path: F.schema_of_variant(F.try_variant_get(x, path, "variant"))
    number = lambda x, path: F.when(kind(x, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), F.try_variant_get(x, path, "double"))
    string = lambda x, path: F.when(kind(x, path) == "STRING", F.try_variant_get(x, path, "string"))
    entry = lambda x: F.struct(string(x, "$.text").alias("text"), number(x, "$.start").cast("int").alias("start"), number(x, "$.end").cast("int").alias("end"), string(x, "$.reason").alias("reason"), number(x, "$.confidence").alias("confidence"))
    rows = answers.select("selection_id", "source", F.posexplode(F.transform(F.try_variant_get(v, "$.highlights", "array<variant>"), entry)).alias("rank", "x")).select("selection_id", "source", "rank", "x.*")
    low = F.greatest(F.lit(0), F.least("start", F.length("source")))
    high = F.greatest(low, F.least("end", F.length("source")))
    filled = F.when(X.trim(F.coalesce("text", F.lit(""))) != "", F.col("text")).otherwise(F.substr(F.col("source"), low + 1, high - low))
    return rows.filter("start is not null and end is not null").withColumn("text", filled).filter(X.trim(F.col("text")) != "")


def retried(call: Callable[[], tuple[int, str]], attempts: int = 3, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The body of a call (status, body), tried again after 429 and 5xx with growing pauses; None where that fails."""
    for k in range(attempts):
        status, body = call()
        if status < 400:
            return message_content(body) or None
        if status != 429 and status < 500:
            return None
        if k + 1 < attempts:
            sleep(base * 2**k + random() * 0.5)
    return None


def backend(mode: str, api_key: str | None) -> str:
    """Which scorer a policy means: "local", or "external" with the local one to fall back on."""
    return "local" if mode == "non-llm-only" or not (api_key or "").strip() else "external"


def with_fallback(external: DataFrame, local: DataFrame, key: str = "doc_id") -> DataFrame:
    """The external rows of keys that have any, the local ones of the others."""
    return external.unionByName(local.join(external.select(key).distinct(), key, "left_anti"))
