"""Chat formatting by a role state machine and a declarative template, with DataFrame functions only.

A conversation's turns become segments of text, each with a loss flag; their concatenation is the
formatted conversation. A template gives the marks around turns, the names of roles, the roles whose
texts are trained on and the machine's transitions. Control strings inside texts are escaped so that
reading back the output gives the very turns: a backslash is doubled, each control string becomes a
backslash and a letter.

Defined results: turns go by (turn, role, text), nulls first, repeated rows repeat; null text and null
role count as empty; roles that the template does not name are written as `?` and the role, and make the
conversation invalid, as does any turn that the machine has no transition for; invalid conversations are
formatted all the same, with `valid` false and `violation`, the first such turn's place from 0 (the number
of turns if only the end is wrong). A null conv_id is a conversation of its own. A conversation is one row, as
its turns have to be held together. An empty table gives no
rows. Other columns take no part.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.functions.text import prefix_sums


@dataclass(frozen=True)
class Template:
    open: str = "### "
    named: str = ": "
    close: str = " </turn>\n"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    trained: tuple[str, ...] = ("assistant",)
    #: (state, role) pairs that may follow one another; a turn's role is the next state.
    transitions: tuple[tuple[str, str], ...] = (("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"))
    final: tuple[str, ...] = ("assistant",)
    #: Control strings and the letters that stand for them after a backslash.
    escapes: tuple[tuple[str, str], ...] = (("###", "h"), ("</turn>", "t"), (":", "c"))

    def for_text(self) -> tuple[tuple[str, str], ...]:
        return tuple(x for x in self.escapes if x[0] != ":")


def escape(text: Column, escapes: tuple[tuple[str, str], ...]) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control, letter in escapes:
        out = F.replace(out, F.lit(control), F.lit("\\" + letter))
    return out


def unescape(text: Column, escapes: tuple[tuple[str, str], ...]) -> Column:
    """Doubled backslashes, read from the left, part the text; between them a backslash begins an escape."""

    def part(x: Column) -> Column:
        for control, letter in escapes:
            x = F.replace(x, F.lit("\\" + letter), F.lit(control))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def _pick(key: Column, values: dict[str, str], otherwise: Column) -> Column:
    out = otherwise
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def format_conversations(rows: DataFrame, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, segments (array of text and loss), formatted, loss_spans (start and end of trained texts in it), valid, violation of each conversation."""
    t = template
    turns = rows.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("row"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("turns"))

    def segments(x: Column) -> Column:
        name = _pick(x["role"], t.names, F.concat(F.lit("?"), escape(x["role"], t.escapes)))
        segment = lambda body, loss: F.struct(body.alias("text"), loss.alias("loss"))
        return F.array(
            segment(F.concat(F.lit(t.open), name, F.lit(t.named)), F.lit(False)),
            segment(escape(x["text"], t.for_text()), x["role"].isin(*t.trained)),
            segment(F.lit(t.close), F.lit(False)),
        )

    allowed = F.create_map(*[F.lit(x) for a, b in t.transitions for x in (f"{a}>{b}", b)])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(s: Column, x: Column) -> Column:
        following = F.try_element_at(allowed, F.concat(s["state"], F.lit(">"), x["role"]))
        # After a wrong turn the machine goes on from that turn's role.
        bad = F.when(s["bad"].isNull() & following.isNull(), s["at"]).otherwise(s["bad"])
        return F.struct(F.coalesce(following, x["role"]).alias("state"), (s["at"] + 1).alias("at"), bad.alias("bad"))

    machine = F.aggregate("turns", start, step)
    out = grouped.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), machine.alias("machine"))
    violation = F.coalesce(F.col("machine.bad"), F.when(~F.col("machine.state").isin(*t.final), F.col("machine.at")))
    starts = prefix_sums(F.transform("segments", lambda s: F.length(s["text"])))
    spans = F.filter(F.zip_with("segments", starts, lambda s, at: F.struct(at.alias("start"), (at + F.length(s["text"])).alias("end"), s["loss"].alias("loss"))), lambda x: x["loss"])
    spans = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return out.select("conv_id", "segments", F.array_join("segments.text", "").alias("formatted"), spans.alias("loss_spans"), violation.isNull().alias("valid"), violation.alias("violation"))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns, structs of role and text, of a formatted conversation."""
    t = template
    parts = F.split(formatted, r"\Q" + t.close + r"\E", -1)

    def turn(part: Column) -> Column:
        name = F.substring_index(F.substr(part, F.lit(len(t.open) + 1)), t.named, 1)
        text = F.substr(part, F.length(name) + F.lit(len(t.open) + len(t.named) + 1))
        other = unescape(F.substr(name, F.lit(2)), t.escapes)
        return F.struct(_pick(name, {v: k for k, v in t.names.items()}, other).alias("role"), unescape(text, t.for_text()).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def trained_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template.for_text())), "")


def read_trained(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, read back from a formatted conversation and its spans."""
    return F.array_join(F.transform(spans, lambda x: unescape(F.substr(formatted, x["start"] + 1, x["end"] - x["start"]), template.for_text())), "")


def digests(rows: DataFrame, template: Template = Template()) -> DataFrame:
    out = format_conversations(rows, template).withColumn("read", read_turns(F.col("formatted"), template)).withColumn("trained", read_trained(F.col("formatted"), F.col("loss_spans"), template))
    newline = F.lit("\n")
    return out.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("read", lambda x: F.concat(x["role"], newline, x["text"], newline)), ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "violation",
    )


CONTROL = "\\### Assistant: </turn> ok"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    return digests(rows.unionByName(planted))


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 'start') AS before FROM c
), o AS (
  SELECT *, (before || '>' || role) IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS fits,
    length('### ' || CASE WHEN role IN ('system', 'user', 'assistant') THEN role
      ELSE '?' || replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c') END || ': '
      || replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t') || ' </turn>' || chr(10)) AS chars FROM n
), g AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(chars) AS formatted_chars, min(pos) FILTER (WHERE NOT fits) AS bad, arg_max(role, pos) AS final FROM o GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, CAST(loss_chars AS BIGINT) AS loss_chars, loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars,
  bad IS NULL AND final = 'assistant' AS valid, CAST(coalesce(bad, CASE WHEN final <> 'assistant' THEN n_turns END) AS INTEGER) AS violation
FROM g
"""
