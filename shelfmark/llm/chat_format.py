r"""Chat formatting from a declarative template by a finite-state machine over roles (DataFrame functions only).

A template is data: a header before each turn, a footer after it, the roles under the loss mask and the transitions
that the machine allows.  ``format_chat`` emits for each conversation the text segments with one loss flag each, the
whole formatted text and whether the order of the turns is valid.  ``parse_chat`` reads the turns and the text under the
mask back from the formatted text.  Both follow the template; no mark is written into the code.

Escaping: the backslash is doubled, then every occurrence of a mark (``open`` and ``close`` without white space around
them, in a role also ``sep``) gets a backslash after its first character: ``#\##``, ``<\/turn>``, ``:\ ``.  So no mark is
left inside a text or a role, wherever occurrences overlap.  Reading back drops one backslash before each character that
follows one, so any text survives, also one that looks like an escape.

Defined results: a null text or role counts as empty; turns with the same number are ordered by role, then text;
a null turn comes first; a null conv_id is one conversation; an unknown role is formatted and makes the conversation
invalid; equal rows are turns of their own; extra columns are ignored; roles and texts may have any length.  A
conversation is one value of the result, so its turns meet in one row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BACKSLASH = "\\"


@dataclass(frozen=True)
class Template:
    """Marks have two characters at least, no backslash, and no end that is also their beginning."""

    open: str = "### "
    sep: str = ": "
    close: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    final: tuple[str, ...] = ("user", "assistant")

    def __post_init__(self) -> None:
        for mark in {self.open, self.sep, self.close, self.open.strip(), self.close.strip()}:
            if len(mark) < 2 or BACKSLASH in mark or any(mark.startswith(mark[k:]) for k in range(1, len(mark)) if mark in (self.sep, self.close)):
                raise ValueError(f"not usable as a mark: {mark!r}")

    @property
    def text_marks(self) -> list[str]:
        return [self.open.strip(), self.close.strip()]


TEMPLATE = Template()


def escape(text: Column, template: Template = TEMPLATE, role: bool = False) -> Column:
    marks = template.text_marks + [template.sep] * role
    pattern = "|".join(f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in sorted(set(marks)))
    return F.regexp_replace(F.replace(text, F.lit(BACKSLASH), F.lit(BACKSLASH * 2)), pattern, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def run_machine(roles: Column, template: Template = TEMPLATE) -> Column:
    """State after all roles; 'error' once a transition is missing."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.transitions.items() for x in (f"{state}>{role}", to)])
    return F.aggregate(roles, F.lit(template.start), lambda state, role: F.coalesce(F.element_at(moves, F.concat(state, F.lit(">"), role)), F.lit("error")))


def format_chat(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted, valid."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # array_sort puts structs with a null turn first in field order; roles and texts break ties.
    trained = lambda t: t["role"].isin(*template.loss_roles)
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(F.concat(F.lit(template.open), escape(t["role"], template, role=True), F.lit(template.sep)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(t["text"], template).alias("text"), trained(t).alias("loss")),
                F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    state = run_machine(F.transform("turns", lambda t: t["role"]), template)
    out = chats.select("conv_id", segments.alias("segments"), state.isin(*template.final).alias("valid"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse_chat(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Adds turns array<struct<role, text, loss>>, read back from ``formatted`` alone."""
    chunks = F.filter(F.split("formatted", re.escape(template.close), -1), lambda x: x != "")
    bodies = F.transform(chunks, lambda c: F.substr(c, F.lit(len(template.open) + 1)))
    # The first separator ends the role, since none is left inside it.
    turns = F.transform(
        bodies,
        lambda c: F.struct(
            unescape(F.substr(c, F.lit(1), F.instr(c, F.lit(template.sep)) - 1)).alias("role"),
            unescape(F.substr(c, F.instr(c, F.lit(template.sep)) + len(template.sep))).alias("text"),
        ),
    )
    marked = F.transform("plain", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["role"].isin(*template.loss_roles).alias("loss")))
    return formatted.withColumn("plain", turns).withColumn("turns", marked).drop("plain")


def digest(parsed: DataFrame) -> DataFrame:
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    d = parsed.select("conv_id", "valid", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), learned.alias("learned"), "formatted")
    return d.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("told").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("valid"),
    )


def op8_chat_format(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    probe = r"\### Assistant: </turn> ok"
    rows = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    chats = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(rows)
    return digest(parse_chat(format_chat(chats)))


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marks AS (  -- a run of k signs # holds k - 2 marks
  SELECT *, list_sum([0] || list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)) + (length(text) - length(replace(text, '</turn>', ''))) // 7 + length(text) - length(replace(text, '\', '')) AS et,
    list_sum([0] || list_transform(regexp_extract_all(role, '#{3,}'), lambda x: length(x) - 2)) + (length(role) - length(replace(role, '</turn>', ''))) // 7 + length(role) - length(replace(role, '\', ''))
      + (length(role) - length(replace(role, ': ', ''))) // 2 AS er
  FROM c),
e AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n, lag(role) OVER w AS before
  FROM marks WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(role) + er + 2 + length(text) + et + 8)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN k = 1 THEN role IN ('system', 'user') WHEN role = 'user' THEN before IN ('system', 'assistant')
    WHEN role = 'assistant' THEN before = 'user' ELSE false END) AND max(CASE WHEN k = n THEN role END) IN ('user', 'assistant') AS valid
FROM e GROUP BY conv_id
"""
