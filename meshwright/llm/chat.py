"""Chat formatting by a finite-state machine over roles.

A template is plain data: the marks around a turn, the roles that carry loss,
the machine's transitions and the control strings. Turns become segments of
text with a loss flag; joined, the segments are the formatted conversation.
Everything is DataFrame expressions.

Inside texts and roles a control string gets a backslash after its first
character, one more for each that is there already, so no raw control string is
left and every text can be read back. ``parsed`` does that from the formatted
string alone.

Null roles and texts are empty; very long texts are formatted whole. Turns are
ordered by number, null first, then role, then text; repeated rows are turns of
their own. A conversation is one row, so one task holds its turns; rows without a
conv_id belong to none, and each is a conversation of its own. A role the machine
does not know makes a conversation invalid but is formatted all the same. An
empty table gives no rows. Further columns, whatever their names, are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    """A declarative chat template."""

    before_role: str = "<|im_start|>"
    after_role: str = "<|im_sep|>"
    after_text: str = "<|im_end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; a conversation must end in one of ``final``
    start: str = "start"
    transitions: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "ready", "user": "asked"},
        "ready": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    final: tuple[str, ...] = ("answered",)
    control: tuple[str, ...] = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    def __post_init__(self) -> None:
        marks = (self.before_role, self.after_role, self.after_text)
        if len(set(marks)) < 3 or not set(marks) <= set(self.control) or any(len(c) < 2 or "\\" in c for c in self.control):
            raise ValueError("the three marks must differ and be control strings of two characters or more without a backslash")
        for c in self.control:
            if any(c[-k:] == d[:k] for d in self.control for k in range(1, min(len(c), len(d)))):
                raise ValueError(f"{c!r} ends as a control string begins; texts next to marks could not be read back")


def java_quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", text)


def escaped(text: Column, t: Template) -> Column:
    """One more backslash after the first character of every control string, escaped or not."""
    for first in dict.fromkeys(c[0] for c in t.control):
        rest = "|".join(java_quoted(c[1:]) for c in t.control if c[0] == first)
        text = F.regexp_replace(text, F.lit(f"{java_quoted(first)}(\\\\*)(?={rest})"), F.lit(f"{java_quoted(first)}\\\\$1"))
    return text


def unescaped(text: Column, t: Template) -> Column:
    for first in dict.fromkeys(c[0] for c in t.control):
        rest = "|".join(java_quoted(c[1:]) for c in t.control if c[0] == first)
        text = F.regexp_replace(text, F.lit(f"{java_quoted(first)}\\\\(\\\\*)(?={rest})"), F.lit(f"{java_quoted(first)}$1"))
    return text


def valid(roles: Column, t: Template) -> Column:
    """Whether the machine takes the roles in order and stops in a final state."""
    steps = F.create_map(*(F.lit(x) for state, row in t.transitions.items() for role, to in row.items() for x in (f"{state}\n{role}", to)))
    last = F.aggregate(roles, F.lit(t.start), lambda state, role: F.coalesce(F.try_element_at(steps, F.concat(state, F.lit("\n"), role)), F.lit("")))
    return last.isin(*t.final)


def formatted(turns: DataFrame, t: Template = Template()) -> DataFrame:
    """Per conversation: conv_id, valid, segments (text, loss), formatted."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    own = turns.select("conv_id", alone.alias("alone"), F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    by = own.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("t"))
    parts = lambda x: F.array(
        F.struct(F.concat(F.lit(t.before_role), escaped(x.role, t), F.lit(t.after_role)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escaped(x.text, t).alias("text"), x.role.isin(*t.loss_roles).alias("loss")),
        F.struct(F.lit(t.after_text).alias("text"), F.lit(False).alias("loss")),
    )
    out = by.select("conv_id", valid(F.col("t.role"), t).alias("valid"), F.flatten(F.transform("t", parts)).alias("segments"))
    return out.withColumn("formatted", F.array_join("segments.text", ""))


def parsed(text: Column, t: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation."""
    turns = F.split(text, java_quoted(t.after_text), -1)
    fields = lambda x: F.split(F.substr(x, F.lit(len(t.before_role) + 1)), java_quoted(t.after_role), -1)
    return F.transform(F.slice(turns, 1, F.size(turns) - 1), lambda x: F.struct(unescaped(fields(x)[0], t).alias("role"), unescaped(fields(x)[1], t).alias("text")))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one more of control strings; read turns and loss back from the output."""
    t = Template()
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    says = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{says}'), (-7L, 1L, 'assistant', '{says}') AS t(conv_id, turn, role, text)")
    out = formatted(turns.unionByName(extra), t).withColumn("turns", parsed(F.col("formatted"), t))
    under_loss = F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescaped(s.text, t)), "")
    as_text = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return out.withColumn("under_loss", under_loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(as_text, 256).alias("turns_sha256"),
        F.length("under_loss").cast("long").alias("loss_chars"),
        F.sha2("under_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


_STEPS = ", ".join(f"('{state}', '{role}', '{to}')" for state, row in Template().transitions.items() for role, to in row.items())


def _sql() -> str:
    """The same columns from the turns themselves; only the formatted length needs the marks and escapes."""
    t = Template()
    marks = sum(map(len, (t.before_role, t.after_role, t.after_text)))
    first = {c[0]: "|".join(re.escape(d[1:]) for d in t.control if d[0] == c[0]) for c in t.control}
    hits = lambda x: " + ".join(f"len(regexp_extract_all({x}, '{re.escape(a)}\\\\*(?:{rest})'))" for a, rest in first.items())
    return rf"""
WITH RECURSIVE a AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text) AS i FROM a),
steps(state, role, next) AS (VALUES {_STEPS}),
fsm AS (SELECT DISTINCT conv_id, alone, 0 AS i, '{t.start}' AS state FROM n
  UNION ALL SELECT n.conv_id, n.alone, n.i, coalesce(s.next, '') FROM fsm JOIN n ON n.conv_id IS NOT DISTINCT FROM fsm.conv_id AND n.alone IS NOT DISTINCT FROM fsm.alone AND n.i = fsm.i + 1
  LEFT JOIN steps s ON s.state = fsm.state AND s.role = n.role),
ends AS (SELECT conv_id, alone, arg_max(state, i) IN ('{"', '".join(t.final)}') AS valid FROM fsm GROUP BY conv_id, alone)
SELECT n.conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({marks} + length(role) + length(text) + {hits('role')} + {hits('text')}) AS BIGINT) AS formatted_chars,
  any_value(ends.valid) AS valid
FROM n JOIN ends ON ends.conv_id IS NOT DISTINCT FROM n.conv_id AND ends.alone IS NOT DISTINCT FROM n.alone GROUP BY n.conv_id, n.alone
"""


SQL = _sql()
