"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns
of one role share a header; control strings inside roles and texts are broken
by a backslash, reversibly.  A conversation is one string, so it is one group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings; ``foreign`` are those of other templates, escaped as well."""

    turn: str = "<|turn|>"
    body: str = "<|body|>"
    join: str = "<|next|>"
    end: str = "<|end|>"
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
    trained: tuple[str, ...] = ("assistant",)

    def own(self) -> tuple[str, ...]:
        return self.turn, self.body, self.join, self.end


def _quoted(*strings: str) -> str:
    return "|".join("\\Q" + s + "\\E" for s in strings)


def escaped(text: Column, template: Template) -> Column:
    """Backslashes doubled, and one put behind the first character of each control string."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"(?s)(?=(?:{_quoted(*template.own(), *template.foreign)}))(.)", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, template: Template = Template(), conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation: ``formatted``, and ``loss_mask``, a flag for each run of turns.

    Turns go by number (null first), ties by role and text.  A null role or text
    is empty.  A run is a stretch of turns of one role; its texts are under the
    loss mask if the template trains on the role.  Null conversation ids are one
    conversation; an empty table gives none; other columns are dropped.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = turns.groupBy(conv_col).agg(F.sort_array(F.collect_list(turn)).alias("__turns"))
    new = lambda i: (i == 0) | (F.get("__turns", i - 1)["role"] != F.get("__turns", i)["role"])
    head = lambda t, i: F.concat(F.when(i > 0, F.lit(template.end)).otherwise(F.lit("")), F.lit(template.turn), escaped(t["role"], template), F.lit(template.body))
    parts = F.transform("__turns", lambda t, i: F.concat(F.when(new(i), head(t, i)).otherwise(F.lit(template.join)), escaped(t["text"], template)))
    runs = F.filter("__turns", lambda t, i: new(i))
    mask = F.transform(runs, lambda t: t["role"].isin(*template.trained))
    return c.select(conv_col, F.concat(F.array_join(parts, ""), F.lit(template.end)).alias("formatted"), mask.alias("loss_mask"))


def runs_of(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, texts>> read from a formatted conversation."""
    found = F.filter(F.split(formatted, _quoted(template.turn)), lambda r, i: i > 0)
    cut = F.transform(found, lambda r: F.split(r, _quoted(template.body, template.join, template.end)))
    return F.transform(
        cut,
        lambda p: F.struct(unescaped(F.get(p, F.lit(0))).alias("role"), F.transform(F.slice(p, 2, F.size(p) - 2), unescaped).alias("texts")),
    )
