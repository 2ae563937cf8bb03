"""Chat formatting: multi-party perspective rotation (DataFrame functions only).

For every participant of a conversation the dialogue is rendered with that speaker as the assistant,
the others as named users and system turns as they are; the mask marks what the assistant is to say
(its text and the end mark). A rendering comes in parts of at most `turns_per_part` turns, in the order
(block, slice), so no row grows with its conversation.

Scale: texts are shuffled once, by conversation and block of turns, so a conversation that holds a
third of all turns is many groups. Participants come from a light aggregate (names only) that is
brought to the same keys, so the join that spreads them moves no text.

Defined cases: a null text is empty; a null role is a user named "unknown" and no participant, whoever else has that
name; system turns are no participant; null turns come first, in up to 256 blocks by their role and text, so that they
spread as well; a null conv_id is a conversation of its own; turns of equal number are ordered by role, then text;
repeated rows are repeated turns; very long texts are rendered whole, a turn never being cut; a conversation without
participants and an empty table give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import pick

SYSTEM = "system"
UNKNOWN = "unknown"
END = "<|end|>\n"
TURNS_PER_PART = 64


def _header(m: Column, speaker: Column) -> Column:
    named = F.concat(F.lit("<|user name="), m["role"], F.lit("|>\n"))
    return (
        F.when(_mine(m, speaker), F.lit("<|assistant|>\n"))
        .when(m["role"] == SYSTEM, F.lit("<|system|>\n"))
        .otherwise(named)
    )


def _mine(m: Column, speaker: Column) -> Column:
    return m["named"] & (m["role"] == speaker)


def rotate(conversations: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """conv_id, speaker, block, slice, n_turns, text, mask_spans (start:end in code points of text, comma-joined)
    and n_masked: a row for each part of each participant's rendering."""
    said = F.concat(F.coalesce("role", F.lit(UNKNOWN)), F.lit(" "), F.coalesce("text", F.lit("")))
    unnumbered = F.conv(F.substring(F.md5(said), 1, 2), 16, 10).cast("long") - 256
    null_key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    turns = pick(conversations, "conv_id", "turn", "role", "text").select(
        null_key.alias("conv"),
        F.coalesce(F.floor(F.col("turn") / turns_per_part).cast("long"), unnumbered).alias("block"),
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(UNKNOWN)).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("role").isNotNull().alias("named"),
    )
    takes_part = F.when(F.col("named") & (F.col("role") != SYSTEM), F.col("role"))
    blocks = turns.groupBy("conv", "block").agg(F.collect_set(takes_part).alias("own"))
    of_conv = blocks.groupBy("conv").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("own")))).alias("speakers"))
    spread = blocks.select("conv", "block").join(of_conv, "conv")
    in_block = W.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "named")
    placed = turns.withColumn("at", F.row_number().over(in_block))
    parts = placed.groupBy(
        "conv", "block", F.expr(f"cast((at - 1) div {turns_per_part} as bigint)").alias("slice")
    ).agg(
        F.max("conv_id").alias("conv_id"),
        F.array_sort(F.collect_list(F.struct("at", "role", "text", "named"))).alias("messages"),
    )
    each = parts.join(spread, ["conv", "block"]).select(
        "conv_id", "block", "slice", "messages", F.explode("speakers").alias("speaker")
    )
    speaker = F.col("speaker")
    shown = F.transform("messages", lambda m: F.concat(_header(m, speaker), m["text"], F.lit(END)))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("n"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(state, m):
        begin = state["at"] + F.length(_header(m, speaker))
        end = begin + F.length(m["text"]) + len(END)
        mine = _mine(m, speaker)
        span = F.array(F.concat_ws(":", begin.cast("string"), end.cast("string")))
        return F.struct(
            end.alias("at"),
            (state["n"] + F.when(mine, end - begin).otherwise(0)).alias("n"),
            F.when(mine, F.concat(state["out"], span)).otherwise(state["out"]).alias("out"),
        )

    return each.select(
        "conv_id",
        "speaker",
        "block",
        "slice",
        F.size("messages").cast("long").alias("n_turns"),
        F.array_join(shown, "").alias("text"),
        F.aggregate("messages", start, step).alias("mask"),
    ).select(
        "conv_id", "speaker", "block", "slice", "n_turns", "text", F.array_join("mask.out", ",").alias("mask_spans"), F.col("mask.n").alias("n_masked")
    )


ORACLE_SQL = """
with t as (
  select conv_id, coalesce('=' || cast(conv_id as varchar), '') as conv, coalesce(role, 'unknown') as role,
    coalesce(text, '') as text, role is not null and role <> 'system' as named,
    coalesce(cast(floor(turn / 64) as bigint), ('0x' || substr(md5(coalesce(role, 'unknown') || ' ' || coalesce(text, '')), 1, 2))::bigint - 256) as block, turn
  from conversations
), p as (
  select *, row_number() over (partition by conv, block order by turn nulls first, role, text, named) as pos from t
), s as (
  select distinct conv, role as speaker from t where named
), r as (
  select p.conv_id, p.conv, s.speaker, p.block, (p.pos - 1) // 64 as slice, p.pos, p.named and p.role = s.speaker as mine,
    case when p.named and p.role = s.speaker then '<|assistant|>' when p.role = 'system' then '<|system|>'
      else '<|user name=' || p.role || '|>' end || chr(10) as head, p.text || '<|end|>' || chr(10) as body
  from p join s using (conv)
), q as (
  select *, cast(sum(length(head) + length(body)) over (partition by conv, speaker, block, slice order by pos) as bigint) as stop
  from r
)
select conv_id, speaker, block, cast(slice as bigint) as slice, count(*) as n_turns,
  string_agg(head || body, '' order by pos) as text,
  coalesce(string_agg(case when mine then (stop - length(body)) || ':' || stop end, ',' order by pos), '') as mask_spans,
  cast(sum(case when mine then length(body) else 0 end) as bigint) as n_masked
from q group by conv_id, conv, speaker, block, slice
"""
