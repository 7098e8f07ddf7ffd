"""Chat formatting with Spark expressions only: sort collected turns, merge neighbours of one role, concatenate.

Template: ``<s>`` block* ``</s>``; a block is ``[INST]..[/INST]`` (user), ``[SYS]..[/SYS]`` (system),
``[ASST]..[/ASST]`` (assistant) or, for any other role, ``[ROLE]role[NEXT]..[/ROLE]``. A block holds the texts of
adjacent turns of one role with ``[NEXT]`` between them, so merging loses no turn border.

Escape: a control string inside a text or role gets a backslash after its first character, and one that already
has backslashes there gets one more; removing one undoes it. No control string of the template can occur in an
escaped text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TAIL = r"/?s>|/?(?:INST|SYS|ASST|ROLE)\]|NEXT\]"
ESCAPE = rf"([<\[])(\\*)({_TAIL})"
UNESCAPE = rf"([<\[])\\(\\*)({_TAIL})"
TAGS = {"user": "INST", "system": "SYS", "assistant": "ASST"}


def escape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPE, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, UNESCAPE, "$1$2$3")


def _tag(role: Column) -> Column:
    out = F.lit("ROLE")
    for name, tag in TAGS.items():
        out = F.when(role == name, F.lit(tag)).otherwise(out)
    return out


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conv_id of turns (conv_id, turn, role, text): formatted, and its segments under the loss mask.

    ``segments`` is the loss mask at the border of texts: array<struct<piece, loss>> whose pieces give ``formatted``
    when concatenated; loss is true on assistant texts only. Null text or role: empty. Turns with equal numbers are
    ordered by role, then text; repeated rows are repeated turns; a null turn comes first; null conv_id is a
    conversation of its own. Other columns are ignored. An empty table gives no rows. A conversation is one
    value, so one task must hold it; nothing but its own size bounds it.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    at = lambda i: F.element_at("t", i.cast("int"))
    starts = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (at(F.greatest(i - 1, F.lit(1)))["role"] != at(i)["role"]))
    merged = sorted_turns.withColumn("starts", starts).select(
        "conv_id",
        F.transform(
            "starts",
            lambda s, k: F.struct(
                at(s)["role"].alias("role"),
                F.slice("t", s, F.coalesce(F.get("starts", k + 1), F.size("t") + 1) - s)["text"].alias("texts"),
            ),
        ).alias("blocks"),
    )
    piece = lambda p, loss: F.struct(p.alias("piece"), loss.alias("loss"))
    no = F.lit(False)

    def segments(b: Column) -> Column:
        tag = _tag(b["role"])
        head = F.concat(F.lit("["), tag, F.lit("]"), F.when(tag == "ROLE", F.concat(escape(b["role"]), F.lit("[NEXT]"))).otherwise(F.lit("")))
        texts = F.flatten(F.transform(b["texts"], lambda x, i: F.array(piece(F.when(i == 0, head).otherwise(F.lit("[NEXT]")), no), piece(escape(x), b["role"] == "assistant"))))
        return F.concat(texts, F.array(piece(F.concat(F.lit("[/"), tag, F.lit("]")), no)))

    out = merged.withColumn("segments", F.concat(F.array(piece(F.lit("<s>"), no)), F.flatten(F.transform("blocks", segments)), F.array(piece(F.lit("</s>"), no))))
    return out.select("conv_id", F.array_join(F.col("segments")["piece"], "").alias("formatted"), "segments")


def parse_formatted(formatted: Column) -> Column:
    """The turns that a formatted conversation holds: array<struct<role, text>>."""
    blocks = F.regexp_extract_all(formatted, F.lit(r"(?s)\[(INST|SYS|ASST|ROLE)\].*?\[/\1\]"), 0)

    def turns(b: Column) -> Column:
        tag = F.substring_index(b, "]", 1)
        parts = F.transform(F.split(F.regexp_extract(b, r"(?s)^\[[A-Z]+\](.*)\[/[A-Z]+\]$", 1), r"\[NEXT\]", -1), unescape)
        role = F.element_at(parts, 1)
        for name, t in TAGS.items():
            role = F.when(tag == f"[{t}", F.lit(name)).otherwise(role)
        texts = F.when(tag == "[ROLE", F.slice(parts, 2, F.size(parts) - 1)).otherwise(parts)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), x.alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digest(conversations: DataFrame) -> DataFrame:
    """What op7 returns, read back from the operator's output."""
    probe = "</s>[INST] ok [/INST]"
    spark = conversations.sparkSession
    own = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(probe).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("x")).select("x.*")
    out = format_conversations(conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own))
    read = out.select("conv_id", "formatted", parse_formatted(F.col("formatted")).alias("turns"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["piece"])), "").alias("learned"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), n as (
  select *, row_number() over w as i, lag(role) over w as prev, lead(role) over w as next,
    regexp_replace(text, '([<\[])(\\*)(/?s>|/?(?:INST|SYS|ASST|ROLE)\]|NEXT\])', '\1\\\2\3', 'g') as esc,
    regexp_replace(role, '([<\[])(\\*)(/?s>|/?(?:INST|SYS|ASST|ROLE)\]|NEXT\])', '\1\\\2\3', 'g') as esc_role,
    case role when 'user' then 'INST' when 'system' then 'SYS' when 'assistant' then 'ASST' else 'ROLE' end as tag
  from c window w as (partition by conv_id order by turn nulls first, role, text)
), p as (
  select *, case when prev is distinct from role then '[' || tag || ']' || case when tag = 'ROLE' then esc_role || '[NEXT]' else '' end else '[NEXT]' end
    || esc || case when next is distinct from role then '[/' || tag || ']' else '' end as piece
  from n
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  cast(length(coalesce(string_agg(case when role = 'assistant' then text end, '' order by i), '')) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by i), '')) as loss_sha256,
  cast(length('<s>' || string_agg(piece, '' order by i) || '</s>') as bigint) as formatted_chars
from p group by conv_id
"""
