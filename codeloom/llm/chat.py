"""Operator 7: chat formatting by multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation (each speaker but the system) the dialogue is rendered once, with that
participant as assistant and the others as named users; system turns stay as they are.  The mask names the code points
to learn from: what the participant says, with the mark that ends the turn.  One exchange by conversation serves all
aggregates and windows, and turns travel once, not once for each perspective.  Where a turn begins is the same for all
but its own speaker, up to a multiple of one difference of heads, so running sums are taken once a conversation and all
work is linear in turns for each perspective.

Defined results: turns are ordered by number, then speaker, then text, nulls first; a null text is empty, a null speaker
is ``unknown``; repeated rows are repeated turns; rows without conversation id are one conversation; a conversation of
system turns only has no perspective; an empty table gives none; other columns are not read.  Names are cut at nothing,
but line ends in them become blanks, and the marks of the template inside a text or a name are kept apart by a
zero-width space, so that no text or name can end a turn or a head.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import table

#: The marks of the chat template; a zero-width space parts them inside a text.
START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
_SAFE = "<\u200b|"


def perspectives(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, participant, text, mask (array of start, end; code points, end exclusive), n_turns, n_masked."""
    safe = lambda c: F.regexp_replace(c, r"<\|", _SAFE)
    speaker = F.translate(safe(F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown"))), "\n", " ")
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), speaker.alias("speaker"), safe(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "text"))).alias("turns"))
    one = turns.select("conv_id", F.posexplode("turns").alias("pos", "t")).select("conv_id", "pos", "t.speaker", "t.text")
    # code points before each turn as its speaker's other participants see it, and the speaker's turns before it
    head = F.when(F.col("speaker") == SYSTEM, len(f"{START}system\n")).otherwise(len(f"{START}user name=\n") + F.length("speaker"))
    size = (head + F.length("text") + len(f"{END}\n")).cast("long")
    by = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum(size).over(by.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "speaker").orderBy("pos")) - 1
    placed = one.select("conv_id", "pos", "speaker", "text", before.alias("before"), earlier.alias("earlier"))
    turns = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "speaker", "text", "before", "earlier"))).alias("turns"))
    people = F.array_sort(F.array_distinct(F.filter(F.col("turns.speaker"), lambda s: s != SYSTEM)))
    each = turns.select("conv_id", "turns", F.explode(people).alias("participant"))
    own = lambda t: t["speaker"] == F.col("participant")
    rendered = F.transform(
        "turns",
        lambda t: F.concat(
            F.when(own(t), F.lit(f"{START}assistant\n")).when(t["speaker"] == SYSTEM, F.lit(f"{START}system\n")).otherwise(F.concat(F.lit(f"{START}user name="), t["speaker"], F.lit("\n"))),
            t["text"],
            F.lit(f"{END}\n"),
        ),
    )
    mine = len(f"{START}assistant\n")
    start = lambda t: t["before"] + t["earlier"] * (mine - len(f"{START}user name=\n") - F.length("participant")) + mine
    mask = F.transform(F.filter("turns", own), lambda t: F.struct(start(t).cast("long").alias("start"), (start(t) + F.length(t["text"]) + len(END)).cast("long").alias("end")))
    out = each.select("conv_id", "participant", F.array_join(rendered, "").alias("text"), mask.alias("mask"), F.size("turns").cast("long").alias("n_turns"))
    return out.withColumn("n_masked", F.aggregate("mask", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perspectives(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.select("conv_id", "participant", "text", mask.alias("mask"), "n_turns", "n_masked")


_SQL = f"""
WITH said AS (SELECT conv_id, turn, replace(replace(coalesce(role, 'unknown'), '<|', '{_SAFE}'), chr(10), ' ') AS speaker, replace(coalesce(text, ''), '<|', '{_SAFE}') AS text FROM conversations),
turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, text) AS pos FROM said),
people AS (SELECT DISTINCT conv_id, speaker AS participant FROM turns WHERE speaker <> '{SYSTEM}'),
parts AS (
  SELECT t.conv_id, participant, pos, speaker = participant AS own, text,
    CASE WHEN speaker = participant THEN '{START}assistant' || chr(10) WHEN speaker = '{SYSTEM}' THEN '{START}system' || chr(10) ELSE '{START}user name=' || speaker || chr(10) END AS head
  FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(text) + {len(END) + 1}) OVER (PARTITION BY conv_id, participant ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS a,
    length(text) + {len(END)} AS n
  FROM parts
)
SELECT conv_id, participant, string_agg(head || text || '{END}' || chr(10), '' ORDER BY pos) AS text,
  coalesce(string_agg((a::BIGINT)::VARCHAR || '-' || ((a + n)::BIGINT)::VARCHAR, ',' ORDER BY pos) FILTER (WHERE own), '') AS mask,
  count(*)::BIGINT AS n_turns, coalesce(sum(n) FILTER (WHERE own), 0)::BIGINT AS n_masked
FROM placed GROUP BY conv_id, participant
"""

QUERIES = {"op7_chat": op7_chat}
ORACLE_SQL = {"op7_chat": _SQL}
