"""Multi-party perspective rotation: every participant's view of a dialogue, for chat training.

For each participant the dialogue is rendered with that speaker as assistant
and the others as named users.  The result is a row for each participant and
turn: the rendered turn, where it lies in the rendering of the whole dialogue
(in characters), and the span of it that is trained on (the assistant's words
and the end mark).  The rows of a participant in order of `seq` are the
rendering; as no row holds a dialogue, a dialogue may be of any length.

DataFrame functions only.  Positions are running sums, which a dialogue with a
third of all turns must not bring into one task: turns are dealt into ranges of
(dialogue, turn), summed within a range, and the few sums of the ranges of each
dialogue are added up.

Defined results: turns come in the order of `turn` (nulls first), ties in that
of a hash of speaker and text; repeated rows are repeated turns.  A speaker of
`system` keeps the role system in every view and is no participant; a null or
blank speaker is a user without a name and no participant, so a dialogue
without participants has no rows.  A null text is empty; a null dialogue id is
one dialogue.  Marks of the format inside a text or name are broken by a space.
White space in a name becomes `_` and `#` is doubled; of speakers of a dialogue
whose names come out alike, the second, third ... in their order get `#2`, `#3`
..., so all are told apart.  The rows grow with participants times turns of a
dialogue, as each sees all of it.  Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = ("system",)


def _plain(text: Column) -> Column:
    """No mark of the format can come from a text."""
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


#: Speakers with a number that are broadcast; more are joined by a shuffle.
FEW = 10_000


def _called(speaker: Column) -> Column:
    return _plain(F.replace(F.regexp_replace(speaker, r"\s+", "_"), F.lit("#"), F.lit("##")))


def _alike(dealt: DataFrame) -> DataFrame:
    """(n_conv, n_speaker, number) of the speakers whose name another speaker of the dialogue has before them."""
    names = dealt.filter(F.col("speaker").isNotNull()).select("conv", "speaker", _called(F.col("speaker")).alias("called")).distinct()
    number = F.row_number().over(Window.partitionBy("conv", "called").orderBy("speaker"))
    found = cut(names.withColumn("number", number).filter("number > 1").select(F.col("conv").alias("n_conv"), F.col("speaker").alias("n_speaker"), "number"))
    return F.broadcast(found) if found.count() <= FEW else found


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: tuple[str, ...] = SYSTEM) -> DataFrame:
    """(conv_id, perspective, turn, seq, speaker, role, name, rendered, char_start, char_end, loss_start, loss_end).

    role: of the turn in this view.  loss_start and loss_end: the characters
    trained on, equal (and at char_end) for the turns of others.
    """
    named = F.nullif(F.trim(F.col(f"`{speaker_col}`").cast("string")), F.lit(""))
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), named.alias("speaker"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("tie", F.xxhash64("speaker", "body")).withColumn("uid", F.monotonically_increasing_id())
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("turn"), F.asc("tie"), F.asc("uid")]
    dealt = cut(rows.repartitionByRange(n, F.asc_nulls_first("conv"), *order).withColumn("part", F.spark_partition_id()))

    alike = _alike(dealt)
    dealt = dealt.join(alike, F.col("conv").eqNullSafe(F.col("n_conv")) & (F.col("speaker") == F.col("n_speaker")), "left").drop("n_conv", "n_speaker")
    is_system = F.coalesce(F.col("speaker").isin(*system), F.lit(False))
    views = dealt.filter(F.col("speaker").isNotNull() & ~is_system).select(F.col("conv").alias("v_conv"), F.col("speaker").alias("perspective")).distinct()
    parts = dealt.select(F.col("conv").alias("p_conv"), F.col("part").alias("v_part")).distinct()
    views = parts.join(views, F.col("p_conv").eqNullSafe(F.col("v_conv"))).select("v_conv", "v_part", "perspective")
    seen = dealt.join(views, (F.col("part") == F.col("v_part")) & F.col("conv").eqNullSafe(F.col("v_conv")))

    mine = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    role = F.when(is_system, "system").when(mine, "assistant").otherwise("user")
    called = F.concat(_called(F.col("speaker")), F.coalesce(F.concat(F.lit("#"), F.col("number").cast("string")), F.lit("")))
    name = F.when((role == "user") & F.col("speaker").isNotNull(), called)
    head = F.concat(F.lit(START), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    seen = seen.select("part", "conv", "perspective", "turn", "tie", "uid", "speaker", role.alias("role"), name.alias("name"), F.concat(head, _plain(F.col("body")), F.lit(f"{END}\n")).alias("rendered"), F.length(head).cast("long").alias("head"))

    own = Window.partitionBy("part", "conv", "perspective").orderBy(*order)
    size = F.length("rendered").cast("long")
    seen = seen.withColumn("nth", F.row_number().over(own).cast("long")).withColumn("upto", F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy("conv", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = seen.groupBy("part", "conv", "perspective").agg(F.count("*").alias("n"), F.sum(size).alias("size"))
    base = sums.select(F.col("part").alias("b_part"), F.col("conv").alias("b_conv"), F.col("perspective").alias("b_perspective"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("turns_before"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("chars_before"))
    full = seen.join(base, (F.col("part") == F.col("b_part")) & F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("perspective") == F.col("b_perspective")))

    end = F.col("chars_before") + F.col("upto")
    start = end - size
    talks = F.col("role") == "assistant"
    return full.select(
        F.col("conv").alias("conv_id"), "perspective", "turn", (F.col("turns_before") + F.col("nth") - 1).alias("seq"), "speaker", "role", "name", "rendered",
        start.alias("char_start"), end.alias("char_end"), F.when(talks, start + F.col("head")).otherwise(end).alias("loss_start"), F.when(talks, end - 1).otherwise(end).alias("loss_end"),
    )


def rotation_query(turns: DataFrame) -> DataFrame:
    return rotate(turns)


SQL = """
WITH t AS (
  SELECT conv_id, turn, nullif(trim(role), '') AS speaker, coalesce(text, '') AS body FROM conversations
), v AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker IS NOT NULL AND speaker <> 'system'
), r AS (
  SELECT t.conv_id, perspective, turn, speaker, body,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.conv_id
), b AS (
  SELECT conv_id, speaker, replace(replace(regexp_replace(speaker, '\\s+', '_', 'g'), '#', '##'), '<|im_', '<| im_') AS called FROM (SELECT DISTINCT conv_id, speaker FROM t WHERE speaker IS NOT NULL)
), a AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, called ORDER BY speaker) AS number FROM b
), n AS (
  SELECT r.*, CASE WHEN role = 'user' THEN called || CASE WHEN number > 1 THEN '#' || number ELSE '' END END AS name FROM r LEFT JOIN a ON r.conv_id IS NOT DISTINCT FROM a.conv_id AND r.speaker = a.speaker
), h AS (
  SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM n
), f AS (
  SELECT *, head || replace(body, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS rendered FROM h
), s AS (
  SELECT *, row_number() OVER w - 1 AS seq, CAST(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS char_end
  FROM f WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST)
)
SELECT conv_id, perspective, turn, seq, speaker, role, name, rendered, char_end - length(rendered) AS char_start, char_end,
  CASE WHEN role = 'assistant' THEN char_end - length(rendered) + length(head) ELSE char_end END AS loss_start,
  CASE WHEN role = 'assistant' THEN char_end - 1 ELSE char_end END AS loss_end
FROM s
"""
