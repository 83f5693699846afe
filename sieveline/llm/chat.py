"""Multi-party chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and all others as named
users; only the assistant's turns are trained on. The result holds one row per participant and turn: the rendered
``segment``, its place in the rendered dialogue (``start``, in characters), and the masked span to train on (``mask_start``, ``mask_end``; null
where nothing of the turn is). Segments in the order of ``turn_no`` make up the dialogue, so no conversation has to fit
in one task, however long.

System turns are nobody's: they are rendered as such and belong to no participant. Turns are ordered by turn, role and text, repeated
rows are separate turns; a null turn comes first. Participants are told apart by the role as it is given. Their rendered labels have ``_`` for characters
that could break the format; where several roles of a conversation would share a label, those that differ from it get ``~`` and their UTF-8 bytes
in hex behind it, so that a label is one participant's only. A null role is the speaker ``unknown``, or ``unknown~`` in a conversation that
has a role of that label: no other participant is rendered so. A null text is empty, and a null conv_id is a conversation of its own.
Marks in a text that look like the format's own are broken up. Conversations without participants (system turns only) give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

END = "<|end|>\n"


def speaker(role: Column) -> Column:
    return F.regexp_replace(F.coalesce(role, F.lit("unknown")), r"[^A-Za-z0-9_.-]", "_")


def _labelled(base: DataFrame, scratch: Scratch) -> DataFrame:
    """base (conv_id, role, speaker, ...) with a speaker of its own for each role of a conversation, without role."""
    shared = base.groupBy("conv_id", "speaker").agg(F.min("role").alias("low"), F.max("role").alias("high"), F.max(F.col("role").isNull()).alias("nameless"))
    shared = shared.where("low < high or (nameless and low is not null)")
    # Written out, so that its size is known: mostly there is none, and the join needs no shuffle then.
    shared = scratch.table(shared.select(F.col("conv_id").alias("c"), F.col("speaker").alias("s"), F.lit(True).alias("shared")), "shared")
    both = base.join(shared, base["conv_id"].eqNullSafe(shared["c"]) & (base["speaker"] == shared["s"]), "left")
    own = F.concat("speaker", F.lit("~"), F.coalesce(F.hex(F.encode("role", "UTF-8")), F.lit("")))
    return both.withColumn("speaker", F.when(F.col("shared") & ~F.col("role").eqNullSafe(F.col("speaker")), own).otherwise(F.col("speaker"))).drop("role", "c", "s", "shared")


def rotate(turns: DataFrame, parts: int | None = None) -> DataFrame:
    """turns: conv_id, turn, role, text. See the module for the result."""
    parts = parts or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scratch = Scratch(turns.sparkSession, "chat")
    base = turns.select("conv_id", "turn", "role", speaker(F.col("role")).alias("speaker"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"))
    base = _labelled(base, scratch)
    people = base.where("speaker <> 'system'").select(F.col("conv_id").alias("conv"), F.col("speaker").alias("participant")).distinct()
    rows = base.join(people, base["conv_id"].eqNullSafe(people["conv"])).drop("conv")
    own = F.col("speaker") == F.col("participant")
    head = F.when(F.col("speaker") == "system", F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), "speaker", F.lit("|>\n")))
    rows = rows.select("conv_id", "participant", "turn", "speaker", own.alias("own"), F.length(head).alias("lead"), F.concat(head, "body", F.lit(END)).alias("segment"), F.length(F.concat(head, "body", F.lit(END))).cast("long").alias("size"))

    # Prefix sums in two steps: inside each range of the order, and over the ranges. A long dialogue spans many ranges.
    order = ["turn", "speaker", "segment"]
    ranged = rows.repartitionByRange(parts, "conv_id", "participant", *order).withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part", "conv_id", "participant").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Written out, since the ranges are drawn anew each time the plan runs.
    local = scratch.table(ranged.withColumn("until", F.sum("size").over(inside)).withColumn("no", F.count("*").over(inside)), "ranges")
    sums = local.groupBy("conv_id", "participant", "part").agg(F.max("until").alias("total"), F.max("no").alias("count"))
    before = Window.partitionBy("conv_id", "participant").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Only dialogues that cross a range's edge have anything before a range: fewer rows than ranges.
    carried = sums.withColumn("chars", F.sum("total").over(before)).withColumn("turns", F.sum("count").over(before)).where("chars is not null")
    carried = carried.select(F.col("conv_id").alias("c"), F.col("participant").alias("p"), F.col("part").alias("q"), "chars", "turns")
    out = local.join(carried, local["conv_id"].eqNullSafe(carried["c"]) & (local["participant"] == carried["p"]) & (local["part"] == carried["q"]), "left")
    start = F.coalesce("chars", F.lit(0)) + F.col("until") - F.col("size")
    return out.select(
        "conv_id",
        "participant",
        (F.coalesce("turns", F.lit(0)) + F.col("no")).alias("turn_no"),
        "speaker",
        "segment",
        start.alias("start"),
        F.when(F.col("own"), start + F.col("lead")).alias("mask_start"),
        F.when(F.col("own"), start + F.col("size")).alias("mask_end"),
    )


SQL = r"""
WITH given AS (
  SELECT conv_id, turn, role, regexp_replace(coalesce(role, 'unknown'), '[^A-Za-z0-9_.-]', '_', 'g') AS label,
         replace(coalesce(text, ''), '<|', '< |') AS body
  FROM conversations),
shared AS (SELECT conv_id, label, count(DISTINCT role) + max(CASE WHEN role IS NULL THEN 1 ELSE 0 END) > 1 AS several FROM given GROUP BY ALL),
base AS (
  SELECT g.conv_id, turn, body, CASE WHEN several AND role IS DISTINCT FROM g.label THEN g.label || '~' || coalesce(hex(encode(role)), '') ELSE g.label END AS speaker
  FROM given g JOIN shared s ON g.conv_id IS NOT DISTINCT FROM s.conv_id AND g.label = s.label),
people AS (SELECT DISTINCT conv_id, speaker AS participant FROM base WHERE speaker <> 'system'),
turned AS (
  SELECT b.conv_id, participant, turn, speaker, speaker = participant AS own, body,
         CASE WHEN speaker = 'system' THEN '<|system|>' || chr(10)
              WHEN speaker = participant THEN '<|assistant|>' || chr(10)
              ELSE '<|user:' || speaker || '|>' || chr(10) END AS head
  FROM base b JOIN people p ON b.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, head || body || '<|end|>' || chr(10) AS segment,
         row_number() OVER w AS turn_no,
         CAST(sum(length(head || body || '<|end|>' || chr(10))) OVER w AS BIGINT) AS until
  FROM turned
  WINDOW w AS (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, speaker, head || body || '<|end|>' || chr(10)
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, participant, turn_no, speaker, segment, until - length(segment) AS start,
       CASE WHEN own THEN until - length(segment) + length(head) END AS mask_start,
       CASE WHEN own THEN until END AS mask_end
FROM placed
"""
