"""Operator 4: chat formatting by perspective rotation.

A conversation is rendered once for every participant: that speaker's turns become the assistant's, all
others' become named users', system turns stay. Beside each rendered text stand the lengths of its segments
and a mask of those to learn from, which are the assistant's.

Long conversations come in parts of PART_TURNS turn numbers, so that no row grows without bound; the parts of a
conversation, in order, are the whole of it. Only DataFrame functions. Turns of one number are ordered by
role and text, nulls first; repeated rows are rendered as often as they stand. A null text is empty, a null
role is the participant "unknown", a null turn counts as part 0's first, and a null conversation id is a
conversation of its own. A conversation of system turns alone has no participant and gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import pick

PART_TURNS = 256
#: The widely used chat markup.
OPEN, CLOSE, SYSTEM, UNKNOWN = "<|im_start|>", "<|im_end|>\n", "system", "unknown"


def rotate(turns: DataFrame, part_turns: int = PART_TURNS, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, participant, part, n_segments, text, segment_chars, loss_mask (arrays, an element for each segment)."""
    rows = pick(turns, conv_id=id_col, turn=turn_col, role=role_col, text=text_col).select("conv_id", "turn", F.coalesce("role", F.lit(UNKNOWN)).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(0)).cast("long").alias("part"))
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = rows.filter(F.col("role") != SYSTEM).groupBy(F.col("conv_id").alias("of_conv")).agg(F.collect_set("role").alias("speakers"))
    views = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("of_conv"))).select("conv_id", "part", "turns", F.explode("speakers").alias("participant"))

    def render(t):  # noqa: ANN001, ANN202
        who = F.when(t["role"] == F.col("participant"), "assistant").when(t["role"] == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), t["role"]))
        return F.concat(F.lit(OPEN), who, F.lit("\n"), t["text"], F.lit(CLOSE))

    segments = views.withColumn("segments", F.transform("turns", render))
    mask = F.transform("turns", lambda t: (t["role"] == F.col("participant")).cast("int"))
    return segments.select("conv_id", "participant", "part", F.size("turns").cast("long").alias("n_segments"), F.array_join("segments", "").alias("text"), F.transform("segments", lambda s: F.char_length(s)).alias("segment_chars"), mask.alias("loss_mask"))
