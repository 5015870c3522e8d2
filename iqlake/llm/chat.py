"""Chat formatting by perspective rotation: every speaker becomes the assistant once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Roles that are context for everybody and take no perspective.
NARRATORS = ("system",)
#: What stands around a turn: before the speaker's label, between label and text, after the text, between turns.
HEAD, BREAK, END, GAP = "<|im_start|>", "\n", "<|im_end|>", "\n"
#: How a turn's speaker is labelled: as the participant, as a narrator, as anybody else (before the name).
OWN, NARRATOR, OTHER = "assistant", "system", "user name="


def speaker_name(role) -> F.Column:
    """A role as it is written in a label: percent-encoded, so that no two roles share a name; null is ``%``."""
    encoded = F.url_encode(role)
    for java, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(java), F.lit(plain))
    return F.coalesce(encoded, F.lit("%"))


def rotate(turns: DataFrame, narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """Render each whole dialogue once per participant, as that participant sees it.

    The participant's turns are ``assistant``, other speakers are ``user name=...``, narrators stay ``system``. Returns
    (conv_id, participant, n_turns, n_trained, text, mask); mask lists the half-open character ranges of the text, as
    ``start-end`` joined by ``;``, that the participant wrote, with the end mark that they have to learn. ``participant`` is
    the role as given, ``speaker_name`` of it is what the others read.

    Turns are in the order of ``turn``, whatever its numbers; ties are ordered by role, then text; repeated rows stay. A null
    turn comes first, a null text is empty, a null role is a speaker of its own. A row with a null conv_id belongs to no
    dialogue that is known and is a dialogue of one turn. ``<|`` inside a text is written ``< |``, so that no text can end its
    own turn. Dialogues of narrators alone, and empty tables, give no rows. Other columns are not looked at.

    A dialogue's turns meet in one task, as its renderings are single rows; renderings are made from there without another
    shuffle, each in time linear in its length.
    """
    said = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", said.alias("said"))
    rows = rows.withColumn("name", speaker_name(F.col("role"))).withColumn("narrates", F.coalesce(F.col("role").isin(*narrators), F.lit(False)))
    known = rows.where("conv_id is not null")

    # where a turn starts for somebody who didn't speak before it, and how many turns its own speaker had before it
    label = F.when(F.col("narrates"), len(NARRATOR)).otherwise(len(OTHER) + F.length("name"))
    around = len(HEAD) + len(BREAK) + len(END) + len(GAP)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "said")
    so_far = F.sum(label + F.length("said") + around).over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn", "said")) - 1
    known = known.withColumn("place", F.row_number().over(order)).withColumn("so_far", F.coalesce(so_far, F.lit(0))).withColumn("own", own)
    alone = rows.where("conv_id is null").select("*", F.lit(1).alias("place"), F.lit(0).cast("long").alias("so_far"), F.lit(0).alias("own"))

    def spoken(t: DataFrame) -> DataFrame:
        """Each turn with the range that its own speaker wrote, as that speaker sees the dialogue."""
        start = F.col("so_far") + F.col("own") * (len(OWN) - len(OTHER) - F.length("name")) + len(HEAD) + len(OWN) + len(BREAK)
        span = F.concat_ws("-", start.cast("string"), (start + F.length("said") + len(END)).cast("string"))
        return t.select("conv_id", F.struct("place", "role", "narrates", "name", "said", span.alias("span")).alias("t"))

    talks = spoken(known).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("talk"))
    talks = talks.unionByName(spoken(alone).select("conv_id", F.array("t").alias("talk")))
    who = F.array_distinct(F.transform(F.filter("talk", lambda t: ~t.narrates), lambda t: t.role))
    seen = talks.select("conv_id", "talk", F.explode(who).alias("participant"))
    mine = F.filter("talk", lambda t: t.role.eqNullSafe(F.col("participant")))

    def written(t):
        seen_as = F.when(t.role.eqNullSafe(F.col("participant")), OWN).when(t.narrates, NARRATOR).otherwise(F.concat(F.lit(OTHER), t["name"]))
        return F.concat(F.lit(HEAD), seen_as, F.lit(BREAK), t.said, F.lit(END + GAP))

    return seen.select(
        "conv_id",
        "participant",
        F.size("talk").cast("long").alias("n_turns"),
        F.size(mine).cast("long").alias("n_trained"),
        F.array_join(F.transform("talk", written), "").alias("text"),
        F.array_join(F.transform(mine, lambda t: t.span), ";").alias("mask"),
    )
