"""Chat formatting by perspective rotation.

Every participant of a conversation gets a rendering in which their turns are the assistant's and carry the
training mask; the others are users, named after themselves. System turns stay system turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Turn numbers in one run of the offsets' first level.
RUN = 256


def perspectives(turns: DataFrame) -> DataFrame:
    """Rendered turns, one row for each turn and perspective: conv_id, perspective, turn, role, name, rendered,
    char_start, mask_start, mask_end.

    Participants are the different speakers of a conversation, ``system`` apart; a null or empty speaker is
    called ``unknown``. A conversation with system turns only has no perspective and no row. A turn is
    ``<|im_start|>role name=...`` (the name for users only), a line break, the text, ``<|im_end|>`` and a line break.
    char_start is the turn's first character within the whole rendering; [mask_start, mask_end) is what the loss counts:
    text and end mark of the participant's own turns, else null. Turns lie in the order of turn (nulls
    first), speaker, text; repeated rows each count. Null text is empty; null conv_id is a conversation. Other columns
    are not read; an empty table gives an empty result. Marks within a text are left as they are. A rendering is not
    gathered into one row, so a conversation of any length stays spread: only turns of one run (RUN turn numbers of one
    conversation, and all that share a number) come together.

    Offsets need no rendered text: a perspective's turns are shorter by the same number of characters each than
    when others read them, so counts of turns and one sum of lengths tell where every turn starts.
    """
    key = ["conv", "nameless", "run"]
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("conv", F.coalesce("conv_id", F.lit(0).cast(t.schema["conv_id"].dataType))).withColumn("nameless", F.col("conv_id").isNull()).withColumn("run", F.floor(F.coalesce(F.col("turn"), F.lit(-(2**62))) / RUN))
    told = F.when(F.col("speaker") == "system", len("system")).otherwise(len("user name=") + F.length("speaker"))
    t = t.withColumn("size", len(START) + told + 1 + F.length("text") + len(END))

    # of each run: the characters before it, and each participant's turns before it
    people = t.groupBy(*key, "speaker").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    order = Window.partitionBy("conv", "nameless").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = people.groupBy(key).agg(F.sum("size").alias("in_run")).withColumn("base", F.coalesce(F.sum("in_run").over(order), F.lit(0))).drop("in_run")
    who = people.filter("speaker <> 'system'").select("conv", "nameless", F.col("speaker").alias("perspective")).distinct()
    seats = runs.join(who, ["conv", "nameless"])
    spoken = people.select(*key, F.col("speaker").alias("perspective"), "n")
    each = Window.partitionBy("conv", "nameless", "perspective").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    seats = seats.join(spoken, [*key, "perspective"], "left").withColumn("before", F.coalesce(F.sum("n").over(each), F.lit(0)))
    seats = seats.groupBy(key).agg(F.first("base").alias("base"), F.collect_list(F.struct("perspective", "before")).alias("seats"))

    # the text is shuffled once, by run; all that follows keeps that partitioning
    inside = Window.partitionBy(key).orderBy("turn", "speaker", "text")
    rows = t.withColumn("nth", F.row_number().over(inside)).withColumn("within", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(seats, key).withColumn("seat", F.explode("seats")).withColumn("perspective", F.col("seat.perspective"))
    own = F.col("speaker") == F.col("perspective")
    earlier = Window.partitionBy(*key, "perspective").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    spoke = F.col("seat.before") + F.coalesce(F.sum(own.cast("int")).over(earlier), F.lit(0))
    rows = rows.withColumn("char_start", F.col("base") + F.col("within") - spoke * (len("user name=") - len("assistant") + F.length("perspective")))
    role = F.when(F.col("speaker") == "system", "system").when(own, "assistant").otherwise("user")
    rows = rows.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    head = F.concat(F.lit(START), "role", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("rendered", F.concat("head", "text", F.lit(END)))
    mask = F.col("char_start") + F.length("head"), F.col("char_start") + F.length("rendered") - 1
    masked = F.col("role") == "assistant"
    return rows.select("conv_id", "perspective", "turn", "role", "name", "rendered", "char_start", F.when(masked, mask[0]).alias("mask_start"), F.when(masked, mask[1]).alias("mask_end"))


def digest(rendered: DataFrame) -> DataFrame:
    return rendered.select("conv_id", "perspective", "turn", "role", "name", F.sha2(F.encode("rendered", "UTF-8"), 256).alias("rendered_sha256"), "char_start", "mask_start", "mask_end")
