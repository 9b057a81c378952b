"""Chat formatting: multi-party perspective rotation.

For every participant the whole dialogue is rendered with that speaker as the assistant and all others as named
users; the mask holds the character spans that the assistant says (its text and the closing mark), which are the
training targets. System turns are rendered as such and are no participant.

A dialogue's messages are in one total order, by (turn, speaker, SHA-256 of the text), and are rendered in parts of
``messages_per_part``, the last one shorter; texts and spans of a part stand on their own, and the parts joined in
order are the dialogue, however many messages share a turn. So no task gathers an unbounded conversation. A message's
place is found in two levels: the messages are dealt by ranges of that order, numbered within their range, and the
numbers of messages in a conversation's earlier ranges are added.

Defined results: a null role is the speaker ``unknown``; a null text is empty; a null turn comes first, as turn -1;
a null conv_id is one conversation of its own; rows equal in all four columns are one message. A conversation of
system turns alone has no perspective. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.shared import written

END = "<|end|>\n"


def header(speaker: Column, perspective: Column) -> Column:
    return F.when(speaker == perspective, F.lit("<|assistant|>\n")).when(speaker == "system", F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), speaker, F.lit("|>\n")))


def numbered_messages(turns: DataFrame) -> DataFrame:
    """Distinct messages of ``turns`` (conv_id, turn, role, text) with their place in their conversation, from 0 on.

    Returns conv_id, turn, speaker, digest, text and place.
    """
    text = F.coalesce("text", F.lit(""))
    said = turns.select("conv_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("speaker"), F.sha2(text, 256).alias("digest"), text.alias("text"))
    said = said.groupBy("conv_id", "turn", "speaker", "digest", "text").agg(F.lit(1).alias("one")).drop("one")
    order = ["turn", "speaker", "digest"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once, as the counts and the numbers must see the same ranges.
    ranged = written(said.repartitionByRange(parts, "conv_id", *order).withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    counts = counts.select(F.col("conv_id").alias("of_conv"), F.col("range").alias("of_range"), F.coalesce(earlier, F.lit(0)).alias("earlier"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order))
    numbered = ranged.withColumn("nth", nth).join(counts, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("range") == F.col("of_range")))
    return numbered.select("conv_id", *order, "text", (F.col("earlier") + F.col("nth") - 1).alias("place"))


def rotate_perspectives(turns: DataFrame, messages_per_part: int = 512) -> DataFrame:
    """Render ``turns`` (conv_id, turn, role, text) once for every participant.

    Returns conv_id, perspective, part, n_turns, text and mask (array of start, end in characters).
    """
    said = numbered_messages(turns).select("conv_id", F.floor(F.col("place") / messages_per_part).cast("long").alias("part"), F.struct("place", "speaker", "text").alias("message"))
    parts = said.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("message")).alias("messages"))
    speaker = F.coalesce("role", F.lit("unknown"))
    people = turns.select(F.col("conv_id").alias("who_conv"), speaker.alias("perspective")).where("perspective <> 'system'").distinct()
    wide = parts.join(people, parts.conv_id.eqNullSafe(people.who_conv))

    def step(acc: Column, m: Column) -> Column:
        head = header(m["speaker"], F.col("perspective"))
        start = acc["pos"] + F.length(head)
        end = start + F.length(m["text"]) + len(END)
        mine = F.when(m["speaker"] == F.col("perspective"), F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(empty)
        return F.struct(end.alias("pos"), F.concat(acc["mask"], mine).alias("mask"))

    empty = F.array().cast("array<struct<start:int,end:int>>")
    spans = F.aggregate("messages", F.struct(F.lit(0).alias("pos"), empty.alias("mask")), step)["mask"]
    text = F.array_join(F.transform("messages", lambda m: F.concat(header(m["speaker"], F.col("perspective")), m["text"], F.lit(END))), "")
    return wide.select("conv_id", "perspective", "part", F.size("messages").alias("n_turns"), text.alias("text"), spans.alias("mask"))
