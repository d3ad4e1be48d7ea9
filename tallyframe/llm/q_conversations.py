"""Queries over ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.llm import conversation
from tallyframe.llm.common import read


def damaged(rows):
    """The damage that the repair is judged by: a checksum of a row's key drops it, empties its text, removes its sentence ends, repeats it
    or makes it the user's. Dropped rows stay as rows that are not ``present``."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("how") != 0).alias("present"), "how")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("how") == 3, 2).otherwise(1))))


def op11_conversation_repair(spark, sf_dir):
    """Every conversation after damage: its faults, the cheapest edits and the hash of what they make of it."""
    rows = damaged(read(spark, sf_dir, "conversations"))
    return conversation.audited(conversation.edits(rows, present=F.col("present")))


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLES = {}
