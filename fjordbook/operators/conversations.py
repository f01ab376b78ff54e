"""Conversation checks and request limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjordbook.operators.keyed import top_per_key

def recent_messages(messages: DataFrame, keep: int) -> DataFrame:
    """The last ``keep`` messages of each conversation; ``fra_slutt`` is 1 for the newest."""
    return top_per_key(messages, ["conv_id"], [F.desc("turn")], keep, rank="fra_slutt")


def _faults() -> Column:
    """Why a message breaks its conversation, or null."""
    return (
        F.when(~F.col("role").isin("user", "assistant") | F.col("role").isNull(), "rolle")
        .when(F.col("text").isNull() | (F.trim(F.regexp_replace("text", r"\s+", " ")) == ""), "tom")
        .when((F.col("fra_slutt") == 1) & (F.col("role") != "user"), "siste ikke fra bruker")
    )


def validate_conversations(messages: DataFrame, keep: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejects)``: the last ``keep`` messages of sound conversations, and the others with a reason.

    Texts stay whole; ``for_lang`` marks those of more than ``longest`` characters.
    The last messages of a conversation come together in one shuffle. One bad message among them rejects the conversation; the reason
    given is that of its earliest bad message, and a role fault precedes a
    blank text, which precedes a wrong last speaker.
    """
    fault = _faults()
    late = fault == "siste ikke fra bruker"
    entry = F.when(fault.isNotNull(), F.struct(late.alias("late"), F.col("turn"), fault.alias("grunn")))
    first = F.min(entry).over(Window.partitionBy("conv_id"))
    judged = recent_messages(messages, keep).withColumn("grunn", first["grunn"])
    too_long = (F.char_length("text") > longest).alias("for_lang")
    valid = judged.filter("grunn is null").select("conv_id", "turn", "role", "text", too_long, "fra_slutt")
    return valid, judged.filter("grunn is not null").select("conv_id", "grunn").distinct()


def rate_windows(events: DataFrame, limit: int = 60, width: str = "1 minute", watermark: str | None = None,
                 client: str = "user_id", endpoint: str = "event_type", ts: str = "ts") -> DataFrame:
    """Requests per client, endpoint and tumbling window, and whether they exceed the limit.

    Works on a stream when ``watermark`` is given. The counts are partial sums
    before the shuffle, so a client with most of the traffic costs no more.
    """
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if watermark:
        stamped = stamped.withWatermark("_ts", watermark)
    counted = stamped.groupBy(F.window("_ts", width).alias("w"), F.col(client), F.col(endpoint)).agg(
        F.count(F.lit(1)).alias("antall")
    )
    over = F.greatest(F.col("antall") - limit, F.lit(0))
    return counted.select(
        F.col("w.start").alias("vindu"), client, endpoint, "antall", over.alias("avvist"),
        (F.col("antall") > limit).alias("over_grensen"),
    )
