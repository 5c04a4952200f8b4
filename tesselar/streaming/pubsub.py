"""Channels and mirrors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.partition import sha1_shard


def channel_shard(channel: Column, shards: int) -> Column:
    """Every notification of a channel goes to one shard."""
    return sha1_shard(channel, shards)


def mirror(df: DataFrame, transaction: str, exposure: float) -> DataFrame:
    """Whole transactions, about `exposure` of them: by the hash of their key, so every task and run chooses alike."""
    return df.where(F.conv(F.right(F.sha1(F.col(transaction).cast("string").cast("binary")), F.lit(8)), 16, 10).cast("long") % 1_000_000 < round(exposure * 1_000_000))


def tee(df: DataFrame, main: str, second: str, transaction: str, exposure: float, kinds: Column | None = None) -> None:
    """Writes all rows to main, and to second the mirrored transactions whose rows satisfy `kinds`; a failure of the second does not touch the first."""
    df.write.parquet(main)
    chosen = mirror(df.sparkSession.read.schema(df.schema).parquet(main), transaction, exposure)
    (chosen if kinds is None else chosen.where(kinds)).write.parquet(second)


def notify(messages: DataFrame, listening: DataFrame) -> DataFrame:
    """Messages (channel, payload, transaction, committed) that each listener (listener, channel) gets: those of committed transactions, on all its channels."""
    return messages.where("committed").join(listening, "channel").select("listener", "channel", "payload")
