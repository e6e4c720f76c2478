"""Routing and remediation of inspected content as expressions: kinds, limits, status, replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import tables as T

TEXT_LIMIT, ASSET_LIMIT, IMAGE_LIMIT, BYTE_LIMIT = 200_000, 32, 100, 24_000_000


def media_kind(content_type: Column, name: Column) -> Column:
    """audio, gif, video or null of an attachment: by its type, by its name where the type says nothing."""
    kind, file = F.coalesce(content_type, F.lit("")), F.coalesce(name, F.lit(""))
    open_ = (kind == "") | (kind == "application/octet-stream")
    gif = (kind == "image/gif") | (~F.startswith(kind, F.lit("image/")) & file.rlike(r"(?i)\.gif$"))
    return (
        F.when(gif, "gif").when(F.startswith(kind, F.lit("audio/")), "audio").when(F.startswith(kind, F.lit("video/")), "video")
        .when(open_ & file.rlike(T.AUDIO_NAMES), "audio").when(open_ & file.rlike(T.VIDEO_NAMES), "video")
    )


def surface_text(kind: Column, name: Column, topic: Column, details: Column) -> Column:
    """Text of a surface by its kind: names of members, names and topics of channels, names and details of the rest."""
    return F.when(kind == "member", name).when(kind == "channel", F.concat_ws("\n", name, topic)).otherwise(F.concat_ws("\n", name, details))


def within_limits(assets: DataFrame) -> DataFrame:
    """``assets`` (message, place, kind, bytes) with issue: the first limit that the asset breaks, in order, or null."""
    order = Window.partitionBy("message").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    count = F.count("*").over(order)
    images = F.count_if(F.col("kind") == "image").over(order)
    size = F.sum("bytes").over(order)
    issue = F.when(count > ASSET_LIMIT, "asset limit").when((F.col("kind") == "image") & (images > IMAGE_LIMIT), "image limit").when(size > BYTE_LIMIT, "byte limit exceeds")
    return assets.withColumn("issue", issue)


def clipped(text: Column, most: int = TEXT_LIMIT) -> Column:
    """Struct of a text cut to the limit, and the issue if it was."""
    return F.struct(F.substring(text, 1, most).alias("text"), F.when(F.length(text) > most, "text limit exceeds").alias("issue"))


def status(hits: list[Column], issues: Column) -> Column:
    """Struct of an inspection: the first hit makes it a spoiler; else issues leave it unscanned; else it is clean."""
    hit = F.coalesce(*hits)
    return F.struct(F.when(hit.isNotNull(), "spoiler").when(F.size(issues) > 0, "unscanned").otherwise("clean").alias("status"), hit.alias("hit"), F.array_distinct(issues).alias("issues"))


def remedy(kind: Column, may_delete: Column, may_rename: Column) -> Column:
    """What is done about a spoiler by kind and permission, or ``report``."""
    return F.when(kind.isin("message", "reaction") & may_delete, "delete").when(kind.isin("member", "channel", "role", "emoji") & may_rename, "rename").otherwise("report")


def safe_name(candidates: Column, hits: Column) -> Column:
    """First candidate whose hit is null."""
    return F.get(F.filter(F.arrays_zip(candidates.alias("c"), hits.alias("h")), lambda z: z["h"].isNull()), F.lit(0))["c"]


def shown_name(display: Column, account: Column, display_hit: Column, account_hit: Column, fixed: str = "member") -> Column:
    """A member's name after the check: the display name, else the account's, else a fixed one."""
    return F.when(display_hit.isNull(), display).when(account_hit.isNull(), account).otherwise(fixed)


def eligible(messages: DataFrame, own: str, exempt: DataFrame) -> DataFrame:
    """Messages (guild, author, channel) of a guild, not the bot's own, not in an exempt channel."""
    kept = messages.where(F.col("guild").isNotNull() & (F.col("author") != own))
    return kept.join(exempt.select("channel"), "channel", "left_anti")


def reactions_text(reactions: DataFrame) -> DataFrame:
    """(message, text): single-letter reactions of each message in order (message, place, name)."""
    letters = reactions.where(F.col("name").rlike("^[a-z]$"))
    return letters.groupBy("message").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda r: r["name"]), "").alias("text"))
