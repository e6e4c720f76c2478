"""Keyed tables in Parquet: append, newest first, update by key; answers by date; change streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HOSTS = ["cdn.discordapp.com", "media.discordapp.net"]  # fixed values: hosts of attachments
CHANGES = "op string, channel bigint, id decimal(20,0), version bigint, author string, text string, ts timestamp"


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def newest(rows: DataFrame, most: int = 500) -> DataFrame:
    """The newest rows by ts, ties by id: a top-k that each task cuts first."""
    return rows.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(most)


def upsert(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with the non-null values of ``changes`` (one row a key) in place of theirs; unknown keys change nothing."""
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in changes.columns if c != key])
    joined = rows.join(new, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c != key and c in changes.columns else F.col(c) for c in rows.columns])


def with_cache(days: DataFrame, cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """(date, solution) of all days in order: the cache's, else the newly fetched; a malformed one is null."""
    both = cache.select("date", "solution").unionByName(fetched.select("date", "solution").join(cache.select("date"), "date", "left_anti"))
    good = F.when(F.col("solution").rlike("^[a-z]{5}$"), F.col("solution"))
    return days.join(both, "date", "left").select("date", good.alias("solution")).orderBy("date")


def answers_for(dates: Column, table: DataFrame, spark: SparkSession) -> DataFrame:
    """(answer_ord, answer) of the selected dates, newest first; none at all if any date has no valid answer."""
    days = spark.range(1).select(F.posexplode(dates).alias("answer_ord", "date"))
    joined = days.join(table, "date", "left").select("answer_ord", F.when(F.col("solution").rlike("^[a-z]{5}$"), F.col("solution")).alias("answer"))
    whole = joined.agg(F.count_if(F.col("answer").isNull()).alias("gaps"))
    return joined.join(F.broadcast(whole), F.col("gaps") == 0).select("answer_ord", "answer")


def fetchable(url: Column, hosts: list[str] = HOSTS) -> Column:
    """True for an HTTPS address of an allowed host, without credentials or port."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    plain = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https"
    bare = F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))) == host
    return F.coalesce(plain & bare & host.isin(hosts), F.lit(False))


def gif_links(text: Column) -> Column:
    """Words that links to GIF pages carry in their paths, one string a link."""
    links = F.regexp_extract_all(text, F.lit(r"https?://(?:www\.)?(?:tenor\.com/view|giphy\.com/gifs|giphy\.com/clips)/([A-Za-z0-9%-]+)"), F.lit(1))
    return F.transform(links, lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, "-[A-Za-z0-9]*[0-9][A-Za-z0-9]*$", ""), "-", " ")))


def changes(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of create, update and delete events from JSON files."""
    reader = spark.readStream.schema(CHANGES)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.json(path)
