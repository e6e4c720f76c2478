"""Labelled examples as JSON Lines: read with checks, write flat, stamp, and JSON-array ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as S

LABELS = ["direct", "strong_hint", "weak_hint", "benign"]
_KNOWN = ["id", "answer", "text", "label", "style", "detector_hit", "context"]
_CONTEXT = "array<struct<author:string,text:string>>"


def read_examples(spark: SparkSession, *paths: str) -> DataFrame:
    """(id, answer, text, label, style, detector_hit, context, extra) of JSON Lines files; blank lines are skipped.

    Other keys go to ``extra`` as text. A missing detector_hit, an unknown label or an id that occurs
    twice is an error; the check is one aggregate over the ids.
    """
    lines = spark.read.text(list(paths)).where(F.trim("value") != "")
    keys = F.from_json("value", "map<string,string>")
    row = F.from_json("value", f"id string, answer string, text string, label string, style string, detector_hit boolean, context {_CONTEXT}")
    out = lines.select(row.alias("r"), F.map_filter(keys, lambda k, v: ~k.isin(_KNOWN)).alias("extra")).select("r.*", "extra")
    out = out.withColumn("context", F.coalesce("context", F.array().cast(_CONTEXT)))
    bad = out.agg(
        F.count_if(F.col("detector_hit").isNull()).alias("unstamped"), F.count_if(~F.coalesce(F.col("label").isin(LABELS), F.lit(False))).alias("unlabelled"), F.count("*").alias("n")
    ).first()
    if bad.unstamped or bad.unlabelled:
        raise ValueError(f"{bad.unstamped} rows without detector_hit, {bad.unlabelled} with an unknown label")
    if not out.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("an id occurs twice")
    return out


def write_examples(examples: DataFrame, path: str) -> None:
    """JSON Lines with the keys of ``extra`` beside the known ones, not escaped to ASCII."""
    known = F.to_json(F.struct(*_KNOWN))
    more = F.to_json("extra")
    joined = F.when(F.size("extra") > 0, F.concat(F.substring(known, F.lit(1), F.length(known) - 1), F.lit(","), F.substring(more, F.lit(2), F.length(more)))).otherwise(known)
    examples.select(joined.alias("value")).write.mode("errorifexists").text(path)


def stamp(examples: DataFrame, hits: DataFrame) -> DataFrame:
    """Examples with detector_hit from a scan (id, hit); write the result to another path than it was read from."""
    return examples.drop("detector_hit").join(hits.select("id", F.col("hit").isNotNull().alias("detector_hit")), "id").select(*_KNOWN, "extra")


def read_array(spark: SparkSession, path: str, schema: str | S.StructType) -> DataFrame:
    """Rows of a JSON array: ledgers and evaluation cases."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def unseen(examples: DataFrame) -> DataFrame:
    """Examples that the rules let through."""
    return examples.where(~F.col("detector_hit"))
