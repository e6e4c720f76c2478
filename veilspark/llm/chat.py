"""Chat formatting of preference pairs: common prompt, paired completions, loss masks (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Template of one turn around its role and text, and the role whose turns are trained on.
OPEN, MIDDLE, CLOSE, LEARNT = "<|", "|>\n", "<|end|>\n", "assistant"


def rendered(role: Column, text: Column) -> Column:
    """One turn in the template; a null role is ``unknown``, a null text empty, and ``<|`` inside them is written with a backslash between."""
    return F.concat(F.lit(OPEN), _safe(role, "unknown"), F.lit(MIDDLE), _safe(text, ""), F.lit(CLOSE))


def _safe(part: Column, none: str) -> Column:
    """A role or text that can't be taken for the template's marks."""
    return F.replace(F.coalesce(part, F.lit(none)), F.lit(OPEN), F.lit("<\\|"))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """One row a pair from (pair_id, chosen boolean, turn, role, text).

    Turns of a side are ordered by turn, then role and text (nulls first). ``n_common`` is the length of the
    longest common turn prefix (role and text equal, null equal to null only); ``prompt`` renders it once, ``chosen`` and
    ``rejected`` render what follows on each side. A mask is an array of (start, end) code points of its completion on
    which the loss counts: text and end mark of each assistant turn; everything else, the
    prompt too, is masked. Equal sides have empty completions; a side without turns is null, its
    mask too, and nothing is common then. Rows with a null pair_id or side belong to no pair and are left out; an empty table
    gives no rows. A conversation's turns meet in the one row that holds them; offsets are running sums, so long ones take linear time.
    """
    side = Window.partitionBy("pair_id", "chosen").orderBy(F.col("turn"), F.col("role"), F.col("text"))
    rows = turns.where(F.col("pair_id").isNotNull() & F.col("chosen").isNotNull())
    rows = rows.withColumn("body", rendered(F.col("role"), F.col("text"))).withColumn("at", F.row_number().over(side))
    rows = rows.withColumn("end", F.sum(F.length("body").cast("long")).over(side.rowsBetween(Window.unboundedPreceding, 0)))
    head = F.length(F.concat(F.lit(OPEN), _safe(F.col("role"), "unknown"), F.lit(MIDDLE)))
    begin = F.col("end") - F.length("body") + head
    learnt = F.coalesce(F.col("role") == LEARNT, F.lit(False))
    turn = F.struct("at", "body", "end", begin.alias("begin"), learnt.alias("learnt"), "role", "text")

    def equal(i: Column) -> Column:
        c, r = F.get("c", i - 1), F.get("r", i - 1)
        return c["role"].eqNullSafe(r["role"]) & c["text"].eqNullSafe(r["text"])

    def of(chosen: bool) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("chosen") == chosen, turn)))

    pairs = rows.groupBy("pair_id").agg(of(True).alias("c"), of(False).alias("r"))
    shortest = F.least(F.size("c"), F.size("r"))
    same = F.aggregate(
        F.when(shortest > 0, F.sequence(F.lit(1), shortest)).otherwise(F.array().cast("array<int>")), F.lit(0),
        lambda n, i: F.when((n == i - 1) & equal(i), i).otherwise(n),
    )
    pairs = pairs.withColumn("n", same)
    skipped = F.coalesce(F.get("c", F.col("n") - 1)["end"], F.lit(0).cast("long"))
    pairs = pairs.withColumn("skip", F.when(F.col("n") > 0, skipped).otherwise(F.lit(0).cast("long")))

    def text(turns_: Column) -> Column:
        return F.array_join(F.transform(turns_, lambda t: t["body"]), "")

    def completion(name: str, own: str) -> list[Column]:
        rest = F.filter(own, lambda t: t["at"] > F.col("n"))
        mask = F.transform(F.filter(rest, lambda t: t["learnt"]), lambda t: F.struct((t["begin"] - F.col("skip")).alias("start"), (t["end"] - 1 - F.col("skip")).alias("end")))
        there = F.size(own) > 0
        return [F.when(there, text(rest)).alias(name), F.when(there, mask).alias(f"{name}_mask")]

    prompt = text(F.filter("c", lambda t: t["at"] <= F.col("n")))
    return pairs.select("pair_id", F.col("n").cast("long").alias("n_common"), prompt.alias("prompt"), *completion("chosen", "c"), *completion("rejected", "r"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as preference pairs: of ids 2k and 2k + 1 the even one is chosen, the odd one rejected."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    odd = F.pmod("conv_id", F.lit(2))
    turns = talks.select(F.expr("(conv_id - pmod(conv_id, 2)) div 2").alias("pair_id"), (odd == 0).alias("chosen"), "turn", "role", "text")
    pairs = preference_pairs(turns)

    def flat(mask: str) -> Column:
        return F.array_join(F.transform(mask, lambda m: F.concat_ws(":", m["start"], m["end"])), ",").alias(mask)

    return pairs.select("pair_id", "n_common", "prompt", "chosen", flat("chosen_mask"), "rejected", flat("rejected_mask"))


SQL = """
WITH t AS (
  SELECT (conv_id - (conv_id % 2 + 2) % 2) // 2 AS pair_id, (conv_id % 2 + 2) % 2 AS side,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS ord,
         replace(coalesce(role, 'unknown'), '<|', '<' || chr(92) || '|') AS role, role AS raw, text,
         '<|' || replace(coalesce(role, 'unknown'), '<|', '<' || chr(92) || '|') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '<' || chr(92) || '|') || '<|end|>' || chr(10) AS body
  FROM conversations WHERE conv_id IS NOT NULL
), e AS (
  SELECT *, sum(length(body)) OVER (PARTITION BY pair_id, side ORDER BY ord) AS stop FROM t
), m AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id,
         coalesce(min(CASE WHEN c.ord IS NULL OR r.ord IS NULL OR c.raw IS DISTINCT FROM r.raw OR c.text IS DISTINCT FROM r.text THEN coalesce(c.ord, r.ord) END) - 1, max(c.ord)) AS n
  FROM (SELECT * FROM e WHERE side = 0) c FULL JOIN (SELECT * FROM e WHERE side = 1) r
    ON c.pair_id = r.pair_id AND c.ord = r.ord
  GROUP BY 1
), k AS (
  SELECT m.pair_id, m.n, coalesce(max(e.stop) FILTER (WHERE e.side = 0 AND e.ord <= m.n), 0) AS skip
  FROM m JOIN e ON e.pair_id = m.pair_id GROUP BY 1, 2
), f AS (
  SELECT e.*, k.n, CAST(e.stop - length(e.body) + length(e.role) + 5 - k.skip AS BIGINT) AS s, CAST(e.stop - 1 - k.skip AS BIGINT) AS z
  FROM e JOIN k ON e.pair_id = k.pair_id
)
SELECT pair_id, CAST(any_value(n) AS BIGINT) AS n_common,
  coalesce(string_agg(body, '' ORDER BY ord) FILTER (WHERE side = 0 AND ord <= n), '') AS prompt,
  CASE WHEN count(*) FILTER (WHERE side = 0) > 0 THEN coalesce(string_agg(body, '' ORDER BY ord) FILTER (WHERE side = 0 AND ord > n), '') END AS chosen,
  CASE WHEN count(*) FILTER (WHERE side = 0) > 0 THEN coalesce(string_agg(s || ':' || z, ',' ORDER BY ord) FILTER (WHERE side = 0 AND ord > n AND raw = 'assistant'), '') END AS chosen_mask,
  CASE WHEN count(*) FILTER (WHERE side = 1) > 0 THEN coalesce(string_agg(body, '' ORDER BY ord) FILTER (WHERE side = 1 AND ord > n), '') END AS rejected,
  CASE WHEN count(*) FILTER (WHERE side = 1) > 0 THEN coalesce(string_agg(s || ':' || z, ',' ORDER BY ord) FILTER (WHERE side = 1 AND ord > n AND raw = 'assistant'), '') END AS rejected_mask
FROM f GROUP BY pair_id
"""
