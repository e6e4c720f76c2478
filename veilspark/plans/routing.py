"""Queries of routing, remediation, judging and reporting operators over the test tables, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import dataset as P
from ..operators import derive as D
from ..operators import gates as G
from ..operators import replay as Y
from ..operators import streams as S
from . import matching as Q

#: Labels of a judge, and kinds of surfaces.
VERDICTS, KINDS = ["spoiler", "hint", "benign"], ["message", "reaction", "member", "channel", "role", "event"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _pick(values: list[str], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (at % len(values)).cast("int"))


def inspection_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of made-up inspections, one a document."""
    k = F.col("doc_id")
    hits = [F.when(k % 5 == 0, "first"), F.when(k % 7 == 0, F.lit(None)).when(k % 3 == 0, "second")]
    issues = F.array_compact(F.array(F.when(k % 2 == 0, "queue full"), F.when(k % 4 == 0, "queue full"), F.when(k % 11 == 0, "OCR timeout")))
    return _docs(spark, sf_dir).select("doc_id", G.status(hits, issues).alias("s")).select("doc_id", "s.status", "s.hit", F.array_join("s.issues", "|").alias("issues"))


def remedies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remedies by kind and permission, counted."""
    rows = _items(spark, sf_dir).select(_pick(KINDS, F.col("l_partkey")).alias("kind"), (F.col("l_suppkey") % 2 == 0).alias("may_delete"), (F.col("l_orderkey") % 3 == 0).alias("may_rename"))
    return rows.groupBy("kind", G.remedy(F.col("kind"), F.col("may_delete"), F.col("may_rename")).alias("remedy")).agg(F.count("*").alias("n"))


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First clean name of three, and the name shown of two, one row a customer."""
    k = F.col("c_custkey")
    hits = F.array(F.when(k % 2 == 0, "h"), F.when(k % 3 == 0, "h"), F.when(k % 5 == 0, "h"))
    names = F.array("c_name", "c_mktsegment", F.lit("name"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select(k.alias("id"), G.safe_name(names, hits).alias("safe"), G.shown_name(F.col("c_name"), F.col("c_mktsegment"), F.get(hits, F.lit(0)), F.get(hits, F.lit(1))).alias("shown"))


def eligible_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that are looked at: of a guild, not the system's, not in an exempt channel."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = talks.select(F.when(F.col("conv_id") % 9 != 0, F.col("conv_id") % 3).alias("guild"), F.col("role").alias("author"), F.col("conv_id").alias("channel"), "turn")
    exempt = talks.where("conv_id % 4 = 0").select(F.col("conv_id").alias("channel")).distinct()
    return G.eligible(rows, "system", exempt).select("channel", "turn", "guild", "author")


def reaction_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-letter reactions of each user's events in order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise(F.substring("event_type", 1, 1))
    return G.reactions_text(events.select(F.col("user_id").alias("message"), F.col("event_id").alias("place"), name.alias("name")))


def clipped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut to 500 characters, and whether they were longer."""
    return _docs(spark, sf_dir).select("doc_id", G.clipped(F.col("text"), 500).alias("c")).select("doc_id", F.md5(F.col("c.text").cast("binary")).alias("text_md5"), F.coalesce("c.issue", F.lit("none")).alias("issue"))


def surface_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of made-up surfaces, one a part."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("kind", _pick(KINDS, F.col("p_partkey")))
    topic, details = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")), F.col("p_brand")
    return rows.select("p_partkey", "kind", G.surface_text(F.col("kind"), F.col("p_name"), topic, details).alias("text"))


def verdict_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities, best label and deletion of made-up verdicts, one a document."""
    k = F.col("doc_id")
    rows = _docs(spark, sf_dir).select(k, _pick(VERDICTS, k).alias("verdict"), ((k % 100) / 100.0).alias("confidence"), (k % 13 == 0).alias("refused"))
    rows = rows.withColumn("s", P.scores(F.col("verdict"), F.col("confidence"), F.col("refused"), VERDICTS))
    return rows.select(
        "doc_id", *[F.round(F.element_at("s", F.lit(v)), 6).alias(f"p_{v}") for v in VERDICTS],
        P.best_label(F.col("s"), VERDICTS).alias("best"), P.deleted(F.col("verdict"), F.col("confidence")).alias("deleted"),
    )


def date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of every event and the two before it, in UTC, counted."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    days = events.select(F.explode(P.selected_dates(F.col("ts").cast("timestamp"), "UTC", 2)).alias("day"))
    return days.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def example_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples out of made-up JSON responses, one an answer."""
    a = D.benchmark_answers(spark, sf_dir)
    examples = F.array(*[F.struct(F.concat(F.lit(f"{label}: "), "answer").alias("text"), F.lit(label).alias("label"), F.lit(style).alias("style")) for label, style in (("direct", "plain"), ("weak_hint", "rhyme"), ("benign", "chat"))])
    return P.parse_examples(a.select("answer", F.to_json(F.struct(examples.alias("examples"))).alias("response")), F.col("answer"))


def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the prompt of every turn with the turn before it."""
    from pyspark.sql import Window

    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    before = F.lag(F.struct(F.coalesce("role", F.lit("")).alias("author"), F.coalesce("text", F.lit("")).alias("text"))).over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = talks.withColumn("context", F.array_compact(F.array(before)))
    return rows.select("conv_id", "turn", F.md5(P.prompt(F.coalesce("text", F.lit("")), F.col("context"), F.lit("crane")).cast("binary")).alias("prompt"))


def overload_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up inspections that a queue rejected or let expire."""
    k = F.col("doc_id")
    issues = F.array_compact(F.array(F.when(k % 6 == 0, "queue full"), F.when(k % 10 == 3, "queue expired")))
    return Y.overload(_docs(spark, sf_dir).select(issues.alias("issues")))


def run_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of made-up generation runs, one an order."""
    k = F.col("o_orderkey")
    cost = Y.run_cost(k % 50, k % 700, k % 2 == 0, k % 3 == 0, 3.0, 15.0)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("id"), F.round(cost, 9).alias("cost"))


def batch_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of batches of 64 made-up queries, loss and accuracy beside them."""
    k = F.col("event_id")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return Y.batch_seconds(events.select(k.alias("place"), (k % 10).alias("seconds")), 64)


def loss_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of batch losses and accuracy over made-up predictions."""
    k = F.col("event_id")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return Y.accuracy(events.select((k % 8).alias("batch"), ((k % 8) / 4.0).alias("loss"), (k % 3).alias("label"), (k % 6).alias("predicted")))


def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two latest events of each user and kind."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("case"), F.col("event_id").alias("at"))
    return Y.newest_runs(rows, 2)


def letter_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single letters, digits and signs of every document, in order, where there are any."""
    docs = D.pinned(_docs(spark, sf_dir).select("doc_id", "text"), t=X.tokens(X.fold_letters(F.col("text"))))
    return docs.select("doc_id", S.letter_stream(F.col("t")).alias("stream")).where(F.col("stream") != "")


QUERIES = {f.__name__: f for f in (
    inspection_status, remedies, safe_names, eligible_turns, reaction_words, clipped_texts, surface_texts, verdict_scores, date_window, example_parse,
    judge_prompts, overload_counts, run_costs, batch_times, loss_accuracy, newest_runs, letter_streams,
)}


def _at(values: list[str], at: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{at} % {len(values)} + 1]"


ORACLES = {
    "inspection_status": """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'first' WHEN doc_id % 7 <> 0 AND doc_id % 3 = 0 THEN 'second' END AS hit,
        concat_ws('|', CASE WHEN doc_id % 2 = 0 THEN 'queue full' END, CASE WHEN doc_id % 11 = 0 THEN 'OCR timeout' END) AS issues FROM documents)
      SELECT doc_id, CASE WHEN hit IS NOT NULL THEN 'spoiler' WHEN issues <> '' THEN 'unscanned' ELSE 'clean' END AS status, hit, issues FROM r""",
    "remedies": f"""WITH r AS (SELECT {_at(KINDS, 'l_partkey')} AS kind, l_suppkey % 2 = 0 AS d, l_orderkey % 3 = 0 AS m FROM lineitem)
      SELECT kind, CASE WHEN d AND kind IN ('message', 'reaction') THEN 'delete' WHEN m AND kind IN ('member', 'channel', 'role', 'emoji') THEN 'rename' ELSE 'report' END AS remedy, count(*) AS n FROM r GROUP BY ALL""",
    "safe_names": """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 <> 0 THEN c_name WHEN c_custkey % 3 <> 0 THEN c_mktsegment WHEN c_custkey % 5 <> 0 THEN 'name' END AS safe,
      CASE WHEN c_custkey % 2 <> 0 THEN c_name WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE 'member' END AS shown FROM customer""",
    "eligible_turns": "SELECT conv_id AS channel, turn, conv_id % 3 AS guild, role AS author FROM conversations WHERE conv_id % 9 <> 0 AND role <> 'system' AND conv_id % 4 <> 0",
    "reaction_words": """SELECT user_id AS message, string_agg(n, '' ORDER BY event_id) AS text FROM (SELECT user_id, event_id, CASE WHEN event_id % 4 = 0 THEN event_type ELSE event_type[1] END AS n FROM events)
      WHERE regexp_full_match(n, '[a-z]') GROUP BY 1""",
    "clipped_texts": "SELECT doc_id, md5(substr(text, 1, 500)) AS text_md5, CASE WHEN length(text) > 500 THEN 'text limit exceeds' ELSE 'none' END AS issue FROM documents",
    "surface_texts": f"""WITH r AS (SELECT *, {_at(KINDS, 'p_partkey')} AS kind, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS topic FROM part)
      SELECT p_partkey, kind, CASE kind WHEN 'member' THEN p_name WHEN 'channel' THEN concat_ws(chr(10), p_name, topic) ELSE concat_ws(chr(10), p_name, p_brand) END AS text FROM r""",
    "verdict_scores": f"""WITH r AS (SELECT doc_id, {_at(VERDICTS, 'doc_id')} AS v, (doc_id % 100) / 100.0::DOUBLE AS c, doc_id % 13 = 0 AS x FROM documents),
      s AS (SELECT *, {', '.join(f"CASE WHEN x THEN {1.0 if v == 'benign' else 0.0} WHEN v = '{v}' THEN c ELSE (1 - c) / 2 END::DOUBLE AS p_{v}" for v in VERDICTS)} FROM r)
      SELECT doc_id, {', '.join(f'round(p_{v}, 6) AS p_{v}' for v in VERDICTS)}, CASE WHEN p_spoiler >= p_hint AND p_spoiler >= p_benign THEN 'spoiler' WHEN p_hint >= p_benign THEN 'hint' ELSE 'benign' END AS best,
        (v = 'spoiler' AND c >= 0.5) OR (v = 'hint' AND c >= 0.7) AS deleted FROM s""",
    "date_window": "SELECT strftime(CAST(ts AS DATE) - CAST(b AS INTEGER), '%Y-%m-%d') AS day, count(*) AS n FROM events, unnest(range(0, 3)) AS u(b) GROUP BY 1",
    "example_parse": f"""WITH {Q.ANSWERS_SQL} SELECT answer || '-0' || i AS id, ['direct', 'weak_hint', 'benign'][i + 1] || ': ' || answer AS text, ['direct', 'weak_hint', 'benign'][i + 1] AS label,
      ['plain', 'rhyme', 'chat'][i + 1] AS style FROM answers, unnest(range(0, 3)) AS u(i)""",
    "judge_prompts": """WITH r AS (SELECT conv_id, turn, coalesce(text, '') AS t, lag(coalesce(role, '') || ': ' || coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
      SELECT conv_id, turn, md5('Answer: crane' || chr(10) || coalesce('Context:' || chr(10) || b || chr(10), '') || 'Message: ' || t) AS prompt FROM r""",
    "overload_counts": "SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 6 = 0) AS rejected, count(*) FILTER (WHERE doc_id % 10 = 3) AS expired FROM documents",
    "run_costs": """SELECT o_orderkey AS id, round((o_orderkey % 50) * ((o_orderkey % 700) * 3.0::DOUBLE + CASE WHEN o_orderkey % 2 = 0 THEN 45 ELSE 120 END * 15.0::DOUBLE) / 1e6 / CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END, 9) AS cost FROM orders""",
    "batch_times": "SELECT event_id // 64 AS batch, CAST(sum(event_id % 10) AS BIGINT) AS seconds FROM events GROUP BY 1",
    "loss_accuracy": "SELECT (SELECT avg(b / 4.0::DOUBLE) FROM (SELECT DISTINCT event_id % 8 AS b FROM events)) AS loss, count(*) FILTER (WHERE event_id % 3 = event_id % 6) / count(*) AS accuracy FROM events",
    "newest_runs": """SELECT "case", "at" FROM (SELECT user_id || ':' || event_type AS "case", event_id AS "at", row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 2""",
    "letter_streams": rf"""WITH t AS (SELECT doc_id, {Q._tokens(Q._fold('text'))} AS t FROM documents),
      s AS (SELECT doc_id, array_to_string(list_transform(list_filter(t, lambda x: regexp_full_match(x, '[a-z0-9@$!|+]|[a-z][0-9]{{1,2}}|[0-9]{{1,2}}[a-z]')), lambda x: CASE WHEN length(x) = 1 THEN x ELSE regexp_replace(x, '[0-9]', '', 'g') END), '') AS stream FROM t)
      SELECT * FROM s WHERE stream <> ''""",
}
