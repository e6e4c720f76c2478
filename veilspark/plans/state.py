"""Queries of conversation state, metrics and dataset operators over the test tables, with SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import tables as T
from ..functions import text as X
from ..operators import conversation as V
from ..operators import dataset as P
from ..operators import derive as D
from ..operators import match as M
from ..operators import metrics as A
from . import matching as Q

DAY = 24 * 3_600_000


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages two minutes apart: channel, id, ms, author, text."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return talks.select(F.col("conv_id").alias("channel"), F.col("turn").alias("id"), (F.col("turn") * 120_000).alias("ms"), F.col("role").alias("author"), "text")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("user_id").alias("user"), F.col("event_id").alias("id"), V.millis(F.col("ts")).alias("ms"), "ts", "event_type", "value")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a made-up score from their length: id, label, style, score."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    label = F.when(F.col("toxic") == 0, "benign").when(F.col("quality") == 1, "direct").otherwise("weak_hint")
    both = docs.select("doc_id", "n_chars", "lang").join(labels, "doc_id")
    return both.select(F.col("doc_id").alias("id"), label.alias("label"), F.col("lang").alias("style"), ((F.col("n_chars") % 100) / 100.0 + F.col("toxic") * 0.3).alias("score"))


def recent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages before each turn that are still in its context."""
    got = V.recent_context(_messages(spark, sf_dir), most=4)
    return got.select("channel", "id", F.array_join(F.transform("context", lambda i: i.cast("string")), ",").alias("context"))


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers sent in two or three messages to a channel each, noise before them."""
    a = D.benchmark_answers(spark, sf_dir)
    cut = F.array(F.lit("hello there friend"), F.substring("answer", 1, 2), F.substring("answer", 3, 1), F.substring("answer", 4, 2), F.lit("bye now everyone"))
    rows = a.select(F.col("answer_ord").alias("channel"), F.posexplode(cut).alias("id", "text"))
    return rows.select("channel", "id", (F.col("id") * 1000).cast("long").alias("ms"), V.fragment(X.fold_letters(F.col("text"))).alias("fragment"))


def fragment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers sent in pieces, found where the last piece arrives."""
    return V.fragment_join(_fragments(spark, sf_dir), D.benchmark_answers(spark, sf_dir))


def backlog_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest three events of each user, in time order."""
    rows = _events(spark, sf_dir).select(F.col("user").alias("channel"), "id", "ms")
    return V.backlog(rows, 3).select("channel", "id", F.col("place").cast("int").alias("place"))


def hot_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users who bought something in the day before."""
    rows = _events(spark, sf_dir).select(F.col("user").alias("channel"), "id", "ms", (F.col("event_type") == "purchase").alias("flag"))
    return V.hot(rows, "flag", DAY).select("channel", "id", "hot")


def suspicious_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each turn would be routed."""
    rows = _messages(spark, sf_dir).withColumn("suspect", V.suspicious(F.col("text")))
    rows = V.hot(rows, "suspect")
    no = F.lit(False)
    return rows.select("channel", "id", V.route(F.lit(True), no, no, F.col("suspect"), F.col("hot")).alias("route"))


def strike_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' strikes, cleared at every third within a day."""
    return V.strikes(_events(spark, sf_dir), DAY, 3).select("user", "id", "held", "fired")


def change_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose type differs from the user's last one."""
    return V.changed(_events(spark, sf_dir), "user", F.col("event_type").cast("string")).select("user", "id")


def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user and type, none where that is a refund-like one (type error)."""
    rows = _events(spark, sf_dir).select(F.col("user").alias("channel"), F.col("event_type").alias("id"), F.col("id").alias("version"), F.when(F.col("value") < 10, "delete").otherwise("update").alias("op"))
    return V.latest_versions(rows).select("channel", "id", "version")


def alert_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up issues of events, rolled up by user and day."""
    rows = _events(spark, sf_dir)
    issues = F.when(F.col("value") > 50, F.array(F.concat(F.lit("queue "), "event_type"), F.lit("download failed"))).otherwise(F.array().cast("array<string>"))
    rows = rows.select(F.col("user").alias("guild"), F.col("ts").cast("timestamp").alias("ts"), "id", issues.alias("issues"))
    got = V.alert_rollup(rows, "1 day")
    reasons = F.array_join(F.transform("reasons", lambda r: F.concat_ws("=", r["reason"], r["c"])), ";")
    return got.select("guild", V.millis(F.col("start")).alias("start_ms"), "n", reasons.alias("reasons"), F.array_join(F.transform("samples", lambda i: i.cast("string")), ",").alias("samples"))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every label."""
    return A.label_counts(_outcomes(spark, sf_dir))


def threshold_at_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold that deletes 500 of 10,000 benign rows at most."""
    return A.threshold_at_budget(_outcomes(spark, sf_dir), 500)


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and false positives at 0.8."""
    return A.rates(_outcomes(spark, sf_dir), 0.8)


def group_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted share by style at 0.8."""
    return A.breakdown(_outcomes(spark, sf_dir), "style", 0.8)


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operating curve over all scores."""
    return A.curve(_outcomes(spark, sf_dir))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear percentiles of batch latencies: 50 events a batch."""
    batches = _events(spark, sf_dir).groupBy(F.floor(F.col("id") / 50).alias("b")).agg(F.sum("value").alias("s"))
    return batches.agg(F.percentile("s", 0.5).alias("p50"), F.percentile("s", 0.95).alias("p95"))


def eval_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of event values by type."""
    return _events(spark, sf_dir).groupBy("event_type").agg(*A.nearest_rank("value", [], {"p50": 0.5, "p95": 0.95}))


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a made-up evaluation: toxic labels are attacks, scores above 0.8 removals."""
    rows = _outcomes(spark, sf_dir)
    none, own = F.array().cast("array<bigint>"), F.array("id")
    cases = rows.select("id", F.when(F.col("label") != "benign", own).otherwise(none).alias("expected"), F.when(F.col("score") > 0.8, own).otherwise(none).alias("removed"), (F.col("id") % 7 != 0).alias("complete"), F.col("score").alias("latency"))
    return A.eval_summary(cases)


def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of made-up requests, one a customer, and null for a model without a price."""
    who = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    held = F.when(k % 11 == 0, F.lit(None)).otherwise(k % 3)
    usage = who.select(
        k.alias("id"), F.when(k % 5 == 0, "other").when(k % 5 == 1, "small-2024").when(k % 5 == 2, "smaller").otherwise("small").alias("model"), F.when(k % 7 != 0, k % 1000).alias("input"),
        (k % 77).alias("output"), (k % 13).alias("cache_read"), held.alias("cache_write_5m"), (k % 2).alias("cache_write_1h"), (F.coalesce(held, F.lit(0)) + k % 2).alias("cache_write"),
    )
    prices = spark.createDataFrame([("small", 1.0, 5.0, 0.1, 1.25, 2.0)], "model string, input double, output double, cache_read double, cache_write_5m double, cache_write_1h double")
    return A.token_cost(usage, prices)


def pair_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of answer and benign document that an exact hit would flag, and all pairs, by language."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    benign = docs.join(labels.where("toxic = 0").select("doc_id"), "doc_id").select("doc_id", "lang", "text")
    answers = D.benchmark_answers(spark, sf_dir)
    seen = benign.select("doc_id", "lang", F.explode(F.array_distinct(X.tokens(X.fold_letters(F.col("text"))))).alias("token"))
    both = D.exact_forms(answers).unionByName(D.inflections(answers)).select("form", "answer_ord").distinct()
    flagged = seen.join(D.small(both), F.col("token") == F.col("form")).select("doc_id", "lang", "answer_ord").distinct().groupBy("lang").agg(F.count("*").alias("flagged"))
    n = answers.count()
    pairs = benign.groupBy("lang").agg((F.count("*") * n).alias("pairs"))
    return pairs.join(flagged, "lang", "left").select("lang", "pairs", F.coalesce("flagged", F.lit(0)).alias("flagged"))


def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split by source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return P.grouped_split(docs, "source").select("doc_id", "split")


def leak_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, each a hint at one answer by its id, that don't name it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (F.col("doc_id") % 60 + 1).alias("answer_ord"))
    pairs = docs.join(D.small(D.benchmark_answers(spark, sf_dir)), "answer_ord")
    rows = pairs.select("answer", "doc_id", "text", F.array(F.struct(F.lit("x").alias("author"), F.lit("no such word").alias("text"))).alias("context"), F.lit("weak_hint").alias("label"))
    return P.leak_filter(rows).select("answer", "doc_id")


def missing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a quarter without an event."""
    have = _events(spark, sf_dir).select(F.to_date("ts").alias("date")).distinct()
    return P.missing_dates(P.calendar(spark, "2024-01-15", "2024-03-31"), have).select(F.date_format("date", "yyyy-MM-dd").alias("date"))


def attempt_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts made of conversations: one a conversation, its turns the messages."""
    talks = _messages(spark, sf_dir).groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("m"))
    rows = talks.select(
        F.col("channel").alias("id"), F.when(F.col("channel") % 4 == 0, "toolong").otherwise("WORDS").alias("word"), F.transform("m", lambda m: m["text"]).alias("messages"),
        F.lit(None).cast("string").alias("text"), F.when(F.col("channel") % 3 == 0, F.transform("m", lambda m: m["id"] % 2 == 0)).otherwise(F.array().cast("array<boolean>")).alias("deleted"),
        (F.col("channel") % 2 == 0).alias("caught"), F.when(F.col("channel") % 5 == 0, "innocent").alias("intent"), F.lit(" someone ").alias("nickname"),
    )
    got = P.attempts(rows, messages=3)
    return got.select("id", "word", F.size("messages").cast("long").alias("n_messages"), F.array_join(F.transform("deleted", lambda d: d.cast("string")), ",").alias("deleted"), "intent", "caught", "nickname")


def outcome_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of made-up attempts, one an event."""
    rows = _events(spark, sf_dir).select(F.when(F.col("event_type") == "view", "innocent").otherwise("leak").alias("intent"), (F.col("value") > 50).alias("caught"))
    return rows.groupBy(A.outcome(F.col("intent"), F.col("caught")).alias("outcome")).agg(F.count("*").alias("n"))


def top_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 40 purchases: a feed's first page."""
    rows = _events(spark, sf_dir).where(F.col("event_type") == "purchase")
    return rows.orderBy(F.col("ms").desc(), F.col("id").desc()).limit(40).select("id", "user", "ms")


def detector_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by language of direct rows caught at 0.8."""
    return A.detector_report(_outcomes(spark, sf_dir).withColumn("hit", F.col("score") > 0.8))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap intervals at 0.8."""
    return A.bootstrap(_outcomes(spark, sf_dir), 0.8)


def style_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six styles for each answer."""
    words = D.benchmark_answers(spark, sf_dir).select(F.col("answer").alias("word"))
    return P.style_plan(words, ["riddle", "rhyme", "anagram", "code"], 6).select("word", "slot", "style")


def systematic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A systematic sample of 10 answers at most."""
    return P.systematic(D.benchmark_answers(spark, sf_dir), ["answer_ord"], 10)


def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows flagged at 0.8 that aren't direct."""
    return A.false_positives(_outcomes(spark, sf_dir).withColumn("hit", F.col("score") > 0.8)).select("id", "label", "style")


def pass_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each label, and those that a threshold of 0.8 lets through."""
    return A.pass_through(_outcomes(spark, sf_dir).withColumn("hit", F.col("score") > 0.8))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attacks of the sweep as a ledger: two of three answers' are closed, caught ones are exact hits."""
    answers = D.benchmark_answers(spark, sf_dir)
    attacks = Q._attacks(answers)
    hits = M.exact(attacks, answers).select("true_ord", "disguise", "answer_ord")
    both = attacks.select("true_ord", "disguise").join(hits, ["true_ord", "disguise"], "left")
    return A.ledger(both.select(F.col("disguise").alias("technique"), (F.col("true_ord") % 3 != 0).alias("closed"), F.coalesce(F.col("answer_ord") == F.col("true_ord"), F.lit(False)).alias("caught")))


def word_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty of the answers."""
    return P.word_sample(D.benchmark_answers(spark, sf_dir).select(F.col("answer").alias("word")), 20)


def batch_rejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of answers and templates with the texts of their made-up results."""
    words = D.benchmark_answers(spark, sf_dir).select(F.col("answer").alias("word"))
    made = P.jobs(words, spark.createDataFrame([("riddle",), ("rhyme",)], "template string"))
    made = made.select(F.concat_ws("-", "word", "template").alias("custom_id"), "word", "template")
    results = made.select("custom_id", F.lit("succeeded").alias("type"), F.lit("end_turn").alias("stop_reason"), F.reverse("word").alias("text"))
    return P.rejoin(made, results)


def judge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the request to a judge for every benchmark text, the answers that it names as evidence."""
    bench, answers = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), D.benchmark_answers(spark, sf_dir)
    words = bench.select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("answer"))
    hints = words.join(D.small(answers), "answer").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct(F.lit("exact").alias("kind"), F.col("answer").alias("candidate")))).alias("evidence"))
    named = [r.answer for r in answers.where("answer_ord <= 5").orderBy("answer_ord").collect()]
    rows = bench.select("item_id", "text").join(hints, "item_id", "left")
    rows = rows.withColumn("evidence", F.coalesce("evidence", F.array().cast("array<struct<kind:string,candidate:string>>")))
    asked = rows.select("item_id", P.judge_request("Judge.", named, F.col("text"), F.col("evidence")).alias("r"))
    system = F.array_join(F.transform("r.system", lambda s: F.concat_ws("|", s["text"], s["cached"].cast("string"))), "|")
    return asked.select("item_id", F.md5(F.concat_ws("|", system, F.array_join("r.user", "|")).cast("binary")).alias("request"))


QUERIES = {f.__name__: f for f in (
    recent_context, fragment_join, backlog_latest, hot_gate, suspicious_turns, strike_fold, change_dedupe, latest_versions, alert_rollup, label_counts,
    threshold_at_budget, rates, group_breakdown, curve, latency_percentiles, eval_percentiles, eval_summary, token_cost, pair_sweep, grouped_split,
    leak_filter, missing_dates, attempt_normalize, outcome_tally, top_recent, detector_report, bootstrap_ci, style_plan, systematic_pairs,
    false_positives, pass_through, ledger, word_sample, batch_rejoin, judge_requests,
)}

_EV = "ev AS (SELECT user_id AS user, event_id AS id, epoch_us(ts) // 1000 AS ms, ts, event_type, value FROM events)"
_OUT = """o AS (SELECT d.doc_id AS id, CASE WHEN toxic = 0 THEN 'benign' WHEN quality = 1 THEN 'direct' ELSE 'weak_hint' END AS label, lang AS style,
  (n_chars % 100) / 100.0::DOUBLE + toxic * 0.3::DOUBLE AS score FROM documents d JOIN labels USING (doc_id))"""
_SUSPICIOUS = T.SUSPICIOUS.replace("'", "''")

ORACLES = {
    "recent_context": """WITH m AS (SELECT conv_id AS channel, turn AS id FROM conversations)
      SELECT a.channel, a.id, string_agg(b.id::VARCHAR, ',' ORDER BY b.id) AS context FROM m a JOIN m b ON a.channel = b.channel AND b.id <= a.id AND a.id - b.id < 4 GROUP BY 1, 2""",
    "fragment_join": f"""WITH {Q.ANSWERS_SQL}, c AS (SELECT answer_ord AS channel, ['hello there friend', answer[1:2], answer[3:3], answer[4:5], 'bye now everyone'] AS c FROM answers),
      m AS (SELECT channel, i - 1 AS id, (i - 1) * 1000 AS ms, regexp_replace(c[i], '[^a-z]', '', 'g') AS t FROM c, unnest(range(1, 6)) AS u(i)),
      f AS (SELECT channel, id, ms, row_number() OVER (PARTITION BY channel ORDER BY ms, id) AS r, CASE WHEN length(t) BETWEEN 1 AND 4 THEN t END AS t FROM m),
      j AS (SELECT e.channel, e.id AS end_id, k AS n, string_agg(b.t, '' ORDER BY b.r) AS joined, count(b.t) AS whole, e.ms - min(b.ms) AS took
        FROM f e, f b, unnest(range(2, 6)) AS u(k) WHERE b.channel = e.channel AND b.r BETWEEN e.r - k + 1 AND e.r GROUP BY e.channel, e.id, e.ms, k),
      h AS (SELECT channel, end_id, n, a.answer_ord, a.answer, row_number() OVER (PARTITION BY channel, end_id ORDER BY n) AS best FROM j JOIN answers a ON joined = a.answer WHERE whole = n AND took < {V.FRAGMENT_MS})
      SELECT channel, CAST(end_id AS INTEGER) AS end_id, CAST(n AS INTEGER) AS n, answer_ord, answer FROM h WHERE best = 1""",
    "backlog_latest": f"""WITH {_EV}, k AS (SELECT user AS channel, id, ms, row_number() OVER (PARTITION BY user ORDER BY ms DESC, id DESC) AS r FROM ev)
      SELECT channel, id, CAST(row_number() OVER (PARTITION BY channel ORDER BY ms, id) AS INTEGER) AS place FROM k WHERE r <= 3""",
    "hot_gate": f"""WITH {_EV}, k AS (SELECT user AS channel, id, ms, max(CASE WHEN event_type = 'purchase' THEN ms END) OVER (PARTITION BY user ORDER BY ms, id ROWS UNBOUNDED PRECEDING) AS l FROM ev)
      SELECT channel, id, coalesce(ms - l < {DAY}, false) AS hot FROM k""",
    "suspicious_turns": f"""WITH m AS (SELECT conv_id AS channel, turn AS id, turn * 120000 AS ms, coalesce(regexp_matches(text, '{_SUSPICIOUS}'), false) AS s FROM conversations),
      k AS (SELECT *, max(CASE WHEN s THEN ms END) OVER (PARTITION BY channel ORDER BY ms, id ROWS UNBOUNDED PRECEDING) AS l FROM m)
      SELECT channel, id, CASE WHEN s THEN 'suspicious' WHEN coalesce(ms - l < 600000, false) THEN 'hot' ELSE 'skip' END AS route FROM k""",
    "change_dedupe": f"WITH {_EV}, k AS (SELECT user, id, event_type, lag(event_type) OVER (PARTITION BY user ORDER BY ms, id) AS b FROM ev) SELECT user, id FROM k WHERE b IS DISTINCT FROM event_type",
    "latest_versions": f"WITH {_EV}, k AS (SELECT user AS channel, event_type AS id, id AS version, value, row_number() OVER (PARTITION BY user, event_type ORDER BY id DESC) AS r FROM ev) SELECT channel, id, version FROM k WHERE r = 1 AND NOT value < 10",
    "alert_rollup": f"""WITH {_EV}, g AS (SELECT user AS guild, epoch_ms(date_trunc('day', ts)) AS start_ms, id, CASE WHEN value > 50 THEN ['inspection queue', 'processing failure'] ELSE ['incomplete coverage'] END AS r FROM ev),
      c AS (SELECT guild, start_ms, reason, count(*) AS c FROM (SELECT guild, start_ms, unnest(r) AS reason FROM g) GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY guild, start_ms ORDER BY id) AS k FROM g)
      SELECT s.guild, s.start_ms, count(*) AS n, any_value(x.reasons) AS reasons, string_agg(s.id::VARCHAR, ',' ORDER BY s.id) FILTER (WHERE k <= 3) AS samples
      FROM s JOIN (SELECT guild, start_ms, string_agg(reason || '=' || c, ';' ORDER BY reason) AS reasons FROM c GROUP BY ALL) x USING (guild, start_ms) GROUP BY s.guild, s.start_ms""",
    "label_counts": f"WITH {_OUT} SELECT l AS label, count(o.id) AS n FROM unnest(['direct', 'strong_hint', 'weak_hint', 'benign']) AS u(l) LEFT JOIN o ON o.label = l GROUP BY 1",
    "threshold_at_budget": f"WITH {_OUT}, b AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS r, count(*) OVER () AS n FROM o WHERE label = 'benign') SELECT score AS threshold FROM b WHERE r = CAST(floor(n * 500 / 10000) AS BIGINT) + 1",
    "rates": f"WITH {_OUT} SELECT avg(CASE WHEN label <> 'benign' THEN (score > 0.8)::INT END) AS recall, avg(CASE WHEN label = 'benign' THEN (score > 0.8)::INT END) * 10000 AS fp_per_10k FROM o",
    "group_breakdown": f"WITH {_OUT} SELECT style, count(*) AS n, avg((score > 0.8)::INT) AS deleted FROM o GROUP BY style",
    "curve": f"""WITH {_OUT}, t AS (SELECT DISTINCT score AS threshold FROM o UNION SELECT -1.0::DOUBLE)
      SELECT threshold, count(*) FILTER (WHERE label <> 'benign' AND score > threshold) / (SELECT count(*) FROM o WHERE label <> 'benign') AS recall,
        count(*) FILTER (WHERE label = 'benign' AND score > threshold) / (SELECT count(*) FROM o WHERE label = 'benign') * 10000 AS fp_per_10k FROM t, o GROUP BY threshold""",
    "latency_percentiles": f"WITH {_EV}, b AS (SELECT id // 50 AS b, sum(value) AS s FROM ev GROUP BY 1) SELECT quantile_cont(s, 0.5) AS p50, quantile_cont(s, 0.95) AS p95 FROM b",
    "eval_percentiles": f"WITH {_EV}, k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM ev) SELECT event_type, max(value) FILTER (WHERE r = ceil(n * 0.5)) AS p50, max(value) FILTER (WHERE r = ceil(n * 0.95)) AS p95 FROM k GROUP BY 1",
    "eval_summary": f"""WITH {_OUT}, k AS (SELECT *, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS n FROM o)
      SELECT count(*) AS cases, count(*) FILTER (WHERE label <> 'benign') AS attacks, count(*) FILTER (WHERE label <> 'benign' AND NOT score > 0.8) AS missed, count(*) FILTER (WHERE label = 'benign' AND score > 0.8) AS false_deletions,
        count(*) FILTER (WHERE id % 7 = 0) AS incomplete, count(*) FILTER (WHERE label <> 'benign' AND score > 0.8) / count(*) FILTER (WHERE label <> 'benign') AS recall,
        max(score) FILTER (WHERE r = ceil(n * 0.5)) AS p50, max(score) FILTER (WHERE r = ceil(n * 0.95)) AS p95 FROM k""",
    "token_cost": """SELECT c_custkey AS id, CASE WHEN c_custkey % 5 IN (0, 2) OR c_custkey % 7 = 0 THEN NULL ELSE ((c_custkey % 1000) * 1.0::DOUBLE + (c_custkey % 77) * 5.0::DOUBLE + (c_custkey % 13) * 0.1::DOUBLE
      + CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE c_custkey % 3 END * 1.25::DOUBLE + (c_custkey % 2) * 2.0::DOUBLE) / 1e6 END AS cost FROM customer""",
    "false_positives": f"WITH {_OUT} SELECT id, label, style FROM o WHERE label <> 'direct' AND score > 0.8",
    "pass_through": f"WITH {_OUT} SELECT l AS label, count(o.id) AS n, count(o.id) FILTER (WHERE NOT score > 0.8) AS passed FROM unnest(['direct', 'strong_hint', 'weak_hint', 'benign']) AS u(l) LEFT JOIN o ON o.label = l GROUP BY 1",
    "ledger": f"""WITH {Q.ANSWERS_SQL}, {Q.ACCEPTED_SQL}, x AS ({Q._MADE_ATTACKS}), c AS (SELECT x.true_ord, disguise, true_ord % 3 <> 0 AS closed, coalesce(a.answer_ord = true_ord, false) AS caught FROM x LEFT JOIN accepted a ON token = form)
      SELECT disguise AS technique, count(*) AS total, count(*) FILTER (WHERE caught) AS caught, count(*) FILTER (WHERE closed AND NOT caught) AS lost, count(*) FILTER (WHERE NOT closed AND caught) AS won FROM c GROUP BY 1""",
    "word_sample": f"WITH {Q.ANSWERS_SQL} SELECT answer AS word FROM answers ORDER BY md5(answer || ':7'), answer LIMIT 20",
    "batch_rejoin": f"WITH {Q.ANSWERS_SQL} SELECT answer || '-' || t AS custom_id, answer AS word, t AS template, reverse(answer) AS text FROM answers, unnest(['riddle', 'rhyme']) AS u(t)",
    "judge_requests": f"""WITH {Q.ANSWERS_SQL}, {Q.ACCEPTED_SQL}, n AS (SELECT string_agg(upper(answer), ', ' ORDER BY answer_ord) AS n FROM answers WHERE answer_ord <= 5),
      t AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM benchmark), e AS (SELECT item_id, string_agg('exact: ' || w, chr(10) ORDER BY w) AS e FROM t JOIN answers ON w = answer GROUP BY 1)
      SELECT b.item_id, md5('Judge.|true|Protected answers: ' || n || '.|false|' || text || coalesce('|Evidence:' || chr(10) || e, '')) AS request FROM benchmark b LEFT JOIN e USING (item_id), n""",
    "pair_sweep": f"""WITH {Q.ANSWERS_SQL}, {Q.SEEN_SQL}, {Q.EXACT_SQL}, {Q.INFLECT_SQL}, f AS (SELECT DISTINCT form, answer_ord FROM (SELECT form, answer_ord FROM exact UNION ALL SELECT form, answer_ord FROM inflected)),
      b AS (SELECT d.doc_id, d.lang FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 0), h AS (SELECT DISTINCT b.doc_id, lang, answer_ord FROM b JOIN seen s ON s.doc_id = b.doc_id JOIN f ON s.token = f.form)
      SELECT lang, (SELECT count(*) FROM b x WHERE x.lang = b.lang) * (SELECT count(*) FROM answers) AS pairs, (SELECT count(*) FROM h WHERE h.lang = b.lang) AS flagged FROM b GROUP BY lang""",
    "grouped_split": """WITH s AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY md5(source || ':7'), source) AS r, count(*) OVER () AS n FROM s)
      SELECT doc_id, CASE WHEN r <= round_even(n * 0.2, 0) THEN 'test' WHEN r <= round_even(n * 0.2, 0) + round_even(n * 0.1, 0) THEN 'val' ELSE 'train' END AS split FROM documents JOIN r USING (source)""",
    "leak_filter": rf"""WITH {Q.ANSWERS_SQL} SELECT answer, doc_id FROM answers JOIN documents ON answer_ord = doc_id % 60 + 1 WHERE NOT regexp_matches(' ' || regexp_replace(lower(text), '[^\pL\pN_]+', '  ', 'g') || ' ', ' ' || answer || '(s|es|ed|d|ing|er|ers|ly|y)? ')""",
    "missing_dates": "SELECT strftime(d, '%Y-%m-%d') AS date FROM (SELECT unnest(generate_series(DATE '2024-01-15', DATE '2024-03-31', INTERVAL 1 DAY)) AS d) WHERE CAST(d AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events)",
    "attempt_normalize": """WITH m AS (SELECT conv_id AS id, turn, text, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE conv_id % 4 <> 0),
      k AS (SELECT id, turn, CASE WHEN id % 3 = 0 THEN turn % 2 = 0 ELSE id % 2 = 0 END AS d, row_number() OVER (PARTITION BY id ORDER BY turn) AS r FROM m WHERE trim(text) <> '')
      SELECT id, 'words' AS word, count(*) AS n_messages, string_agg(d::VARCHAR, ',' ORDER BY turn) AS deleted, CASE WHEN id % 5 = 0 THEN 'innocent' ELSE 'leak' END AS intent, bool_or(d) AS caught, 'someone' AS nickname FROM k WHERE r <= 3 GROUP BY id""",
    "outcome_tally": f"WITH {_EV} SELECT CASE WHEN event_type = 'view' AND value > 50 THEN 'false_alarm' WHEN event_type = 'view' THEN 'passed' WHEN value > 50 THEN 'caught' ELSE 'missed' END AS outcome, count(*) AS n FROM ev GROUP BY 1",
    "top_recent": f"WITH {_EV} SELECT id, user, ms FROM ev WHERE event_type = 'purchase' ORDER BY ms DESC, id DESC LIMIT 40",
    "detector_report": f"WITH {_OUT} SELECT style, count(*) AS n, count(*) FILTER (WHERE score > 0.8) AS caught, count(*) FILTER (WHERE score > 0.8) / count(*) AS recall FROM o WHERE label = 'direct' GROUP BY style",
    "style_plan": f"""WITH {Q.ANSWERS_SQL}, s AS (SELECT answer AS word, st, row_number() OVER (PARTITION BY answer ORDER BY md5(answer || ':' || st || ':7'), st) - 1 AS r FROM answers, unnest(['riddle', 'rhyme', 'anagram', 'code']) AS u(st))
      SELECT word, CAST(slot AS INTEGER) AS slot, st AS style FROM s, unnest(range(0, 6)) AS v(slot) WHERE slot % 4 = r""",
    "systematic_pairs": f"WITH {Q.ANSWERS_SQL} SELECT answer_ord, answer FROM answers WHERE (answer_ord - 1) % CAST(ceil((SELECT count(*) FROM answers) / 10) AS BIGINT) = 0",
    "strike_fold": f"""WITH RECURSIVE {_EV}, k AS (SELECT user, id, ms, row_number() OVER (PARTITION BY user ORDER BY ms, id) AS r FROM ev),
      f AS (SELECT user, id, ms, r, [ms] AS live, 1 AS held, false AS fired FROM k WHERE r = 1 UNION ALL
        SELECT n.user, n.id, n.ms, n.r, CASE WHEN len(list_filter(f.live, lambda t: n.ms - t < {DAY})) >= 2 THEN [] ELSE list_append(list_filter(f.live, lambda t: n.ms - t < {DAY}), n.ms) END,
          len(list_filter(f.live, lambda t: n.ms - t < {DAY})) + 1, len(list_filter(f.live, lambda t: n.ms - t < {DAY})) >= 2 FROM f JOIN k n ON n.user = f.user AND n.r = f.r + 1)
      SELECT user, id, CAST(held AS INTEGER) AS held, fired FROM f""",
}
