"""Queries of the whole detector, of routing and of sources over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import tables as T
from ..functions.phonetic import double_metaphone
from ..operators import derive as D
from ..operators import gates as G
from ..operators import scan as R
from ..sources import documents as E
from ..sources import store
from . import matching as Q


#: Types and name endings of made-up attachments.
TYPES = ["audio/ogg", "video/mp4", "image/gif", "", "application/octet-stream", "text/plain", "image/png", None]
ENDINGS = ["", ".MKV", ".flac", ".mp3", ".gif", ".mp4.txt", ".Webm", ".opus", ".pdf"]


def _tool(spark: SparkSession, sf_dir: str):
    vocab = Q._vocab(spark, sf_dir)
    words = vocab.where((F.col("n_docs") >= 3) & F.col("token").rlike("^[a-z]+$")).select(F.col("token").alias("word"))
    return R.detector(D.benchmark_answers(spark, sf_dir), words)


def scan_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First answer that each document reveals by any rule, all answers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return R.scan(docs, _tool(spark, sf_dir), ["doc_id"])


def scan_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First answer that each turn reveals by any rule, all answers."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return R.scan(talks, _tool(spark, sf_dir), ["conv_id", "turn"])


def scan_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in twelve disguises, and what the whole detector makes of them."""
    attacks = Q._attacks(D.benchmark_answers(spark, sf_dir))
    got = R.scan(attacks, _tool(spark, sf_dir), ["true_ord", "disguise"], "token")
    return got.groupBy("disguise").agg(F.count("*").alias("total"), F.count("hit").alias("caught"))


def phonetic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Double Metaphone keys of the answers."""
    rows = [(r.answer, *double_metaphone(r.answer)) for r in D.benchmark_answers(spark, sf_dir).collect()]
    return spark.createDataFrame(rows, "answer string, first string, second string")


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and lines of the text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", E.html_text(F.col("html")).alias("text"))
    return pages.select("page_id", F.length("text").cast("long").alias("n_chars"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


def page_fetchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of HTTPS hosts that the host list allows (example hosts in place of attachments' own)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", store.fetchable(F.col("url"), ["example.com", "www.example.com"]).alias("fetchable"))


def issue_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of made-up issues, one a document: two of its words around a word of one class or none."""
    from ..operators.conversation import issue_class

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    parts = F.array(*[F.lit(x) for x in ("queue", "limit", "Disabled", "answer unavailable", "external", "unknown", "timeout", "text")])
    issue = F.concat_ws(" ", F.get(words, F.lit(0)), F.get(parts, (F.col("doc_id") % 8).cast("int")), F.get(words, F.lit(1)))
    return docs.select("doc_id", issue.alias("issue")).select("doc_id", "issue", issue_class(F.col("issue")).alias("class"))


def asset_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First limit that each line item breaks as an asset of its part."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assets = items.select(
        F.col("l_partkey").alias("message"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"),
        F.when(F.col("l_returnflag") == "A", "image").otherwise("file").alias("kind"), (F.col("l_quantity") * 100_000).cast("long").alias("bytes"),
    )
    return G.within_limits(assets).select("message", "place", F.coalesce("issue", F.lit("none")).alias("issue"))


def media_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of made-up attachments, one a line item: a type or none, and a name by its part."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    types, ends = (F.array(*[F.lit(x) for x in values]) for values in (TYPES, ENDINGS))
    frame = items.select(
        "l_orderkey", "l_linenumber", F.get(types, (F.col("l_partkey") % len(TYPES)).cast("int")).alias("content_type"),
        F.concat(F.lit("f"), F.col("l_suppkey").cast("string"), F.get(ends, (F.col("l_orderkey") % len(ENDINGS)).cast("int"))).alias("name"),
    )
    return frame.select("l_orderkey", "l_linenumber", F.coalesce(G.media_kind(F.col("content_type"), F.col("name")), F.lit("none")).alias("kind"))


QUERIES = {f.__name__: f for f in (scan_verdicts, scan_turns, scan_sweep, phonetic_keys, page_text, page_fetchable, issue_classes, asset_limits, media_kinds)}

ORACLES = {
    "issue_classes": f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents),
      i AS (SELECT doc_id, concat_ws(' ', w[1], ['queue', 'limit', 'Disabled', 'answer unavailable', 'external', 'unknown', 'timeout', 'text'][doc_id % 8 + 1], w[2]) AS issue FROM w)
      SELECT doc_id, issue, CASE {" ".join(f"WHEN regexp_matches(lower(issue), '{p}') THEN '{c}'" for p, c in T.ISSUE_CLASSES)} ELSE 'incomplete coverage' END AS class FROM i""",
    "media_kinds": f"""WITH a AS (SELECT l_orderkey, l_linenumber, coalesce([{", ".join("NULL" if x is None else f"'{x}'" for x in TYPES)}][l_partkey % {len(TYPES)} + 1], '') AS t,
        'f' || l_suppkey || [{", ".join(f"'{x}'" for x in ENDINGS)}][l_orderkey % {len(ENDINGS)} + 1] AS f FROM lineitem),
      e AS (SELECT *, lower(CASE WHEN contains(f, '.') THEN string_split(f, '.')[-1] ELSE '' END) AS e, t IN ('', 'application/octet-stream') AS o FROM a)
      SELECT l_orderkey, l_linenumber, CASE WHEN t = 'image/gif' OR (t NOT LIKE 'image/%' AND e = 'gif') THEN 'gif' WHEN t LIKE 'audio/%' THEN 'audio' WHEN t LIKE 'video/%' THEN 'video'
        WHEN o AND e IN ('mp3', 'ogg', 'oga', 'opus', 'wav', 'm4a', 'aac', 'flac', 'weba', 'wma', 'aif', 'aiff') THEN 'audio' WHEN o AND e IN ('mp4', 'm4v', 'mov', 'webm', 'mkv', 'avi') THEN 'video' ELSE 'none' END AS kind FROM e""",
    "page_text": r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<script\b.*?</script>', ' ', 'gis'), '<style\b.*?</style>', ' ', 'gis') AS t FROM pages),
      b AS (SELECT page_id, regexp_replace(regexp_replace(t, '</?(?:p|div|br|li|tr|h[1-6])\b[^>]*>', chr(10), 'gi'), '<[^>]*>', '', 'g') AS t FROM a),
      c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS t FROM b),
      d AS (SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g')) AS t FROM c)
      SELECT page_id, length(t) AS n_chars, CAST(len(string_split(t, chr(10))) AS BIGINT) AS n_lines FROM d""",
    "asset_limits": f"""WITH a AS (SELECT l_partkey AS message, l_orderkey * 10 + l_linenumber AS place, l_returnflag = 'A' AS image, CAST(l_quantity * 100000 AS BIGINT) AS b FROM lineitem),
      w AS (SELECT *, count(*) OVER o AS n, count(*) FILTER (WHERE image) OVER o AS i, sum(b) OVER o AS s FROM a WINDOW o AS (PARTITION BY message ORDER BY place ROWS UNBOUNDED PRECEDING))
      SELECT message, place, CASE WHEN n > {G.ASSET_LIMIT} THEN 'asset limit' WHEN image AND i > {G.IMAGE_LIMIT} THEN 'image limit' WHEN s > {G.BYTE_LIMIT} THEN 'byte limit exceeds' ELSE 'none' END AS issue FROM w""",
    "page_fetchable": "SELECT page_id, regexp_full_match(lower(url), 'https://(www\\.)?example\\.com([/?#].*)?') AS fetchable FROM pages",
}


def eval_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that conversations with answers worked into them lose: one case an answer, whole, in pieces and clean."""
    from ..operators import replay as Y

    a = D.benchmark_answers(spark, sf_dir)
    texts = F.array(F.concat(F.lit("it is "), "answer"), F.lit("hello"), F.substring("answer", 1, 2), F.substring("answer", 3, 3), F.lit("goodbye"))
    cases = a.select(F.col("answer").alias("case"), F.posexplode(texts).alias("place", "text"))
    cases = cases.select("case", "place", F.col("place").cast("string").alias("id"), "text", (F.col("place") * 1000).cast("long").alias("ms"))
    got = Y.replay(cases, R.Detector([r.answer for r in a.orderBy("answer_ord").collect()], frozenset({"hello", "goodbye", "is", "it"})))
    return got.select("case", F.array_join("removed", ",").alias("removed"))


def grey_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent grey of made-up images, one a part: greys from line items."""
    from ..operators import replay as Y

    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return Y.grey_peak(items.select(F.col("l_suppkey").alias("image"), (F.col("l_quantity").cast("int") * 5).alias("grey")))


QUERIES |= {"eval_replay": eval_replay, "grey_peaks": grey_peaks}
ORACLES["grey_peaks"] = """WITH c AS (SELECT l_suppkey AS image, CAST(l_quantity AS INT) * 5 AS grey, count(*) AS n FROM lineitem GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY n DESC, grey) AS k FROM c WHERE grey BETWEEN 8 AND 247), t AS (SELECT image, sum(n) AS total FROM c GROUP BY 1)
  SELECT t.image, CASE WHEN r.n >= 0.01 * total THEN grey END AS peak FROM t LEFT JOIN r ON t.image = r.image AND k = 1"""
