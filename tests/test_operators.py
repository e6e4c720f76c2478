"""Conversation, metric, dataset and routing operators on small inline tables, sources and streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from veilspark.operators import conversation as V
from veilspark.operators import dataset as P
from veilspark.operators import gates as G
from veilspark.operators import metrics as A
from veilspark.sources import documents as E
from veilspark.sources import labelled, store
from veilspark.streaming import state


def test_context_expires_and_is_cut(spark):
    rows = spark.createDataFrame([(1, i, i * 200_000) for i in range(6)] + [(2, 0, 0)], "channel long, id long, ms long")
    got = {(r.channel, r.id): list(r.context) for r in V.recent_context(rows).collect()}
    assert got[1, 5] == [3, 4, 5] and got[1, 0] == [0] and got[2, 0] == [0]
    assert len({(r.channel, r.id): r.context for r in V.recent_context(rows, most=2).collect()}[1, 5]) == 2


def test_fragments(spark):
    texts = [(1, 0, 0, "wa"), (1, 1, 1000, "ge"), (1, 2, 2000, "r"), (2, 0, 0, "wa"), (2, 1, 500_000, "ger"), (3, 0, 0, "wa"), (3, 1, 1, "longer words"), (3, 2, 2, "ger")]
    rows = spark.createDataFrame(texts, "channel long, id long, ms long, text string").withColumn("fragment", V.fragment(F.col("text")))
    answers = spark.createDataFrame([(1, "wager")], "answer_ord int, answer string")
    assert [(r.channel, r.end_id, r.n) for r in V.fragment_join(rows, answers).collect()] == [(1, 2, 3)]


def test_strikes_clear(spark):
    rows = spark.createDataFrame([(1, i, i * 1000) for i in range(7)] + [(2, 9, 5)], "user long, id long, ms long")
    got = {(r.user, r.id): (r.held, r.fired) for r in V.strikes(rows).collect()}
    assert [got[1, i] for i in range(7)] == [(1, False), (2, False), (3, True), (1, False), (2, False), (3, True), (1, False)]
    assert got[2, 9] == (1, False)


def test_changes_and_versions(spark):
    rows = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 2, "x"), ("a", 3, 3, None), ("a", 4, 4, "x")], "k string, id long, ms long, v string")
    assert [r.id for r in V.changed(rows, "k", F.col("v")).orderBy("id").collect()] == [1, 3, 4]
    events = spark.createDataFrame([(1, 1, 1, "create"), (1, 1, 2, "delete"), (1, 2, 1, "create")], "channel long, id long, version long, op string")
    assert [(r.id, r.version) for r in V.latest_versions(events).collect()] == [(2, 1)]


def test_metrics_edge_cases(spark):
    rows = spark.createDataFrame([("benign", 0.9), ("benign", 0.5), ("benign", 0.1), ("direct", 0.8)], "label string, score double")
    assert A.threshold_at_budget(rows, 0).first()[0] == 0.9
    assert A.threshold_at_budget(rows, 3334).first()[0] == 0.5
    assert A.threshold_at_budget(rows, 10_000).first()[0] == 0.0
    r = A.rates(rows.where("label = 'direct'"), 0.5).first()
    assert r.recall == 1.0 and r.fp_per_10k is None
    assert A.curve(rows).where("threshold = -1").first().recall == 1.0
    low, high = A.bootstrap(rows.withColumn("id", F.monotonically_increasing_id()), 0.5).where("measure = 'recall'").select("low", "high").first()
    assert low == high == 1.0


def test_split_keeps_groups(spark):
    rows = spark.createDataFrame([(f"w{i}", j) for i in range(20) for j in range(3)], "answer string, n int")
    got = P.grouped_split(rows, "answer")
    assert got.groupBy("answer").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty()
    assert {r.split: r.n for r in got.select("answer", "split").distinct().groupBy("split").agg(F.count("*").alias("n")).collect()} == {"test": 4, "val": 2, "train": 14}
    with pytest.raises(ValueError):
        P.grouped_split(rows.limit(1), "answer")


def test_attempts_and_verdicts(spark):
    rows = spark.createDataFrame(
        [(1, "CRANE", ["a", " ", "b"], None, [True, False, False], None, "x", None), (2, "no", ["a"], None, None, True, None, None), (3, "light", None, "old", None, True, "innocent", None)],
        "id int, word string, messages array<string>, text string, deleted array<boolean>, caught boolean, intent string, nickname string",
    )
    got = {r.id: r for r in P.attempts(rows).collect()}
    assert set(got) == {1, 3} and got[1].messages == ["a", "b"] and got[1].deleted == [True, False] and got[3].intent == "innocent" and got[3].caught
    judged = spark.createDataFrame([(1, '{"verdict":"spoiler","confidence":0.9,"reason":"r"}'), (2, '{"verdict":"x","confidence":0.9,"reason":"r"}'), (3, '{"verdict":"hint","confidence":2,"reason":"r"}'), (4, '{"verdict":"hint","confidence":0.5,"reason":"r","more":1}'), (5, None)], "id int, response string")
    assert [r.id for r in P.valid_verdicts(judged, ["spoiler", "hint", "clean"]).collect()] == [1]
    labels = ["direct", "hint", "benign"]
    s = spark.createDataFrame([("hint", 0.6, False), ("hint", 0.6, True)], "l string, c double, r boolean").select(P.scores(F.col("l"), F.col("c"), F.col("r"), labels).alias("s"))
    assert [r[0] for r in s.select(P.best_label(F.col("s"), labels)).collect()] == ["hint", "benign"]


def test_gates(spark):
    rows = spark.createDataFrame([("crane", None, ["x"]), (None, None, ["x", "x"]), (None, None, [])], "a string, b string, i array<string>")
    got = [r.s for r in rows.select(G.status([F.col("a"), F.col("b")], F.col("i")).alias("s")).collect()]
    assert [g.status for g in got] == ["spoiler", "unscanned", "clean"] and got[1].issues == ["x"]
    name = spark.createDataFrame([(["bad", "ok"], ["crane", None])], "c array<string>, h array<string>").select(G.safe_name(F.col("c"), F.col("h"))).first()[0]
    assert name == "ok"
    react = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "smile")], "message int, place int, name string")
    assert G.reactions_text(react).first().text == "ab"


def test_labelled_round_trip(spark, tmp_path):
    rows = [{"id": "1", "answer": "crane", "text": "é x", "label": "direct", "style": "s", "detector_hit": True, "source": "made"}, {"id": "2", "answer": "crane", "text": "y", "label": "benign", "style": "s", "detector_hit": False, "context": [{"author": "a", "text": "b"}]}]
    (tmp_path / "in.jsonl").write_text("\n\n".join(json.dumps(r) for r in rows))
    got = labelled.read_examples(spark, str(tmp_path / "in.jsonl"))
    assert {r.id: r.extra for r in got.collect()} == {"1": {"source": "made"}, "2": {}}
    labelled.write_examples(got, str(tmp_path / "out"))
    again = labelled.read_examples(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
    assert labelled.unseen(got).count() == 1
    for bad in ({**rows[0], "label": "odd"}, {k: v for k, v in rows[0].items() if k != "detector_hit"}):
        (tmp_path / "bad.jsonl").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            labelled.read_examples(spark, str(tmp_path / "bad.jsonl"))
    with pytest.raises(ValueError):
        labelled.read_examples(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "in.jsonl"))


def test_store(spark):
    rows = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "id long, ts long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert sorted(tuple(r) for r in store.upsert(rows, new).collect()) == [(1, 10, "a"), (2, 20, "c")]
    assert [r.id for r in store.newest(rows, 1).collect()] == [2]
    urls = ["https://cdn.discordapp.com/a", "http://cdn.discordapp.com/a", "https://cdn.discordapp.com:444/a", "https://u@cdn.discordapp.com/a", "https://evil.example/a", None, "no url"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(store.fetchable(F.col("u"))).collect()
    assert [r[0] for r in got] == [True] + [False] * 6
    days = spark.createDataFrame([("2024-01-01", "crane"), ("2024-01-02", "BAD")], "date string, solution string").withColumn("date", F.to_date("date"))
    assert [r.answer for r in store.answers_for(F.array(F.lit("2024-01-01").cast("date")), days, spark).collect()] == ["crane"]
    assert store.answers_for(F.array(*[F.lit(d).cast("date") for d in ("2024-01-01", "2024-01-02")]), days, spark).isEmpty()
    zone = spark.range(1).select(P.selected_dates(F.lit("2024-03-10 02:00:00").cast("timestamp"), "America/New_York", 1).alias("d")).first().d
    assert [str(d) for d in zone] == ["2024-03-09", "2024-03-08"]


def test_documents(spark):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("word/document.xml", "<w:document xmlns:w='w'><w:p><w:t>cra</w:t><w:t>ne</w:t></w:p></w:document>")
    files = [(1, inner.getvalue()), (2, "plain é".encode()), (3, b"\x89PNG\r\n\x1a\n..."), (4, "hi".encode("utf-16")), (5, b"\x00\x01\x02"), (6, b"<?xml version='1.0'?><!DOCTYPE a><a/>")]
    got = {r.id: r for r in E.extract(spark.createDataFrame(files, "id int, content binary"), ["id"]).collect()}
    assert got[1].kind == "zip" and "crane" in got[1].text and got[2].text == "plain é" and got[3].kind == "image" and got[4].text == "hi"
    assert got[5].kind == "unknown" and got[6].issues == ["document failed: doctype"]
    trees = [(1, json.dumps({"content": "a", "embeds": [{"title": "b", "fields": [{"name": "c", "value": "d"}], "image": {"url": "u"}}]})), (2, None), (3, "{")]
    flat = {r.id: r for r in E.flatten_trees(spark.createDataFrame(trees, "id int, tree string"), ["id"]).collect()}
    assert flat[1].text == "a\nb\nc\nd" and flat[1].assets == ["u"] and flat[2].issues == flat[3].issues == ["content failed"]


def _run(spark, frame, name):
    query = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    rows = [(1, i, i * 200_000, "create", "t") for i in range(6)] + [(1, 4, 900_000, "delete", None), (1, 7, 1_000_001, "create", "u")]
    spark.createDataFrame(rows, "channel long, id long, ms long, op string, text string").write.json(str(tmp_path / "c"))
    stream = spark.readStream.schema("channel long, id long, ms long, op string, text string").json(str(tmp_path / "c"))
    got = {r.id: r.context for r in _run(spark, state.contexts(stream), "ctx")}
    assert got[5] == "3,5" and got[0] == "0"
    spark.createDataFrame([(1, i, i * 1000) for i in range(4)], "user long, id long, ms long").write.json(str(tmp_path / "s"))
    stream = spark.readStream.schema("user long, id long, ms long").json(str(tmp_path / "s"))
    assert {r.id: r.fired for r in _run(spark, state.strikes(stream), "strk")} == {0: False, 1: False, 2: True, 3: False}
    spark.createDataFrame([(1, "2024-01-01 00:00:10", ["queue"]), (1, "2024-01-01 00:00:20", []), (1, "2024-01-01 01:00:00", [])], "guild long, ts string, issues array<string>").write.json(str(tmp_path / "a"))
    stream = spark.readStream.schema("guild long, ts timestamp, issues array<string>").json(str(tmp_path / "a"))
    assert {(r.reason, r.n) for r in _run(spark, state.alerts(stream), "alrt")} >= {("inspection queue", 1), ("incomplete coverage", 1)}


def test_replays(spark, tmp_path):
    from veilspark.functions.detector import Detector
    from veilspark.operators import replay as Y

    tool = Detector(["crane", "wager"], frozenset({"hello", "bye"}))
    cases = spark.createDataFrame(
        [("a", 0, "1", "hello", 0), ("a", 1, "2", "crane", 1), ("b", 0, "3", "wa", 0), ("b", 1, "4", "ger", 1000), ("c", 0, "5", "wa", 0), ("c", 1, "6", "ger", 900_000), ("c", 2, "7", None, 900_001)],
        "case string, place int, id string, text string, ms long",
    )
    assert {r.case: r.removed for r in Y.replay(cases, tool).collect()} == {"a": ["2"], "b": ["3", "4"], "c": []}
    held = cases.select(F.lit("me").alias("author"), F.col("id").cast("int").alias("place"), "id", "text").where("id > 2 AND id < 5")
    assert {r.id: r.hit for r in Y.held_fragments(held, tool).collect()} == {"3": None, "4": "wager"}

    def judge(texts):
        if "boom" in texts:
            raise OSError("down")
        return ["clean"] * len(texts)

    rows = spark.createDataFrame([(1, "x"), (2, "boom")], "id int, text string").coalesce(1)
    assert sorted(tuple(r) for r in Y.judged(rows, judge, size=1).collect()) == [(1, "clean"), (2, "failed")]
    Y.report(spark, str(tmp_path / "report"), counts=spark.createDataFrame([(1,)], "n int"))
    assert spark.read.json(str(tmp_path / "report" / "counts")).first().n == 1
    (tmp_path / "f.bin").write_bytes(b"12345")
    assert E.read_files(spark, str(tmp_path / "f.bin"), 4).isEmpty() and E.read_files(spark, str(tmp_path / "f.bin"), 5).first().length == 5
    assert Y.accuracy(spark.createDataFrame([(0, 1.0, 1, 1), (0, 3.0, 1, 0), (1, 4.0, 1, 1)], "batch int, loss double, label int, predicted int")).first().loss == 3.0


def test_bootstrap_query_takes_a_thousand_rounds(spark, sf):
    from veilspark.plans import state

    rows = state._outcomes(spark, sf)
    got, want, fewer = (sorted(map(tuple, df.collect())) for df in (state.bootstrap_ci(spark, sf), A.bootstrap(rows, 0.8, rounds=1000), A.bootstrap(rows, 0.8, rounds=200)))
    assert got == want != fewer


def test_running_sums_follow_a_global_order(spark):
    from veilspark.operators import ordered

    values = [None, *(float(i * 7919 % 1009) for i in range(600)), 5.0, 5.0]
    rows = spark.createDataFrame([(i, v, i % 5) for i, v in enumerate(values)], "id int, v double, n int")
    got = ordered.running(rows, ordered.part_of(rows, F.col("v")), [F.col("v").asc_nulls_first(), F.col("id")], {"before": F.col("n")}).collect()
    total = 0
    for r in sorted(got, key=lambda r: (r.v is not None, r.v or 0, r.id)):
        assert r.before == total
        total += r.n
    assert len(got) == len(values)
    none = rows.where("id < 0")
    assert ordered.running(none, ordered.part_of(none, F.col("v")), [F.col("v")], {"before": F.col("n")}).collect() == []


def test_threshold_and_curve_on_ties_and_empties(spark):
    rows = spark.createDataFrame([("benign", s) for s in (0.9, 0.9, 0.5, 0.1)] + [("direct", 0.9), ("direct", 0.2), ("benign", None)], "label string, score double")
    assert A.threshold_at_budget(rows, 2000).first()[0] == 0.9 and A.threshold_at_budget(rows, 5000).first()[0] == 0.5 and A.threshold_at_budget(rows, 10_000).first()[0] == 0.0
    points = {r.threshold: (r.recall, r.fp_per_10k) for r in A.curve(rows.where("score is not null")).collect()}
    assert points[-1.0] == (1.0, 10_000.0) and points[0.9] == (0.0, 0.0) and points[0.5] == (0.5, 5000.0) and points[0.1] == (1.0, 7500.0)
    assert A.curve(rows.where("score > 1")).count() == 1
