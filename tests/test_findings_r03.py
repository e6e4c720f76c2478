"""Tests of what the findings of round 3 named."""

import base64

from pyspark.sql import functions as F

from veilspark.llm import lines
from veilspark.functions import text as X
from veilspark.functions.detector import Detector
from veilspark.operators import decode as C
from veilspark.operators import reader as R


def test_base64_texts_have_no_vertical_tab_or_odd_line_break(spark):
    texts = ["9A\x0b,", "plain text", "two\nlines\r\n", "last break\x85", "tab\tand\fpage"]
    rows = [(i, base64.b64encode(t.encode()).decode()) for i, t in enumerate(texts)]
    got = spark.createDataFrame(rows, "i int, raw string").select("i", C.base64_texts(F.col("raw")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [[], ["plain text"], ["two\nlines\r\n"], [], ["tab\tand\fpage"]]


def test_line_dedup_in_slices_drops_the_same_lines(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id % 2 = 0")

    def rows():
        return sorted(tuple(r) for r in lines.dedup_lines(docs).select("doc_id", F.md5(F.col("text").cast("binary")), "n_lines", "n_removed").collect())

    whole = rows()
    assert sum(r[-1] for r in whole) > 0
    monkeypatch.setattr(lines, "SLICE_LINES", 100)
    monkeypatch.setattr(lines, "SLICE_PAIRS", 0)
    monkeypatch.setattr(lines, "OPEN", 2)
    monkeypatch.setattr(lines, "SLICES", 3)
    dealt, deal = set(), lines._slices
    monkeypatch.setattr(lines, "_slices", lambda n, each: dealt.add(deal(n, each)) or deal(n, each))
    assert rows() == whole and 3 in dealt


def test_reader_cuts_texts_as_the_native_functions_do(spark):
    texts = ["Plain WORDS, (here) isn't", "Straße ΟΔΟΣ Σ", "a\x1cb c\x1fd e\x0bf", "n\xa0b\u2003wide\u3000x\x85y\u200bz", "\u212aelvin Ⓐⓑ 𝓗𝓮𝓵𝓵𝓸 ｆｕｌｌ Ünïcödé İx", "p@ss €5 ¢ £ !! ..a.. 1st", "", " \n\t "]
    tokens = X.tokens(X.fold_letters(F.col("text")))
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", tokens.alias("t"), X.words(tokens).alias("w")).orderBy("i").collect()
    for text, row in zip(texts, got, strict=True):
        assert R.tokens(text) == row.t and R.words(text) == row.w, text


def test_rules_across_tokens_at_their_edges():
    forms = {"crane": [(1, "crane")]}
    assert list(R.split_words("a cr-a ne cra ne", forms, 8, 12)) == [(1, 2, "crane", 1, "crane"), (3, 2, "crane", 1, "crane")]
    assert R.boundary("xxc ran exx", forms, [5]) == {(1, "crane")} and R.boundary("crane", forms, [5]) == set()
    backwards = R.initials_of({"enarc": [(1, "crane")]})
    assert R.reversed_initials("each new x animal runs catches", backwards) == {(1, "crane")} and R.reversed_initials("each new animal runs", backwards) == set()
    assert R.columns("cxx\nrxx\nax\nnx\nexx", forms, forms, 40, 80, 40) == {("crane", 1, "crane")}
    assert R.columns("xxxxc\nxxxrx\nxxaxx\nxnxxx\nexxxx", forms, forms, 40, 80, 40) == {("crane", 1, "crane")}
    assert list(R.capital_streams("none\nCall Rita And Ned Early")) == [(1, "crane,rane")]
    near = {"crate": [("n", 1, "crane")]}
    assert R.edits("a crate, N", near) == {("crate", 1, "crane")} and R.edits("a crate", near) == set()


def test_detector_stops_at_the_first_token_that_hits_and_remembers_blobs(monkeypatch):
    tool, asked = Detector(["crane", "slate"]), []
    token = tool.token
    monkeypatch.setattr(tool, "token", lambda t: asked.append(t) or token(t))
    assert tool.scan("say crane and slate, too") == "crane" and asked == ["say", "crane"]
    blob = base64.b64encode(b"xx slate xx").decode()
    assert tool.scan(f"look {blob}") == "slate" and tool.read["xx slate xx"] == "slate" and tool.scan(f"and {blob}") == "slate"
    # capitals that a compatibility form makes are trimmed from a token's ends, and are no letters
    assert tool.scan("crane\u2122") == "crane"
