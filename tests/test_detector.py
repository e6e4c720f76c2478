"""The whole detector on single texts, and the native rules that it shares with the plans."""

import itertools

import pytest
from pyspark.sql import functions as F

from veilspark.functions import text as X
from veilspark.functions.detector import Detector, leet, near
from veilspark.functions.phonetic import double_metaphone
from veilspark.functions.translit import transliterate
from veilspark.operators import decode, match, scan
from veilspark.plans import scanning

WORDS = frozenset("help lane the and saw a german wage but add an planet without really easy game win right light is it now friends hello good morning".split())
TOOL = Detector(
    ["crane", "wager", "plane", "house", "light"], WORDS - {"light"},
    emoji_names={"🐳": "spouting whale", "🍎": "red apple", "🦒": "giraffe", "🥚": "egg", "🌈": "rainbow"},
)
REVEALS = {
    "the word is crane": "crane", "enarc": "crane", "c r a n e": "crane", "cr lol ane": "crane", "help lane": "plane", "saw a german": "wager",
    "its wage but add an r": "wager", "planet without the t": "plane", "Y3JhbmU=": "crane", "8 15 21 19 5": "house", "MNZGC3TF": "crane",
    "whiskey then alpha golf echo romeo": "wager", ".-- .- --. . .-.": "wager", "dot dash dash / dot dash": None, "l1ght": "light", "вейджер": "wager", "🐳🍎🦒🥚🌈": "wager",
    "ɹǝƃɐʍ": "wager", "hoWie sAid the biG onE was Right": "wager", "ho**w**ie s**a**id the bi**g** on**e** was **r**ight": "wager",
    "w\na\ng\ne\nr": "wager", "%77%61%67%65%72": "wager", "fudqh": "crane", "wxaxgxexr": "wager", "twenty three one seven five eighteen": "wager",
    "really easy lol game and win": "wager", "ｗａｇｅｒ": "wager", "w​a​g​e​r": "wager", "wagering": "wager", "итсcrane": None, "waegr": "wager", "924 37": None,
    "hello friends good morning": None, "": None, None: None,
    # fancy fonts: strokes, signs of other scripts, whole alphabets of a generator
    "匚尺卂几乇": "crane", "ςгคภє": "crane", "ᏟᎡᎪᏁᎬ": "crane", "ꁅꂦ山ꍏꁅꀎꋪ 山ꍏꁅꍟꋪ": "wager", "ɭιɠʜт": "light",
    # ordinals, places and values in turn, emoji of one letter
    "23rd 1st 7th 5th 18th": "wager", "twenty third first seventh fifth eighteenth": "wager", "letter 1 = 23, letter 2 = 1, letter 3 = 7, letter 4 = 5, letter 5 = 18": "wager",
    "<:blue_c:2><a:letter_r:1><:a:3><:n_x1:4><:e:5>": "crane",
    # whole runs of one script joined, loanword sounds
    "و ا ي ج ر": "wager", "ウェイジャー": "wager", "워거": "wager",
}


@pytest.mark.parametrize("text", [t for t, a in REVEALS.items() if a])
def test_reveals(text):
    assert TOOL.scan(text) == REVEALS[text]


@pytest.mark.parametrize("text", ["hello friends good morning", "", None, "is it now"])
def test_clean(text):
    assert TOOL.scan(text) is None


def test_first_answer_wins():
    assert Detector(["crane", "light"]).scan("light crane") == "light"
    assert Detector(["light", "crane"]).fuzzy("lihgt") == "light"
    assert Detector([]).scan("crane") is None


def test_near_is_damerau_distance_one():
    def distance(a, b):
        d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    words = ["".join(p) for n in (2, 3, 4) for p in itertools.product("ab", repeat=n)]
    assert all(near(a, b) == (distance(a, b) <= 1) for a in words for b in words)


def test_leet_is_bounded():
    assert leet("l1ght") == ["light", "llght"]
    assert leet("1" * 7 + "a") == [] and leet("12345") == []


def test_sounds():
    assert double_metaphone("light")[0] == double_metaphone("lite")[0]
    assert double_metaphone("phone")[0] == double_metaphone("fone")[0]
    assert double_metaphone("") == ("", "")


def test_scripts():
    assert any("krein" in s.variants or "kreyn" in s.variants for s in transliterate("крейн"))
    assert any("wayjr" in s.variants or "waygr" in s.variants for s in transliterate("وايجر")) and transliterate("وايجر")[0].abjad
    assert transliterate("한국")[0].variants[0].startswith("han")
    assert transliterate("plain words") == []
    assert "woger" in transliterate("워거")[0].variants and "shark" in transliterate("シャーク")[0].variants and "film" in transliterate("फ़िल्म")[0].variants
    joined = [s for s in transliterate("да нет, yes да") if s.joined]
    assert [s.variants[0] for s in joined] == ["danet"]
    assert transliterate("'' ' ־") == [] and transliterate("ג'ירף") == transliterate("ג׳ירף")


def test_batched_scan_keeps_rows(spark):
    rows = spark.createDataFrame([(1, "crane"), (2, None), (3, ""), (3, "hello")], "id int, text string")
    got = [(r.id, r.hit) for r in scan.scan(rows, TOOL, ["id"]).collect()]
    assert sorted(got, key=str) == sorted([(1, "crane"), (2, None), (3, None), (3, None)], key=str)


def test_native_normalisation(spark):
    cases = [("**bo​ld** É", "bold e"), ("[a](b)", " a b "), ("<@123> hi", "  hi"), (None, None), ("- item", "item"), ("> said", "said"), (":letter_a:", " a ")]
    frame = spark.createDataFrame(cases, "text string, want string")
    got = frame.select(X.normalize_ascii(F.col("text")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_native_decoders_agree_with_the_detector(spark):
    texts = ["8 15 21 19 5", "&#x77;&#x61;&#x67;", "0x776167", "call 1 then 2 then 3", "nothing here", "", "1 2", "8th 15th 21st 19th 5th", "1 8 2 15 3 21 4 19 5 5", "1 8 2 15 4 21"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    reads = F.flatten(F.transform(decode.number_runs(F.col("text")), decode.number_texts))
    for r in frame.select("text", decode.candidates(F.concat(reads, decode.escape_texts(F.col("text")))).alias("c")).collect():
        from veilspark.functions.detector import decoded

        assert set(r.c) == set(decoded(r.text)), r.text


def test_wildcard_and_typo_need_no_cross_join(spark):
    answers = spark.createDataFrame([(1, "crane"), (2, "light")], "answer_ord int, answer string")
    tokens = spark.createDataFrame([("cr4ne",), ("l?ght",), ("carne",), ("cran",), ("zzzzz",), ("c?a?n",)], "token string")
    wild = {(r.token, r.answer) for r in match.wildcard(tokens, answers).collect()}
    assert wild == {("cr4ne", "crane"), ("l?ght", "light")}
    typos = match.typo(tokens, answers)
    assert {(r.token, r.answer) for r in typos.collect()} == {("cr4ne", "crane"), ("l?ght", "light"), ("carne", "crane"), ("cran", "crane")}
    assert "Cartesian" not in typos._jdf.queryExecution().toString() and "NestedLoop" not in typos._jdf.queryExecution().toString()


def test_scan_verdicts_takes_all_answers(spark, tmp_path):
    names = [a + b + "zqk" for a in "bcd" for b in "aeio"]
    spark.createDataFrame([(1, " ".join(names))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, f"it is {w}") for i, w in enumerate(names)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.hit for r in scanning.scan_verdicts(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(names))


def test_dictionary_is_whole_but_only_asked_words_travel(spark):
    answers = spark.createDataFrame([(1, "crane"), (2, "light")], "answer_ord int, answer string")
    listed = ["crank", "nacre", "fudqh", "lig", "cranes", "zebra", "window", "lit"]
    words = spark.createDataFrame([(w, 3) for w in [*listed, *(f"zz{i:05d}".translate(str.maketrans("0123456789", "bdfhjkmpqv")) for i in range(3000))]], "word string, n_docs long")
    tool = scan.detector(answers, words)
    whole = Detector(["crane", "light"], frozenset(r.word for r in words.collect()))
    assert {"crank", "nacre"} <= tool.dictionary and len(tool.dictionary) < 100 and "zebra" not in tool.dictionary
    texts = ["the crank", "a nacre box", "lig ht", "two cranes", "zebra window", "carne", "cr 4 ne", "fu dqh", "fudqh", "its crank but without k add e"]
    assert [tool.scan(t) for t in texts] == [whole.scan(t) for t in texts]


def test_wildcard_takes_answers_of_any_length(spark):
    answers = spark.createDataFrame([(1, "extraordinarily"), (2, "abc"), (3, "ab")], "answer_ord int, answer string")
    tokens = spark.createDataFrame([("extr4ordin4rily",), ("???raor????????",), ("e?tra0rdinarilx",), ("a?c",), ("abc-",), ("??c",)], "token string")
    assert {(r.token, r.answer) for r in match.wildcard(tokens, answers).collect()} == {("extr4ordin4rily", "extraordinarily"), ("???raor????????", "extraordinarily")}
