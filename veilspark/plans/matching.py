"""Queries of the derived forms and token matchers over the test tables, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import tables as T
from ..functions import text as X
from ..operators import derive as D
from ..operators import match as M


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.vocabulary(_docs(spark, sf_dir))


def exact_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First answer that each document names exactly, in any accepted form."""
    docs = _docs(spark, sf_dir)
    seen = docs.select("doc_id", F.explode(F.array_distinct(X.tokens(X.fold_letters(F.col("text"))))).alias("token"))
    hits = M.exact(seen, D.benchmark_answers(spark, sf_dir))
    return hits.groupBy("doc_id").agg(F.min(F.struct("answer_ord", "answer", "token")).alias("h")).select("doc_id", "h.answer_ord", "h.answer", "h.token")


def _matcher(rule):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        vocab = _vocab(spark, sf_dir)
        return rule(M.unlisted(vocab, D.dictionary(vocab)), D.benchmark_answers(spark, sf_dir)).select("token", "n_docs", "answer_ord", "answer")

    query.__doc__ = rule.__doc__
    return query


def _made(answers: DataFrame) -> DataFrame:
    """Answers in disguises that prose seldom has: digits and signs for letters, pairs that look like one."""
    a = F.col("answer")
    pairs = a
    for letter, pair in (("w", "vv"), ("m", "rn"), ("d", "cl")):
        pairs = F.replace(pairs, F.lit(letter), F.lit(pair))
    forms = F.array(F.translate(a, "oeas", "0345"), F.translate(a, "it", "1+"), pairs, F.translate(a, "lgz", "192"))
    return answers.select(F.explode(forms).alias("token")).distinct().withColumn("n_docs", F.lit(0).cast("long"))


def skeleton_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that are an answer's consonants: of the vocabulary, and of every third answer without its vowels."""
    vocab, answers = _vocab(spark, sf_dir), D.benchmark_answers(spark, sf_dir)
    made = answers.where("answer_ord % 3 = 0").select(X.consonants(F.col("answer")).alias("token")).distinct().withColumn("n_docs", F.lit(0).cast("long"))
    tokens = M.unlisted(vocab.select("token", "n_docs").unionByName(made), D.dictionary(vocab))
    return M.skeleton(tokens, answers).select("token", "n_docs", "answer_ord", "answer")


def _disguised(rule):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        answers = D.benchmark_answers(spark, sf_dir)
        tokens = _vocab(spark, sf_dir).select("token", "n_docs").unionByName(_made(answers))
        return rule(tokens, answers).select("token", "n_docs", "answer_ord", "answer")

    query.__doc__ = rule.__doc__
    return query


def substring_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens outside the dictionary that contain an answer and more."""
    vocab = _vocab(spark, sf_dir)
    loose = vocab.join(D.dictionary(vocab), F.col("token") == F.col("word"), "left_anti")
    return M.substring(loose, D.benchmark_answers(spark, sf_dir)).select("token", "n_docs", "answer_ord", "answer")


def _forms(build):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(D.benchmark_answers(spark, sf_dir))

    return query


def _attacks(answers: DataFrame) -> DataFrame:
    """Every answer in every disguise of a sweep: (answer_ord, answer, disguise, text)."""
    a = F.col("answer")
    letters = F.split(a, "")
    disguises = {
        "plain": a, "reverse": F.reverse(a), "rot13": X.rotated(a, 13), "atbash": X.atbash(a), "keypad": X.keypad(a),
        "doubled": F.array_join(F.transform(letters, lambda c: F.concat(c, c)), ""),
        "digits": F.translate(a, "oeas", "0345"), "noise": F.array_join(letters, "x"),
        "swapped": F.concat(F.substring(a, 2, 1), F.substring(a, 1, 1), F.substring(a, F.lit(3), F.length(a))),
        "inside": F.concat(F.lit("zz"), a, F.lit("q")), "suffix": F.concat(a, F.lit("ness")), "shift3": X.rotated(a, 3),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("disguise"), v.alias("token")) for k, v in disguises.items()])
    return answers.select(F.col("answer_ord").alias("true_ord"), F.explode(rows).alias("d")).select("true_ord", "d.disguise", "d.token")


def attack_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caught and all attacks of each disguise: answers disguised, matched by all rules outside the dictionary."""
    answers = D.benchmark_answers(spark, sf_dir)
    attacks = _attacks(answers)
    words = D.dictionary(_vocab(spark, sf_dir))
    loose = M.unlisted(attacks, words)
    hits = [M.exact(attacks, answers), M.leet(attacks, answers), M.wildcard(attacks, answers)]
    hits += [rule(loose, answers) for rule in (M.anagram, M.typo, M.undoubled, M.interleaved, M.caesar, M.substring)]
    caught = hits[0].select("true_ord", "disguise", "answer_ord")
    for h in hits[1:]:
        caught = caught.unionByName(h.select("true_ord", "disguise", "answer_ord"))
    caught = caught.where(F.col("true_ord") == F.col("answer_ord")).select("true_ord", "disguise").distinct().withColumn("hit", F.lit(1))
    joined = attacks.join(caught, ["true_ord", "disguise"], "left")
    return joined.groupBy("disguise").agg(F.count("*").alias("total"), F.sum(F.coalesce("hit", F.lit(0))).alias("caught"))


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document normalised by the native rules."""
    return _docs(spark, sf_dir).select("doc_id", X.normalize_ascii(F.col("text")).alias("norm"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, words and lines of every document, and its tokens in order as one string."""
    norm = _docs(spark, sf_dir).select("doc_id", X.fold_letters(F.col("text")).alias("norm"))
    cut = norm.select("doc_id", "norm", X.tokens(F.col("norm")).alias("t"))
    return cut.select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(X.words(F.col("t"))).cast("long").alias("n_words"),
        F.size(X.lines(F.col("norm"))).cast("long").alias("n_lines"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"),
    )


def letter_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter keys of every all-letter token of the vocabulary."""
    w = F.col("token")
    kept = _vocab(spark, sf_dir).where(w.rlike("^[a-z]+$"))
    return kept.select("token", X.sorted_letters(w).alias("sorted"), X.undoubled(w).alias("undoubled"), X.consonants(w).alias("consonants"), F.reverse(w).alias("reversed"))


def unflipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer turned upside down and back again."""
    a = D.benchmark_answers(spark, sf_dir)
    turned = F.reverse(F.translate("answer", T.ALPHABET, "ɐqɔpǝɟƃɥᴉɾʞlɯuodbɹsʇnʌʍxʎz"))
    return a.select("answer_ord", turned.alias("turned"), X.unflip(turned).alias("back"))


QUERIES = {
    "exact_hits": exact_hits, "normalize_ascii": normalized, "tokens": token_counts, "letter_keys": letter_keys, "unflip": unflipped,
    "exact_forms": _forms(D.exact_forms), "inflection_forms": _forms(D.inflections), "caesar_forms": _forms(D.caesar_forms), "key_forms": _forms(D.key_forms),
    "anagram_hits": _matcher(M.anagram), "damerau_hits": _matcher(M.typo), "dedupe_hits": _matcher(M.undoubled),
    "skeleton_hits": skeleton_hits, "interleave_hits": _matcher(M.interleaved), "caesar_hits": _matcher(M.caesar),
    "substring_hits": substring_hits, "wildcard_hits": _disguised(M.wildcard), "leet_hits": _disguised(M.leet),
    "visual_pair_hits": _disguised(M.looked_alike), "attack_sweep": attack_sweep,
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rot(c: str, n: int) -> str:
    return f"translate({c}, '{T.ALPHABET}', '{T.ALPHABET[n:] + T.ALPHABET[:n]}')"


def _fold(c: str) -> str:
    (a, b), (x, y) = T.style_folds(), T.latin_folds()
    return f"translate(translate(replace(lower({c}), 'ß', 'ss'), {_q(a)}, {_q(b)}), {_q(x)}, {_q(y)})"


def _norm(c: str) -> str:
    c = f"regexp_replace({c}, {_q(T.INVISIBLE)}, '', 'g')"
    for pattern, new in T.ASCII_ART:
        c = f"regexp_replace({c}, {_q(pattern)}, {_q(new)}, 'g')"
    for pattern, new in T.MARKUP:
        back = new.replace("$1", chr(92) + "1").replace("$2", chr(92) + "2")
        c = f"regexp_replace({c}, {_q(pattern)}, {_q(back)}, 'g')"
    return _fold(c)


def _tokens(c: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({c}, '\s+'), lambda t: regexp_replace(t, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), lambda t: t <> '')"


def _undoubled(c: str) -> str:
    return "regexp_replace(" * len(T.ALPHABET) + c + "".join(f", '{x}{x}+', '{x}', 'g')" for x in T.ALPHABET)


def _key(c: str, step: int) -> str:
    near = "".join(next((row[i] if 0 <= (i := row.index(k) + step) < len(row) else "?") for row in T.KEY_ROWS if k in row) for k in T.ALPHABET)
    return f"translate({c}, '{T.ALPHABET}', '{near}')"


ANSWERS_SQL = """answers AS (
  SELECT CAST(row_number() OVER (ORDER BY word) AS INTEGER) AS answer_ord, word AS answer FROM (
    SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM benchmark) WHERE length(word) = 5)"""
SEEN_SQL = f"seen AS (SELECT DISTINCT doc_id, unnest({_tokens(_fold('text'))}) AS token FROM documents)"
VOCAB_SQL = f"""{SEEN_SQL}, vocab AS (SELECT token, count(*) AS n_docs FROM seen GROUP BY 1),
words AS (SELECT token AS word FROM vocab WHERE n_docs >= 3 AND regexp_full_match(token, '[a-z]+')),
loose AS (SELECT * FROM vocab WHERE regexp_full_match(token, '[a-z]{{3,12}}') AND token NOT IN (SELECT word FROM words))"""
_SUFFIXES = ", ".join(map(_q, T.SUFFIXES))
_PIG = "regexp_extract(answer, '^[^aeiou]+')"
EXACT_SQL = f"""exact AS (SELECT DISTINCT * FROM (
  SELECT answer_ord, answer, 'plain' AS kind, answer AS form FROM answers UNION ALL
  SELECT answer_ord, answer, 'reverse', reverse(answer) FROM answers UNION ALL
  SELECT answer_ord, answer, 'rot13', {_rot('answer', 13)} FROM answers UNION ALL
  SELECT answer_ord, answer, 'atbash', translate(answer, '{T.ALPHABET}', '{T.ALPHABET[::-1]}') FROM answers UNION ALL
  SELECT answer_ord, answer, 'base64', lower(regexp_replace(base64(encode(answer)), '=+$', '')) FROM answers UNION ALL
  SELECT answer_ord, answer, 'hex', lower(hex(answer)) FROM answers UNION ALL
  SELECT answer_ord, answer, 'hex_upper', lower(hex(upper(answer))) FROM answers UNION ALL
  SELECT answer_ord, answer, 'keypad', translate(answer, '{T.ALPHABET}', '{T.KEYPAD}') FROM answers UNION ALL
  SELECT answer_ord, answer, 'key_left', {_key('answer', -1)} FROM answers WHERE NOT contains({_key('answer', -1)}, '?') UNION ALL
  SELECT answer_ord, answer, 'key_right', {_key('answer', 1)} FROM answers WHERE NOT contains({_key('answer', 1)}, '?') UNION ALL
  SELECT answer_ord, answer, 'pig_latin', unnest(CASE WHEN length({_PIG}) = 0 THEN [answer || 'way', answer || 'yay', answer || 'ay']
    ELSE list_transform(range(1, length({_PIG}) + 1), lambda k: substr(answer, k + 1) || substr(answer, 1, k) || 'ay') END) FROM answers))"""
INFLECT_SQL = f"""inflected AS (SELECT DISTINCT answer_ord, answer, 'inflection' AS kind, form FROM (
  SELECT answer_ord, answer, answer || unnest([{_SUFFIXES}]) AS form FROM answers UNION ALL
  SELECT answer_ord, answer, substr(answer, 1, length(answer) - 1) || unnest([{', '.join(map(_q, T.SUFFIXES_E))}]) FROM answers WHERE answer LIKE '%e' UNION ALL
  SELECT answer_ord, answer, substr(answer, 1, length(answer) - 1) || unnest([{', '.join(map(_q, T.SUFFIXES_Y))}]) FROM answers WHERE answer LIKE '%y'))"""
ACCEPTED_SQL = f"""{EXACT_SQL}, {INFLECT_SQL},
accepted AS (SELECT form, min(answer_ord) AS answer_ord, arg_min(answer, answer_ord) AS answer FROM (SELECT * FROM exact UNION ALL SELECT * FROM inflected) GROUP BY form)"""
_CAESAR = " UNION ALL ".join(f"SELECT answer_ord, answer, 'caesar' AS kind, {_rot('answer', n)} AS form FROM answers" for n in range(26))
_SORTED = "array_to_string(list_sort(string_split({0}, '')), '')"
_HIT = "token, n_docs, answer_ord, answer"
_ALIKE = "token"
for _pair, _letter in T.LOOKALIKES:
    _ALIKE = f"replace({_ALIKE}, '{_pair}', '{_letter}')"
_MORSE = "array_to_string(list_transform(string_split(answer, ''), lambda c: CASE c " + " ".join(f"WHEN '{a}' THEN '{m}'" for a, m in zip(T.ALPHABET, T.MORSE, strict=True)) + " END), ' ')"
_EVERY = "array_to_string(list_transform(range({0}, length(token) + 1, 2), lambda i: token[i]), '')"
#: Answers in disguises that prose seldom has, so that rules without a hit in the corpus are held against something.
MADE_SQL = """made AS (SELECT DISTINCT token, 0 AS n_docs FROM (SELECT translate(answer, 'oeas', '0345') AS token FROM answers UNION ALL SELECT translate(answer, 'it', '1+') FROM answers
  UNION ALL SELECT replace(replace(replace(answer, 'w', 'vv'), 'm', 'rn'), 'd', 'cl') FROM answers UNION ALL SELECT translate(answer, 'lgz', '192') FROM answers))"""
_LEET_STEP = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in T.LEET.items())
_LEET_SQL = rf"""RECURSIVE {ANSWERS_SQL}, {VOCAB_SQL}, {ACCEPTED_SQL},
{MADE_SQL}, wild AS (SELECT token, n_docs FROM (SELECT token, n_docs FROM vocab UNION ALL SELECT * FROM made) WHERE regexp_matches(token, '[0-9@$!|+(€£¢]') AND regexp_matches(token, '[a-z]')
  AND regexp_full_match(token, '[a-z0-9@$!|+(€£¢]+')
  AND 64 >= pow(2, length(token) - length(replace(token, '1', '')))),
v AS (SELECT token, n_docs, 0 AS i, '' AS s FROM wild UNION ALL
  SELECT token, n_docs, i + 1, s || unnest(string_split(CASE token[i + 1] {_LEET_STEP} ELSE token[i + 1] END, '')) FROM v WHERE i < length(token))"""
ANSWERS_M = ANSWERS_SQL.replace(" AS (", " AS MATERIALIZED (", 1)
VOCAB_M = VOCAB_SQL.replace("vocab AS (", "vocab AS MATERIALIZED (").replace("words AS (", "words AS MATERIALIZED (").replace("loose AS (", "loose AS MATERIALIZED (")


def _keyed(token: str, answer: str) -> str:
    """SQL of the tokens that share a key with an answer, keys computed once for each side."""
    return f"""WITH {ANSWERS_M}, {VOCAB_M}, a AS MATERIALIZED (SELECT answer_ord, answer, {answer} AS k FROM answers), t AS MATERIALIZED (SELECT token, n_docs, {token} AS k FROM loose)
        SELECT {_HIT} FROM t JOIN a USING (k)"""


def _deleted(c: str) -> str:
    return f"list_concat([{c}], list_transform(range(1, length({c}) + 1), lambda i: substr({c}, 1, i - 1) || substr({c}, i + 1)))"


ORACLES = {
    "exact_hits": f"""WITH {ANSWERS_SQL}, {SEEN_SQL}, {ACCEPTED_SQL}
      SELECT doc_id, answer_ord, answer, token FROM (
        SELECT s.doc_id, a.answer_ord, a.answer, s.token, row_number() OVER (PARTITION BY doc_id ORDER BY a.answer_ord, s.token) AS r
        FROM seen s JOIN accepted a ON s.token = a.form) WHERE r = 1""",
    "normalize_ascii": f"SELECT doc_id, {_norm('text')} AS norm FROM documents",
    "tokens": rf"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens,
        CAST(len(list_filter(t, lambda x: regexp_matches(x, '[a-z]'))) AS BIGINT) AS n_words,
        CAST(len(list_filter(string_split({_fold('text')}, chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS n_lines,
        md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, text, {_tokens(_fold('text'))} AS t FROM documents)""",
    "letter_keys": f"""WITH {VOCAB_SQL} SELECT token, {_SORTED.format('token')} AS sorted, {_undoubled('token')} AS undoubled,
        regexp_replace(token, '[aeiou]', '', 'g') AS consonants, reverse(token) AS reversed FROM vocab WHERE regexp_full_match(token, '[a-z]+')""",
    "unflip": f"""WITH {ANSWERS_SQL} SELECT answer_ord, reverse(translate(answer, '{T.ALPHABET}', 'ɐqɔpǝɟƃɥᴉɾʞlɯuodbɹsʇnʌʍxʎz')) AS turned,
        translate(reverse(reverse(translate(answer, '{T.ALPHABET}', 'ɐqɔpǝɟƃɥᴉɾʞlɯuodbɹsʇnʌʍxʎz'))), '{T.UPSIDE_DOWN[0]}', '{T.UPSIDE_DOWN[1]}') AS back FROM answers""",
    "exact_forms": f"WITH {ANSWERS_SQL}, {EXACT_SQL} SELECT answer_ord, answer, kind, form FROM exact",
    "inflection_forms": f"WITH {ANSWERS_SQL}, {INFLECT_SQL} SELECT answer_ord, answer, kind, form FROM inflected",
    "caesar_forms": f"WITH {ANSWERS_SQL} {_CAESAR}",
    "key_forms": f"""WITH {ANSWERS_SQL} SELECT answer_ord, answer, 'sorted' AS kind, {_SORTED.format('answer')} AS form FROM answers UNION ALL
        SELECT answer_ord, answer, 'undoubled', {_undoubled('answer')} FROM answers UNION ALL
        SELECT answer_ord, answer, 'consonants', regexp_replace(answer, '[aeiou]', '', 'g') FROM answers UNION ALL
        SELECT answer_ord, answer, 'morse', {_MORSE} FROM answers""",
    "anagram_hits": _keyed(_SORTED.format("token"), _SORTED.format("answer")),
    # strings a distance of one apart share themselves or one of their deletions
    "damerau_hits": f"""WITH {ANSWERS_M}, {VOCAB_M}, a AS MATERIALIZED (SELECT DISTINCT answer_ord, answer, unnest({_deleted('answer')}) AS k FROM answers),
        t AS MATERIALIZED (SELECT DISTINCT token, n_docs, unnest({_deleted('token')}) AS k FROM loose), p AS MATERIALIZED (SELECT DISTINCT {_HIT} FROM t JOIN a USING (k))
        SELECT {_HIT} FROM p WHERE damerau_levenshtein(token, answer) <= 1""",
    "dedupe_hits": _keyed(_undoubled("token"), _undoubled("answer")),
    "skeleton_hits": f"""WITH {ANSWERS_M}, {VOCAB_M}, s AS MATERIALIZED (SELECT answer_ord, answer, regexp_replace(answer, '[aeiou]', '', 'g') AS k FROM answers),
        m AS (SELECT DISTINCT k AS token, 0 AS n_docs FROM s ANTI JOIN words ON k = word WHERE answer_ord % 3 = 0)
        SELECT {_HIT} FROM (SELECT token, n_docs FROM loose UNION ALL SELECT * FROM m) JOIN s ON token = k WHERE length(token) >= 3""",
    "interleave_hits": f"""WITH {ANSWERS_M}, {VOCAB_M}, {ACCEPTED_SQL}, t AS MATERIALIZED (SELECT token, n_docs, unnest([{_EVERY.format(1)}, {_EVERY.format(2)}]) AS k FROM loose)
        SELECT DISTINCT {_HIT} FROM t JOIN accepted ON form = k WHERE length(token) BETWEEN 2 * length(answer) - 1 AND 2 * length(answer) + 1""",
    "caesar_hits": f"WITH {ANSWERS_SQL}, {VOCAB_SQL}, c AS (SELECT DISTINCT answer_ord, answer, form FROM ({_CAESAR})) SELECT {_HIT} FROM loose JOIN c ON token = form",
    # answers have five letters
    "substring_hits": f"""WITH {ANSWERS_M}, {VOCAB_M}, w AS MATERIALIZED (SELECT token, n_docs FROM vocab ANTI JOIN words ON token = word WHERE regexp_full_match(token, '[a-z]{{6,}}')),
        p AS MATERIALIZED (SELECT DISTINCT token, n_docs, unnest(list_transform(range(1, length(token) - 3), lambda i: substr(token, i, 5))) AS answer FROM w)
        SELECT {_HIT} FROM p JOIN answers USING (answer)""",
    "wildcard_hits": f"""WITH {ANSWERS_SQL}, {VOCAB_SQL}, {MADE_SQL} SELECT {_HIT} FROM (SELECT token, n_docs FROM vocab UNION ALL SELECT * FROM made) JOIN answers ON length(token) = length(answer)
        AND len(list_filter(range(1, length(answer) + 1), lambda i: regexp_matches(token[i], '[a-z]') AND token[i] <> answer[i])) = 0
        WHERE length(regexp_replace(token, '[^a-z]', '', 'g')) >= 3 AND regexp_matches(token, '[^a-z]')""",
    "leet_hits": f"WITH {_LEET_SQL} SELECT DISTINCT {_HIT} FROM v JOIN accepted ON s = form WHERE i = length(token) AND regexp_full_match(s, '[a-z]+')",
    "visual_pair_hits": f"WITH {ANSWERS_SQL}, {VOCAB_SQL}, {ACCEPTED_SQL}, {MADE_SQL} SELECT {_HIT} FROM (SELECT token, n_docs, {_ALIKE} AS k FROM (SELECT token, n_docs FROM vocab UNION ALL SELECT * FROM made)) JOIN accepted ON k = form WHERE k <> token",
}
_ATTACKS = {
    "plain": "answer", "reverse": "reverse(answer)", "rot13": _rot("answer", 13), "atbash": f"translate(answer, '{T.ALPHABET}', '{T.ALPHABET[::-1]}')", "keypad": f"translate(answer, '{T.ALPHABET}', '{T.KEYPAD}')",
    "doubled": r"regexp_replace(answer, '(.)', '\1\1', 'g')", "digits": "translate(answer, 'oeas', '0345')", "noise": "array_to_string(string_split(answer, ''), 'x')",
    "swapped": "answer[2] || answer[1] || answer[3:]", "inside": "'zz' || answer || 'q'", "suffix": "answer || 'ness'", "shift3": _rot("answer", 3),
}
_MADE_ATTACKS = " UNION ALL ".join(f"SELECT answer_ord AS true_ord, '{k}' AS disguise, {v} AS token FROM answers" for k, v in _ATTACKS.items())
ORACLES["attack_sweep"] = rf"""WITH RECURSIVE {ANSWERS_M}, {VOCAB_M}, {ACCEPTED_SQL}, c AS (SELECT DISTINCT answer_ord, form FROM ({_CAESAR})),
x AS MATERIALIZED ({_MADE_ATTACKS}), l AS MATERIALIZED (SELECT * FROM x ANTI JOIN words ON token = word WHERE regexp_full_match(token, '[a-z]{{3,12}}')),
v AS (SELECT true_ord, disguise, token, 0 AS i, '' AS s FROM x WHERE regexp_matches(token, '[0-9]') AND regexp_matches(token, '[a-z]') UNION ALL
  SELECT true_ord, disguise, token, i + 1, s || unnest(string_split(CASE token[i + 1] {_LEET_STEP} ELSE token[i + 1] END, '')) FROM v WHERE i < length(token)),
h AS (SELECT true_ord, disguise, answer_ord FROM x JOIN accepted ON token = form
  UNION SELECT true_ord, disguise, answer_ord FROM v JOIN accepted ON s = form WHERE i = length(token)
  UNION SELECT true_ord, disguise, answer_ord FROM x JOIN answers ON true_ord = answer_ord AND length(token) = length(answer) AND regexp_matches(token, '[^a-z]') AND length(regexp_replace(token, '[^a-z]', '', 'g')) >= 3
    AND len(list_filter(range(1, length(answer) + 1), lambda i: regexp_matches(token[i], '[a-z]') AND token[i] <> answer[i])) = 0
  UNION SELECT true_ord, disguise, answer_ord FROM l JOIN answers ON true_ord = answer_ord AND ({_SORTED.format('token')} = {_SORTED.format('answer')} OR damerau_levenshtein(token, answer) <= 1
    OR {_undoubled('token')} = {_undoubled('answer')} OR (contains(token, answer) AND length(token) > length(answer)))
  UNION SELECT true_ord, disguise, answer_ord FROM l JOIN accepted ON (form = {_EVERY.format(1)} OR form = {_EVERY.format(2)}) AND length(token) BETWEEN 2 * length(answer) - 1 AND 2 * length(answer) + 1
  UNION SELECT true_ord, disguise, answer_ord FROM l JOIN c ON token = form)
SELECT x.disguise, count(*) AS total, CAST(count(g.true_ord) AS BIGINT) AS caught FROM x LEFT JOIN (SELECT DISTINCT true_ord, disguise FROM h WHERE true_ord = answer_ord) g ON g.true_ord = x.true_ord AND g.disguise = x.disguise GROUP BY 1"""
