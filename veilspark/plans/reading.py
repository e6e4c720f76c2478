"""Queries of the rules that read across tokens and of the decoders, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import tables as T
from ..functions import text as X
from ..operators import decode as C
from ..operators import derive as D
from ..operators import reader as R
from ..operators import streams as S
from . import matching as Q


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, norm, tokens, words, lines) of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = D.pinned(docs, norm=X.fold_letters(F.col("text")))
    docs = D.pinned(docs, tokens=X.tokens(F.col("norm")))
    return docs.withColumns({"lines": X.lines(F.col("norm")), "words": X.words(F.col("tokens"))})


def split_join_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers split over neighbouring tokens: joined runs that are an accepted form, look-alikes read too (wildcards, digits and shifts over joined runs are the whole detector's)."""
    return S.split_words(Q._docs(spark, sf_dir), D.benchmark_answers(spark, sf_dir))


def boundary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that run across a word boundary."""
    return S.boundary(Q._docs(spark, sf_dir), D.benchmark_answers(spark, sf_dir))


def line_initial_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in the first letters of a document's lines."""
    answers = D.benchmark_answers(spark, sf_dir)
    # made-up texts with negative ids: an answer's letters down the lines, of some with a letter before
    said = F.when(F.col("answer_ord") % 2 == 0, F.col("answer")).otherwise(F.concat(F.lit("x"), "answer"))
    made = answers.select((-F.col("answer_ord")).cast("long").alias("doc_id"), F.transform(F.split(said, ""), lambda c: F.concat(c, F.lit("ome words"))).alias("lines"))
    docs = _read(spark, sf_dir).select("doc_id", "lines").unionByName(made)
    streams = docs.select("doc_id", S.line_initials(F.col("lines")).alias("stream")).where(F.col("stream").isNotNull())
    return S.in_stream(streams, answers, S.LONG_STREAM)


def grid_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the columns, and number of the diagonals, of every document's block of lines."""
    block = S.grid(_read(spark, sf_dir))
    cut = block.select("doc_id", S.columns_of(F.col("cells"), F.col("width")).alias("c"), S.diagonals_of(F.col("cells"), F.col("width")).alias("d"))
    return cut.select("doc_id", F.size("c").cast("long").alias("n_columns"), F.md5(F.array_join("c", "|").cast("binary")).alias("columns_md5"), F.size("d").cast("long").alias("n_diagonals"))


def column_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers down a column or along a diagonal of a document's lines."""
    return S.column_hits(Q._docs(spark, sf_dir), D.benchmark_answers(spark, sf_dir))


def reversed_initials_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers backwards in the initials of the words."""
    return S.reversed_initials(Q._docs(spark, sf_dir), D.benchmark_answers(spark, sf_dir))


def capital_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of capitals of every line of the documents that has any."""
    return R.by_text(Q._docs(spark, sf_dir), R.capital_streams, "line int, streams string")


def edit_arithmetic_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near misses beside the letter that mends them."""
    words = D.dictionary(Q._vocab(spark, sf_dir))
    return S.edit_arithmetic(Q._docs(spark, sf_dir), words, D.benchmark_answers(spark, sf_dir))


def number_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of numbers of every document."""
    docs = _read(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(C.number_runs(F.col("norm"))).alias("run", "r")).select("doc_id", F.array_join("r", " ").alias("numbers"))


def _cases(spark: SparkSession, sf_dir: str, forms: dict[str, Column]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("form"), v.alias("text")) for k, v in forms.items()])
    return D.benchmark_answers(spark, sf_dir).select("answer", F.explode(rows).alias("c")).select("answer", "c.form", "c.text")


def _each(answer_letters: Column, f) -> Column:
    return F.transform(answer_letters, f)


def _listed(texts: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(texts)), "|")


def number_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written as numbers, and what the decoder reads in them."""
    letters = F.split("answer", "")
    code = lambda c: F.ascii(c)
    cases = _cases(spark, sf_dir, {
        "a1z26": F.array_join(_each(letters, lambda c: (code(c) - 96).cast("string")), "-"),
        "a0z25": F.array_join(_each(letters, lambda c: (code(c) - 97).cast("string")), " "),
        "ascii": F.array_join(_each(letters, lambda c: code(c).cast("string")), " then "),
        "octal": F.array_join(_each(letters, lambda c: F.conv(code(c).cast("string"), 10, 8)), ","),
        "binary": F.array_join(_each(letters, lambda c: F.lpad(F.conv(code(c).cast("string"), 10, 2), 8, "0")), " "),
    })
    reads = F.flatten(F.transform(C.number_runs(F.col("text")), C.number_texts))
    return cases.select("answer", "form", _listed(C.candidates(reads)).alias("decoded"))


def escape_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written as escapes, and whether the decoder reads them."""
    letters = F.split("answer", "")
    low = lambda c: F.lower(F.hex(c))

    def each(before: str, after: str = "", sep: str = "") -> Column:
        return F.array_join(_each(letters, lambda c: F.concat(F.lit(before), low(c), F.lit(after))), sep)

    cases = _cases(spark, sf_dir, {
        "u": each("\\u00"), "x": each("\\x"), "plus": each("U+00", "", " "), "percent": each("%"), "percent_u": each("%u00"),
        "entity_hex": each("&#x", ";"), "entity": F.array_join(_each(letters, lambda c: F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))), ""),
        "hex_bytes": each("", "", " "), "hex_0x": F.concat(F.lit("0x"), F.lower(F.hex("answer"))),
        "bits": F.array_join(_each(letters, lambda c: F.lpad(F.conv(F.ascii(c).cast("string"), 10, 2), 8, "0")), ""),
    })
    return cases.select("answer", "form", _listed(C.candidates(C.escape_texts(F.col("text")))).alias("decoded"))


def base64_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with an answer in Base64, padded and not, decoded again."""
    sentence = F.concat(F.lit("it is "), F.col("answer"), F.lit(" today"))
    coded = F.base64(sentence.cast("binary"))
    cases = _cases(spark, sf_dir, {"padded": F.concat(F.lit("look: "), coded), "bare": F.regexp_replace(coded, "=+$", "")})
    return cases.select("answer", "form", F.array_join(C.base64_texts(F.col("text")), "|").alias("decoded"))


def base64_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with Base64 runs that decode to printable text, and how many."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.size(C.base64_texts(F.col("text"))).cast("long").alias("n_decoded")).where(F.col("n_decoded") > 0)


def spoken_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters that documents spell by names."""
    return _read(spark, sf_dir).select("doc_id", F.explode(C.spelled(F.col("words"))).alias("letters"))


def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as number words (a = one), read back as digits."""
    small = {n: w for w, n in T.UNITS.items()} | {20 + n: f"twenty {w}" for w, n in T.UNITS.items() if 0 < n < 10} | {20: "twenty"}
    table = F.create_map(*[F.lit(x) for i in range(1, 27) for x in (T.ALPHABET[i - 1], small[i])])
    said = F.array_join(F.transform(F.split("answer", ""), lambda c: F.element_at(table, c)), " ")
    a = D.benchmark_answers(spark, sf_dir).select("answer", said.alias("said"))
    return a.select("answer", "said", C.number_words(F.split("said", " ")).alias("digits"))


def morse_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in Morse with other marks, read back as Morse with letters between spaces."""
    code = X.morse(F.col("answer"))
    cases = _cases(spark, sf_dir, {"plain": code, "slashes": F.replace(code, F.lit(" "), F.lit("/")), "marks": F.translate(code, ".-", "•—"), "commas": F.replace(code, F.lit(" "), F.lit(", "))})
    return cases.select("answer", "form", F.exists(C.morse_texts(F.col("text")), lambda t: F.contains(t, code_of(F.col("answer")))).alias("found"))


def code_of(answer: Column) -> Column:
    return X.morse(answer)


QUERIES = {
    "split_join_hits": split_join_hits, "boundary_hits": boundary_hits, "line_initial_hits": line_initial_hits, "grid_streams": grid_streams,
    "column_hits": column_hits, "reversed_initials_hits": reversed_initials_hits, "capital_streams": capital_streams,
    "edit_arithmetic_hits": edit_arithmetic_hits, "number_runs": number_runs, "number_decode": number_decode, "escape_decode": escape_decode,
    "base64_decode": base64_decode, "base64_runs": base64_runs, "spoken_letters": spoken_letters, "number_words": number_words, "morse_decode": morse_decode,
}

_A = Q.ANSWERS_SQL
_PARTS = r"list_filter(list_transform(tok, lambda t: regexp_replace(t, '[^a-z0-9@$!|+(€£¢]', '', 'g')), lambda t: t <> '')"
_READ = rf"""docs AS (SELECT doc_id, text, {Q._fold('text')} AS norm FROM documents),
cut AS (SELECT doc_id, text, norm, {Q._tokens('norm')} AS tok,
  list_filter(list_transform(string_split(norm, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM docs),
rd AS (SELECT *, list_filter(list_transform(tok, lambda t: regexp_replace(t, '[^a-z]', '', 'g')), lambda t: t <> '') AS ws FROM cut)"""
_ALIKE = "joined"
for _p, _l in T.LOOKALIKES:
    _ALIKE = f"replace({_ALIKE}, '{_p}', '{_l}')"
_IN_STREAM = f"""SELECT DISTINCT doc_id, stream, answer_ord, answer FROM s JOIN (SELECT * FROM accepted) a ON stream = form WHERE length(stream) >= 3
  UNION SELECT DISTINCT doc_id, stream, answer_ord, answer FROM s JOIN answers ON length(stream) >= 3 AND length(stream) <= {S.LONG_STREAM} AND (contains(stream, answer) OR contains(stream, reverse(answer)))"""
_GRID = f"""g AS (SELECT doc_id, CASE WHEN len(lines) >= 3 THEN list_transform(lines[1:{S.GRID_ROWS}], lambda x: substr(regexp_replace(x, '\\s+', '', 'g'), 1, {S.GRID_COLUMNS})) ELSE [] END AS r FROM rd),
w AS (SELECT doc_id, r, coalesce(list_max(list_transform(r, lambda x: length(x))), 0) AS width FROM g),
c AS (SELECT doc_id, list_transform(range(1, width + 1), lambda j: array_to_string(list_transform(r, lambda x: substr(x, j, 1)), '')) AS cols,
  CASE WHEN len(r) >= 3 AND width >= 1 THEN list_filter(list_distinct(list_concat(
    list_transform(range(3 - len(r), greatest(width - 2, 0) + 1), lambda d: array_to_string(list_transform(r, lambda x, i: CASE WHEN d + i - 1 >= 1 THEN substr(x, CAST(d + i - 1 AS BIGINT), 1) ELSE '' END), '')),
    list_transform(range(3 - len(r), greatest(width - 2, 0) + 1), lambda d: array_to_string(list_transform(r, lambda x, i: CASE WHEN width + 2 - d - i >= 1 THEN substr(x, CAST(width + 2 - d - i AS BIGINT), 1) ELSE '' END), ''))
  )), lambda z: length(z) >= 3) ELSE [] END AS diags FROM w)"""
_NATO_CASE = " ".join(f"WHEN '{w}' THEN '{l}'" for w, l in {**T.LETTER_NAMES, **T.NATO}.items())


def _each_sql(of: str, sep: str = "", before: str = "", after: str = "") -> str:
    """SQL that writes each letter c of an answer."""
    return f"array_to_string(list_transform(string_split(answer, ''), lambda c: '{before}' || {of} || '{after}'), '{sep}')"


def _forms_sql(forms: dict[str, str]) -> str:
    return "x AS (" + " UNION ALL ".join(f"SELECT answer, '{k}' AS form, {v} AS text FROM answers" for k, v in forms.items()) + ")"


_HEX, _BITS = "lower(hex(c))", "lpad(bin(ascii(c)), 8, '0')"
_NUMBER_FORMS = _forms_sql({
    "a1z26": _each_sql("(ascii(c) - 96)", "-"), "a0z25": _each_sql("(ascii(c) - 97)", " "), "ascii": _each_sql("ascii(c)", " then "),
    "octal": _each_sql("format('{:o}', ascii(c))", ","), "binary": _each_sql(_BITS, " "),
})
_ESCAPE_FORMS = _forms_sql({
    "u": _each_sql(_HEX, before=r"\u00"), "x": _each_sql(_HEX, before=r"\x"), "plus": _each_sql(_HEX, " ", "U+00"), "percent": _each_sql(_HEX, before="%"), "percent_u": _each_sql(_HEX, before="%u00"),
    "entity_hex": _each_sql(_HEX, before="&#x", after=";"), "entity": _each_sql("ascii(c)", before="&#", after=";"), "hex_bytes": _each_sql(_HEX, " "),
    "hex_0x": "'0x' || lower(hex(answer))", "bits": _each_sql(_BITS),
})
_CHARS = "array_to_string(list_transform({0}, lambda n: chr(CAST({1} AS INTEGER))), '')"
#: Decoded texts as they are kept: letters and spaces, three letters at least, sorted.
_KEPT = r"array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter({0}, lambda z: z IS NOT NULL), lambda z: trim(regexp_replace(z, '[^a-z\s]', ' ', 'g'))), lambda z: regexp_matches(regexp_replace(z, '\s', '', 'g'), '[a-z]{{3}}')))), '|')"
_NUMBER_READS = f"""[CASE WHEN len(l) >= 3 AND len(list_filter(v, lambda n: n <> 0)) - len(l) <= 2 THEN {_CHARS.format('l', 'n + 96')} END,
  CASE WHEN list_min(v) >= 0 AND list_max(v) <= 25 THEN {_CHARS.format('v', 'n + 97')} END, CASE WHEN list_min(v) >= 65 AND list_max(v) <= 122 THEN lower({_CHARS.format('v', 'n')}) END,
  CASE WHEN len(list_filter(r, lambda n: NOT regexp_full_match(n, '1[0-7][0-7]'))) = 0 THEN lower({_CHARS.format('r', "CAST(n[1] AS INT) * 64 + CAST(n[2] AS INT) * 8 + CAST(n[3] AS INT)")}) END,
  CASE WHEN len(list_filter(r, lambda n: NOT regexp_full_match(n, '[01]{{7,8}}'))) = 0 THEN lower({_CHARS.format('r', "'0b' || n")}) END]"""
_MORSE_CASE = " ".join(f"WHEN '{m}' THEN '{c}'" for c, m in zip(T.ALPHABET, T.MORSE, strict=True))
_MORSE_FORMS = _forms_sql({"plain": Q._MORSE, "slashes": f"replace({Q._MORSE}, ' ', '/')", "marks": f"translate({Q._MORSE}, '.-', '•—')", "commas": f"replace({Q._MORSE}, ' ', ', ')"})
_UNITS, _TENS = T.UNITS | T.ORDINAL_UNITS, T.TENS | T.ORDINAL_TENS
_VALUES = {f"{w}th": n for w, n in (_UNITS | _TENS).items()} | _UNITS | _TENS
_SAID = {n: w for w, n in T.UNITS.items()} | {20 + n: f"twenty {w}" for w, n in T.UNITS.items() if 0 < n < 10} | {20: "twenty"}
_SAID_CASE = "CASE c " + " ".join(f"WHEN '{T.ALPHABET[i - 1]}' THEN '{_SAID[i]}'" for i in range(1, 27)) + " END"
_VALUE = "CASE {0} " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in _VALUES.items()) + " END"
_LOW = ", ".join(f"'{w}'" for w, n in _UNITS.items() if n < 10)
_TEN = ", ".join(f"'{w}'" for w, n in _VALUES.items() if n >= 20)

ORACLES = {
    "split_join_hits": f"""WITH {_A}, {_READ}, {Q.ACCEPTED_SQL}, p AS (SELECT doc_id, {_PARTS} AS p FROM rd),
      e AS (SELECT doc_id, i - 1 AS pos, n, array_to_string(p[i:i + n - 1], '') AS joined FROM p, unnest(range(1, len(p) + 1)) AS u(i), unnest(range(2, 13)) AS v(n) WHERE i + n - 1 <= len(p)),
      f AS (SELECT doc_id, pos, n, joined, joined AS v FROM e WHERE length(joined) <= 8 UNION SELECT doc_id, pos, n, joined, {_ALIKE} FROM e WHERE length(joined) <= 8)
      SELECT DISTINCT doc_id, CAST(pos AS INTEGER) AS pos, CAST(n AS INTEGER) AS n, joined, answer_ord, answer FROM f JOIN accepted ON v = form""",
    "boundary_hits": f"""WITH {_A}, {_READ}, w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM rd),
      s AS (SELECT doc_id, i, right(concat(lag(w, 4) OVER o, lag(w, 3) OVER o, lag(w, 2) OVER o, lag(w) OVER o), 4) AS l, left(concat(w, lead(w) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o), 4) AS r
        FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i))
      SELECT DISTINCT doc_id, answer_ord, answer FROM (SELECT doc_id, substr(l || r, length(l) - k + 1, 5) AS piece FROM s, unnest(range(1, 5)) AS u(k) WHERE i > 1 AND k <= length(l)) JOIN answers ON piece = answer""",
    "line_initial_hits": f"""WITH {_A}, {_READ}, {Q.ACCEPTED_SQL}, b AS (SELECT doc_id, lines FROM rd UNION ALL
        SELECT -answer_ord, list_transform(string_split(CASE WHEN answer_ord % 2 = 0 THEN answer ELSE 'x' || answer END, ''), lambda c: c || 'ome words') FROM answers),
      s AS (SELECT doc_id, array_to_string(list_transform(lines, lambda x: coalesce(regexp_extract(x, '[a-z]'), '')), '') AS stream FROM b WHERE len(lines) >= 3) {_IN_STREAM}""",
    "grid_streams": f"WITH {_READ}, {_GRID} SELECT doc_id, CAST(len(cols) AS BIGINT) AS n_columns, md5(array_to_string(cols, '|')) AS columns_md5, CAST(len(diags) AS BIGINT) AS n_diagonals FROM c",
    "column_hits": f"""WITH {_A}, {_READ}, {_GRID}, {Q.ACCEPTED_SQL}, s AS (SELECT doc_id, regexp_replace(unnest(list_concat(cols, diags)), '[^a-z]', '', 'g') AS stream FROM c) {_IN_STREAM}""",
    "reversed_initials_hits": f"""WITH {_A}, {_READ}, x AS (SELECT doc_id, array_to_string(list_transform(ws, lambda z: substr(z, 1, 1)), '') AS s FROM rd)
      SELECT DISTINCT doc_id, answer_ord, answer FROM x JOIN answers ON contains(s, reverse(answer)) OR regexp_matches(s, reverse(answer)[1:1] || '.' || reverse(answer)[2:]) OR regexp_matches(s, reverse(answer)[1:2] || '.' || reverse(answer)[3:])
        OR regexp_matches(s, reverse(answer)[1:3] || '.' || reverse(answer)[4:]) OR regexp_matches(s, reverse(answer)[1:4] || '.' || reverse(answer)[5:])""",
    "capital_streams": r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), r AS (SELECT doc_id, i - 1 AS line, ls[i] AS raw FROM l, unnest(range(1, len(ls) + 1)) AS u(i)),
      n AS (SELECT *, regexp_replace(raw, 'https?://\S+', ' ', 'g') AS nl FROM r), t AS (SELECT *, regexp_replace(nl, '\b[A-Z]{2,}\b', ' ', 'g') AS t FROM n),
      k AS (SELECT *, length(regexp_replace(t, '[^a-z]', '', 'g')) AS lo, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(nl, '[^a-z]', '', 'g')) AS sl, length(regexp_replace(nl, '[^A-Z]', '', 'g')) AS su FROM t),
      m AS (SELECT doc_id, line, list_concat(CASE WHEN lo >= 3 AND up BETWEEN 3 AND 12 THEN [lower(regexp_replace(t, '[^A-Z]', '', 'g')), lower(regexp_replace(regexp_replace(t, '(^|[.!?]\s+)[A-Z]', '\1', 'g'), '[^A-Z]', '', 'g')), lower(regexp_replace(regexp_replace(t, '\bI\b', '', 'g'), '[^A-Z]', '', 'g'))] ELSE [] END,
        CASE WHEN sl BETWEEN 3 AND 12 AND su > sl THEN [regexp_replace(nl, '[^a-z]', '', 'g')] ELSE [] END) AS s FROM k),
      d AS (SELECT doc_id, line, list_filter(s, lambda x, i: i = 1 OR NOT list_contains(s[1:i - 1], x)) AS s FROM m)
      SELECT doc_id, CAST(line AS INTEGER) AS line, array_to_string(s, ',') AS streams FROM d WHERE array_to_string(s, ',') <> ''""",
    "number_runs": r"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(norm, '([0-9])(?:st|nd|rd|th)\b', '\1', 'g'), '[^a-z0-9]+'), lambda x: x <> '') AS p FROM (SELECT doc_id, """ + Q._fold("text") + r""" AS norm FROM documents)),
      e AS (SELECT doc_id, i, p[i] AS t FROM p, unnest(range(1, len(p) + 1)) AS u(i) WHERE regexp_full_match(p[i], '[0-9]+')),
      g AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 3 THEN 0 ELSE 1 END AS new FROM e),
      h AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
      r AS (SELECT doc_id, list(t ORDER BY i) AS r FROM h GROUP BY doc_id, run HAVING count(*) >= 3)
      SELECT doc_id, array_to_string(r, ' ') AS numbers FROM r UNION ALL
      SELECT doc_id, array_to_string(list_filter(r, lambda x, i: i % 2 = 0), ' ') FROM r WHERE len(r) >= 6 AND len(r) % 2 = 0
        AND len(list_filter(r, lambda x, i: i % 2 = 1 AND try_cast(x AS HUGEINT) IS DISTINCT FROM (i + 1) // 2)) = 0""",
    "base64_decode": f"""WITH {_A}, b AS (SELECT answer, base64(encode('it is ' || answer || ' today')) AS b FROM answers),
      x AS (SELECT answer, 'padded' AS form, 'look: ' || b AS text FROM b UNION ALL SELECT answer, 'bare', rtrim(b, '=') FROM b),
      r AS (SELECT answer, form, regexp_extract(text, '([A-Za-z0-9+/]{{6,}})={{0,2}}', 1) AS r FROM x)
      SELECT answer, form, decode(from_base64(r || repeat('=', CAST((4 - length(r) % 4) % 4 AS BIGINT)))) AS decoded FROM r""",
    "base64_runs": r"""WITH r AS (SELECT doc_id, regexp_extract_all(text, '([A-Za-z0-9+/]{6,})={0,2}', 1) AS r FROM documents),
      w AS (SELECT doc_id, list_transform(r, lambda x: CASE WHEN length(x) % 4 = 1 THEN substr(x, 1, length(x) - 1) ELSE x END) AS w FROM r),
      t AS (SELECT doc_id, unnest(w) AS w FROM w), d AS (SELECT doc_id, TRY(decode(from_base64(w || repeat('=', CAST((4 - length(w) % 4) % 4 AS BIGINT))))) AS s FROM t)
      SELECT doc_id, count(*) AS n_decoded FROM d WHERE regexp_full_match(s, '[\p{L}\p{N}\p{P}\p{S}\s]+') GROUP BY doc_id""",
    "escape_decode": rf"""WITH {_A}, {_ESCAPE_FORMS}, c AS (SELECT answer, form, CASE form
        WHEN 'u' THEN regexp_extract_all(text, '\\u([0-9a-f]{{4}})', 1) WHEN 'x' THEN regexp_extract_all(text, '\\x([0-9a-f]{{2}})', 1) WHEN 'plus' THEN regexp_extract_all(text, 'U\+([0-9a-f]{{4}})', 1)
        WHEN 'percent' THEN regexp_extract_all(text, '%([0-9a-f]{{2}})', 1) WHEN 'percent_u' THEN regexp_extract_all(text, '%u([0-9a-f]{{4}})', 1) WHEN 'entity_hex' THEN regexp_extract_all(text, '&#x([0-9a-f]+);', 1)
        WHEN 'entity' THEN list_transform(regexp_extract_all(text, '&#([0-9]+);', 1), lambda n: lower(hex(CAST(n AS INTEGER)))) WHEN 'hex_bytes' THEN string_split(text, ' ')
        WHEN 'hex_0x' THEN regexp_extract_all(substr(text, 3), '..') ELSE list_transform(regexp_extract_all(text, '.{{8}}'), lambda n: lower(hex(CAST('0b' || n AS INTEGER)))) END AS codes FROM x)
      SELECT answer, form, {_KEPT.format('[lower(' + _CHARS.format('codes', "'0x' || n") + ')]')} AS decoded FROM c""",
    "number_decode": f"""WITH {_A}, {_NUMBER_FORMS}, r AS (SELECT answer, form, regexp_extract_all(text, '[0-9]+') AS r FROM x),
      v AS (SELECT *, list_transform(r, lambda n: CAST(n AS BIGINT)) AS v FROM r), l AS (SELECT *, list_filter(v, lambda n: n BETWEEN 1 AND 26) AS l FROM v)
      SELECT answer, form, {_KEPT.format(_NUMBER_READS)} AS decoded FROM l""",
    "morse_decode": f"""WITH {_A}, {_MORSE_FORMS}, l AS (SELECT answer, form, regexp_split_to_array(translate(text, '•—', '.-'), '[ ,/]+') AS l FROM x)
      SELECT answer, form, array_to_string(list_transform(l, lambda m: CASE m {_MORSE_CASE} END), '') = answer AS found FROM l""",
    "spoken_letters": rf"""WITH {_READ}, p AS (SELECT doc_id, string_split(regexp_replace(array_to_string(ws, ' '), '\b(?:double|doble) (?:u|you|yu|ve)\b', 'doubleu', 'g'), ' ') AS p FROM rd),
      w AS (SELECT doc_id, i, p[i] AS w FROM p, unnest(range(1, len(p) + 1)) AS u(i)), e AS (SELECT doc_id, i, CASE w {_NATO_CASE} END AS c FROM w),
      g AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 2 THEN 0 ELSE 1 END AS new FROM e WHERE c IS NOT NULL),
      h AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g)
      SELECT doc_id, string_agg(c, '' ORDER BY i) AS letters FROM h GROUP BY doc_id, run HAVING count(*) >= 3""",
    "number_words": f"""WITH {_A}, x AS (SELECT answer, {_each_sql(_SAID_CASE, ' ')} AS said FROM answers), w AS (SELECT answer, said, string_split(said, ' ') AS w FROM x)
      SELECT answer, said, array_to_string(list_filter(list_transform(w, lambda x, i: CASE WHEN i > 1 AND x IN ({_LOW}) AND w[i - 1] IN ({_TEN}) THEN NULL
        WHEN x IN ({_TEN}) AND w[i + 1] IN ({_LOW}) THEN CAST({_VALUE.format('x')} + {_VALUE.format('w[i + 1]')} AS VARCHAR) ELSE CAST({_VALUE.format('x')} AS VARCHAR) END), lambda z: z IS NOT NULL), ' ') AS digits FROM w""",
    "edit_arithmetic_hits": rf"""WITH {_A}, {Q.VOCAB_SQL}, {_READ}, near AS (
        SELECT word, answer_ord, answer, (SELECT min(i) FROM unnest(range(1, greatest(length(word), length(answer)) + 1)) AS u(i) WHERE substr(word, i, 1) <> substr(answer, i, 1)) AS i
        FROM words JOIN answers ON word <> answer AND length(word) >= 4 AND abs(length(word) - length(answer)) <= 1 AND damerau_levenshtein(word, answer) <= 1),
      ed AS (SELECT word, answer_ord, answer, CASE WHEN length(word) > length(answer) THEN substr(word, i, 1) ELSE substr(answer, i, 1) END AS edit FROM near),
      tx AS (SELECT doc_id, norm, ws, list_filter(list_distinct(list_concat(ws, list_transform(ws, lambda joined: {_ALIKE}))), lambda z: length(z) = 1) AS alone FROM rd)
      SELECT DISTINCT doc_id, word, answer_ord, answer FROM (SELECT doc_id, norm, alone, unnest(ws) AS w FROM tx WHERE len(alone) > 0) t JOIN ed ON t.w = ed.word
      WHERE list_contains(alone, edit) AND (edit NOT IN ('a', 'i') OR regexp_matches(norm, '\b{T.INSTRUCTIONS}\b') OR regexp_matches(norm, '\bletter\b'))""",
}
