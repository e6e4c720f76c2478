"""Dataset operators: grouped split, leak filter, plans, jobs, attempts, missing dates, prompts, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .metrics import LABELS
from .ordered import hashed_part, part_of, running

# Endings with which a word still names the answer.
ENDINGS = "s es ed d ing er ers ly y".split()


def grouped_split(rows: DataFrame, by: str, test: float = 0.2, val: float = 0.1, seed: int = 7) -> DataFrame:
    """``rows`` with split; all rows of one ``by`` are in one split.

    Groups are ranked by a hash of name and seed; sizes round half to even, the first ranks are test, then
    val, the rest train. An error if a split would be empty.
    """
    groups = rows.select(by).distinct()
    n = groups.count()
    n_test, n_val = round(n * test), round(n * val)
    if min(n_test, n_val, n - n_test - n_val) < 1:
        raise ValueError(f"{n} groups leave a split empty")
    hashed = F.md5(F.concat(F.col(by), F.lit(f":{seed}")))
    ranked = running(groups, hashed_part(hashed), [hashed, F.col(by)], {"__r": F.lit(1)})
    split = F.when(F.col("__r") < n_test, "test").when(F.col("__r") < n_test + n_val, "val").otherwise("train")
    return rows.join(ranked.select(by, split.alias("split")), by)


def mentions(text: Column, word: Column) -> Column:
    """True where the text has the word on its own or with a common ending: one of its words is such a form."""
    forms = F.array(word, *[F.concat(word, F.lit(e)) for e in ENDINGS])
    return F.arrays_overlap(F.split(F.lower(text), r"(?U)\W+"), forms)


def leak_filter(rows: DataFrame) -> DataFrame:
    """Rows (answer, text, context, label) without those labelled as hints that in fact name the answer."""
    told = mentions(F.col("text"), F.col("answer")) | F.exists("context", lambda c: mentions(c["text"], F.col("answer")))
    return rows.where((F.col("label") == "direct") | ~told)


def systematic(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """Every k-th row in order (its first column a number), k the least step that leaves ``most`` rows or fewer: a sampling operator."""
    n = rows.count()
    step = max(1, -(-n // most))
    numbered = running(rows, part_of(rows, F.col(order[0])), [F.col(c) for c in order], {"__i": F.lit(1)})
    return numbered.where(F.col("__i") % step == 0).drop("__i")


def jobs(words: DataFrame, templates: DataFrame) -> DataFrame:
    """Every word with every template; templates are a short list."""
    return words.crossJoin(F.broadcast(templates))


def style_plan(words: DataFrame, styles: list[str], per_word: int, seed: int = 7) -> DataFrame:
    """(word, slot, style): ``per_word`` styles of each word in a hashed order, begun again when all are used."""
    order = F.array_sort(F.array(*[F.struct(F.md5(F.concat(F.col("word"), F.lit(f":{s}:{seed}"))).alias("h"), F.lit(s).alias("s")) for s in styles]))
    slots = words.select("word", F.explode(F.sequence(F.lit(0), F.lit(per_word - 1))).alias("slot"), order.alias("o"))
    return slots.select("word", "slot", F.get("o", F.col("slot") % len(styles))["s"].alias("style"))


def missing_dates(days: DataFrame, have: DataFrame) -> DataFrame:
    """Days of a calendar (date) without a cached row."""
    return days.join(have.select("date"), "date", "left_anti")


def calendar(spark, first: str, last: str) -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS date")


def selected_dates(now: Column, zone: str, back: int) -> Column:
    """The calendar date of an instant in a zone and the ``back`` (0 to 31) days before it, newest first."""
    if not 0 <= back <= 31:
        raise ValueError("back must be 0 to 31")
    day = F.to_date(F.from_utc_timestamp(now, zone))
    return F.sequence(day, F.date_sub(day, back), F.expr("INTERVAL -1 DAY"))


def parse_examples(responses: DataFrame, prefix: Column) -> DataFrame:
    """(id, text, label, style): examples of JSON responses (response), ids numbered in each response; an unknown label is an error."""
    kind = "struct<examples:array<struct<text:string,label:string,style:string>>>"
    rows = responses.select(prefix.alias("p"), F.posexplode(F.from_json("response", kind)["examples"]).alias("i", "e"))
    known = F.coalesce(F.col("e.label").isin(LABELS), F.lit(False))
    label = F.when(known, F.col("e.label")).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce("e.label", F.lit("null")))))
    return rows.select(F.format_string("%s-%02d", "p", "i").alias("id"), "e.text", label.alias("label"), "e.style")


def word_sample(words: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """``n`` different words of (word), the first by a hash of word and seed: a sampling operator. An error if there are fewer."""
    pool = words.select(F.lower("word").alias("word")).where(F.col("word") != "").distinct()
    if pool.limit(n).count() < n:
        raise ValueError(f"fewer than {n} words")
    return pool.orderBy(F.md5(F.concat("word", F.lit(f":{seed}"))), "word").limit(n)


def rejoin(jobs_: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs (custom_id, any others) with the text of their results (custom_id, type, stop_reason, text).

    It is an error if a result has not succeeded to the end of its turn, or belongs to no job.
    """
    mine = results.select("custom_id", "type", "stop_reason", "text").join(jobs_.withColumn("__job", F.lit(True)), "custom_id", "left")
    wrong = F.concat(F.col("custom_id"), F.lit(": "), F.concat_ws(" ", "type", "stop_reason"))
    fine = F.col("__job") & (F.col("type") == "succeeded") & (F.col("stop_reason") == "end_turn")
    text = F.when(F.coalesce(fine, F.lit(False)), F.col("text")).otherwise(F.raise_error(wrong))
    return mine.select(*jobs_.columns, text.alias("text"))


def judge_request(instructions: str, answers: list[str], content: Column, evidence: Column) -> Column:
    """Request to a judge as a struct: cached instructions, the protected answers, the content, and pointers (kind, candidate) if there are any."""
    if not answers:
        raise ValueError("a judge needs a protected answer")
    named = F.lit(f"Protected answers: {', '.join(a.upper() for a in answers)}.")
    hints = F.concat(F.lit("Evidence:\n"), F.array_join(F.transform(evidence, lambda e: F.concat(e["kind"], F.lit(": "), e["candidate"])), "\n"))
    parts = F.array_compact(F.array(content, F.when(F.size(evidence) > 0, hints)))
    return F.struct(
        F.array(F.struct(F.lit(instructions).alias("text"), F.lit(True).alias("cached")), F.struct(named.alias("text"), F.lit(False).alias("cached"))).alias("system"),
        parts.alias("user"),
    )


def attempts(rows: DataFrame, messages: int = 12, chars: int = 2000) -> DataFrame:
    """Normalised playground attempts; invalid ones go.

    Takes (id, word, messages, text, deleted, caught, intent, nickname). Older rows have one text and one flag. Messages
    are cut to ``chars``, blank ones go with their flags, ``messages`` stay; the word must be five letters.
    """
    said = F.when(F.size("messages") > 0, F.col("messages")).otherwise(F.array("text"))
    paired = F.size(said) == F.size("deleted")
    flags = F.when(paired, F.col("deleted")).otherwise(F.transform(said, lambda m: F.coalesce("caught", F.lit(False))))
    cut = F.transform(F.arrays_zip(said.alias("m"), flags.alias("d")), lambda z: F.struct(F.substring(F.coalesce(z["m"], F.lit("")), 1, chars).alias("m"), F.coalesce(z["d"], F.lit(False)).alias("d")))
    kept = F.slice(F.filter(cut, lambda z: F.trim(z["m"]) != ""), 1, messages)
    out = rows.select("id", F.lower("word").alias("word"), kept.alias("k"), "intent", "nickname")
    out = out.where(F.col("word").rlike("^[a-z]{5}$") & (F.size("k") > 0))
    return out.select(
        "id", "word", F.transform("k", lambda z: z["m"]).alias("messages"), F.transform("k", lambda z: z["d"]).alias("deleted"),
        F.when(F.col("intent") == "innocent", "innocent").otherwise("leak").alias("intent"),
        F.exists("k", lambda z: z["d"]).alias("caught"), F.trim(F.substring(F.coalesce("nickname", F.lit("")), 1, 24)).alias("nickname"),
    )


def scores(label: Column, confidence: Column, refused: Column, labels: list[str]) -> Column:
    """Map of label to probability of a judge's verdict: the rest shared evenly; a refusal is benign for sure."""
    rest = (1 - confidence) / (len(labels) - 1)
    said = F.map_from_arrays(F.array(*map(F.lit, labels)), F.array(*[F.when(label == x, confidence).otherwise(rest) for x in labels]))
    sure = F.map_from_arrays(F.array(*map(F.lit, labels)), F.array(*[F.lit(1.0 if x == "benign" else 0.0) for x in labels]))
    return F.when(refused, sure).otherwise(said)


def best_label(scores_: Column, labels: list[str]) -> Column:
    """Label of the greatest probability, ties to the first in order."""
    ranked = F.array(*[F.struct(F.element_at(scores_, F.lit(x)).alias("p"), F.lit(-i).alias("o"), F.lit(x).alias("l")) for i, x in enumerate(labels)])
    return F.array_max(ranked)["l"]


def deleted(verdict: Column, confidence: Column) -> Column:
    """A judge's verdict deletes a spoiler from 0.5 and a hint from 0.7."""
    return ((verdict == "spoiler") & (confidence >= 0.5)) | ((verdict == "hint") & (confidence >= 0.7))


def prompt(text: Column, context: Column, answer: Column) -> Column:
    """Prompt of a text with the messages before it."""
    before = F.array_join(F.transform(context, lambda c: F.concat(c["author"], F.lit(": "), c["text"])), "\n")
    return F.concat(F.lit("Answer: "), answer, F.lit("\n"), F.when(F.size(context) > 0, F.concat(F.lit("Context:\n"), before, F.lit("\n"))).otherwise(""), F.lit("Message: "), text)


def valid_verdicts(rows: DataFrame, verdicts: list[str]) -> DataFrame:
    """Rows whose JSON ``response`` is exactly a known verdict, a confidence from 0 to 1 and a reason."""
    read = F.from_json("response", "struct<verdict:string,confidence:double,reason:string>")
    keys = F.array_sort(F.map_keys(F.from_json("response", "map<string,string>")))
    good = read["verdict"].isin(verdicts) & read["confidence"].between(0, 1) & ~F.isnan(read["confidence"])
    fit = F.coalesce(good & (keys == F.array(F.lit("confidence"), F.lit("reason"), F.lit("verdict"))), F.lit(False))
    return rows.withColumn("v", read).where(fit).select(*[c for c in rows.columns if c != "response"], "v.verdict", "v.confidence", "v.reason")
