"""Quality rules as weak supervision: votes, estimated accuracies, posterior (operator 7).

Everything is DataFrame or SQL expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeline.sources.tables import settle

SYMBOLS = "#*$%&|<>"
WINDOW = 5
BLANKS = r"[\x20\x09-\x0D]+"

# Rules that may vote "bad": (rule, measure, from where on). Fixed values, chosen for running text.
AGAINST = (
    ("symbols", "symbol_share", 0.04),
    ("repeats", "repeat_share", 0.25),
    ("lines", "dup_line_share", 0.45),
    ("capitals", "capital_share", 0.25),
    ("shouts", "shout_share", 0.05),
    ("variety", "same_word_share", 0.80),
    ("long_words", "word_length", 13.0),
    ("short_words", "shortness", 0.50),
    ("fragments", "line_break_share", 0.35),
)
# Rules that may vote "good": (rule, measures and up to where all of them must stay).
IN_FAVOUR = (
    ("plain", (("symbol_share", 0.01), ("capital_share", 0.12), ("shout_share", 0.01))),
    ("fresh", (("repeat_share", 0.05), ("dup_line_share", 0.05))),
    ("prose", (("word_length", 9.0), ("shortness", 0.36), ("line_break_share", 0.15))),
)
NAMES = tuple(f"vote_{rule}" for rule, *_ in (*AGAINST, *IN_FAVOUR))
START_BAD_RATE = 0.1  # share of bad documents that estimation starts from
START_RATES = ((0.3, 0.005),) * len(AGAINST) + ((0.4, 0.95),) * len(IN_FAVOUR)  # votes on bad, on good ones
MOST_FALSE = 0.01  # a rule against is built to hit at most this share of good documents
ROUNDS = 15
PRIOR_SHARE = 0.02  # weight of the starting rates beside the votes, as a share of all votes


@dataclass(frozen=True)
class Accuracies:
    """Share of bad documents, and how often each rule votes on bad and on good ones."""

    bad: float
    rates: tuple[tuple[float, float], ...]


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents' columns in a struct ``row``, base counts, and the measures that rules look at."""
    body = F.coalesce(F.col(text), F.lit(""))
    step = docs.select(
        F.struct(*docs.columns).alias("row"),
        body.alias("body"),
        F.array_remove(F.split(body, BLANKS), "").alias("words"),
        F.filter(F.split(body, "\n"), lambda x: F.regexp_replace(x, BLANKS, "") != "").alias("lines"),
    )

    def count_of(mark: str) -> Column:
        return F.octet_length("body") - F.octet_length(F.replace(F.col("body"), F.lit(mark)))

    windows = F.transform(
        F.sequence(F.lit(0), F.size("words") - WINDOW),
        lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]),
    )
    step = step.select(
        "row",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        sum((count_of(s) for s in SYMBOLS[1:]), count_of(SYMBOLS[0])).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.octet_length(F.regexp_replace("body", "[^A-Z]+", "")).alias("n_capitals"),
        count_of("!").alias("n_shouts"),
        F.when(F.size("words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    step = step.withColumn("n_repeat_words", _repeated_words("windows"))
    n, chars = F.col("n_words"), F.col("word_chars")
    return step.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        _share(F.col("n_symbols"), chars).alias("symbol_share"),
        _share(F.col("n_repeat_words"), n).alias("repeat_share"),
        _share(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_share"),
        _share(F.col("n_capitals"), chars).alias("capital_share"),
        _share(F.col("n_shouts"), n).alias("shout_share"),
        # long texts repeat their words anyway
        F.when((n >= 20) & (n <= 400), 1 - F.col("n_distinct") / n).alias("same_word_share"),
        _share(chars, n).alias("word_length"),
        _share(n, chars).alias("shortness"),
        _share(F.col("n_lines") - 1, n).alias("line_break_share"),
    )


def _repeated_words(windows: str) -> Column:
    """Words in windows that occur twice or more in the list of window hashes.

    Only texts with an equal pair do more than one pass: their windows are sorted with their
    places, those with an equal neighbour give their place, and the words that these places
    cover are counted in order.
    """
    paired = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(pairs: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            before = F.when(k > 0, F.get(pairs, k - 1)["h"])
            same = F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(
                F.get(pairs, k + 1)["h"] == x["h"], F.lit(False)
            )
            return F.when(same, x["i"])

        return F.filter(F.transform(pairs, twin), lambda i: i.isNotNull())

    # a lambda over a one-element list binds the sorted list once
    twins = F.sort_array(F.get(F.transform(F.array(paired), places), F.lit(0)))
    covered = F.aggregate(
        twins,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("total")),
        lambda acc, i: F.struct(
            i.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("total")
        ),
        lambda acc: acc["total"],
    )
    twice = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(twice, covered).otherwise(F.lit(0).cast("bigint"))


def votes() -> list[Column]:
    """-1 bad, 1 good, 0 abstains; a rule abstains where it has nothing to measure."""
    against = [F.when(F.col(m) >= bad, -1).otherwise(0) for _, m, bad in AGAINST]
    favour = []
    for _, limits in IN_FAVOUR:
        fine = F.lit(True)
        for measure, most in limits:
            fine = fine & (F.col(measure) <= most)
        favour.append(F.when(fine, 1).otherwise(0))
    return [vote.cast("tinyint").alias(name) for name, vote in zip(NAMES, against + favour)]


def log_odds(a: Accuracies) -> Column:
    """Log odds that a document is bad, given its votes; abstentions say nothing."""
    odds = F.lit(math.log(a.bad / (1 - a.bad)))
    for name, (on_bad, on_good) in zip(NAMES, a.rates):
        odds = odds + F.when(F.col(name) != 0, math.log(on_bad / on_good)).otherwise(0.0)
    return odds


def fit(votes_table: DataFrame) -> Accuracies:
    """Estimate the accuracies by expectation-maximisation over all documents' votes.

    Documents are reduced to counts per vote pattern (two to the number of rules at most),
    which are written once; each round is one aggregate over them, and only its few sums come
    to the driver. Without documents the starting values stand.
    """
    patterns = settle(votes_table.groupBy(*NAMES).agg(F.count("*").alias("n")), "vote-patterns")
    now = Accuracies(START_BAD_RATE, START_RATES)
    for _ in range(ROUNDS):
        bad = 1 / (1 + F.exp(-log_odds(now)))
        weight = {"bad": F.col("n") * bad, "good": F.col("n") * (1 - bad)}
        sums = [F.sum(w).alias(c) for c, w in weight.items()]
        for name in NAMES:
            for c, w in weight.items():
                sums.append(F.sum(F.when(F.col(name) != 0, w).otherwise(0.0)).alias(f"{name}_{c}"))
        row = patterns.agg(*sums).first()
        if row["bad"] is None:
            return now
        prior = PRIOR_SHARE * (row["bad"] + row["good"])
        rates = []
        for k, (name, start) in enumerate(zip(NAMES, START_RATES)):
            on_bad, on_good = (
                min(0.999, max(0.0005, (row[f"{name}_{c}"] + prior * s) / (row[c] + prior)))
                for c, s in zip(("bad", "good"), start)
            )
            if k < len(AGAINST):
                on_good = min(on_good, MOST_FALSE)
            # no rule speaks against its own vote
            rates.append((max(on_bad, on_good) if k < len(AGAINST) else min(on_bad, on_good), on_good))
        now = Accuracies(min(0.9, max(0.001, row["bad"] / (row["bad"] + row["good"]))), tuple(rates))
    return now


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(measured: DataFrame, accuracies: Accuracies) -> DataFrame:
    """``probability`` (of good quality), ``base_failed`` and ``kept`` for documents with votes."""
    probability = 1 / (1 + F.exp(log_odds(accuracies)))
    return (
        measured.withColumn("probability", probability)
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= 0.5))
    )


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts, probability of good quality and verdict of every document.

    One pass over the texts, written as counts and votes; estimation and verdict read only
    those. Rules vote good or bad or abstain, expectation-maximisation finds how often each is
    right, and a document is kept by its posterior probability, not by passing every rule.

    A null, empty or blank text has no words: all counts 0, base failed, not kept. Null keys and
    repeated rows are judged like others. An empty table gives no rows. Other columns are not
    read.
    """
    measured = with_measures(docs.select(key, text), text).select(
        F.col("row")[key].alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *votes()
    )
    measured = settle(measured, "quality-votes")
    return judged(measured, fit(measured))


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents whose verdict is to keep them, with their own columns."""
    estimated = fit(with_measures(docs.select(text), text).select(*votes()))
    measured = with_measures(docs, text).select(
        "row", "n_words", "n_repeat_words", *votes()
    )
    # Through a generator the filter isn't pushed down, which would measure every text many times.
    verdict = judged(measured, estimated).select(F.explode(F.array(F.struct("row", "kept"))).alias("judged"))
    return verdict.filter("judged.kept").select("judged.row.*")
