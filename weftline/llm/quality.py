"""Quality rules as weak supervision.

Each rule looks at one signal of a text and votes good (+1), bad (-1) or abstains (0). How far a rule
is to be trusted is not set by hand: expectation-maximisation over all texts estimates, for each rule
and each hidden class, how often it gives each vote, and the posterior probability of the good class
replaces "all rules must pass". A few disagreeing rules no longer decide alone.

EM needs only how often each combination of votes occurs: at most 3 ** len(RULES) counts, whatever the
number of texts. Its result is a table of log-odds, one number per rule and vote, with which the
posterior is again a plain expression. Texts that fail the base checks do not take part in it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import SPACES, checkpointed, words

SYMBOLS = "#*$%&|<>"
VOTES = (-1, 0, 1)
ITERATIONS = 60
#: Prior belief in a vote, as pseudo-counts: how often a rule agrees, abstains, disagrees. It names the
#: two classes, and keeps estimates away from 0 and 1 where a table is small.
AGREE, ABSTAIN, DISAGREE = 8.0, 4.0, 2.0
#: Words so frequent in running text of their language that a long text without any is suspect.
FREQUENT = ("the", "of", "and", "in", "le", "la", "de", "et", "der", "die", "und", "el", "que", "y")


def _thresholds(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rule_votes() -> dict[str, Column]:
    """The rules over the columns of :func:`signals`."""
    c = F.col
    return {
        "length": _thresholds(c("n_words") >= 80, c("n_words") < 50),
        "word_length": _thresholds(c("word_chars").between(3 * c("n_words"), 9 * c("n_words")), (c("word_chars") > 14 * c("n_words")) | (c("word_chars") < 2 * c("n_words"))),
        "symbols": _thresholds(100 * c("n_symbols") <= 2 * c("n_words"), 10 * c("n_symbols") > c("n_words")),
        "duplicate_lines": _thresholds(10 * c("n_dup_lines") <= c("n_lines"), 10 * c("n_dup_lines") > 3 * c("n_lines")),
        "repeated_words": _thresholds(5 * c("n_repeat_words") <= c("n_words"), 5 * c("n_repeat_words") > 2 * c("n_words")),
        "frequent_words": _thresholds(c("n_frequent") >= 2, (c("n_frequent") == 0) & (c("n_words") >= 30)),
    }


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the rules look at, one row per input row; a null text has no words and no lines."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("w", words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    rows = rows.select(
        "doc_id",
        "w",
        lines.alias("lines"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        F.length(F.array_join("w", "")).alias("word_chars"),
    )
    hashes = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    rows = rows.withColumn("tri", hashes)
    # A value other than the one before it in sorted order starts a run; what is left are repeats.
    rows = rows.withColumn("sorted", F.when(F.size(F.array_distinct("tri")) < F.size("tri"), F.array_sort("tri")).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("twice", F.array_distinct(F.filter("sorted", lambda x, i: F.get("sorted", i - 1) == x)))
    few = F.filter(F.sequence(F.lit(0), F.size("tri") - 1), lambda i: F.array_contains("twice", F.get("tri", i)))
    rows = rows.withColumn("keyed", F.when(F.size("twice") > 64, F.array_sort(F.transform("tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    beside = F.filter("keyed", lambda x, j: F.coalesce(F.get("keyed", j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("keyed", j + 1)["h"] == x["h"], F.lit(False)))
    many = F.array_sort(F.transform(beside, lambda x: x["i"]))
    none = F.array().cast("array<int>")
    rows = rows.withColumn("at", F.when(F.size("twice") == 0, none).when(F.size("twice") <= 64, few).otherwise(many))
    room = F.transform("at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("at", j + 1) - p, F.lit(3))))
    return rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(room, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_intersect("w", F.array(*map(F.lit, FREQUENT)))).cast("long").alias("n_frequent"),
    )


def fit(patterns: Mapping[Sequence[int], int], iterations: int = ITERATIONS) -> tuple[float, list[dict[int, float]]]:
    """Log-odds of the good class: of the class itself, and of each vote of each rule.

    ``patterns`` counts the texts with each combination of votes. EM starts from the belief that each
    vote for bad makes a text a good deal less likely to be good, so that the bad class forms around
    such votes however rare they are. A vote has the prior of AGREE, ABSTAIN and DISAGREE in the class
    that it speaks for, and never speaks for the other one.
    """
    n_rules = len(next(iter(patterns), ()))
    post = {p: _sigmoid(3.0 - 3.5 * p.count(-1)) for p in patterns}
    prior, tables = 0.0, [dict.fromkeys(VOTES, 0.0) for _ in range(n_rules)]
    for _ in range(iterations if patterns else 0):
        good = sum(n * post[p] for p, n in patterns.items())
        bad = sum(n * (1 - post[p]) for p, n in patterns.items())
        prior = math.log((good + 1) / (bad + 1))
        tables = []
        for k in range(n_rules):
            counts = {1: dict(zip(VOTES, (DISAGREE, ABSTAIN, AGREE), strict=True)), 0: dict(zip(VOTES, (AGREE, ABSTAIN, DISAGREE), strict=True))}
            for p, n in patterns.items():
                counts[1][p[k]] += n * post[p]
                counts[0][p[k]] += n * (1 - post[p])
            sums = {c: sum(counts[c].values()) for c in counts}
            odds = {v: math.log(counts[1][v] / sums[1]) - math.log(counts[0][v] / sums[0]) for v in VOTES}
            tables.append({-1: min(odds[-1], 0.0), 0: odds[0], 1: max(odds[1], 0.0)})
        post = {p: _sigmoid(prior + sum(t[v] for t, v in zip(tables, p, strict=True))) for p in patterns}
    return prior, tables


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, and the posterior ``quality``.

    ``kept`` is false where the base checks fail, else whether the posterior reaches ``least``. Null,
    empty and blank texts have no words and fail. Rows that repeat an id are rows of their own. An
    empty table gives an empty result; the rules then have no weight.
    """
    rows = checkpointed(signals(docs, id_col, text_col))
    votes = rule_votes()
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # What fails the base checks is decided already, and would only hide what sets the others apart.
    counted = rows.filter(~failed).groupBy(*(v.alias(k) for k, v in votes.items())).count().collect()  # 3 ** len(votes) rows at most
    prior, tables = fit({tuple(r[k] for k in votes): r["count"] for r in counted})
    odds = F.lit(prior)
    for (_, vote), table in zip(votes.items(), tables, strict=False):
        odds = odds + F.when(vote < 0, table[-1]).when(vote > 0, table[1]).otherwise(table[0])
    quality = 1 / (1 + F.exp(-odds))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (quality >= least)).alias("kept"), quality.alias("quality")
    )
