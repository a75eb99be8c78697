"""Pairwise similarities.

Set and token features are Spark expressions, and so are the rules of the rule matcher. What compares
characters (subsequence ratios, partial ratio, Jaro-Winkler, phonetic codes) is computed by Arrow UDFs
over whole batches, all of a pair in one UDF call where several are needed, so that strings cross to
Python once. The plain functions say what the batched ones compute, one pair at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types

from weftline.functions import lexicon as X
from weftline.functions import subsequence
from weftline.functions import text as T
from weftline.functions.phonetic import metaphone

# --- plain functions -----------------------------------------------------------------------------


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; the columns of the table are the bits of an integer."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 times twice the common subsequence over the sum of lengths; 100 if both are empty."""
    n = len(a) + len(b)
    return 100.0 * 2 * lcs_length(a, b) / n if n else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Of sorted distinct words: the common ones, alone and with what each side has besides."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if common and (not left or not right):
        return 100.0
    with_left, with_right = f"{common} {left}".strip(), f"{common} {right}".strip()
    best = ratio(with_left, with_right)
    return max(best, ratio(common, with_left), ratio(common, with_right)) if common else best


def _best_window(short: str, long: str) -> float:
    m, n = len(short), len(long)
    best = 0.0
    for start in range(1 - m, n):
        window = long[max(0, start) : start + m]
        # No more than the window's length can be common.
        if 200.0 * min(m, len(window)) / (m + len(window)) > best:
            best = max(best, ratio(short, window))
    return best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one, also over its ends."""
    if not a or not b:
        return 100.0 if not a and not b else 0.0
    if len(a) > len(b):
        a, b = b, a
    best = _best_window(a, b)
    return max(best, _best_window(b, a)) if len(a) == len(b) else best


def jaro_winkler(a: str, b: str) -> float:
    """On 0 to 1; 1 if both are empty. A common start of up to four characters lifts what is over 0.7."""
    if not a or not b:
        return float(not a and not b)
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    from_a = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                from_a.append(c)
                break
    m = len(from_a)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(from_a, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    start = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        start += 1
    return jaro + start * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


_ACRONYM_STOP = frozenset(X.ACRONYM_STOP_WORDS)


def phonetic_similarity(a: str, b: str) -> float:
    """Ratio of the phonetic codes of the alphabetic words; 0 if a side has none."""
    codes = [" ".join(metaphone(w) for w in re.findall("[a-zA-Z]+", s) if w.lower() not in _ACRONYM_STOP) for s in (a, b)]
    words = [any(w.lower() not in _ACRONYM_STOP for w in re.findall("[a-zA-Z]+", s)) for s in (a, b)]
    return ratio(*codes) if all(words) else 0.0


# --- the same over columns -----------------------------------------------------------------------


def _texts(side: pd.Series) -> list[str]:
    return side.fillna("").tolist()


def _in_order(texts: list[str]) -> list[str]:
    """Words of each text, sorted; a text that repeats is sorted once."""
    known: dict[str, str] = {}
    return [known[t] if t in known else known.setdefault(t, " ".join(sorted(t.split()))) for t in texts]


def _set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """:func:`token_set_ratio` of each pair.

    The common words begin what they are compared with, so that only the two whole strings need a
    subsequence.
    """
    known: dict[str, frozenset[str]] = {}
    words = lambda t: known[t] if t in known else known.setdefault(t, frozenset(t.split()))
    out, left, right, at = np.zeros(len(a)), [], [], []
    for k, (x, y) in enumerate(zip(map(words, a), map(words, b), strict=True)):
        if not x or not y:
            continue
        shared = " ".join(sorted(x & y))
        if shared and (x <= y or y <= x):
            out[k] = 100.0
            continue
        p, q = (f"{shared} {' '.join(sorted(z))}".strip() for z in (x - y, y - x))
        if shared:
            out[k] = max(200.0 * len(shared) / (len(shared) + min(len(p), len(q))), 0.0)
        left.append(p)
        right.append(q)
        at.append(k)
    out[at] = np.maximum(out[at], subsequence.ratios(left, right))
    return out


def _phonetics(a: list[str], b: list[str]) -> np.ndarray:
    """:func:`phonetic_similarity` of each pair; a text that repeats is coded once."""
    known: dict[str, tuple[bool, str]] = {}

    def coded(t: str) -> tuple[bool, str]:
        if t not in known:
            words = [w for w in re.findall("[a-zA-Z]+", t) if w.lower() not in _ACRONYM_STOP]
            known[t] = bool(words), " ".join(map(metaphone, words))
        return known[t]

    x, y = [coded(t) for t in a], [coded(t) for t in b]
    both = np.array([p[0] and q[0] for p, q in zip(x, y, strict=True)], bool)
    return np.where(both, subsequence.ratios([c for _, c in x], [c for _, c in y]), 0.0)


def _sort_ratios(a: list[str], b: list[str]) -> np.ndarray:
    return subsequence.ratios(_in_order(a), _in_order(b))


def _over(f: Callable[[list[str], list[str]], np.ndarray]):
    @F.pandas_udf(types.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(f(_texts(a), _texts(b)), float))

    return run


ratio_col = _over(subsequence.ratios)
token_sort_ratio_col = _over(_sort_ratios)
token_set_ratio_col = _over(_set_ratios)
partial_ratio_col = _over(subsequence.best_window_ratios)
jaro_winkler_col = _over(lambda a, b: np.array([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)]))
phonetic_similarity_col = _over(_phonetics)

#: What :func:`character_features` returns.
CHARACTER_FEATURES = (
    "name_ratio", "name_token_sort_ratio", "name_token_set_ratio", "name_partial_ratio",
    "addr_ratio", "addr_token_sort_ratio", "addr_partial_ratio", "name_phonetic_sim",
)


@F.pandas_udf(types.StructType([types.StructField(c, types.DoubleType()) for c in CHARACTER_FEATURES]))
def character_features(n1: pd.Series, n2: pd.Series, a1: pd.Series, a2: pd.Series) -> pd.DataFrame:
    """All features of pairs that compare characters."""
    name, addr = (_texts(n1), _texts(n2)), (_texts(a1), _texts(a2))
    made = (
        subsequence.ratios(*name), _sort_ratios(*name), _set_ratios(*name), subsequence.best_window_ratios(*name),
        subsequence.ratios(*addr), _sort_ratios(*addr), subsequence.best_window_ratios(*addr), _phonetics(*name),
    )
    return pd.DataFrame(dict(zip(CHARACTER_FEATURES, made, strict=True)))


NAME_CHARACTERS, ADDRESS_CHARACTERS = (tuple(c for c in CHARACTER_FEATURES if c.startswith(p)) for p in ("name", "addr"))


@F.pandas_udf(types.StructType([types.StructField(c, types.DoubleType()) for c in NAME_CHARACTERS]))
def name_character_features(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Those of :func:`character_features` that look at names."""
    name = _texts(a), _texts(b)
    made = subsequence.ratios(*name), _sort_ratios(*name), _set_ratios(*name), subsequence.best_window_ratios(*name), _phonetics(*name)
    return pd.DataFrame(dict(zip(NAME_CHARACTERS, made, strict=True)))


@F.pandas_udf(types.StructType([types.StructField(c, types.DoubleType()) for c in ADDRESS_CHARACTERS]))
def address_character_features(a: pd.Series, b: pd.Series, sorted_a: pd.Series, sorted_b: pd.Series) -> pd.DataFrame:
    """Those of :func:`character_features` that look at addresses, given also with their words in order."""
    addr = _texts(a), _texts(b)
    made = subsequence.ratios(*addr), subsequence.ratios(_texts(sorted_a), _texts(sorted_b)), subsequence.best_window_ratios(*addr)
    return pd.DataFrame(dict(zip(ADDRESS_CHARACTERS, made, strict=True)))


_BANDS = ("name_words", "addr_order", "addr_words")


@F.pandas_udf(types.StructType([types.StructField(c, types.DoubleType()) for c in _BANDS]))
def rule_ratios(n1: pd.Series, n2: pd.Series, a1: pd.Series, a2: pd.Series) -> pd.DataFrame:
    """What the rules look at: word set ratio of the names, sorted and set ratio of the addresses."""
    addr = _texts(a1), _texts(a2)
    made = _set_ratios(_texts(n1), _texts(n2)), _sort_ratios(*addr), _set_ratios(*addr)
    return pd.DataFrame(dict(zip(_BANDS, made, strict=True)))


@dataclass(frozen=True)
class Rule:
    """Names whose ratio is in [least, below), with evidence of the address: weights of the name's ratio
    and of the address's."""

    least: float
    below: float
    evidence: str
    name: float
    address: float
    measure: str = "addr_order"


#: The rules, of which the first that applies gives the score.
RULES = (
    Rule(85, 101, "no address", 0.95, 0.0),
    Rule(80, 101, "alike", 0.60, 0.40, "addr_best"),
    Rule(80, 101, "address", 0.75, 0.25),
    Rule(60, 80, "close", 0.45, 0.55),
    Rule(0, 50, "same place", 0.25, 0.75),
)


def rule_score_col(n1: Column, a1: Column, n2: Column, a2: Column, ratios: Column) -> Column:
    """Score of the rule matcher on 0 to 1, from :func:`rule_ratios` of the texts in lower case."""
    order, words = ratios["addr_order"], ratios["addr_words"]
    given = T.strip(a2) != ""
    shared = F.arrays_overlap(T.all_numbers(a1), T.all_numbers(a2))
    evidence = {
        "no address": ~given,
        "address": given,
        "alike": given & ((order >= 50) | shared | (words >= 60)),
        "close": given & ((order >= 60) | (shared & (words >= 65))),
        "same place": given & (F.length(a1) > 5) & (order >= 75),
    }
    measure = {"addr_order": order, "addr_best": F.greatest(order, words)}
    name, out = ratios["name_words"], F.lit(None).cast("double")
    for rule in reversed(RULES):
        applies = (name >= rule.least) & (name < rule.below) & evidence[rule.evidence]
        out = F.when(applies, (rule.name * name + rule.address * measure[rule.measure]) / 100).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays as sets; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def set_jaccard(a: Column, b: Column) -> Column:
    """:func:`jaccard` of arrays without repeats."""
    shared = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - shared
    return F.when(both > 0, shared / both).otherwise(0.0)


def first_word_match(a: Column, b: Column) -> Column:
    first = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(\S+)", 1)
    return ((first(a) == first(b)) & (first(a) != "")).cast("int")


def length_diff(a: Column, b: Column) -> Column:
    return F.abs(F.length(F.coalesce(a, F.lit(""))) - F.length(F.coalesce(b, F.lit("")))).cast("int")


def pincode_match(a: Column, b: Column) -> Column:
    """1 equal, 0 different, -1 if one is missing."""
    return equal_or_missing(T.safe(a), T.safe(b))


def equal_or_missing(a: Column, b: Column) -> Column:
    """:func:`pincode_match` of texts that are not null and have no white space at their ends."""
    return F.when((a == "") | (b == ""), -1).when(a == b, 1).otherwise(0).cast("int")


def numeric_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the numbers; 0.5 if a side has none."""
    return number_similarity(T.numbers(a), T.numbers(b))


def number_similarity(x: Column, y: Column) -> Column:
    """:func:`numeric_similarity` of what :func:`weftline.functions.text.numbers` finds."""
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.5).otherwise(set_jaccard(x, y))


def acronym_match(a: Column, b: Column) -> Column:
    """1.0 if the initialism of one side is a word of the other, or all its words together."""
    return acronym_held(T.initialism(a), T.acronym_words(a), T.initialism(b), T.acronym_words(b))


def acronym_held(short_a: Column, words_a: Column, short_b: Column, words_b: Column) -> Column:
    """:func:`acronym_match` of initialisms and words in upper case."""
    held = lambda short, words: (F.length(short) >= 2) & (F.array_contains(words, short) | (F.array_join(words, "") == short))
    return F.when(held(short_b, words_a) | held(short_a, words_b), 1.0).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two arrays; of L2-normalised vectors, their cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(a: Column) -> Column:
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(a, lambda x: x.cast("double") / norm)
