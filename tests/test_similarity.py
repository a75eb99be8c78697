import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import similarity as S
from weftline.functions import subsequence
from weftline.functions.phonetic import metaphone

words = st.text(alphabet="abc d", max_size=12)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_ratio_is_the_textbook_one(a, b):
    assert S.lcs_length(a, b) == plain_lcs(a, b)
    assert S.ratio(a, b) == S.ratio(b, a)
    assert 0 <= S.ratio(a, b) <= 100
    assert 0 <= S.jaro_winkler(a, b) <= 1 and 0 <= S.partial_ratio(a, b) <= 100
    assert S.token_sort_ratio(a, b) == S.token_sort_ratio(b, a)


def test_known_values():
    assert S.token_set_ratio("apple computer", "apple") == 100.0
    assert S.token_set_ratio("", "x") == 0.0
    assert S.partial_ratio("motors", "tata motors limited") == 100.0
    assert round(S.jaro_winkler("acme corporation", "acme corp"), 4) == 0.9125
    assert S.jaro_winkler("", "") == 1.0
    assert metaphone("knight").startswith("N") and metaphone("phone") == "FN" and metaphone("thin") == "0N"
    assert S.phonetic_similarity("smith inc", "smyth") > 90
    assert S.phonetic_similarity("", "x") == 0.0


RULES = [
    ("abc", "1 main street", "xyz", "1 main street", True),  # names differ, addresses agree
    ("abc", "1", "xyz", "1", False),
    ("tata motors", "x", "tata motors", "", True),
    ("tata motors", "x", "tata steel", " ", False),
    ("tata motors", "12 main st", "tata motors", "12 elm rd", True),
    ("tata motors", "aaa", "tata motors", "zzz", True),
    ("tata motors ab", "12 main st", "tata motion cd", "12 main st", True),
    ("tata motors ab", "aaa", "tata motion cd", "zzz", False),
]


def test_rule_branches(spark):
    df = spark.createDataFrame([r[:4] for r in RULES], "n1 string, a1 string, n2 string, a2 string").withColumn("r", S.rule_ratios("n1", "n2", "a1", "a2"))
    score = S.rule_score_col(*(F.col(c) for c in ("n1", "a1", "n2", "a2", "r")))
    for row in df.withColumn("score", score).collect():
        assert (row["score"] > 0) == dict((r[:4], r[4]) for r in RULES)[tuple(row[:4])]
        x, order, words = row["r"]
        assert x == pytest.approx(S.token_set_ratio(row["n1"], row["n2"]))
        assert order == pytest.approx(S.token_sort_ratio(row["a1"], row["a2"])) and words == pytest.approx(S.token_set_ratio(row["a1"], row["a2"]))


@settings(deadline=None)
@given(st.lists(st.tuples(*[st.text(alphabet="abcd é1", max_size=90)] * 2), max_size=12))
def test_batches_equal_single_pairs(pairs):
    a, b = [p for p, _ in pairs], [q for _, q in pairs]
    for batched, single in (
        (subsequence.ratios, S.ratio), (subsequence.best_window_ratios, S.partial_ratio), (S._sort_ratios, S.token_sort_ratio),
        (S._set_ratios, S.token_set_ratio), (S._phonetics, S.phonetic_similarity),
    ):
        assert list(batched(a, b)) == pytest.approx([single(x, y) for x, y in pairs])


@settings(deadline=None)
@given(st.lists(st.text(alphabet="abcd é1", max_size=90), min_size=1, max_size=9), st.booleans())
def test_pairs_combed_together_equal_single_pairs(strings, windows):
    x, y = (k.ravel() for k in np.indices((len(strings), len(strings))))
    common, best = subsequence.combed_pairs(strings, x, y, windows)
    assert list(common) == [S.lcs_length(strings[i], strings[j]) for i, j in zip(x, y, strict=True)]
    if windows:
        assert list(best) == pytest.approx([S.partial_ratio(strings[i], strings[j]) for i, j in zip(x, y, strict=True)])


def test_long_strings_are_combed():
    strings = ["ab" * 200, "ba" * 150 + "c", "", "abc"]
    common, best = subsequence.combed_pairs(strings, np.array([0, 1, 2, 3]), np.array([1, 3, 0, 0]))
    assert list(common) == [S.lcs_length(strings[i], strings[j]) for i, j in ((0, 1), (1, 3), (2, 0), (3, 0))]
    assert list(best) == pytest.approx([S.partial_ratio(strings[i], strings[j]) for i, j in ((0, 1), (1, 3), (2, 0), (3, 0))])


def test_column_features(spark):
    df = spark.createDataFrame([("560001", "560001"), ("1", "2"), ("", "2"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(S.pincode_match(F.col("a"), F.col("b"))).collect()] == [1, 0, -1, -1]
    df = spark.createDataFrame([("TCS", "Tata Consultancy Software"), ("SBI", "Other Name"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(S.acronym_match(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    df = spark.createDataFrame([("12 elm", "12 oak 7"), ("elm", "12"), ("560001", "560001")], "a string, b string")
    assert [r[0] for r in df.select(S.numeric_similarity(F.col("a"), F.col("b"))).collect()] == [0.5, 0.5, 0.5]
