import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.stem import porter_stem
from weftline.sources import tsv


def values(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("c")).alias("x")).collect()]


NAMES = [
    ("Infosys Pvt. Ltd.", "infosys private limited"),
    ("The Boeing Company", "boeing company"),
    ("Over The Moon Ltd", "over the moon limited"),
    ("L'Oreal (Paris) Ltd.", "l oreal paris limited"),
    ("LVMH Moët Hennessy", "lvmh moet hennessy"),
    ("TotalEnergies SE", "totalenergies societas europaea"),
    ("A & B Co", "a and b company"),
    ("Straße AG", "strae ag"),
    ("the", "the"),
    ("  ", ""),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("exact", [False, True])
def test_business_names(spark, exact):
    assert values(spark, [n for n, _ in NAMES], lambda c: T.normalize_business_name(c, exact)) == [w for _, w in NAMES]


def test_folding_forms(spark):
    assert values(spark, ["ﬁ½é", "Ａｂ"], T.fold_exact) == ["fi12e", "Ab"]
    assert values(spark, ["é½", "Ａｂ"], T.fold) == ["e", "Ab"]


def test_addresses(spark):
    rows = ["560001", "22 Avenue Montaigne, 75008 Paris", "Near City Mall, 12 MG Rd, 560001", "170 W Tasman Dr, San Jose, CA 95134", None, "5 Opp Bank; Pune"]
    got = values(spark, rows, lambda c: T.normalize_address(c))
    assert [tuple(r) for r in got] == [
        ("", False, "560001"),
        ("22 avenue montaigne paris", False, "75008"),
        ("12 mg road", True, "560001"),
        ("170 west tasman drive san jose ca", False, "95134"),
        ("", False, None),
        ("5 pune", True, None),
    ]


def test_tokens_and_grams(spark):
    assert values(spark, ["The the Tata of Motors", "", None], T.extract_tokens) == [["tata", "motors"], [], []]
    assert values(spark, ["ab c"], T.char_grams) == [[" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "]]


def test_id_lists(spark):
    assert values(spark, ["", " ", None, "S2-00001, S3-00002", ",a,,b "], tsv.parse_id_list) == [[], [], [], ["S2-00001", "S3-00002"], ["a", "b"]]


def test_country_equality(spark):
    df = spark.createDataFrame([("US", " us "), ("", ""), (None, "US"), ("US", "India")], "a string, b string")
    assert [r[0] for r in df.select(T.country_equal(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_probes(spark):
    assert values(spark, ["The Tata Motors Ltd", "Co AB", ""], T.distinctive_words) == [["Tata", "Motors"], ["AB"], []]
    assert [tuple(r) for r in values(spark, ["5 12 Rue Montaigne", ""], T.address_probes)] == [("12", "Montaigne"), (None, None)]
    assert values(spark, ["Tata Consultancy and Services"], T.initialism) == ["TC"]


@pytest.mark.parametrize(
    "word,stem",
    [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
     ("generalization", "gener"), ("adjustment", "adjust"), ("motoring", "motor"), ("controlling", "control"), ("rate", "rate"), ("agreed", "agre")],
)
def test_stems(word, stem):
    assert porter_stem(word) == stem


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz", max_size=15))
def test_stemming_shortens(word):
    assert len(porter_stem(word)) <= len(word) + 1
