"""Text functions as Spark expressions: normalisation, tokens, probes, n-grams.

Everything is a built-in expression, except exact Unicode folding and stemming, for which Spark has no
function; these are Arrow UDFs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from weftline.functions import lexicon as X
from weftline.functions.stem import porter_stem


def strip(c: Column) -> Column:
    """Without white space at the ends; null stays null."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def safe(c: Column) -> Column:
    """Null becomes empty, white space at the ends goes."""
    return F.coalesce(strip(c), F.lit(""))


@lru_cache(maxsize=1)
def _letters() -> tuple[str, str]:
    """All characters of the basic plane whose compatibility decomposition has one ASCII character."""
    pairs = []
    for code in range(0x80, 0x10000):
        c = chr(code)
        base = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(base) == 1:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """Accented letters become their ASCII base, all else beyond ASCII goes.

    Characters that decompose into several ASCII characters go too; :func:`fold_exact` keeps them.
    """
    return F.regexp_replace(F.translate(c, *_letters()), r"[^\x00-\x7F]", "")


@F.pandas_udf(types.StringType())
def fold_exact(s: pd.Series) -> pd.Series:
    """Full compatibility decomposition, then what is ASCII."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def _mapped(tokens: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(pairs, t), t))


def _split(c: Column) -> Column:
    """Words between white space; no words give an empty array."""
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def normalize_business_name(c: Column, exact: bool = False) -> Column:
    """Lower case, folded, punctuation to spaces, legal forms spelled out, one leading "the" gone."""
    text = (fold_exact if exact else fold)(F.lower(safe(c)))
    text = F.regexp_replace(F.replace(text, F.lit("&"), F.lit(" and ")), r"[^a-z0-9\s]", " ")
    joined = F.array_join(_mapped(_split(text), X.LEGAL_FORMS), " ")
    return F.regexp_replace(joined, r"^the ", "")


def detect_landmark(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(X.LANDMARK), F.lit(False))


def extract_pincode(c: Column) -> Column:
    """The first stand-alone number of five or six digits, else null."""
    return F.nullif(F.regexp_extract(c, X.POSTAL_CODE, 1), F.lit(""))


def normalize_address(c: Column, exact: bool = False) -> Column:
    """A struct: normalized_address, has_landmark, pincode."""
    text = (fold_exact if exact else fold)(F.lower(safe(c)))
    bare = F.regexp_replace(F.regexp_replace(text, X.POSTAL_CODE, " "), X.LANDMARK_PHRASE, " ")
    bare = F.regexp_replace(bare, r"[^a-z0-9\s]", " ")
    joined = F.array_join(_mapped(_split(bare), X.ADDRESS_WORDS), " ")
    return F.struct(joined.alias("normalized_address"), detect_landmark(text).alias("has_landmark"), extract_pincode(text).alias("pincode"))


def normalize_address_text(c: Column, exact: bool = False) -> Column:
    return normalize_address(c, exact)["normalized_address"]


def _words_of(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


def _without(tokens: Column, words: Sequence[str]) -> Column:
    return F.filter(tokens, lambda t: ~F.lower(t).isin(*words))


def extract_tokens(c: Column) -> Column:
    """Distinct lower-case ASCII words without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\b[a-z0-9]+\b"), F.lit(0))
    return F.array_except(found, F.array(*map(F.lit, X.STOP_WORDS)))


def in_order(c: Column) -> Column:
    """The words, sorted, with single spaces."""
    return F.array_join(F.sort_array(_split(c)), " ")


def hashed(tokens: Column) -> Column:
    """Numbers for tokens: sets of them are compared much faster. Of 100,000 tokens any two share one with
    a chance of 3 in 10 thousand million."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


NORMALIZED = ("business_name_norm", "business_address_norm", "has_landmark", "address_pincode")


def normalize_dataframe(df: DataFrame, exact: bool = False) -> DataFrame:
    """Adds the four normalised columns; the postal code is empty where there is none."""
    df = df.withColumns({"business_name_norm": normalize_business_name(F.col("business_name"), exact), "_address": normalize_address(F.col("business_address"), exact)})
    return df.withColumns(
        {
            "business_address_norm": F.col("_address.normalized_address"),
            "has_landmark": F.col("_address.has_landmark"),
            "address_pincode": F.coalesce("_address.pincode", F.lit("")),
        }
    ).drop("_address")


def ensure_normalized(df: DataFrame) -> DataFrame:
    """Normalises unless all four columns are there."""
    return df if set(NORMALIZED) <= set(df.columns) else normalize_dataframe(df.drop(*NORMALIZED))


def country_key(c: Column) -> Column:
    return F.lower(strip(c))


def country_equal(a: Column, b: Column) -> Column:
    """Equal but for case and white space, and not blank; never null."""
    return F.coalesce((country_key(a) == country_key(b)) & (F.length(strip(a)) > 0), F.lit(False))


def prefix_key(c: Column, n: int = 4) -> Column:
    return F.lower(F.substring(c, 1, n))


def char_grams(c: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams inside words that are padded with one space on both sides, repeats kept."""
    padded = F.transform(_split(F.lower(F.coalesce(c, F.lit("")))), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w: Column) -> Column:
        of = lambda n: F.when(
            F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))
        ).otherwise(F.array().cast("array<string>"))
        return F.concat(*(of(n) for n in range(low, high + 1)))

    return F.flatten(F.transform(padded, grams))


#: Runs of letters and digits of any script.
ANY_WORD = r"[\p{L}\p{N}]+"


def distinctive_words(c: Column, generic: Sequence[str] = X.GENERIC_TERMS) -> Column:
    """Words of three letters or more that are not generic; if there are none, of two or more."""
    found = _without(_words_of(c, ANY_WORD), generic)
    long = F.filter(found, lambda w: F.length(w) >= 3)
    return F.when(F.size(long) > 0, long).otherwise(F.filter(found, lambda w: F.length(w) >= 2))


def address_probes(c: Column, generic: Sequence[str] = X.GENERIC_TERMS) -> Column:
    """A struct: the first number of two digits or more, and the first word of four letters or more."""
    numbers = F.filter(all_numbers(c), lambda n: F.length(n) >= 2)
    words = F.filter(_without(_words_of(c, ANY_WORD), generic), lambda w: (F.length(w) >= 4) & w.rlike(r"^\p{L}+$"))
    return F.struct(F.get(numbers, F.lit(0)).alias("number"), F.get(words, F.lit(0)).alias("word"))


def query_words(name: Column, address: Column) -> Column:
    """Words of the single-query lookup: two or one of the name, else one of name and address."""
    good = lambda c: F.filter(_without(_words_of(c, ANY_WORD), X.GENERIC_QUERY_TERMS), lambda w: F.length(w) >= 3)
    own = good(name)
    both = F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(address, F.lit("")))
    return F.when(F.size(own) > 0, F.slice(own, 1, 2)).otherwise(F.slice(good(both), 1, 1))


@F.pandas_udf(types.ArrayType(types.StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    """Porter stems of lower-case, folded words."""
    cache: dict[str, str] = {}

    def one(w: str) -> str:
        if w not in cache:
            plain = "".join(c for c in unicodedata.normalize("NFKD", w.lower()) if not unicodedata.combining(c))
            cache[w] = porter_stem(plain) if plain.isascii() else plain
        return cache[w]

    return tokens.map(lambda ts: [one(t) for t in ts] if ts is not None else [])


def initialism(c: Column) -> Column:
    """First letters of the alphabetic words that are not left out, in upper case."""
    return F.array_join(F.transform(_without(_words_of(c, r"[a-zA-Z]+"), X.ACRONYM_STOP_WORDS), lambda w: F.upper(F.substring(w, 1, 1))), "")


def acronym_words(c: Column) -> Column:
    return F.transform(_without(_words_of(c, r"[a-zA-Z0-9]+"), X.ACRONYM_STOP_WORDS), lambda w: F.upper(w))


def all_numbers(c: Column) -> Column:
    """Stand-alone numbers."""
    return _words_of(c, r"\b\d+\b")


def numbers(c: Column) -> Column:
    """Distinct stand-alone numbers but those of five or six digits."""
    return F.array_distinct(F.filter(all_numbers(c), lambda n: ~F.length(n).isin(5, 6)))


def match_bucket(n: Column) -> Column:
    return F.when(n == 0, "0 matches").when(n == 1, "1 match").otherwise(">1 matches")
