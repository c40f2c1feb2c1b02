"""Text helpers, Column in and Column out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tablescout.functions.similarity import text_ratio

# Every character that Python's str.split() treats as a blank.
BLANKS = r"[\s\x1c-\x1f\x85\p{Z}]+"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def score4(value: Column) -> Column:
    """Four decimals, half up. Noise of the last bits is cut first, so that the order of
    additions does not decide a half."""
    return F.round(F.round(value, 10), 4)


def norm_col(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"[\s_\-.\p{Z}]+", " "))


def norm_value(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.trim(F.regexp_replace(F.lower(text), BLANKS, " "))


# Plain decimals, and doubles as Spark writes them; codes such as 007, 10D or 1e1 are no numbers.
PLAIN_NUMBER = r"^\s*[+-]?(0|[1-9][0-9]*)(\.[0-9]*(E-?[0-9]+)?)?\s*$"


def number_text(value: Column) -> Column:
    """One spelling per number, so that 2020 and 2020.0 are the same text."""
    text = value.cast("string")
    number = F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))
    whole = (F.floor(number) == number) & (F.abs(number) < 9.0e15)
    return F.when(number.isNotNull() & whole, number.cast("bigint").cast("string")).when(
        number.isNotNull(), number.cast("string")
    ).otherwise(text)


def slug_tokens(text: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " ")
    return F.filter(words, lambda w: F.length(w) > 2)


def name_tokens(name: Column) -> Column:
    return slug_tokens(F.replace(name, F.lit("_"), F.lit(" ")))


def safe_text(*parts: Column) -> Column:
    """Spaced text of scalars and lists; nulls vanish."""
    return F.concat_ws(" ", *parts)


def extract_years(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"\b(19\d{2}|20\d{2}|21\d{2})\b"), 1)
    years = F.transform(found, lambda y: y.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(years, lambda y: y.between(1900, 2100))))


def token_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens found in the text, row by row."""
    asked = F.array_distinct(slug_tokens(query))
    return let(asked, lambda q: F.when(F.size(q) == 0, F.lit(0.0)).otherwise(
        F.round(F.size(F.array_intersect(q, slug_tokens(text))) / F.size(q), 4)))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Similarity 0..100 of two texts seen as token sets."""

    @F.pandas_udf("double")
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([text_ratio(x, y) for x, y in zip(left, right)], dtype="float64")

    return score(a, b)
