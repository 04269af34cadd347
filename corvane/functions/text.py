"""Tokens and n-grams as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def tokens(text: Column) -> Column:
    """Maximal runs of ASCII letters in lower case; every other character separates. Null stays null, '' gives [].

    Runs are taken before they are lowered: lowering first would turn some non-ASCII
    letters into ASCII ones.
    """
    return F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z]+)"), 1), lambda t: F.lower(t))


def bigrams(tk: Column) -> Column:
    """Neighbouring tokens joined by '_'; fewer than two tokens give []."""
    n = F.size(tk)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(tk, 1, F.greatest(n - 1, F.lit(0))), F.slice(tk, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws("_", a, b)))


def ngrams(tk: Column, low: int = 1, high: int = 2) -> Column:
    """n-grams of low..high words (1 or 2), unigrams first."""
    parts = ([tk] if low == 1 else []) + ([bigrams(tk)] if high == 2 else [])
    return F.concat(*parts) if len(parts) > 1 else parts[0]
