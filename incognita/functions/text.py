"""Normalization of texts: Spark SQL functions, with Python for Unicode normal forms alone."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources import lexicon

_FROM = "".join(lexicon.FOLDED.values())
_TO = "".join(k * len(v) for k, v in lexicon.FOLDED.items())
#: Texts of these characters alone are in normal form C already: no mark follows a letter and nothing decomposes.
_PLAIN = r"^[\x{0}-\x{2FF}\x{2010}-\x{205E}\x{20AC}\x{2122}]*$"


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


def strip_quotes(text: Column) -> Column:
    """The text without guillemets and straight double quotes."""
    return F.translate(text, lexicon.QUOTES_REMOVED, "")


def nfc(text: Column) -> Column:
    """Normal form C; only texts that may not be in it go through Python."""
    plain = text.rlike(_PLAIN)
    return F.coalesce(F.when(plain, text), _nfc(F.when(~plain, text)))


def fold_characters(text: Column) -> Column:
    """Apostrophes, quotes, dashes and spaces in one spelling each."""
    return F.translate(text, _FROM, _TO)


def normalize(text: Column) -> Column:
    """Quotes stripped, then normal form C and folded characters: the text that all offsets refer to."""
    return fold_characters(nfc(strip_quotes(text)))


def clean_artifacts(text: Column) -> Column:
    """Runs of line ends cut to two, of spaces to one, tabs made spaces."""
    return F.translate(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), " {2,}", " "), "\t", " ")


def fold_for_matching(text: Column) -> Column:
    """Lower case without accents; only texts with other than ASCII characters go through Python."""
    plain = text.rlike(r"^[\x{0}-\x{7F}]*$")
    return F.lower(F.coalesce(F.when(plain, text), _folded(F.when(~plain, text))))


def norm_key(text: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
