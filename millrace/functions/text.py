"""Words of search texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def explode_words(df: DataFrame, text: str, word: str = "keyword", segmenter: Callable[[Column], Column] = tokens) -> DataFrame:
    """One row for each word, none for a text without words. segmenter: a column of texts to one of arrays of words; a pandas UDF for
    languages that need a dictionary."""
    return df.withColumn(word, F.explode(segmenter(F.col(text))))
