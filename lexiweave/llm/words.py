"""Words as problems 3 and 6 define them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A maximal run of a-z and U+00DF to U+00FF without the division sign U+00F7, in lower-cased text.
LETTERS = "a-zß-öø-ÿ"


def words(text: Column, least: int = 1) -> Column:
    """The words of at least ``least`` letters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([{LETTERS}]{{{least},}})"), 1)


def not_blank(text: Column) -> Column:
    """Whether the text is neither null nor only white space of any kind."""
    return text.isNotNull() & text.rlike(r"[^\s\p{Z}]")
