"""Frequency of every distinct value or term, with marks for those too rare or too common.

Each record emits its sorted terms, where the first of equal ones is flagged; Spark's hash aggregate combines
occurrences and records by term within each task before the one shuffle, so a term that stands in every record
sends one row per task. The frequency bounds are applied to the sums. No count is capped or estimated.

Edge cases: null and blank fields hold no terms and don't count as records of the field; a term that is repeated
in a record counts once as a record; repeated rows count once each; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweave.llm.words import not_blank, words

RARE_BELOW = 3
COMMON_ABOVE = 0.2
LEAST_LETTERS = 3


def term_counts(df: DataFrame, field_name: str, terms: Column) -> DataFrame:
    """field_name, term, n_occurrences, n_records for an array column of terms per record."""
    flagged = F.transform("t", lambda x, i: F.struct(x.alias("term"), ((i == 0) | (F.get("t", i - 1) != x)).cast("long").alias("first")))
    rows = df.select(F.sort_array(terms).alias("t")).where(F.size("t") > 0).select(F.explode(flagged).alias("x")).select("x.*")
    return rows.groupBy("term").agg(F.count("*").alias("n_occurrences"), F.sum("first").alias("n_records")).select(F.lit(field_name).alias("field_name"), "term", "n_occurrences", "n_records")


def text_term_counts(df: DataFrame, field: str) -> DataFrame:
    """Counts of the words of three or more letters in a text column."""
    return term_counts(df, field, words(F.col(field), LEAST_LETTERS))


def value_counts(df: DataFrame, field: str) -> DataFrame:
    """Counts of the non-null values of a column, as strings."""
    got = df.where(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("term")).agg(F.count("*").alias("n_occurrences"))
    return got.select(F.lit(field).alias("field_name"), "term", "n_occurrences", F.col("n_occurrences").alias("n_records"))


def mark(counts: DataFrame, records: DataFrame, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """Adds ``mark``: ``rare``, else ``common``, else null. ``records``: field_name, records, a row per field."""
    tag = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > F.col("records") * common_above, "common")
    # One row per field name.
    return counts.join(F.broadcast(records), "field_name").withColumn("mark", tag).drop("records")


def record_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """field_name, records: how many rows of each field are neither null nor blank, in one pass."""
    one = df.agg(*(F.count(F.when(not_blank(F.col(f).cast("string")), 1)).alias(f) for f in fields))
    return one.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("records")) for f in fields))).alias("x")).select("x.*")
