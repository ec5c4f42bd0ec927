"""Full-text search over tables of id, label, content, date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.functions.text import tokens


def phrase_search(documents: DataFrame, phrases: list[str], content: str = "content") -> DataFrame:
    """Documents in which every phrase stands as tokens that follow one another."""
    padded = F.concat(F.lit(" "), F.array_join(tokens(F.col(content)), " "), F.lit(" "))
    has = [F.contains(padded, F.lit(" " + " ".join(p.lower().split()) + " ")) for p in phrases]
    return documents.where(reduce(lambda a, b: a & b, has, F.lit(True)))


def postings(documents: DataFrame, content: str = "content") -> DataFrame:
    """corpus_id, doc_id, term, at: the places of each term in each document, to be stored by term."""
    rows = documents.select("corpus_id", "doc_id", F.posexplode(tokens(F.col(content))).alias("p", "term"))
    return rows.groupBy("corpus_id", "doc_id", "term").agg(F.sort_array(F.collect_list("p")).alias("at"))


def phrase_hits(stored: DataFrame, phrases: list[str]) -> DataFrame:
    """corpus_id, doc_id of documents in which every phrase stands, from stored ``postings``.

    Only the rows of the phrases' terms are read. Each place of a phrase's term votes for the place where the phrase
    would start; a start that all its terms vote for is an occurrence.
    """
    votes = [(k, term, p) for k, phrase in enumerate(phrases) for p, term in enumerate(phrase.lower().split())]
    asked = stored.sparkSession.createDataFrame(votes, "phrase int, term string, p int")
    near = stored.where(F.col("term").isin(sorted({t for _, t, _ in votes}))).join(F.broadcast(asked), "term")  # a row for each word of the phrases
    starts = near.select("corpus_id", "doc_id", "phrase", F.explode("at").alias("q"), "p").select("corpus_id", "doc_id", "phrase", (F.col("q") - F.col("p")).alias("start"))
    found = starts.groupBy("corpus_id", "doc_id", "phrase", "start").agg(F.count("*").alias("n")).join(F.broadcast(asked.groupBy("phrase").agg(F.count("*").alias("words"))), "phrase").where("n = words")
    return found.groupBy("corpus_id", "doc_id").agg(F.count_distinct("phrase").alias("k")).where(F.col("k") == len(phrases)).select("corpus_id", "doc_id")


def phrase_count(documents: DataFrame, phrases: list[str], content: str = "content") -> DataFrame:
    return phrase_search(documents, phrases, content).agg(F.count("*").alias("n_docs"))


def by_id(documents: DataFrame, value, field: str = "doc_id") -> DataFrame:
    return documents.where(F.col(field) == value)


def by_prefix(documents: DataFrame, prefix: str, field: str = "doc_id") -> DataFrame:
    return documents.where(F.col(field).startswith(prefix))


def insert_new(stored: DataFrame, new: DataFrame, key: str = "doc_id", overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """The table with the new documents, and the new ones refused because they were there."""
    fresh = new.dropDuplicates([key])
    if overwrite:
        return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh), fresh.limit(0)
    return stored.unionByName(fresh.join(stored.select(key), key, "left_anti")), fresh.join(stored.select(key), key, "left_semi")
