"""Edits of an indexed data set: forms added and deleted, nodes deleted, objects updated.

Document frequencies are counted again from the links, never decremented; each edge is stored once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.functions.text import ngram_id, occurrences


def form_occurrences(documents: DataFrame, form: str, fields: tuple[str, ...] = ("content",)) -> DataFrame:
    """corpus_id, doc_id, occs of documents in which the form stands."""
    total = sum((F.coalesce(occurrences(F.col(f), form), F.lit(0)) for f in fields), F.lit(0))
    return documents.select("corpus_id", "doc_id", total.cast("long").alias("occs")).where("occs > 0")


def add_form(doc_ngram: DataFrame, documents: DataFrame, form: str, keyword_doc: str | None = None, fields: tuple[str, ...] = ("content",)) -> DataFrame:
    """Links (corpus_id, doc_id, ngram_id, occs) with those of a new form.

    Documents already linked keep their link; ``keyword_doc`` is linked once even if the form doesn't stand in it.
    """
    ident = ngram_id(F.lit(form))
    found = form_occurrences(documents, form, fields)
    if keyword_doc is not None:
        forced = documents.where(F.col("doc_id") == keyword_doc).select("corpus_id", "doc_id", F.lit(1).cast("long").alias("occs"))
        found = found.unionByName(forced.join(found, ["corpus_id", "doc_id"], "left_anti"))
    links = found.select("corpus_id", "doc_id", ident.alias("ngram_id"), "occs")
    return doc_ngram.unionByName(links.join(doc_ngram.select("corpus_id", "doc_id", "ngram_id"), ["corpus_id", "doc_id", "ngram_id"], "left_anti"))


def delete_form(doc_ngram: DataFrame, documents: DataFrame, form: str, ident: str, last_form: bool, fields: tuple[str, ...] = ("content",)) -> DataFrame:
    """Links without a form: the n-gram goes with its last form, else each link loses the form's occurrences."""
    if last_form:
        return delete_node(doc_ngram, ident)
    keys = ["corpus_id", "doc_id", "ngram_id"]
    less = form_occurrences(documents, form, fields).select("corpus_id", "doc_id", F.lit(ident).alias("ngram_id"), F.col("occs").alias("less"))
    return subtract(doc_ngram, less, keys).select(*keys, "occs")


def subtract(links: DataFrame, less: DataFrame, keys: list[str]) -> DataFrame:
    """Links with ``occs`` lowered by ``less`` (keys, less); those that fall to zero are gone."""
    left = links.join(less, keys, "left").withColumn("occs", F.col("occs") - F.coalesce("less", F.lit(0)))
    return left.drop("less").where("occs > 0")


def delete_node(doc_ngram: DataFrame, ident: str) -> DataFrame:
    return doc_ngram.where(F.col("ngram_id") != ident)


def delete_from_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges (a, b, ...) none of whose ends is removed (id)."""
    for end in ("a", "b"):
        edges = edges.join(removed.select(F.col("id").alias(end)), end, "left_anti")
    return edges


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows and the stored ones that they don't replace."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new.dropDuplicates(keys))


def purge(edges: DataFrame, weight: str = "weight") -> DataFrame:
    return edges.where(F.col(weight) > 0)


def empty_content(documents: DataFrame) -> DataFrame:
    return documents.withColumn("content", F.lit(""))
