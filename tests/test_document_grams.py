from collections import Counter

from pyspark.sql import functions as F

from lexiweave.config import Extraction
from lexiweave.functions import tagging
from lexiweave.functions.stemming import vocabulary_stems
from lexiweave.operators import document_grams, index

DOCS = [
    ("c", "1", "The Mining of ore", "It RED red. Red walked, 3.5 walking's? İstanbul ΟΔΟΣ Οδός K2!"),
    ("c", "1", None, "It red again. Red walked and walked and walked"),
    ("c", "2", "", "   "),
    ("c", None, "the", "the data of the data ... e.g. data"),
    (None, "3", "研究 と 研究。", "😀 smile-y (a (b)) \"c\""),
]


def docs(spark):
    return spark.createDataFrame(DOCS, "corpus_id string, doc_id string, title string, content string")


def by_rows(documents, stops, cfg):
    """Every accepted n-gram as a row of its own, counted."""
    got, tags = Counter(), {}
    for r in index.sentence_ngrams(documents, cfg).where(tagging.postag_valid(F.col("tags"))).collect():
        if r.form not in stops:
            key = (r.corpus_id, r.doc_id, r.form)
            got[key] += 1
            tags[key] = max(tags.get(key, []), r.tags)
    return {(*k, n, tuple(tags[k])) for k, n in got.items()}


def found(df):
    rows = df.collect()
    assert len({(r.corpus_id, r.doc_id, r.form) for r in rows}) == len(rows)
    return {(r.corpus_id, r.doc_id, r.form, r.occs, tuple(r.postag)) for r in rows}, {(r.corpus_id, r.doc_id, r.form, r.ngram_id) for r in rows}


def test_candidates_equal_rows_counted(spark, monkeypatch):
    stops = spark.createDataFrame([("the",), ("data",)], "label string")
    # A stemmer without a function of one word is joined, and gives the same ids.
    joined = lambda words: vocabulary_stems(words)
    for cfg, bytes_ in ((Extraction(), 1 << 20), (Extraction(ngram_min=2, ngram_max=13), 1)):
        monkeypatch.setattr(document_grams, "AT_ONCE", bytes_)
        rows, ids = found(index.candidates(docs(spark), stops, cfg))
        assert rows == by_rows(docs(spark), {"the", "data"}, cfg) and rows
        assert found(index.candidates(docs(spark), stops, cfg, joined)) == (rows, ids)


def test_no_ngram_is_shuffled(spark):
    plan = index.candidates(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan


def test_tag_of_one_word(spark):
    words = "-3.5 3 5 3x5 would would\u0085 would\u0085\u0085 w ould RED red ness business treatment careful famous able music active best a a  a\u0085b (x \\x ~ x".split(" ") + ["ed\r\n", "ed\n\n", "ed\n", ""]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", tagging.tag(F.col("w")).alias("t")).collect()
    assert [tagging.tag_word(r.w) for r in got] == [r.t for r in got]
