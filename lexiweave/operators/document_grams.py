"""n-grams of whole documents, counted within their row: no n-gram is shuffled.

Tokens come as text, those of a sentence apart by blanks, sentences by line ends. A batch of documents is counted by
array operations over the numbers of its words, so only distinct words meet the rules of the tagger and the stemmer.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.config import Extraction
from lexiweave.functions import tagging
from lexiweave.functions import text as tx

#: Bytes of text whose n-grams are counted at once; a longer document is counted alone, and whole.
AT_ONCE = 400_000
#: Words whose tag and stem a worker remembers.
REMEMBERED = 1 << 17

#: Tags in the order of their names, so that the greatest number is the greatest name.
TAGS = sorted({"?", *(name for _, name in tagging.WORD_PATTERNS)})
_NUMBER = {name: k for k, name in enumerate(TAGS)}
_GRAMMAR = re.compile(tagging.POSTAG_VALID)
_BEYOND = re.compile(r"[^\x00-\x7F]")


@lru_cache(REMEMBERED)
def _tag(word: str) -> int:
    return _NUMBER[tagging.tag_word(word)]


@lru_cache(REMEMBERED)
def _accepted(tags: tuple[int, ...]) -> bool:
    return bool(_GRAMMAR.search("".join(TAGS[t] + "," for t in tags)))


def document_tokens(documents: DataFrame, cfg: Extraction = Extraction()) -> DataFrame:
    """corpus_id, doc_id, text and low, its lower case: the sentences of all rows of a document, whose texts are shuffled if it can have several."""
    content = tx.select_content(*(F.col(f) for f in cfg.fields if f in documents.columns))
    docs = documents.select("corpus_id", "doc_id", content.alias("x")).groupBy("corpus_id", "doc_id").agg(F.collect_list("x").alias("x"))
    lines = F.transform(F.flatten(F.transform("x", tx.sentences)), lambda s: F.array_join(tx.treebank_tokens(s), " "))
    text = docs.select("corpus_id", "doc_id", F.array_join(F.filter(lines, lambda s: s != ""), "\n").alias("text"))
    return text.withColumn("low", F.lower("text"))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Document and sentence of each token, the number of its word, and the words."""
    lines = pc.split_pattern(texts, "\n")
    tokens = pc.split_pattern(lines.flatten(), " ")
    line = pc.list_parent_indices(tokens).to_numpy()
    coded = tokens.flatten().dictionary_encode()
    return pc.list_parent_indices(lines).to_numpy()[line], line, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _joined(words: pa.Array, numbers: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """The ``n`` words from each place on, apart by blanks."""
    parts = [words.take(pa.array(numbers[at + k])) for k in range(n)]
    return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")


def _counted(b: pa.RecordBatch, least: int, most: int, stem: Callable[[str], str] | None) -> Iterator[pa.RecordBatch]:
    """The distinct accepted n-grams of each document: a batch for each length."""
    doc, line, raw, spelt = _words(b.column(2))
    _, _, word, words = _words(b.column(3))
    tag = np.array([_tag(w) for w in spelt.to_pylist()], np.int64)[raw]
    # An id is made of ASCII, and its stems are lower case.
    stems = None if stem is None else pa.array([_BEYOND.sub("?", stem(w).lower()) for w in words.to_pylist()], pa.string())
    names = pa.array(TAGS, pa.string())
    gram, _ = pd.factorize(doc * len(words) + word)
    tags, at = tag, np.arange(len(word))
    for n in range(1, most + 1):
        if n > 1:
            # Those that go on within their sentence; ids are made small again, so no product is too large.
            on = np.flatnonzero(at + n - 1 < len(word))
            on = on[line[at[on]] == line[at[on] + n - 1]]
            at = at[on]
            gram, _ = pd.factorize(gram[on] * len(words) + word[at + n - 1])
            tags = tags[on] * len(TAGS) + tag[at + n - 1]
            if n % 12 == 0:
                tags = np.unique(tags, return_inverse=True)[1]
        if not len(at):
            return
        if n < least:
            continue
        kind, first = pd.factorize(tags)
        some = np.zeros(len(first), np.int64)
        some[kind] = at
        fine = np.flatnonzero(np.array([_accepted(tuple(tag[i : i + n].tolist())) for i in some])[kind])
        occs = np.bincount(gram[fine])
        # Of a form with several tags the greatest counts: the last one written.
        own = tags[fine]
        by = np.argsort(own.astype(np.uint16) if len(own) and own.max() < 1 << 16 else own, kind="stable")
        place = np.zeros(len(occs), np.int64)
        place[gram[fine][by]] = at[fine][by]
        found = np.flatnonzero(occs)
        place, occs = place[found], occs[found]
        of = pa.array(doc[place])
        postag = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(place) + 1, n), pa.int32()), names.take(pa.array(tag[place[:, None] + np.arange(n)].ravel())))
        cols = {"form": _joined(words, word, place, n), "corpus_id": b.column(0).take(of), "doc_id": b.column(1).take(of), "occs": pa.array(occs, pa.int64()), "postag": postag}
        yield pa.RecordBatch.from_pydict(cols if stems is None else cols | {"stems": _joined(stems, word, place, n)})


def accepted_grams(documents: DataFrame, cfg: Extraction = Extraction(), stem: Callable[[str], str] | None = None) -> DataFrame:
    """form, corpus_id, doc_id, occs, postag of the n-grams that pass the tag grammar, none across sentences.

    With ``stem``, a function of a lower-case word, also stems: those of the form in ASCII, apart by blanks.
    """
    texts = document_tokens(documents, cfg)
    keys = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in ("corpus_id", "doc_id"))
    least, most = cfg.ngram_min, cfg.ngram_max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = stem and lru_cache(REMEMBERED)(stem)
        for b in batches:
            b = b.filter(pc.greater(pc.binary_length(b.column(2)), 0))
            size = np.cumsum(pc.binary_length(b.column(2)).to_numpy()) // AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if j > i:
                    yield from _counted(b.slice(i, j - i), least, most, known)

    return texts.mapInArrow(run, f"form string, {keys}, occs long, postag array<string>" + ", stems string" * (stem is not None))
