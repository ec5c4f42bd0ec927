"""Extraction and indexing: documents to n-grams, forms, document frequencies and keywords."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.config import Extraction
from lexiweave.functions import tagging
from lexiweave.functions import text as tx
from lexiweave.functions.stemming import vocabulary_stems
from lexiweave.operators.document_grams import accepted_grams

#: Rows of a whitelist or stop list up to which it is sent to each task; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has few enough rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def doc_tokens(documents: DataFrame, content: str = "content") -> DataFrame:
    """corpus_id, doc_id, pos (from 1), token; a document is one sequence."""
    return documents.select("corpus_id", "doc_id", F.posexplode(tx.tokens(F.col(content))).alias("p", "token")).select("corpus_id", "doc_id", (F.col("p") + 1).alias("pos"), "token")


def term_rows(documents: DataFrame, least: int = 1, most: int = 1, content: str = "content") -> DataFrame:
    """corpus_id, doc_id, term: each n-gram of a document where it stands."""
    # Tokens are a column of their own, else each slice would split the text again.
    toks = documents.select("corpus_id", "doc_id", tx.tokens(F.col(content)).alias("t"))
    terms = F.col("t") if most == 1 else tx.word_ngrams(F.col("t"), least, most)
    return toks.select("corpus_id", "doc_id", F.explode(terms).alias("term"))


def doc_terms(documents: DataFrame, least: int = 1, most: int = 1, content: str = "content") -> DataFrame:
    """corpus_id, doc_id, term, occs: n-grams of a document with their number."""
    return term_rows(documents, least, most, content).groupBy("corpus_id", "doc_id", "term").agg(F.count("*").alias("occs"))


def term_sets(documents: DataFrame, least: int = 1, most: int = 1, content: str = "content") -> DataFrame:
    """corpus_id, doc_id, s: the distinct n-grams of documents that are one row each, without any shuffle."""
    toks = documents.select("corpus_id", "doc_id", tx.tokens(F.col(content)).alias("t"))
    return toks.select("corpus_id", "doc_id", F.array_distinct(F.col("t") if most == 1 else tx.word_ngrams(F.col("t"), least, most)).alias("s"))


def only_terms(sets: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """``term_sets`` without any but the given terms, of which there are at most ``k`` rows: they are sent along in the plan."""
    kept = [r[0] for r in terms.select("term").limit(k).collect()]
    return sets.select("corpus_id", "doc_id", F.array_intersect("s", F.array(*map(F.lit, sorted(kept))).cast("array<string>")).alias("s"))


def sentence_ngrams(documents: DataFrame, cfg: Extraction = Extraction()) -> DataFrame:
    """corpus_id, doc_id, tokens, tags, form for each tagged n-gram; none crosses a sentence or a field."""
    have = [f for f in cfg.fields if f in documents.columns]
    text = tx.select_content(*(F.col(f) for f in have))
    one = documents.select("corpus_id", "doc_id", F.explode(tx.sentences(text)).alias("s")).select("corpus_id", "doc_id", tx.treebank_tokens(F.col("s")).alias("t"))
    grams = F.flatten(F.transform(F.sequence(F.lit(cfg.ngram_min), F.lit(cfg.ngram_max)), lambda n: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size("t"), F.lit(1))), lambda i: F.slice("t", i, n)), lambda g: F.size(g) == n)))
    rows = one.where(F.size("t") > 0).select("corpus_id", "doc_id", F.explode(grams).alias("tokens"))
    return rows.withColumn("tags", F.transform("tokens", tagging.tag)).withColumn("form", F.lower(F.array_join("tokens", " ")))


def identity_stems(words: DataFrame) -> DataFrame:
    return words.select("token").distinct().withColumn("stem", F.col("token"))


identity_stems.word = str


def candidates(documents: DataFrame, stops: DataFrame | None = None, cfg: Extraction = Extraction(), stemmer: Callable[[DataFrame], DataFrame] = vocabulary_stems) -> DataFrame:
    """n-grams that pass the tag grammar and aren't stop n-grams, grouped by the id of their stems.

    corpus_id, doc_id, ngram_id, form, postag, occs. A stop n-gram is refused as a whole only. ``stemmer`` gives token
    and stem for each distinct token; ``identity_stems`` leaves words as they are. One whose attribute ``word`` does the
    same for a single token is called where the token stands; others are joined.
    """
    word = getattr(stemmer, "word", None)
    forms = accepted_grams(documents, cfg, word)
    if stops is not None:
        forms = forms.join(small(stops.select(F.col("label").alias("form"))), "form", "left_anti")
    own = ("form", "corpus_id", "doc_id", "occs", "postag")
    if word:
        return forms.select(*own, F.sha2("stems", 256).alias("ngram_id"))
    # Stems are made once for each distinct word and joined back.
    words = forms.select("form").distinct().select("form", F.posexplode(F.split("form", " ")).alias("p", "token"))
    stems = stemmer(words)
    ids = words.join(stems, "token").groupBy("form").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "stem"))), lambda x: x["stem"]), " ").alias("stems"))
    return forms.select(*own).join(ids.select("form", tx.ngram_id(F.col("stems")).alias("ngram_id")), "form")


def document_forms(documents: DataFrame, whitelist: DataFrame, cfg: Extraction = Extraction()) -> DataFrame:
    """corpus_id, doc_id, ngram_id, form, label, occs of whitelisted forms, under the id of their lemma.

    A document that comes twice in a corpus counts once.
    """
    docs = documents.dropDuplicates(["corpus_id", "doc_id"])
    rows = sentence_ngrams(docs, cfg).select("corpus_id", "doc_id", "form")
    found = rows.join(small(whitelist.select("form", "lemma_id", "label")), "form")
    return found.groupBy("corpus_id", "doc_id", F.col("lemma_id").alias("ngram_id"), "form").agg(F.max("label").alias("label"), F.count("*").alias("occs"))


def links_of_forms(forms: DataFrame) -> DataFrame:
    """corpus_id, doc_id, ngram_id, label, occs: the forms of ``document_forms`` grouped by n-gram."""
    return forms.groupBy("corpus_id", "doc_id", "ngram_id").agg(F.max("label").alias("label"), F.sum("occs").alias("occs"))


def index_documents(documents: DataFrame, whitelist: DataFrame, cfg: Extraction = Extraction()) -> DataFrame:
    """corpus_id, doc_id, ngram_id, label, occs of whitelisted n-grams, forms grouped by lemma."""
    return links_of_forms(document_forms(documents, whitelist, cfg))


def document_frequency(doc_ngram: DataFrame, key: str = "ngram_id") -> DataFrame:
    """corpus_id, key, df; rows are distinct by corpus, document and key."""
    return doc_ngram.groupBy("corpus_id", key).agg(F.count("*").alias("df"))


def major_form(forms: DataFrame, key: str = "ngram_id") -> DataFrame:
    """The greatest form of each n-gram by code points, and how many forms it has (key, form)."""
    return forms.groupBy(key).agg(F.max("form").alias("label"), F.count_distinct("form").alias("n_forms"))


#: How edges of each class and target are merged; others are summed.
EDGE_POLICIES = {
    ("Corpus", "Corpora"): "unique",
    ("Corpus", "Document"): "unique",
    ("Corpora", "Corpus"): "unique",
    ("Corpora", "Whitelist"): "overwrite",
    ("Corpora", "Source"): "overwrite",
    ("Document", "Document"): "overwrite",
    ("Document", "keyword"): "overwrite",
    ("NGram", "NGram"): "overwrite",
    ("NGram", "postag"): "overwrite",
    ("Whitelist", "NGram"): "overwrite",
    ("Whitelist", "StopNGram"): "overwrite",
}


def merge_objects(edges: DataFrame) -> DataFrame:
    """Edges (category, id, target, neighbour, weight, seq) merged by the policy of their class, those of weight 0 or less purged."""
    keys = ["category", "id", "target", "neighbour"]
    policy = F.lit("sum")
    for (category, target), how in EDGE_POLICIES.items():
        policy = F.when((F.col("category") == category) & (F.col("target") == target), how).otherwise(policy)
    # The policy depends on the key alone, so all three sums are one aggregation.
    got = edges.groupBy(*keys).agg(F.min_by("weight", "seq").alias("unique"), F.max_by("weight", "seq").alias("overwrite"), F.sum("weight").alias("sum"))
    weight = F.when(policy == "unique", F.col("unique")).when(policy == "overwrite", F.col("overwrite")).otherwise(F.col("sum"))
    return got.select(*keys, weight.alias("weight")).where("weight > 0")


def new_rows(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """What isn't stored yet."""
    return new.join(stored.select(*keys), keys, "left_anti")


def merge_edges(edges: DataFrame, policy: str, keys: list[str]) -> DataFrame:
    """Edges (keys, weight, seq) merged: ``unique`` keeps the first, ``overwrite`` the last, ``sum`` adds."""
    how = {"unique": F.min_by("weight", "seq"), "overwrite": F.max_by("weight", "seq"), "sum": F.sum("weight")}
    return edges.groupBy(*keys).agg(how[policy].alias("weight"))


def top_terms(terms: DataFrame, k: int, least_length: int = 4) -> DataFrame:
    """The ``k`` terms of most documents (corpus_id, doc_id, term, ...), ties by term: a whitelist made by machine."""
    df = terms.where(F.length("term") >= least_length).groupBy("term").agg(F.count("*").alias("df"))
    return df.orderBy(F.desc("df"), "term").limit(k)
