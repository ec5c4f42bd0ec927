"""Queries of this subpackage that the driver runs: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.functions.text import word_ngrams
from lexiweave.llm import cooccurrence, garbled, leakage, near_duplicates, packing, sentences, subjects, term_frequency
from lexiweave.llm.words import LETTERS, words
from lexiweave.operators import packed_values
from lexiweave.store import materialise, read, spread


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read(spark, folder, "tinacsv_docs").select("rec_id", "title", "abstract"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read(spark, folder, "documents").select("doc_id", "text"))


def _term_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs, terms = _docs(spark, folder), read(spark, folder, "whitelist_terms")
    counts = term_frequency.text_term_counts(docs, "title").unionByName(term_frequency.text_term_counts(docs, "abstract")).unionByName(term_frequency.value_counts(terms, "total_occs"))
    records = term_frequency.record_counts(docs, ["title", "abstract"]).unionByName(term_frequency.record_counts(terms, ["total_occs"]))
    return term_frequency.mark(counts, records)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _term_counts(spark, folder).where("mark is not null").select("field_name", "term", "mark")


def p6_term_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _term_counts(spark, folder)


#: Focus terms are sent to each task up to about this size, and joined by shuffle beyond.
TERM_BYTES = 32 << 20


def focus_baskets(docs: DataFrame, focus: DataFrame, most_bytes: int = TERM_BYTES) -> DataFrame:
    """rec_id and the focus terms whose words follow one another in the abstract."""
    terms = focus.select("term").where("term is not null").distinct()
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 200), F.lit(0))).first()[0]
    docs = docs.where("abstract is not null")
    return _focus_by_table(docs, [r[0] for r in terms.collect()]) if size <= most_bytes else _focus_by_join(docs, terms)


def _focus_by_table(docs: DataFrame, terms: list[str]) -> DataFrame:
    word = re.compile(f"[{LETTERS}]+")
    first: dict[str, list[tuple[str, list[str]]]] = {}
    for t in terms:
        if own := word.findall(t):
            first.setdefault(own[0], []).append((t, own))

    def find(text: str) -> list[str]:
        ws = word.findall(text.lower())
        return sorted({t for i, w in enumerate(ws) if w in first for t, own in first[w] if ws[i : i + len(own)] == own})

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(find)

    got = docs.select("rec_id", F.pandas_udf(run, "array<string>")("abstract").alias("items"))
    return got.where(F.size("items") > 0)


def _focus_by_join(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The n-grams of each text, of all lengths that terms have, joined with the terms."""
    keyed = terms.select("term", words(F.col("term")).alias("w")).where(F.size("w") > 0).select("term", F.array_join("w", " ").alias("key"), F.size("w").alias("n"))
    lengths = [r[0] for r in keyed.select("n").distinct().collect()]
    own = docs.select("rec_id", words(F.col("abstract")).alias("w"))
    grams = F.array_distinct(F.flatten(F.array(*(word_ngrams(F.col("w"), n, n) for n in lengths)))) if lengths else F.array().cast("array<string>")
    hits = own.select("rec_id", F.explode(grams).alias("key")).join(keyed, "key")
    return hits.groupBy("rec_id").agg(F.sort_array(F.collect_set("term")).alias("items"))


def _pair_table(spark: SparkSession, folder: str) -> cooccurrence.PairTable:
    """The table of all records, merged in two deliveries: the first half of the ids, then the rest.

    The table is opened from its folder again before the second merge and after it.
    """
    docs = read(spark, folder, "tinacsv_docs")
    half = docs.agg(F.floor((F.min("rec_id") + F.max("rec_id")) / 2)).first()[0] or 0
    late = lambda c: (F.coalesce(F.col(c), F.lit(0)) > half).alias("late")
    values = packed_values.split_values(docs, {"doc_keywords": ("rec_id", "doc_keywords")})
    keywords = values.groupBy("row_id").agg(F.collect_set(F.lower("item")).alias("items")).select(F.lit("doc_keywords").alias("field_name"), "items", late("row_id"))
    focus = focus_baskets(spread(docs.select("rec_id", "abstract")), read(spark, folder, "focus_terms")).select(F.lit("abstract").alias("field_name"), "items", late("rec_id"))
    baskets = materialise(keywords.unionByName(focus))
    records = docs.groupBy(late("rec_id")).agg(F.count("*").alias("n")).select("late", F.explode(F.array(F.lit("doc_keywords"), F.lit("abstract"))).alias("field_name"), "n")
    table = cooccurrence.PairTable(spark)
    for part in (~F.col("late"), F.col("late")):
        table.apply(baskets.where(part), records=records.where(part).select("field_name", "n"))
        table = cooccurrence.PairTable(spark, table.folder)
    return table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    scores = _pair_table(spark, folder).scores(least=4, per=2000)
    return cooccurrence.associated(scores).select("field_name", "item_a", "item_b")


def p3_pair_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _pair_table(spark, folder).scores()


def p3_focus_scores(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of focus terms in abstracts, with their counts and lift."""
    docs = spread(read(spark, folder, "tinacsv_docs").select("rec_id", "abstract"))
    focus = focus_baskets(docs, read(spark, folder, "focus_terms")).select(F.lit("abstract").alias("field_name"), "items")
    table = cooccurrence.PairTable(spark)
    table.apply(focus, records=docs.agg(F.count("*").alias("n")).select(F.lit("abstract").alias("field_name"), "n"))
    return table.scores().drop("field_name").withColumn("lift", F.round("lift", 6))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(_docs(spark, folder))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.group_pairs(near_duplicates.near_duplicate_groups(_docs(spark, folder), count_links=False))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_units(_docs(spark, folder), "rec_id", "abstract")


def p7_restored(spark: SparkSession, folder: str) -> DataFrame:
    return garbled.find_garbled(_docs(spark, folder), "rec_id", ["title", "abstract"])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_restored(spark, folder).select("rec_id", "field_name")


def _packed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return packing.pack(materialise(packing.token_counts(_documents(spark, folder))))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)[0]


def p8_certificates(spark: SparkSession, folder: str) -> DataFrame:
    """Containers and lower bounds by round and part; part -1 is the whole table after the round."""
    return _packed(spark, folder)[1]


def p8_small_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The certificates of parts of a hundred items, which exchange items over several rounds."""
    return packing.pack(materialise(packing.token_counts(_documents(spark, folder))), part_items=100)[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least one window of an item word by word: the verdict ``verbatim``."""
    return leakage.leaks(_documents(spark, folder), read(spark, folder, "eval_items"), verbatim=True).select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Every leak, with re-parameterised items, the number of windows and of those that are verbatim."""
    return leakage.leaks(_documents(spark, folder), read(spark, folder, "eval_items"))


def p10_subjects(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.assign_subjects(_documents(spark, folder), read(spark, folder, "subject_labels"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_subjects(spark, folder).select("doc_id", "subject")


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by subject."""
    return p10_subjects(spark, folder).groupBy("subject").agg(F.count("*").alias("n_docs"), F.count_if("is_main").alias("n_main"))


_DOC_TERMS = """unnest(list_distinct(regexp_extract_all(lower({f}), '[a-zß-öø-ÿ]{{3,}}')))"""
_TERM_SQL = " UNION ALL ".join(
    [f"SELECT '{f}' AS field_name, term, count(*) AS n, (SELECT count(*) FROM tinacsv_docs WHERE regexp_matches({f}, '[^\\s\\pZ]')) AS r FROM (SELECT {_DOC_TERMS.format(f=f)} AS term FROM tinacsv_docs) GROUP BY term" for f in ("title", "abstract")]
    + ["SELECT 'total_occs' AS field_name, CAST(total_occs AS VARCHAR) AS term, count(*) AS n, (SELECT count(total_occs) FROM whitelist_terms) AS r FROM whitelist_terms WHERE total_occs IS NOT NULL GROUP BY total_occs"]
)
_ALL_TERMS = """unnest(regexp_extract_all(lower({f}), '[a-zß-öø-ÿ]{{3,}}'))"""
_COUNT_SQL = " UNION ALL ".join(
    [f"SELECT '{f}' AS field_name, term, CAST(sum(k) AS BIGINT) AS n_occurrences, count(*) AS n_records, (SELECT count(*) FROM tinacsv_docs WHERE regexp_matches({f}, '[^\\s\\pZ]')) AS r FROM (SELECT rec_id, term, count(*) AS k FROM (SELECT rec_id, {_ALL_TERMS.format(f=f)} AS term FROM tinacsv_docs) GROUP BY ALL) GROUP BY term" for f in ("title", "abstract")]
    + ["SELECT 'total_occs' AS field_name, CAST(total_occs AS VARCHAR) AS term, count(*) AS n_occurrences, count(*) AS n_records, (SELECT count(total_occs) FROM whitelist_terms) AS r FROM whitelist_terms WHERE total_occs IS NOT NULL GROUP BY total_occs"]
)


def _windows(table: str, key: str) -> str:
    """Distinct rows of key and 12 words that follow one another."""
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i + 11], ' ') AS win FROM (SELECT {key}, w, unnest(generate_series(1, len(w) - 11)) AS i
        FROM (SELECT {key}, regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+') AS w FROM {table}) WHERE len(w) > 11)"""


_FOCUS_WORDS = "array_to_string(regexp_extract_all(lower({c}), '[a-zß-öø-ÿ]+'), ' ')"

ORACLE = {
    "p3_focus_scores": f"""WITH f AS (SELECT DISTINCT term, {_FOCUS_WORDS.format(c='term')} AS k FROM focus_terms WHERE term IS NOT NULL), d AS (SELECT rec_id, {_FOCUS_WORDS.format(c='abstract')} AS w FROM tinacsv_docs WHERE abstract IS NOT NULL),
    b AS (SELECT DISTINCT rec_id, term FROM d JOIN f ON k <> '' AND contains(' ' || w || ' ', ' ' || k || ' ')), i AS (SELECT term, count(*) AS n FROM b GROUP BY ALL), n AS (SELECT count(*) AS n FROM tinacsv_docs),
    p AS (SELECT x.term AS item_a, y.term AS item_b, count(*) AS n_ab FROM b x JOIN b y ON x.rec_id = y.rec_id AND x.term < y.term GROUP BY ALL)
    SELECT item_a, item_b, n_ab, u.n AS n_a, v.n AS n_b, n.n AS n_records, round(n.n * n_ab / (u.n * v.n), 6) AS lift FROM p JOIN i u ON item_a = u.term JOIN i v ON item_b = v.term, n""",
    "p6_term_counts": f"SELECT field_name, term, n_occurrences, n_records, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records > 0.2 * r THEN 'common' END AS mark FROM ({_COUNT_SQL})",
    "p9_found": f"SELECT DISTINCT doc_id, item_id FROM ({_windows('documents', 'doc_id')}) AS d JOIN ({_windows('eval_items', 'item_id')}) AS e USING (win)",
    "p6_found": f"SELECT field_name, term, CASE WHEN n < 3 THEN 'rare' ELSE 'common' END AS mark FROM ({_TERM_SQL}) WHERE n < 3 OR n > 0.2 * r",
}

QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p3_found": p3_found,
    "p3_pair_scores": p3_pair_scores,
    "p3_focus_scores": p3_focus_scores,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_restored": p7_restored,
    "p8_containers": p8_containers,
    "p8_certificates": p8_certificates,
    "p8_small_parts": p8_small_parts,
    "p9_found": p9_found,
    "p10_found": p10_found,
    "p10_subjects": p10_subjects,
    "p10_composition": p10_composition,
    "p9_leaks": p9_leaks,
    "p6_term_counts": p6_term_counts,
}
