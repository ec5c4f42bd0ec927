"""Readers: CSV of records, MEDLINE exports and archives, whitelists, stop n-grams; by protocol name."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexiweave.config import SourceFields
from lexiweave.functions import text as tx


# One cell and the comma or end after it; a quote that opens a cell must close.
_CELL = re.compile(r'"((?:[^"]|"")*+)"(?!")([^,]*)(?:,|\Z)|([^",][^,]*|)(?:,|\Z)', re.S)


def csv_cells(record: str) -> list[str] | None:
    """The cells of a record, or None where a quote never closes."""
    out, at = [], 0
    while m := _CELL.match(record, at):
        out.append(m[1].replace('""', '"') + m[2] if m[1] is not None else m[3])
        if not m[0].endswith(","):
            return out
        at = m.end()
    return None


def _split(records: pd.Series, first: pd.Series) -> pd.Series:
    return records.map(lambda r: None if r is None else csv_cells(r))


def _cells(record: str, first: str) -> Column:
    """Spark reads no plan that needs only the column of uneven records, so the first cell goes along with those."""
    uneven = F.when(F.col(record).isNotNull(), F.col(f"`{first}`"))
    return F.pandas_udf(_split, "array<string>")(record, uneven)


def _uneven_csv(spark: SparkSession, path: str, encoding: str) -> tuple[DataFrame, str, list[str]]:
    """All records of a file, the column that keeps the text of those with cells too few or too many, the header."""
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": encoding}
    header = spark.read.csv(path, **options).columns
    kept = "_record"
    while kept in header:
        kept = f"_{kept}"
    schema = StructType([StructField(c, StringType()) for c in [*header, kept]])
    return spark.read.schema(schema).csv(path, **options, mode="PERMISSIVE", columnNameOfCorruptRecord=kept), kept, header


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV file with header, all strings; records may hold line breaks.

    Missing cells are empty, surplus cells are left aside (see ``csv_uneven``), undecodable bytes are dropped. Records
    whose quotes never close are no rows; ``csv_uneven`` has them with their reason.
    """
    df, kept, header = _uneven_csv(spark, path, encoding)
    if not header:
        return df.select()
    whole = F.col(kept).isNull() | _cells(kept, header[0]).isNotNull()
    return df.where(whole).select(*(F.replace(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit("\ufffd"), F.lit("")).alias(c) for c in header))


def csv_uneven(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """record, reason and surplus (cells) of each record that hasn't as many cells as the header.

    The reason is ``quoting`` for those that ``read_csv`` rejects, ``missing_cells`` or ``surplus_cells`` for those
    that it keeps.
    """
    df, kept, header = _uneven_csv(spark, path, encoding)
    if not header:
        return spark.createDataFrame([], "record string, reason string, surplus array<string>")
    rows = df.where(F.col(kept).isNotNull()).select(F.col(kept).alias("record"), _cells(kept, header[0]).alias("cells"))
    reason = F.when(F.col("cells").isNull(), "quoting").when(F.size("cells") < len(header), "missing_cells").otherwise("surplus_cells")
    surplus = F.when(F.size("cells") > len(header), F.slice("cells", len(header) + 1, F.greatest(F.size("cells"), F.lit(1))))
    return rows.select("record", reason.alias("reason"), surplus.alias("surplus"))


def project_documents(df: DataFrame, fields: SourceFields = SourceFields()) -> DataFrame:
    """doc_id, corpus_id, label, content and the optional fields that the source has.

    The label's column is chosen when the plan is made. Rows without id, content or period drop out; other columns
    are ignored.
    """
    label = fields.label if fields.label in df.columns else fields.label_default
    some = {k: c for k, c in fields.optional.items() if c in df.columns}
    need = lambda c: F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`") != "")
    rows = df.where(need(fields.id) & F.col(f"`{fields.content}`").isNotNull() & need(fields.corpus_id))
    roles = {"doc_id": fields.id, "corpus_id": fields.corpus_id, "label": label, "content": fields.content}
    return rows.select(*(F.col(f"`{c}`").cast("string").alias(k) for k, c in (roles | some).items()))


def record_csv(spark: SparkSession, path: str, fields: SourceFields = SourceFields(), encoding: str = "UTF-8") -> DataFrame:
    return project_documents(read_csv(spark, path, encoding), fields)


def medline_records(lines: DataFrame, source: Column | None = None) -> DataFrame:
    """record: map of tag to list of values, from whole records in ``value`` (lines of one record).

    Six blanks continue the line before; repeated tags keep all values in order.
    """
    joined = F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), "\n {6}", " ")
    parts = F.filter(F.split(joined, "\n"), lambda x: x.rlike(r"^[A-Z0-9 ]{4}-"))
    pairs = F.transform(parts, lambda x: F.struct(F.trim(F.substring(x, 1, 4)).alias("tag"), F.substring(x, 7, 1 << 30).alias("text")))
    tags = F.array_distinct(F.transform("pairs", lambda p: p["tag"]))
    values = F.transform("tags", lambda t: F.transform(F.filter("pairs", lambda p: p["tag"] == t), lambda p: p["text"]))
    keep = [source.alias("source_path")] if source is not None else []
    return lines.select(pairs.alias("pairs"), *keep).where(F.size("pairs") > 0).withColumn("tags", tags).select(F.map_from_arrays("tags", values).alias("record"), *(["source_path"] if keep else []))


#: Bytes at the head of a file from which its line ends are told.
HEAD = 1 << 16


def _by_line_end(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """Files by what ends their lines; folders and patterns are resolved, hidden files left out."""
    out: dict[str, list[str]] = {}
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for one in [path] if isinstance(path, str) else path:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(one)
        fs = p.getFileSystem(conf)
        found = [f for g in fs.globStatus(p) or [] for f in (fs.listStatus(g.getPath()) if g.isDirectory() else [g])]
        if not found:
            raise ValueError(f"no such file: {one}")
        for f in found:
            if f.isDirectory() or f.getPath().getName()[0] in "._":
                continue
            stream = fs.open(f.getPath())
            head = bytes(stream.readNBytes(HEAD))
            stream.close()
            out.setdefault("\r\n" if b"\r\n" in head else "\r" if b"\r" in head and b"\n" not in head else "\n", []).append(f.getPath().toString())
    return out


def text_records(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """value: what stands between blank lines of text files, whatever ends their lines; undecodable bytes are dropped.

    The line ends at the head of a file decide where it may be split between tasks; records of files with mixed ends come
    out right as well. Files in another encoding than UTF-8 are decoded whole, one task each.
    """
    if encoding.upper().replace("_", "-") != "UTF-8":
        chunks = spark.read.format("binaryFile").load(path).select(F.decode("content", encoding).alias("value"))
    else:
        frames = [spark.read.text(files, lineSep=end * 2) for end, files in _by_line_end(spark, path).items()]
        chunks = frames[0] if frames else spark.createDataFrame([], "value string")
        for f in frames[1:]:
            chunks = chunks.unionByName(f)
    clean = F.regexp_replace(F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit("")), "\r\n?", "\n")
    return chunks.select(F.explode(F.split(clean, r"\n[ \t]{0,5}\n")).alias("value")).where(F.trim("value") != "")


def medline(spark: SparkSession, path: str | list[str], period_size: int = 4, encoding: str = "UTF-8") -> DataFrame:
    """Documents of MEDLINE exports; the period is the head of the publication date. Records without one drop out."""
    rec = medline_records(text_records(spark, path, encoding))
    one = lambda t: F.array_join(F.col("record")[t], " ")
    got = rec.select(one("PMID").alias("doc_id"), F.substring(one("DP"), 1, period_size).alias("corpus_id"), F.coalesce(one("TI"), one("PMID")).alias("label"), one("AB").alias("content"), one("TI").alias("title"), "record")
    return got.where("doc_id is not null and corpus_id is not null and corpus_id <> '' and content is not null")


def medline_archive(spark: SparkSession, root: str, periods: list[str], period_size: int = 4) -> DataFrame:
    """Documents of <root>/<period>/<period>.txt for the periods asked for."""
    return medline(spark, [f"{root}/{p}/{p}.txt" for p in periods], period_size)


def whitelist(df: DataFrame, order: str | None = None) -> DataFrame:
    """form_id, form, lemma_id, label of the accepted rows (status, label, ngram forms); the last row of a form wins.

    The order of rows is that of the file, or of the column ``order``.

    A label is a form only if it stands among the forms. Accepts the column ``ngram forms`` or ``ngram_forms``.
    """
    forms = "ngram forms" if "ngram forms" in df.columns else "ngram_forms"
    rows = df.withColumn("row_no", F.col(order) if order else F.monotonically_increasing_id()).where(F.trim("status") == "w").select("row_no", tx.strip(F.col("label")).alias("label"), F.explode(F.split(F.col(f"`{forms}`"), r"\*\*\*")).alias("form"))
    rows = rows.select("row_no", "label", tx.strip(F.col("form")).alias("form")).where("form <> ''")
    ids = rows.select(tx.ngram_id(F.col("form")).alias("form_id"), F.lower("form").alias("form"), tx.ngram_id(F.col("label")).alias("lemma_id"), "label", "row_no")
    return ids.groupBy("form_id").agg(*(F.max_by(c, "row_no").alias(c) for c in ("form", "lemma_id", "label")))


def whitelist_csv(spark: SparkSession, path: str) -> DataFrame:
    return whitelist(read_csv(spark, path))


def _labels(source: list) -> list[str]:
    """Stop n-grams of a list of words, of n-grams (lists of words), or of such lists by length."""
    out = []
    for x in source:
        if isinstance(x, str):
            out.append(x)
        elif all(isinstance(w, str) for w in x):
            out.append(" ".join(x))
        else:
            out += _labels(x)
    return out


def stop_ngrams(spark: SparkSession, source: str | list, encoding: str = "UTF-8") -> DataFrame:
    """label and n of stop n-grams, from a file (one a line), a list (flat, of n-grams, or by length), or ``builtin://<language>``."""
    if isinstance(source, str) and source.startswith("builtin://"):
        from pyspark.ml.feature import StopWordsRemover

        source = StopWordsRemover.loadDefaultStopWords(source.removeprefix("builtin://"))
    if isinstance(source, str):
        rows = text_records(spark, source, encoding).select(F.explode(F.split("value", "\n")).alias("label")).select(F.lower(F.trim("label")).alias("label"))
    else:
        rows = spark.createDataFrame([(w.lower().strip(),) for w in _labels(source)], "label string")
    return rows.where("label <> ''").distinct().withColumn("n", F.size(F.split("label", " ")))


def add_stops(stops: DataFrame, *labels: str) -> DataFrame:
    """A stop list with further n-grams."""
    return stops.unionByName(stop_ngrams(stops.sparkSession, list(labels))).distinct()


READERS: dict[str, Callable[..., DataFrame]] = {"recordcsv": record_csv, "basecsv": read_csv, "medline": medline, "medlinearchive": medline_archive, "whitelist": whitelist_csv}


def register_reader(protocol: str, reader: Callable[..., DataFrame]) -> None:
    """Make a further format known: a function of session and path that gives documents."""
    READERS[protocol] = reader


def open_source(spark: SparkSession, dsn: str, **options) -> DataFrame:
    """``protocol://path`` read by the protocol's reader."""
    protocol, sep, path = dsn.partition("://")
    if not sep or protocol not in READERS:
        raise ValueError(f"unknown source format: {dsn}")
    return READERS[protocol](spark, path, **options)
