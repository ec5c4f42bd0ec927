"""Reports and sinks: whitelist report, co-occurrence tables, CSV text and graph exchange XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweave.functions import tagging
from lexiweave.operators.index import small
from lexiweave.store import materialise

SEPARATOR = " *** "
# The columns of a whitelist report, in order.
WHITELIST_COLUMNS = (
    "status",
    "label",
    "pos tag",
    "total occs",
    "ngram forms",
    "length",
    "total occs ^ length",
    "max occs per period",
    "max occs period id",
    "max occs  ^ length per period",
    "max occs ^ length period id",
    "periods",
    "documents",
)


def _joined(c: str | Column) -> Column:
    return F.array_join(F.sort_array(F.collect_set(c)), SEPARATOR)


def period_maxima(df: DataFrame, sizes: DataFrame, key: str, length: Column) -> DataFrame:
    """key, the largest df / documents and df ^ length / documents over corpora, and the corpora (ties: greatest id).

    ``df``: corpus_id, key, df and what ``length`` reads; ``sizes``: corpus_id, docs. Corpora without documents are left out.
    """
    r = df.join(small(sizes.where("docs > 0")), "corpus_id").withColumn("ratio", F.col("df") / F.col("docs")).withColumn("ratio_n", F.pow(F.col("df").cast("double"), length) / F.col("docs"))
    return r.groupBy(key).agg(
        F.max("ratio").alias("max_occs"),
        F.max_by("corpus_id", F.struct("ratio", "corpus_id")).alias("max_period"),
        F.max("ratio_n").alias("max_occs_n"),
        F.max_by("corpus_id", F.struct("ratio_n", "corpus_id")).alias("max_period_n"),
    )


def whitelist_report(forms: DataFrame, sizes: DataFrame, min_occurrences: int = 1, status: str = "") -> DataFrame:
    """One row per n-gram with the report's columns in snake case, but for the list of documents.

    ``forms``: corpus_id, doc_id, ngram_id, form and, if they aren't those of the rule tagger, postag (array); if the
    n-grams of a document are told apart already, also ``first``: 1 for one form of each n-gram in a document, else 0;
    ``sizes``: corpus_id, docs. "Total" is the sum of document frequencies. Lists are sorted. The forms of an n-gram have
    the same number of words.
    """
    tagged = "postag" in forms.columns
    head = F.struct("form", F.array_join("postag", ",").alias("postag")) if tagged else F.struct("form")
    df = F.sum("first") if "first" in forms.columns else F.count_distinct("doc_id")
    of = forms.groupBy("ngram_id", "corpus_id").agg(df.alias("df"), F.max(head).alias("head"), F.collect_set("form").alias("forms"))
    of = of.join(small(sizes), "corpus_id", "left").withColumn("length", F.size(F.split("head.form", " ")))
    ratio = F.when(F.col("docs") > 0, F.col("df") / F.col("docs"))
    ratio_n = F.when(F.col("docs") > 0, F.pow(F.col("df").cast("double"), F.col("length")) / F.col("docs"))
    of = of.withColumns({"ratio": ratio, "ratio_n": ratio_n})
    ranked = lambda r: F.max_by("corpus_id", F.when(F.col(r).isNotNull(), F.struct(r, "corpus_id")))
    out = of.groupBy("ngram_id").agg(
        F.max("head").alias("head"),
        F.sum("df").alias("total"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("forms")))), SEPARATOR).alias("forms"),
        F.max("ratio").alias("max_occs"),
        ranked("ratio").alias("max_period"),
        F.max("ratio_n").alias("max_occs_n"),
        ranked("ratio_n").alias("max_period_n"),
        _joined("corpus_id").alias("periods"),
    )
    out = out.where(F.col("total") >= min_occurrences).withColumn("length", F.size(F.split("head.form", " ")))
    # Tags of the rules are made for labels only, not for each n-gram of each document.
    postag = F.col("head.postag") if tagged else F.array_join(F.transform(F.split("head.form", " "), tagging.tag), ",")
    return out.select("ngram_id", F.lit(status).alias("status"), F.col("head.form").alias("label"), postag.alias("postag"), "total", "forms", "length", F.pow(F.col("total").cast("double"), "length").alias("total_n"), "max_occs", "max_period", "max_occs_n", "max_period_n", "periods")


def report_documents(forms: DataFrame, report: DataFrame) -> DataFrame:
    """ngram_id, doc_id of each n-gram of a report: the documents column of its file in long form."""
    return forms.select("ngram_id", F.col("doc_id").cast("string").alias("doc_id")).distinct().join(report.select("ngram_id"), "ngram_id", "left_semi")


def whitelist_file_rows(report: DataFrame, documents: DataFrame) -> DataFrame:
    """The report under the names of a whitelist file; only there documents (ngram_id, doc_id) are joined into one cell."""
    names = ("status", "label", "postag", "total", "forms", "length", "total_n", "max_occs", "max_period", "max_occs_n", "max_period_n", "periods", "documents")
    cells = documents.groupBy("ngram_id").agg(_joined("doc_id").alias("documents"))
    return report.join(cells, "ngram_id", "left").select(*(F.col(c).alias(n) for c, n in zip(names, WHITELIST_COLUMNS)))


def csv_value(df: DataFrame) -> Column:
    """A CSV line: strings quoted with inner double quotes made single ones, floats with two decimals, the rest plain."""
    cells = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "string":
            cells.append(F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), '"', "'"), F.lit('"')))
        elif kind in ("double", "float"):
            cells.append(F.coalesce(F.format_string("%.2f", c.cast("double")), F.lit("")))
        else:
            cells.append(F.coalesce(c.cast("string"), F.lit("")))
    return F.concat_ws(",", *cells)


def csv_line(df: DataFrame) -> DataFrame:
    return df.select(csv_value(df).alias("value"))


def write_csv(df: DataFrame, path: str, header: bool = True, order: list[str] | None = None) -> None:
    """CSV text in files whose names give their order: sorted by range over all tasks, the header in the first of them."""
    if not order:
        lines = csv_line(df)
        if header:
            lines = df.sparkSession.createDataFrame([(_head(df),)], "value string").unionByName(lines)
        lines.write.mode("overwrite").text(path)
        return
    keys = F.struct(*(F.col(f"`{c}`") for c in order))
    lines = df.select(F.lit(1).alias("part"), keys.alias("at"), csv_value(df).alias("value"))
    if header:
        lines = lines.unionByName(df.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(_head(df)).alias("value")), allowMissingColumns=True)
    lines.repartitionByRange("part", "at").sortWithinPartitions("part", "at").select("value").write.mode("overwrite").text(path)


def _head(df: DataFrame) -> str:
    return ",".join(f'"{c}"' for c in df.columns)


def cooccurrence_rows(cooc: DataFrame, min_cooc: int, periods: list[str] | str | None = None) -> DataFrame:
    """a, b, cooc, corpus_id of pairs that meet often enough."""
    if isinstance(periods, str):
        periods = [periods]
    rows = cooc.where(F.col("cooc") >= min_cooc)
    return (rows if periods is None else rows.where(F.col("corpus_id").isin(periods))).select("a", "b", "cooc", "corpus_id")


def numbered(df: DataFrame, column: str, name: str = "i") -> DataFrame:
    """The distinct values of a column with their 1-based places in sorted order.

    Values are sorted by range over all tasks and counted within each; only the size of each range is shared.
    """
    spark = df.sparkSession
    parts = df.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column)
    rows = materialise(parts.select(column, F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33) + 1).alias("at")))
    sizes = sorted(rows.groupBy("part").count().collect())  # one row per range
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    start = spark.createDataFrame(starts, "part int, before long")
    return rows.join(F.broadcast(start), "part").select(column, (F.col("before") + F.col("at")).cast("int").alias(name))


def archive_matrix(doc_term: DataFrame, terms: DataFrame, min_cooc: int = 1) -> DataFrame:
    """i <= j, cooc, corpus_id: 1-based places of sorted terms, the diagonal being document frequency.

    ``doc_term``: corpus_id, doc_id, term; ``terms``: the list of terms.
    """
    rows = doc_term.select("corpus_id", "doc_id", "term").distinct().join(small(numbered(terms, "term")), "term")
    return matrix_of_sets(rows.groupBy("corpus_id", "doc_id").agg(F.collect_list("i").alias("s")), min_cooc)


def matrix_of_sets(sets: DataFrame, min_cooc: int = 1) -> DataFrame:
    """``archive_matrix`` of documents that are one row each: corpus_id and ``s``, the distinct places of their terms."""
    left = sets.select("corpus_id", F.sort_array("s").alias("s")).select("corpus_id", "s", F.posexplode("s").alias("p", "i"))
    pairs = left.select("corpus_id", "i", F.explode(F.expr("slice(s, p + 1, size(s))")).alias("j"))
    return pairs.groupBy("corpus_id", "i", "j").agg(F.count("*").alias("cooc")).where(F.col("cooc") >= min_cooc)


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graph_head(meta: dict[str, str]) -> str:
    """A GEXF 1.1 file up to its first node."""
    attrs = "".join(f'<attribute id="{i}" title="{t}" type="{k}"></attribute>' for i, (t, k) in enumerate((("weight", "float"), ("category", "string"), ("content", "string"), ("keyword", "string"))))
    esc = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    params = "".join(f'<param key="{esc(k)}" value="{esc(v)}"/>' for k, v in meta.items() if k not in ("date", "description", "creator"))
    head = (
        '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.1draft" xmlns:viz="http://www.gephi.org/gexf/viz" version="1.1">\n'
        f'<meta lastmodifieddate="{esc(meta.get("date", ""))}"><description>{esc(meta.get("description", ""))}</description><creator>{esc(meta.get("creator", ""))}</creator><parameters>{params}</parameters></meta>\n'
        f'<graph type="static">\n<attributes class="node" type="static">{attrs}</attributes>\n<nodes>'
    )
    return head


def graph_xml(nodes: DataFrame, edges: DataFrame, meta: dict[str, str] | None = None, with_edges: bool = True) -> DataFrame:
    """``part``, ``value``: lines of a GEXF 1.1 file in order of part.

    ``nodes``: category, id, label, weight, content, keywords (array); ``edges``: src_category, src, dst_category, dst,
    weight. Edges of weight 0 or to nodes that aren't there are left out; edges are directed.
    """
    spark = nodes.sparkSession
    head = graph_head(meta or {})
    fixed = spark.createDataFrame([(0, head), (2, "</nodes>\n<edges>"), (4, "</edges>\n</graph>\n</gexf>")], "part int, value string")
    value = lambda i, c: F.concat(F.lit(f'<attvalue for="{i}" value="'), c, F.lit('" />'))
    gid = lambda cat, i: F.concat(_xml(F.col(cat)), F.lit("::"), _xml(F.col(i)))
    content = F.when(F.col("category") == "Document", value(2, _xml(F.coalesce("content", F.lit("")))))
    keys = F.array_join(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: value(3, _xml(k))), "")
    node = F.concat(F.lit('<node id="'), gid("category", "id"), F.lit('" label="'), _xml(F.coalesce("label", F.lit(""))), F.lit('"><attvalues>'), value(0, F.format_string("%.2f", F.col("weight").cast("double"))), value(1, _xml(F.col("category"))), F.coalesce(content, F.lit("")), keys, F.lit("</attvalues></node>"))
    out = fixed.unionByName(nodes.select(F.lit(1).alias("part"), node.alias("value")))
    if with_edges:
        there = lambda c: nodes.select(F.col("category").alias(f"{c}_category"), F.col("id").alias(c)).distinct()
        kept = edges.where("weight <> 0").join(there("src"), ["src_category", "src"], "left_semi").join(there("dst"), ["dst_category", "dst"], "left_semi")
        src, dst = gid("src_category", "src"), gid("dst_category", "dst")
        edge = F.concat(F.lit('<edge id="'), src, F.lit("--"), dst, F.lit('" source="'), src, F.lit('" target="'), dst, F.lit('" type="directed" weight="'), F.format_string("%.6f", F.col("weight").cast("double")), F.lit('"></edge>'))
        out = out.unionByName(kept.select(F.lit(3).alias("part"), edge.alias("value")))
    return out


def write_graph_xml(lines: DataFrame, path: str) -> None:
    """The lines in order of part, in files whose names give their order; joined they are the graph's file."""
    lines.repartitionByRange("part", F.xxhash64("value")).sortWithinPartitions("part").select("value").write.mode("overwrite").text(path)
