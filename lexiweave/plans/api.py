"""The engine's calls: extract, index, preprocess, graph, archive counts and exports."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.config import DOCUMENT_GRAPH, NGRAM_GRAPH, Extraction, GraphConfig
from lexiweave.functions import text as tx
from lexiweave.functions.stemming import vocabulary_stems
from lexiweave.operators import graph, index, mutate, report, search
from lexiweave.plans.dataset import Dataset, folders
from lexiweave.sources import readers
from lexiweave.store import materialise


class Engine:
    """Entry point: ``root`` holds the data sets, with ``sources``, ``whitelists`` and ``user`` beside them.

    ``extract`` may be replaced by another tokenizer: documents, stop n-grams and settings to the rows of
    ``index.candidates``; ``stemmer`` by another function of the distinct words (see ``stemming.vocabulary_stems``).
    """

    def __init__(self, spark: SparkSession, root: str, extraction: Extraction = Extraction(), tokenizer: Callable[..., DataFrame] = index.candidates, stemmer: Callable[[DataFrame], DataFrame] = vocabulary_stems):
        self.spark, self.root, self.extraction, self.tokenizer, self.stemmer = spark, root.rstrip("/"), extraction, tokenizer, stemmer

    def dataset(self, name: str) -> Dataset:
        return Dataset(self.spark, self.root, name)

    def datasets(self) -> list[str]:
        return folders(self.spark, self.root)

    def _files(self, *names: str) -> list[str]:
        """Paths in a folder below the root, but for hidden ones and those that begin with a tilde."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *names)))
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(f.getPath().toString() for f in fs.listStatus(path) if f.getPath().getName()[0] not in "~._") if fs.exists(path) else []

    def source_files(self) -> list[str]:
        return self._files("sources")

    def whitelists(self) -> list[str]:
        return self._files("whitelists")

    def user_files(self, name: str, kind: str) -> list[str]:
        """What was written for a data set: ``gexf`` or ``cooccurrences``."""
        return self._files("user", name, kind)

    def user_path(self, name: str, kind: str, label: str) -> str:
        return f"{self.root}/user/{name}/{kind}/{label}"

    def delete_whitelist(self, path: str) -> bool:
        """Remove a whitelist that ``whitelists`` lists; other paths are left alone."""
        if path not in self.whitelists():
            return False
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def whitelist(self, source: DataFrame | str) -> DataFrame:
        """A whitelist from a frame, a path, the name of a data set (its own whitelist) or of a file among ``whitelists``.

        A file is known by its name up to the first dash or dot.
        """
        if not isinstance(source, str):
            return source
        if "/" not in source:
            if self.dataset(source).exists("whitelist"):
                return self.dataset(source).read("whitelist")
            named = [p for p in self.whitelists() if re.split(r"[-.]", p.rsplit("/", 1)[-1])[0] == source]
            source = named[0] if named else source
        return readers.whitelist_csv(self.spark, source)

    def extract_file(self, dsn: str, out: str | None = None, min_occurrences: int = 1, stops: DataFrame | None = None, **options) -> DataFrame:
        """Source to candidate whitelist, written as CSV if ``out`` is given."""
        docs = readers.open_source(self.spark, dsn, **options)
        return self.extract(docs, out, min_occurrences, stops)

    def extract(self, documents: DataFrame, out: str | None = None, min_occurrences: int = 1, stops: DataFrame | None = None) -> DataFrame:
        forms = self.tokenizer(documents, stops, self.extraction, self.stemmer)
        sizes = documents.groupBy("corpus_id").agg(F.count_distinct("doc_id").alias("docs"))
        rows = report.whitelist_report(forms, sizes, min_occurrences)
        if out:
            report.write_csv(report.whitelist_file_rows(rows, report.report_documents(forms, rows)), out, order=["label"])
        return rows

    def index_file(self, dsn: str, name: str, whitelist: DataFrame | str, **options) -> DataFrame:
        """Index a source into a data set and preprocess it; returns the documents that were there already."""
        return self.index(readers.open_source(self.spark, dsn, **options), name, self.whitelist(whitelist))

    def index(self, documents: DataFrame, name: str, whitelist: DataFrame) -> DataFrame:
        data = self.dataset(name)
        keys = ["corpus_id", "doc_id"]
        known = documents.limit(0)
        if data.exists("documents"):
            known = documents.join(data.read("documents").select(*keys), keys, "left_semi")
        known = known.unionByName(documents.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys).join(documents, keys).select(*documents.columns))
        forms = materialise(index.document_forms(documents, whitelist, self.extraction))
        data.write("whitelist", whitelist)
        data.merge("doc_form", forms, [*keys, "ngram_id", "form"])
        data.merge("doc_ngram", index.links_of_forms(forms), [*keys, "ngram_id"])
        data.merge("postings", search.postings(documents.dropDuplicates(keys)).repartition("term").sortWithinPartitions("term"), [*keys, "term"])
        data.merge("documents", documents, keys)
        self.graph_preprocess(name)
        return known

    def search(self, name: str, phrases: list[str]) -> DataFrame:
        """corpus_id, doc_id of documents that hold all phrases, from the stored postings; ``count`` it for their number."""
        return search.phrase_hits(self.dataset(name).read("postings"), phrases)

    def master_whitelist(self, name: str) -> DataFrame:
        """The whitelist report of what a data set holds, accepted as a whole: one row for each n-gram."""
        data = self.dataset(name)
        forms = data.read("doc_form")
        sizes = data.read("documents").groupBy("corpus_id").agg(F.count_distinct("doc_id").alias("docs"))
        return report.whitelist_report(forms, sizes, status="w")

    def graph_preprocess(self, name: str, node_threshold: tuple[float, float] = NGRAM_GRAPH.node_threshold) -> DataFrame:
        """Co-occurrences of every corpus, stored by corpus; the master whitelist is stored and written as a file."""
        data = self.dataset(name)
        links = data.read("doc_ngram")
        df = index.document_frequency(links)
        cooc = graph.cooccurrence(links)
        side = lambda c: df.where(F.col("df").between(*node_threshold)).select("corpus_id", F.col("ngram_id").alias(c))
        master = data.write("whitelist_master", self.master_whitelist(name))
        report.write_csv(report.whitelist_file_rows(master, report.report_documents(data.read("doc_form"), master)), f"{self.root}/whitelists/{name}_master", order=["label"])
        return data.write("cooc", cooc.join(side("a"), ["corpus_id", "a"], "left_semi").join(side("b"), ["corpus_id", "b"], "left_semi").select("corpus_id", "a", "b", "cooc"), partition_by="corpus_id")

    def generate_graph(self, name: str, periods: list[str] | None = None, out: str | None = None, ngram_graph: GraphConfig = NGRAM_GRAPH, document_graph: GraphConfig = DOCUMENT_GRAPH, export_edges: bool = True) -> tuple[DataFrame, DataFrame]:
        """nodes (category, id, label, weight, content, keywords) and edges of the n-gram and document graphs."""
        data = self.dataset(name)
        pick = lambda t: t if periods is None else t.where(F.col("corpus_id").isin(periods))
        links, docs = pick(data.read("doc_ngram")), pick(data.read("documents"))
        n_docs = docs.select("doc_id").distinct().count()
        if not n_docs or not links.limit(1).count():
            raise ValueError("the chosen periods hold no documents or no n-grams")
        df = index.document_frequency(links)
        nodes = graph.node_weights(df, "ngram_id")
        ngrams = graph.ngram_graph(graph.sum_periods(pick(data.read("cooc"))), nodes, ngram_graph, n_docs)
        pairs = graph.log_jaccard(links, nodes.select(F.col("node").alias("ngram_id"), F.col("w").alias("df"))) if document_graph.proximity == "log_jaccard" else graph.shared_items(links).withColumn("weight", F.col("shared").cast("double"))
        if not document_graph.node_threshold[0] <= 1 <= document_graph.node_threshold[1]:
            pairs = pairs.limit(0)
        edges = graph.edge_threshold(graph.mirror(pairs, F.col("weight")), document_graph.edge_threshold)
        if document_graph.max_degree:
            edges = graph.max_degree(edges, document_graph.max_degree).drop("rank")
        labels = links.groupBy(F.col("ngram_id").alias("node")).agg(F.max("label").alias("label"))
        n_nodes = graph.surviving_nodes(ngrams, nodes).join(labels, "node", "left").select(F.lit("NGram").alias("category"), F.col("node").alias("id"), "label", F.col("w").cast("double").alias("weight"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("array<string>").alias("keywords"))
        heads = docs.groupBy(F.col("doc_id").alias("id")).agg(F.max("label").alias("label"), F.max("content").alias("content"))
        d_nodes = heads.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_semi").select(F.lit("Document").alias("category"), "id", "label", F.lit(1.0).alias("weight"), "content", F.lit(None).cast("array<string>").alias("keywords"))
        all_nodes = n_nodes.unionByName(d_nodes)
        cat = lambda e, a, b: e.select(F.lit(a).alias("src_category"), "src", F.lit(b).alias("dst_category"), "dst", F.col("weight").cast("double").alias("weight"))
        across = links.groupBy("doc_id", "ngram_id").agg(F.sum("occs").alias("weight"))
        all_edges = cat(ngrams, "NGram", "NGram").unionByName(cat(edges, "Document", "Document"))
        all_edges = all_edges.unionByName(cat(across.withColumnRenamed("doc_id", "src").withColumnRenamed("ngram_id", "dst"), "Document", "NGram")).unionByName(cat(across.withColumnRenamed("ngram_id", "src").withColumnRenamed("doc_id", "dst"), "NGram", "Document"))
        data.write("graph_nodes", all_nodes)
        data.write("graph_edges", all_edges)
        if out:
            meta = {"date": datetime.date.today().isoformat(), "description": name, "creator": "lexiweave"} | {f"NGramGraph.{k}": v for k, v in asdict(ngram_graph).items()} | {f"DocumentGraph.{k}": v for k, v in asdict(document_graph).items()}
            report.write_graph_xml(report.graph_xml(data.read("graph_nodes"), data.read("graph_edges"), meta, export_edges), out)
        return data.read("graph_nodes"), data.read("graph_edges")

    def index_archive(self, root: str, periods: list[str], whitelist: DataFrame, out: str | None = None, min_cooc: int = 10, store: str | None = None) -> DataFrame:
        """Co-occurrence matrix of whitelisted terms over an archive; a document is one sequence of tokens.

        With ``out`` the matrix and, beside it, the sorted terms are written; ``store`` names a data set that keeps the
        matrix by terms (see ``archive``).
        """
        docs = readers.medline_archive(self.spark, root, periods)
        wl = whitelist.select("form", "label")
        # The longest form sets the length of n-grams; one row.
        longest = wl.agg(F.max(F.size(F.split("form", " ")))).first()[0] or 1
        terms = index.doc_terms(docs, 1, longest).join(index.small(wl.withColumnRenamed("form", "term")), "term").select("corpus_id", "doc_id", F.col("label").alias("term"))
        places = materialise(report.numbered(wl, "label"))
        matrix = report.archive_matrix(terms, places.select(F.col("label").alias("term")), min_cooc)
        if out or store:
            matrix = materialise(matrix)
        if out:
            report.write_csv(matrix, out, header=False, order=["corpus_id", "i", "j"])
            report.write_csv(places.select("label"), f"{out}-terms", header=False, order=["label"])
        if store:
            side = lambda c, n: index.small(places.select(F.col("i").alias(c), F.col("label").alias(n)))
            self.dataset(store).write("archive", matrix.join(side("i", "a"), "i").join(side("j", "b"), "j").select("corpus_id", "a", "b", "cooc"), partition_by="corpus_id")
        return matrix

    def archive(self, name: str, period: str | None = None) -> DataFrame:
        """corpus_id, a, b, cooc of a stored archive matrix, of one period or all."""
        rows = self.dataset(name).read("archive")
        return rows if period is None else rows.where(F.col("corpus_id") == period)

    def export_cooc(self, name: str, periods: list[str] | str | None = None, out: str | None = None, min_cooc: int = 1) -> DataFrame:
        rows = report.cooccurrence_rows(self.dataset(name).read("cooc"), min_cooc, periods)
        if out:
            report.write_csv(rows, out, header=False)
        return rows

    def update(self, name: str, table: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Rows that replace stored ones of the same keys; links whose number fell to zero are purged."""
        stored = self.dataset(name).upsert(table, rows, keys)
        return self.dataset(name).write(table, mutate.purge(stored, "occs")) if "occs" in stored.columns else stored

    def add_form(self, name: str, form: str, keyword_doc: str | None = None) -> DataFrame:
        """Link a form in the documents of a data set; returns form, doc_count."""
        data = self.dataset(name)
        ident = tx.ngram_id(F.lit(form))
        keys = ["corpus_id", "doc_id", "ngram_id"]
        stored = data.read("doc_ngram")
        # Links of other n-grams are neither read nor written.
        own = stored.where(F.col("ngram_id") == ident)
        known = own.select("label").limit(1).collect()
        new = mutate.add_form(own.select(*keys, "occs"), data.read("documents"), form, keyword_doc).withColumn("label", F.lit(known[0][0] if known else form))
        new = materialise(new)
        data.merge("doc_form", new.select(*keys, F.lit(form.lower()).alias("form"), "label", "occs"), [*keys, "form"])
        data.merge("doc_ngram", new, keys)
        return new.agg(F.lit(form).alias("form"), F.count_distinct("doc_id").alias("doc_count"))

    def delete_form(self, name: str, form: str, ident: str) -> DataFrame:
        """Take a form from an n-gram, which goes with its last form; returns form, doc_count."""
        data = self.dataset(name)
        keys = ["corpus_id", "doc_id", "ngram_id"]
        links, forms = data.read("doc_ngram"), data.read("doc_form")
        gone = (F.col("ngram_id") == ident) & (F.col("form") == form.lower())
        last = not forms.where((F.col("ngram_id") == ident) & (F.col("form") != form.lower())).limit(1).count()
        hit = links.where(F.col("ngram_id") == ident).agg(F.lit(form).alias("form"), F.count_distinct("doc_id").alias("doc_count")).collect()
        less = forms.where(gone).groupBy(*keys).agg(F.sum("occs").alias("less"))
        new = links.where(F.col("ngram_id") != ident) if last else mutate.subtract(links, less, keys)
        data.write("doc_ngram", new.select(*links.columns))
        data.write("doc_form", forms.where(F.col("ngram_id") != ident) if last else forms.where(~gone))
        return self.spark.createDataFrame(hit, "form string, doc_count long")

    def delete_dataset(self, name: str) -> None:
        self.dataset(name).drop()
        user = Dataset(self.spark, f"{self.root}/user", name)
        user.drop()
