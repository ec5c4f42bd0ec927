"""Co-occurrence and similarity graphs: pairs, proximities, thresholds, top-k neighbours and nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweave.config import GraphConfig
from lexiweave.operators.index import small


def cooccurrence(doc_ngram: DataFrame, item: str = "ngram_id") -> DataFrame:
    """corpus_id, a < b, cooc: documents of a corpus that hold both items.

    Items are gathered per document in one shuffle; pairs come from nested explodes, not from a join.
    """
    return cooccurrence_of_sets(doc_ngram.groupBy("corpus_id", "doc_id").agg(F.collect_set(item).alias("s")))


def cooccurrence_of_sets(sets: DataFrame) -> DataFrame:
    """``cooccurrence`` of documents that are one row each: corpus_id and ``s``, the distinct items."""
    sets = sets.where(F.size("s") > 1).select("corpus_id", F.sort_array("s").alias("s"))
    left = sets.select("corpus_id", "s", F.posexplode("s").alias("p", "a")).where(F.col("p") < F.size("s") - 1)
    pairs = left.select("corpus_id", "a", F.explode(F.expr("slice(s, p + 2, size(s))")).alias("b"))
    return pairs.groupBy("corpus_id", "a", "b").agg(F.count("*").alias("cooc"))


def sum_periods(cooc: DataFrame, periods: list[str] | None = None) -> DataFrame:
    """a, b, cooc over the chosen corpora, all by default."""
    rows = cooc if periods is None else cooc.where(F.col("corpus_id").isin(periods))
    return rows.groupBy("a", "b").agg(F.sum("cooc").alias("cooc"))


def node_weights(df: DataFrame, key: str, periods: list[str] | None = None) -> DataFrame:
    """node, w: document frequency over the chosen corpora (corpus_id, key, df)."""
    rows = df if periods is None else df.where(F.col("corpus_id").isin(periods))
    return rows.groupBy(F.col(key).alias("node")).agg(F.sum("df").alias("w"))


def with_weights(edges: DataFrame, nodes: DataFrame, threshold: tuple[float, float]) -> DataFrame:
    """Edges whose both ends pass the node threshold, with the ends' weights oa and ob."""
    kept = nodes.where(F.col("w").between(*threshold))
    side = lambda c: kept.select(F.col("node").alias(c), F.col("w").alias(f"o{c}"))
    return edges.join(side("a"), "a").join(side("b"), "b")


def mirror(edges: DataFrame, weight: Column | None = None, back: Column | None = None) -> DataFrame:
    """src, dst, weight in both directions, ``back`` for the second."""
    weight = F.col("cooc").cast("double") if weight is None else weight
    back = weight if back is None else back
    both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), weight.alias("weight")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), back.alias("weight"))))
    return edges.select(both.alias("e")).select("e.*")


def _cooccurrences(e: DataFrame, n: int | None, cfg: GraphConfig) -> DataFrame:
    return mirror(e)


def _pseudo_inclusion(e: DataFrame, n: int | None, cfg: GraphConfig) -> DataFrame:
    x, y = F.col("cooc") / F.col("oa"), F.col("cooc") / F.col("ob")
    a = cfg.alpha
    return mirror(e, F.pow(x, F.lit(a)) * F.pow(y, F.lit(1 / a)), F.pow(y, F.lit(a)) * F.pow(x, F.lit(1 / a)))


def _equivalence_index(e: DataFrame, n: int | None, cfg: GraphConfig) -> DataFrame:
    return mirror(e, F.log(F.col("cooc") * F.lit(float(n)) / (F.col("oa") * F.col("ob"))))


PROXIMITIES: dict[str, Callable[[DataFrame, int | None, GraphConfig], DataFrame]] = {
    "cooccurrences": _cooccurrences,
    "pseudo_inclusion": _pseudo_inclusion,
    "equivalence_index": _equivalence_index,
}


def edge_threshold(edges: DataFrame, bounds: tuple[float, float]) -> DataFrame:
    return edges.where(F.col("weight").between(*bounds))


def max_degree(edges: DataFrame, k: int) -> DataFrame:
    """Each source's ``k`` heaviest neighbours, ties by neighbour."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return edges.withColumn("rank", rank).where(F.col("rank") <= k)


def ngram_graph(cooc: DataFrame, nodes: DataFrame, cfg: GraphConfig, n_documents: int | None = None) -> DataFrame:
    """src, dst, weight: node threshold, then proximity, then edge threshold, then degree."""
    edges = PROXIMITIES[cfg.proximity](with_weights(cooc, nodes, cfg.node_threshold), n_documents, cfg)
    edges = edge_threshold(edges, cfg.edge_threshold)
    return max_degree(edges, cfg.max_degree).drop("rank") if cfg.max_degree else edges


#: Documents of an item that meet in one task; the documents of a more frequent item are cut into blocks of about so many.
BLOCK_DOCUMENTS = 2_000


def _meetings(sets: DataFrame, df: DataFrame) -> DataFrame:
    """a < b, the rows ra and rb of both, and their common items, once for each pair that meets in its prefixes.

    ``sets``: d, x (items, rarest first), n (length of the prefix) and what else is wanted; ``df``: i, df. A pair comes
    from its first common item only. The documents of a frequent item are cut into blocks, and each two blocks meet in
    a task of their own.
    """
    blocks = df.where(F.col("df") > BLOCK_DOCUMENTS).select("i", F.ceil(F.col("df") / BLOCK_DOCUMENTS).cast("int").alias("blocks"))
    rows = sets.select(F.struct(*sets.columns).alias("r"), F.explode(F.slice("x", F.lit(1), F.col("n"))).alias("i"))
    rows = rows.join(small(blocks), "i", "left").withColumn("own", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("r.d"), F.col("blocks")).cast("int")).otherwise(0))
    last = F.coalesce("blocks", F.lit(1)) - 1
    left = rows.select("i", F.col("r").alias("ra"), F.col("own").alias("u"), F.explode(F.sequence("own", last)).alias("v"))
    right = rows.select("i", F.col("r").alias("rb"), F.col("own").alias("v"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("u"))
    met = left.join(right, ["i", "u", "v"]).where((F.col("ra.d") < F.col("rb.d")) | ((F.col("u") < F.col("v")) & (F.col("ra.d") > F.col("rb.d"))))
    # Exploded, so that it isn't computed again for the filter and for each use.
    both = met.select("i", "ra", "rb", F.explode(F.array(F.array_intersect("ra.x", "rb.x"))).alias("both")).where(F.get("both", 0) == F.col("i"))
    return both.select(F.least("ra.d", "rb.d").alias("a"), F.greatest("ra.d", "rb.d").alias("b"), "ra", "rb", "both")


def _sets(doc_item: DataFrame, df: DataFrame, doc: str, item: str) -> DataFrame:
    """d, x: the items of each document, rarest first, and w: their weights 1 / ln(1 + df)."""
    rows = doc_item.select(F.col(doc).alias("d"), F.col(item).alias("i")).distinct().join(df, "i")
    e = rows.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("df", "i"))).alias("e"))
    return e.select("d", F.col("e.i").alias("x"), F.transform("e", lambda y: 1 / F.log1p(y["df"].cast("double"))).alias("w"))


def shared_items(doc_item: DataFrame, doc: str = "doc_id", item: str = "ngram_id", least: int = 1) -> DataFrame:
    """a < b, shared: items that two documents have in common, at least ``least``; other pairs never arise.

    Documents with so many common items share one of all but their ``least - 1`` most frequent items, so only these meet.
    """
    df = doc_item.select(F.col(doc).alias("d"), F.col(item).alias("i")).distinct().groupBy("i").agg(F.count("*").alias("df"))
    sets = _sets(doc_item, df, doc, item).select("d", "x", (F.size("x") - (least - 1)).alias("n"))
    return _meetings(sets.where("n > 0"), df).select("a", "b", F.size("both").cast("long").alias("shared")).where(F.col("shared") >= least)


def log_jaccard(doc_item: DataFrame, df: DataFrame, doc: str = "doc_id", item: str = "ngram_id", least: float = 0.0) -> DataFrame:
    """a < b, shared, weight: common over united weight of items, an item weighing 1 / ln(1 + df) (item, df).

    The united weight is S(a) + S(b) - common, so only pairs with a common item are met. With ``least`` only pairs of
    that weight or more come: the common items of such a pair weigh ``least`` times S of either document, so one of
    them is among a document's rarest items, those before the last ones that weigh less than that together.
    """
    df = df.select(F.col(item).alias("i"), F.col("df").cast("long").alias("df"))
    total = lambda w: F.aggregate(w, F.lit(0.0), lambda acc, y: acc + y)
    sets = _sets(doc_item, df, doc, item).withColumn("s", total("w"))
    # Weights are summed from the last item on while they are too few.
    bound = F.col("s") * (least * (1 - 1e-9))
    few = F.aggregate(F.reverse("w"), F.struct(F.lit(0.0).alias("w"), F.lit(0).alias("n")), lambda acc, y: F.struct((acc["w"] + y).alias("w"), (acc["n"] + (acc["w"] + y < bound).cast("int")).alias("n")))
    sets = sets.withColumn("n", F.size("x") - few["n"] if least > 0 else F.size("x"))
    num = total(F.transform("both", lambda y: F.get("ra.w", F.array_position("ra.x", y).cast("int") - 1)))
    met = _meetings(sets, df).select("a", "b", F.size("both").cast("long").alias("shared"), F.explode(F.array(num)).alias("num"), (F.col("ra.s") + F.col("rb.s")).alias("sum"))
    return met.select("a", "b", "shared", (F.col("num") / (F.col("sum") - F.col("num"))).alias("weight")).where(F.col("weight") >= least)


def surviving_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, w of the sources of an edge table; isolated nodes vanish."""
    return nodes.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
