"""Near-duplicate records by multiple-global-order filtering.

A text is its set of five-character runs; two texts are alike if at least ``threshold`` of the runs of either are in
both. Six global orders of all runs are fixed by hash functions. Each order is cut into 64 ranges, and the first run
of a text in each range is a prefix token. Candidates must share the prefix token of one range in all six orders: the
six filters are intersected in one join key, so pairs that pass fewer of them are never made. A further pair of
orders gives a sketch of 128 bits that candidates must agree on before they are verified on their whole texts.

Full-length prefixes under the order of rarity admit every pair without loss, but are not selective on the test tables:
the runs come from few syllables and stand in a thousandth of all records each, so a prefix of 0.3 of a text's runs
meets almost every record. By default prefixes are therefore one run per range. Then a pair of similarity s is missed with
probability (1 - s^6)^64: 3e-4 at 0.7, 4e-6 at 0.75, 3e-9 at 0.8 (plus 1e-5 for the sketch at 0.7).

With ``exact`` no pair is missed: candidates share a run among their prefixes of full length under the order of rarity
(at least 1 - threshold of a text's runs, rarest first), pass the filters of length and of place in the prefix, and
share a run of their prefixes under each of the other orders too; those that pass all filters are verified. Its cost
follows how often the rarer runs of texts repeat; texts of a frequent run meet in blocks, two blocks to a task.

Copies are folded by a 64-bit hash of the normalised text before pairing. A bucket of up to 65 texts gives all its
pairs. In a larger one each text meets the 64 next to it; then every text outside the bucket's largest component meets
the whole bucket, which covers all pairs that could still join two components. Links are counted on demand: a group that
has a text in such a bucket is cut into blocks, and all pairs of its texts are compared, two blocks at a time.

Edge cases: records whose abstract is null or blank take no part; a null title is empty; texts of fewer than five
characters are alike only if equal; repeated rows and ties keep every record, the group is known by the smallest
record id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.llm.components import components
from lexiweave.llm.words import not_blank
from lexiweave.store import materialise, release

RUN = 5
THRESHOLD = 0.7
ORDERS = 6
RANGES = 64
NEAR = 64
#: Differing bits of 128 up to which a candidate is verified.
SKETCH_BITS = 40
#: Ids of texts to verify are broadcast up to this many (16 MB), and joined by shuffle beyond.
BROADCAST_IDS = 1_000_000
#: Different texts, and characters of them, in a block of a large group, about.
BLOCK_TEXTS, BLOCK_CHARS = 1000, 4_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def normalised(title: Column, abstract: Column) -> Column:
    """Title, blank, abstract in lower case with each stretch of white space made one blank."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), abstract)
    return F.regexp_replace(F.lower(text), "[\\s\\u000b\\u001c-\\u001f\\u0085\\p{Z}]+", " ")


def _runs(codes: np.ndarray) -> np.ndarray:
    """A hash of the run that starts at each position but the last four."""
    n = len(codes) - RUN + 1
    h = codes[:n].astype(_U)
    for k in range(1, RUN):
        h = h * _U(0x100000001B3) + codes[k : n + k]
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def run_set(text: str) -> np.ndarray:
    """The distinct runs of a text, sorted."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.unique(_runs(codes)) if len(codes) >= RUN else np.zeros(0, _U)


def similarity(x: str, y: str) -> float:
    """Share of the runs of either text that are in both; equal texts without runs have 1."""
    a, b = run_set(x), run_set(y)
    if not len(a) or not len(b):
        return float(x == y)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def first_runs(texts: list[str], orders: range) -> np.ndarray:
    """For each text and order, the first run in each of the 64 ranges: shape (texts, orders, ranges).

    An empty range borrows from the next one that isn't, so that equal texts agree; a text without runs has zeros.
    """
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    sizes = np.array([len(r) // 4 for r in raw])
    out = np.zeros((len(texts), len(orders), RANGES), _U)
    codes = np.frombuffer(b"".join(raw), np.uint32)
    if len(codes) < RUN:
        return out
    h = _runs(codes)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(texts)), sizes)[: len(h)]
    keep = np.arange(len(h)) + RUN <= ends[doc]
    h, doc = h[keep], doc[keep]
    base = doc * RANGES
    some = np.bincount(doc, minlength=len(texts)) > 0
    top = _U(0xFFFFFFFFFFFFFFFF)
    for k, order in enumerate(orders):
        x = (h ^ _U(0xA24BAED4963EE407 * (2 * order + 1) & 0xFFFFFFFFFFFFFFFF)) * _U((0x9FB21C651E98DF25 + 0x1000000016 * order) | 1)
        x ^= x >> _U(29)
        x *= _MIX
        least = np.full(len(texts) * RANGES, top, _U)
        # The top bits name the range, the rest the place within it.
        np.minimum.at(least, base + (x >> _U(58)).astype(np.int64), x << _U(6))
        least = least.reshape(len(texts), RANGES)
        for row in np.nonzero((least == top).any(1) & some)[0]:
            own = least[row]
            full = np.nonzero(own != top)[0]
            empty = np.nonzero(own == top)[0]
            at = full[np.searchsorted(full, empty) % len(full)]
            own[empty] = own[at] + ((at - empty) % RANGES).astype(_U) * _MIX
        out[:, k] = least
    out[~some] = 0
    return out


def band_keys(texts: list[str]) -> np.ndarray:
    """64 keys a text; two texts have key r in common if they agree on range r in all orders."""
    first = first_runs(texts, range(ORDERS))
    key = np.broadcast_to(np.arange(1, RANGES + 1, dtype=_U) * _U(0xC2B2AE3D27D4EB4F), (len(texts), RANGES)).copy()
    for k in range(ORDERS):
        key = (key ^ first[:, k]) * _MIX
        key ^= key >> _U(31)
    return key.view(np.int64)


def sketches(texts: list[str]) -> np.ndarray:
    """Two 64-bit words a text whose bits agree more often the more alike two texts are."""
    first = first_runs(texts, range(ORDERS, ORDERS + 2))
    first = (first ^ (first >> _U(33))) * _MIX
    bits = (first >> _U(63)).astype(np.uint8)
    return np.packbits(bits, axis=2).reshape(len(texts), 2, 8).view(">i8").astype(np.int64)[:, :, 0]


def _chunks(batch: pa.RecordBatch, column: int, size: int = 200_000) -> Iterator[tuple[int, int, list[str]]]:
    """Pieces of a batch of at most ``size`` characters, or of one text."""
    texts = batch.column(column).to_pylist()
    at = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield at, i, texts[at:i]
            at = i
            total = 0
        total += len(t)
    if texts:
        yield at, len(texts), texts[at:]


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        node = b.column(0).to_numpy()
        # Copies within a batch send their keys once.
        b = b.take(pa.array(np.sort(np.unique(node, return_index=True)[1])))
        node = b.column(0).to_numpy()
        for i, j, texts in _chunks(b, 1):
            long = np.array([len(t) >= RUN for t in texts])
            keys = band_keys(texts)[long]
            yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(node[i:j][long], RANGES))], names=["key", "node"])


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, texts in _chunks(b, 2):
            s = sketches(texts)
            yield pa.record_batch([b.column(0)[i:j], b.column(1)[i:j], pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy())], names=["rec_id", "node", "s1", "s2"])


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of texts next to each other in buckets; input sorted by key and node.

    Rows have ``hot`` false, a and b a pair of nodes; or true, a a node and b the key of its large bucket.
    """
    none = np.zeros(0, np.int64)
    ck, cn, told, size = none, none, False, 0  # the open bucket: its last rows, whether they were told as hot, rows so far
    for batch in batches:
        k = np.concatenate([ck, batch.column(0).to_numpy()])
        n = np.concatenate([cn, batch.column(1).to_numpy()])
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (n[1:] != n[:-1])
        old = len(ck)
        k, n = k[fresh], n[fresh]
        out_a, out_b = [none], [none]
        for d in range(1, min(NEAR, len(k) - 1) + 1):
            same = np.nonzero(k[d:] == k[:-d])[0]
            if not len(same):
                break
            same = same[same + d >= old]
            out_a.append(n[same])
            out_b.append(n[same + d])
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        starts = np.nonzero(np.concatenate([[True], k[1:] != k[:-1]]))[0]
        lengths = np.diff(np.append(starts, len(k)))
        full = lengths.copy()
        if old and len(full):
            full[0] += size - old  # rows of the open bucket that aren't carried any more
        hot = np.repeat(full > NEAR + 1, lengths)
        if told and old:
            hot[:old] = False
        ha, hb = n[hot], k[hot]
        yield pa.record_batch([pa.array(np.concatenate([np.minimum(a, b), ha])), pa.array(np.concatenate([np.maximum(a, b), hb])), pa.array(np.repeat([False, True], [len(a), len(ha)]))], names=["a", "b", "hot"])
        if len(k):
            at, size = starts[-1], int(full[-1])
            told = size > NEAR + 1
            at = max(at, len(k) - NEAR) if told else at
            ck, cn = k[at:], n[at:]


def _verify(x, y):
    return pd.Series([similarity(a, b) for a, b in zip(x, y)], dtype="float64")


def _links(pairs: DataFrame, marks: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs of nodes that are alike, out of candidates (a, b); written to the shared folder."""
    one = marks.groupBy("node").agg(F.first("s1").alias("s1"), F.first("s2").alias("s2"))
    side = lambda c: one.select(F.col("node").alias(c), F.col("s1").alias(f"{c}1"), F.col("s2").alias(f"{c}2"))
    differ = F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")))
    near = materialise(pairs.join(side("a"), "a").join(side("b"), "b").where(differ <= SKETCH_BITS).select("a", "b"))
    ids = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    own = texts.join(ids, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    end = lambda c: own.select(F.col("node").alias(c), F.col("text").alias(f"t{c}"))
    alike = F.pandas_udf(_verify, "double")
    done = materialise(near.join(end("a"), "a").join(end("b"), "b").select("a", "b", alike("ta", "tb").alias("similarity")).where(F.col("similarity") >= threshold))
    release(near)
    return done


def _common_runs(x: list[np.ndarray], y: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """The number of runs in both, for each of the sets ``x`` and each of ``y``."""
    both = np.zeros((len(x), len(y)), np.int64)
    runs, n = np.unique(np.concatenate([*x, *y]), return_counts=True)
    runs = runs[n > 1]

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row, h = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.searchsorted(runs, h)
        known = at < len(runs)
        known[known] = runs[at[known]] == h[known]
        row, at = row[known], at[known]
        order = np.argsort(at, kind="stable")
        return row[order], at[order]

    sides = [(len(s), *places(s)) for s in (x, y)]
    for start in range(0, len(runs), width):
        parts = []
        for n_sets, row, at in sides:
            lo, hi = np.searchsorted(at, [start, start + width])
            part = np.zeros((n_sets, width), np.float32)
            part[row[lo:hi], at[lo:hi] - start] = 1
            parts.append(part)
        both += (parts[0] @ parts[1].T).astype(np.int64)
    return both


def _block_links(threshold: float):
    """Links of each text in two blocks of a group; rows have block, node and text."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        first, second = key[1].as_py(), key[2].as_py()
        block, node = table["block"].to_numpy(), table["node"].to_numpy()
        sets = [run_set(t.as_py()) for t in table["text"]]
        left, right = np.nonzero(block == first)[0], np.nonzero(block == second)[0]
        if not len(left) or not len(right):
            return pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        both = _common_runs([sets[i] for i in left], [sets[i] for i in right])
        sizes = np.array([len(s) for s in sets])
        alike = both / np.maximum(sizes[left][:, None] + sizes[right][None, :] - both, 1) >= threshold
        if first == second:
            np.fill_diagonal(alike, False)
            return pa.table({"node": node[left], "n": alike.sum(1)})
        return pa.table({"node": np.concatenate([node[left], node[right]]), "n": np.concatenate([alike.sum(1), alike.sum(0)])})

    return run


def _exact_degrees(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """node, n_links over all pairs of nodes (node, label) with the same label."""
    own = materialise(texts.join(members, "node").groupBy("label", "node").agg(F.first("text").alias("text")))
    sizes = own.groupBy("label").agg(F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum(F.length("text")) / BLOCK_CHARS)).alias("blocks"))
    cut = own.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    cells = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "text")
    part = cells.groupBy("label", "i", "j").applyInArrow(_block_links(threshold), "node long, n long")
    done = materialise(part.groupBy("node").agg(F.sum("n").alias("n_links")))
    release(own)
    return done


#: Texts of a run that meet in one task in the exact mode; the texts of a more frequent run are cut into blocks.
BLOCK_NODES = 2000


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, size and run for each run of each text."""
    for b in batches:
        for i, j, texts in _chunks(b, 1):
            sets = [run_set(t) for t in texts]
            n = [len(s) for s in sets]
            node = b.column(0).to_numpy()[i:j]
            runs = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(np.repeat(node, n)), pa.array(np.repeat(n, n).astype(np.int32)), pa.array(runs)], names=["node", "size", "run"])


def _prefixes(runs: np.ndarray, threshold: float) -> list[np.ndarray]:
    """The prefix of full length of a set of runs under each order by hash."""
    n = len(runs) - int(np.ceil(threshold * len(runs) - 1e-9)) + 1
    out = []
    for k in range(ORDERS - 1):
        x = (runs ^ _U(0xA24BAED4963EE407 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF)) * _MIX
        x ^= x >> _U(31)
        out.append(runs[np.argpartition(x, n - 1)[:n]] if n < len(runs) else runs)
    return out


def exact_similarity(x: str, y: str, threshold: float) -> float:
    """``similarity`` of texts that pass all filters, 0 for those that share no run of their prefixes under some order."""
    a, b = run_set(x), run_set(y)
    if not len(a) or not len(b):
        return float(x == y)
    for p, q in zip(_prefixes(a, threshold), _prefixes(b, threshold)):
        if not len(np.intersect1d(p, q, assume_unique=True)):
            return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def exact_links(texts: DataFrame, threshold: float) -> DataFrame:
    """a < b, similarity: all pairs of nodes (node, text) that are alike; written to the shared folder."""
    own = materialise(texts.groupBy("node").agg(F.first("text").alias("text")))
    runs = own.mapInArrow(_run_rows, "node long, size int, run long")
    often = materialise(runs.groupBy("run").agg(F.count("*").alias("df")))
    # Places in the prefix count the runs of one text alone as well; only runs of several texts can meet.
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "run"))
    length = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9).cast("int") + 1
    prefix = runs.join(often, "run").withColumn("at", place).where(F.col("at") <= length).where("df > 1")
    blocks = F.ceil(F.col("df") / BLOCK_NODES).cast("int")
    prefix = materialise(prefix.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("blocks", blocks))
    side = lambda n, u, v, spread: prefix.select("run", F.col("node").alias(n), F.col("size").alias(f"s{n}"), F.col("at").alias(f"p{n}"), F.col("own").alias(u), F.explode(spread).alias(v))
    met = side("a", "u", "v", F.sequence("own", F.col("blocks") - 1)).join(side("b", "v", "u", F.sequence(F.lit(0), F.col("own"))), ["run", "u", "v"])
    met = met.where((F.col("a") < F.col("b")) | ((F.col("u") < F.col("v")) & (F.col("a") > F.col("b"))))
    need = F.ceil((F.col("sa") + F.col("sb")) * (threshold / (1 + threshold)) - 1e-9)
    fits = (F.least("sa", "sb") >= F.greatest("sa", "sb") * threshold - 1e-9) & (1 + F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb")) >= need)
    # The places are counted by one order, so what is left after the first common run bounds the overlap.
    first = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min_by(fits, F.col("pa") + F.col("pb")).alias("fits")).where("fits").select("a", "b")
    end = lambda c: own.select(F.col("node").alias(c), F.col("text").alias(f"t{c}"))
    alike = F.pandas_udf(lambda x, y: pd.Series([exact_similarity(p, q, threshold) for p, q in zip(x, y)], dtype="float64"), "double")
    done = materialise(first.join(end("a"), "a").join(end("b"), "b").select("a", "b", alike("ta", "tb").alias("similarity")).where(F.col("similarity") >= threshold))
    for df in (own, often, prefix):
        release(df)
    return done


def near_duplicate_groups(records: DataFrame, threshold: float = THRESHOLD, count_links: bool = True, exact: bool = False) -> DataFrame:
    """rec_id, group_id (smallest rec_id of the group) and, if asked for, n_links for each record (rec_id, title, abstract).

    ``n_links`` counts the different texts that the record's text is alike to; its copies are not among them. With
    ``exact`` no pair is missed, at a cost that depends on the texts.
    """
    texts = records.where(not_blank(F.col("abstract"))).select(F.col("rec_id").cast("long").alias("rec_id"), normalised(F.col("title"), F.col("abstract")).alias("text")).select("rec_id", F.xxhash64("text").alias("node"), "text")
    texts = materialise(texts)
    marks, crowd = texts, None
    if exact:
        links = exact_links(texts.select("node", "text"), threshold)
        labels = materialise(components(links))
    else:
        marks = materialise(texts.mapInArrow(_sketch_rows, "rec_id long, node long, s1 long, s2 long"))
        bands = texts.select("node", "text").mapInArrow(_band_rows, "key long, node long")
        found = materialise(bands.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_pair_rows, "a long, b long, hot boolean").distinct())
        links = _links(found.where("not hot").select("a", "b"), marks, texts, threshold)
        labels = materialise(components(links))
        large = found.where("hot").select(F.col("a").alias("node"), F.col("b").alias("key"))
        if large.limit(1).count():
            part = large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            most = part.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
            rest = part.join(most, "key").where("label <> most").select("key", F.col("node").alias("x"), F.col("label").alias("lx"))
            across = rest.join(part.select("key", F.col("node").alias("y"), F.col("label").alias("ly")), "key").where("lx <> ly")
            more = _links(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), marks, texts, threshold)
            links = materialise(links.unionByName(more).dropDuplicates(["a", "b"]))
            labels = materialise(components(links))
            if count_links:
                # Not all pairs within the components of a large bucket were made.
                crowded = large.select("node").distinct().join(labels, "node").select("label").distinct()
                crowd = _exact_degrees(labels.join(crowded, "label", "left_semi").select("node", "label"), texts, threshold)
        release(found)
    own = materialise(marks.select("rec_id", "node"))
    release(texts)
    own = own.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    group = own.groupBy("label").agg(F.min("rec_id").alias("group_id"))
    own = own.join(group, "label")
    if not count_links:
        return own.select("rec_id", "group_id")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    if crowd is not None:
        degree = degree.join(crowd.select("node"), "node", "left_anti").unionByName(crowd)
    return own.join(degree, "node", "left").select("rec_id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def group_pairs(groups: DataFrame) -> DataFrame:
    """rec_a < rec_b for the records of each group. The result itself grows as the square of a group."""
    groups = materialise(groups.select("rec_id", "group_id"))
    more = groups.where("rec_id <> group_id")
    # A record that has company: any but the first of its group, and the first of those.
    all_of = more.unionByName(more.select(F.col("group_id").alias("rec_id"), "group_id").distinct())
    left, right = all_of.withColumnRenamed("rec_id", "rec_a"), all_of.withColumnRenamed("rec_id", "rec_b")
    return left.join(right, "group_id").where("rec_a < rec_b").select("rec_a", "rec_b")
