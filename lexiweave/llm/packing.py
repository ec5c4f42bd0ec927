"""Filling fixed-capacity containers: bound-certified repacking.

Sizes are tokens of a public tokenizer. Items are spread by hash over parts of bounded size; each part is packed best
fit decreasing and its number of containers is held against lower bounds by dual feasible functions, which certify
it where they meet. A part that isn't certified is packed a second time, with containers completed exactly where one or
two items can do that, and keeps the better packing.

While all containers together exceed the bound of the whole table, parts exchange items: a part with a gap gives back
the items of its containers that have room, a certified one those of its emptiest container only; the rest stays closed.
What was given back is spread over fewer parts and packed again. A round is accepted only if it needs fewer containers
than it opened, so repacking never makes the result worse; the last one packs a single part or saves nothing.

An item longer than a container is cut into full containers and a rest, which is packed like any other item; no other
item is cut.

Edge cases: null and empty texts are items of size 0 and share a container; repeated rows are items of their own;
ties are broken by item, so the packing of a part does not depend on the order of rows; an empty table gives no
containers; extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.store import materialise

CAPACITY = 2048
#: Items of a part on average; a part is packed in one task.
PART_ITEMS = 10_000
#: Containers with less room than this share of the capacity stay closed when items are exchanged.
SLACK = 0.002
#: Vocabulary of token ranks in the format of tiktoken, and its pattern of pretokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, object] = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """item (own number of the row), id, n_tokens. The vocabulary must lie at the same path on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary)
        for b in batches:
            n = [0 if (t := x.as_py()) is None else len(enc.encode_ordinary(t)) for x in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["item", "id", "n_tokens"])

    rows = df.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("id"), F.col(text_col))
    return rows.mapInArrow(run, "item long, id long, n_tokens long")


def lower_bound(histogram: np.ndarray, capacity: int = CAPACITY) -> int:
    """Containers that any packing needs, for the number of items of each size from 0 to the capacity.

    The largest of the volume and of the dual feasible functions of Fekete and Schepers: u(k) for k up to 30, and U(e),
    which rounds sizes above capacity - e up to a container and drops those below e.
    """
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = math.ceil(int((histogram * sizes).sum()) / capacity)
    for k in range(1, 31):
        # In units of 1 / (k * capacity): sizes where (k + 1) x is whole stay, others fall to floor((k + 1) x) / k.
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, k * sizes, scaled // capacity * capacity)
        best = max(best, -(-int((histogram * value).sum()) // (k * capacity)))
    for e in np.unique(np.linspace(1, capacity // 2, 64).astype(int)):
        value = np.where(sizes > capacity - e, capacity, np.where(sizes >= e, sizes, 0))
        best = max(best, -(-int((histogram * value).sum()) // capacity))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The container of each item, items taken from large to small and put where least room is left."""
    out = np.zeros(len(sizes), np.int64)
    rooms: list[int] = []  # sizes of room that some container has
    stacks: dict[int, list[int]] = {}
    made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            room, box = capacity, made
            made += 1
        else:
            room = rooms[at]
            box = stacks[room].pop()
            if not stacks[room]:
                del stacks[room]
                rooms.pop(at)
        out[i] = box
        left = room - size
        if left not in stacks:
            stacks[left] = []
            bisect.insort(rooms, left)
        stacks[left].append(box)
    return out


def completing(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The container of each item; one container at a time, with items from large to small.

    As soon as one or two items left fill what room there is to the last token, they close the container.
    """
    out = np.zeros(len(sizes), np.int64)
    left = np.bincount(sizes, minlength=capacity + 1)
    stacks: dict[int, list[int]] = {}
    for i in np.argsort(-sizes, kind="stable")[::-1].tolist():
        stacks.setdefault(int(sizes[i]), []).append(i)
    box = -1

    def put(size: int) -> None:
        left[size] -= 1
        out[stacks[size].pop()] = box

    left[0] = 0  # items without tokens stay in the first container
    while len(some := np.nonzero(left)[0]):
        box += 1
        room = capacity - int(some[-1])
        put(int(some[-1]))
        while room:
            if left[room]:
                put(room)
                break
            # Pairs x <= room - x, both there.
            x = np.arange(1, room // 2 + 1)
            there = (left[x] > 0) & (left[room - x] > (2 * x == room))
            if there.any():
                a = int(x[there.argmax()])
                put(room - a)
                put(a)
                break
            fits = np.nonzero(left[: room + 1])[0]
            if not len(fits):
                break
            put(int(fits[-1]))
            room -= int(fits[-1])
    return out


_PACKED = "part long, item long, id long, piece long, first_token long, n_tokens long, box long, bound long, boxes long, loose boolean"


def _pack_part(own: pd.DataFrame, part: int, capacity: int) -> pd.DataFrame:
    sizes = own["n_tokens"].to_numpy()
    bound = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
    box = best_fit_decreasing(sizes, capacity)
    if box.max() + 1 > bound:
        again = completing(sizes, capacity)
        if again.max() < box.max():
            box = again
    fill = np.bincount(box, weights=sizes).astype(np.int64)
    gives = fill < capacity * (1 - SLACK) if len(fill) > bound else np.arange(len(fill)) == fill.argmin()
    return own.assign(part=part, box=box, bound=bound, boxes=len(fill), loose=gives[box])[["part", "item", "id", "piece", "first_token", "n_tokens", "box", "bound", "boxes", "loose"]]


def _pack_parts(capacity: int):
    """Packs one part after the other; rows come sorted by part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            for part, own in b.groupby("part", sort=True):
                if held and held[0]["part"].iat[0] != part:
                    yield _pack_part(pd.concat(held, ignore_index=True), int(held[0]["part"].iat[0]), capacity)
                    held = []
                held.append(own)
        if held:
            yield _pack_part(pd.concat(held, ignore_index=True), int(held[0]["part"].iat[0]), capacity)

    return run


def _pack(pieces: DataFrame, parts: int, capacity: int) -> DataFrame:
    cores = pieces.sparkSession.sparkContext.defaultParallelism
    tasks = min(parts, max(4 * cores, parts // 64))
    spread = pieces.withColumn("part", F.pmod(F.xxhash64("item", "piece"), F.lit(parts)))
    return materialise(spread.repartition(tasks, "part").sortWithinPartitions("part", "item", "piece").mapInPandas(_pack_parts(capacity), _PACKED))


_PIECE = ["item", "id", "piece", "first_token", "n_tokens"]


def _cut(sizes: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Full containers cut from long items, and the items and rests to pack."""
    full = F.floor(F.col("n_tokens") / capacity).cast("long")
    long = sizes.where(F.col("n_tokens") > capacity)
    cut = long.withColumn("piece", F.explode(F.sequence(F.lit(1).cast("long"), full)))
    cut = cut.select("item", "id", "piece", ((F.col("piece") - 1) * capacity).alias("first_token"), F.lit(capacity).cast("long").alias("n_tokens"))
    rest = sizes.withColumn("full", F.when(F.col("n_tokens") > capacity, full).otherwise(0).cast("long"))
    rest = rest.select("item", "id", (F.col("full") + 1).alias("piece"), (F.col("full") * capacity).alias("first_token"), (F.col("n_tokens") - F.col("full") * capacity).alias("n_tokens"), "full")
    return cut, rest.where("full = 0 or n_tokens > 0").select(*_PIECE)


def pack(sizes: DataFrame, capacity: int = CAPACITY, part_items: int = PART_ITEMS) -> tuple[DataFrame, DataFrame]:
    """Assignments (doc_id, piece, first_token, n_tokens, container) and certificates of the rounds.

    ``sizes`` has item, id, n_tokens. A container is known by round, part and number within. Certificates hold, for
    each round and part: containers, lower bound, whether they meet; for part -1 the same for all parts of the round
    together, closed containers included, against the bound of the whole table.
    """
    spark = sizes.sparkSession
    cut, rest = _cut(sizes, capacity)
    rest = materialise(rest)
    # The histogram has one row per size up to the capacity.
    histogram = np.zeros(capacity + 1, np.int64)
    for size, count in rest.groupBy("n_tokens").count().collect():
        histogram[size] = count
    n, bound = int(histogram.sum()), lower_bound(histogram, capacity)
    done = [cut.select(*_PIECE, F.concat_ws("-", F.lit("full"), "item", "piece").alias("container"))]
    certs, wholes = [], []
    parts = max(1, math.ceil(n / part_items))
    packed, r, closed = _pack(rest, parts, capacity), 1, 0
    while True:
        name = F.concat_ws("-", F.lit(str(r)), "part", "box").alias("container")
        of_part = packed.groupBy("part").agg(F.first("boxes").alias("containers"), F.first("bound").alias("bound"))
        certs.append(of_part.select(F.lit(r).alias("round"), "part", "containers", "bound"))
        total = of_part.agg(F.coalesce(F.sum("containers"), F.lit(0))).first()[0]
        wholes.append((r, -1, closed + total, bound))
        loose = packed.where("loose")
        n, boxes = loose.agg(F.count("*"), F.count_distinct("part", "box")).first()
        # Certified as a whole, or nobody to exchange with.
        if closed + total <= bound or parts == 1 or not n:
            done.append(packed.select(*_PIECE, name))
            break
        fewer_parts = min(parts - 1, max(1, math.ceil(n / part_items)))
        again = _pack(loose.select(*_PIECE), fewer_parts, capacity)
        saved = boxes - again.agg(F.count_distinct("part", "box")).first()[0]
        if saved <= 0:
            done.append(packed.select(*_PIECE, name))
            break
        done.append(packed.where("not loose").select(*_PIECE, name))
        closed += total - boxes
        packed, parts, r = again, fewer_parts, r + 1
    out, cert = done[0], certs[0]
    for d in done[1:]:
        out = out.unionByName(d)
    for c in certs[1:]:
        cert = cert.unionByName(c)
    cert = cert.unionByName(spark.createDataFrame(wholes, "round int, part long, containers long, bound long")).withColumn("certified", F.col("containers") == F.col("bound"))
    return out.select(F.col("id").alias("doc_id"), "piece", "first_token", "n_tokens", "container"), cert
