"""Evaluation texts in training text, by template canonicalisation and a hash join of windows.

Words are maximal runs of a-z and 0-9 after lower-casing and removing accents. A word of the items is part of their
template if it stands in at least three items or, in a second and looser reading, if some item writes it in small
letters; any other word is a slot: a number, a unit (a short word after a number) or a name. A window of 12 words is
canonicalised by replacing each slot with its type and the distance to the same word before it in the window, so two
windows have the same canonical form exactly if their templates agree and their slots can be renamed one into the
other. The hash of that form is the join key. A window with fewer than ``ANCHORS`` template words in both readings can
match word by word only, and its key is the hash of its words: lists of numbers or names share no key.

Documents' windows are held against a map of bits of all keys, of fixed size, and those that pass are joined with the
items' windows by key: broadcast where these are few (``BROADCAST_BYTES``), else by shuffle. The slot check on the
words gives one verdict for each match: ``verbatim`` where all words are equal, ``reparameterised`` where the templates
are equal and each slot of one has one value in the other; other matches are chance hits and drop out.

Edge cases: null and blank texts, and items of fewer words than the window, match nothing; repeated documents count
once for each id; a window shared by several items counts for all of them; very long texts are processed whole;
extra columns are ignored; no items, no matches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweave.store import materialise

WINDOW = 12
#: A word in at least so many items belongs to their template.
TEMPLATE_ITEMS = 3
#: Template words that a re-parameterised window needs at least.
ANCHORS = 5
#: Letters of a unit at most.
UNIT = 4
#: Bits of the map that documents' windows are held against, as a power of two (2 MB).
MAP_BITS = 24
#: Windows of the items are broadcast up to about this size, and joined by shuffle beyond.
BROADCAST_BYTES = 64 << 20
#: Hashes of template words (8 bytes each) that are sent to each task at most; real vocabularies are far smaller.
MOST_WORDS = 1 << 25

_MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
_ASCII = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
_NUMBER, _UNIT, _NAME = 0, 1, 2
# A code for each type of slot and distance to its last occurrence in the window.
_SLOTS = (np.arange(1, 3 * WINDOW + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(0xA24BAED4963EE407)
_TYPES = (b"0", b"1", b"2")


def words(text: str) -> list[bytes]:
    """The words of a text, in order."""
    return _split(text.lower())


def _split(text: str) -> list[bytes]:
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFD", text))
    return text.encode("ascii", "replace").translate(_ASCII).split()


_hashes: dict[bytes, int] = {}


def _hash(word: bytes) -> int:
    """64 bits of a word, of which the lowest tells a number and the next a short word."""
    if len(_hashes) > 1_000_000:
        _hashes.clear()
    got = _hashes[word] = xxhash.xxh64_intdigest(word) & ~3 | (word[0] < 58) | (len(word) <= UNIT) << 1
    return got


def word_hashes(ws: list[bytes]) -> np.ndarray:
    get = _hashes.get
    return np.fromiter((get(w) or _hash(w) for w in ws), np.uint64, len(ws))


class Reading:
    """Canonical windows under one set of template words (sorted hashes)."""

    def __init__(self, known: np.ndarray, window: int = WINDOW):
        self.known, self.window = known, window

    def codes(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word belongs to the template, and its type as a slot."""
        fixed = np.zeros(len(h), bool)
        if len(self.known):
            fixed = self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] == h
        number = (h & np.uint64(1)).astype(bool)
        fixed &= ~number
        kind = np.where(number, _NUMBER, _NAME)
        after = np.zeros(len(h), bool)
        after[1:] = number[:-1]
        kind[after & ~number & (h & np.uint64(2)).astype(bool)] = _UNIT
        return fixed, kind

    def keys(self, h: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each canonical window and its number of template words, and what ``codes`` says."""
        n = len(h) - self.window + 1
        fixed, kind = self.codes(h)
        out = np.zeros(n, np.uint64)
        for k in range(self.window):
            at = slice(k, n + k)
            # What stands before the window is not seen, so its first word is no unit.
            own = kind[at] if k else np.where(kind[at] == _UNIT, _NAME, kind[at])
            near = np.where(back[at] <= k, back[at], 0)
            out = out * _BASE + np.where(fixed[at], h[at], _SLOTS[own * self.window + near])
        seen = np.concatenate([[0], np.cumsum(fixed)])
        return (out ^ (out >> np.uint64(32))) * _MIX, seen[self.window :] - seen[: -self.window], fixed, kind


def _last_seen(h: np.ndarray, window: int) -> np.ndarray:
    """The distance from each word to the same word before it; the window's length or more if it is too far."""
    order = np.argsort(h, kind="stable")
    gap = np.full(len(h), window, np.int64)
    same = h[order[1:]] == h[order[:-1]]
    gap[order[1:][same]] = (order[1:] - order[:-1])[same]
    return gap


def _windows(ids: list, texts: list[list[bytes]], readings: list[Reading], anchors: int, bits: np.ndarray | None) -> dict[str, list]:
    """Windows of some texts: id, start, key, words, template; only those whose key is in the map, if one is given."""
    out: dict[str, list] = {c: [] for c in ("id", "start", "key", "words", "template")}
    flat = [w for t in texts for w in t]
    size = readings[0].window
    if len(flat) < size:
        return out
    ends = np.cumsum([len(t) for t in texts])
    h = word_hashes(flat)
    n = len(h) - size + 1
    doc = np.searchsorted(ends, np.arange(n), "right")
    whole = np.arange(n) + size <= ends[doc]
    back = _last_seen(h, size)
    exact = np.zeros(n, np.uint64)
    for k in range(size):
        exact = exact * _BASE + h[k : n + k]
    exact = (exact ^ (exact >> np.uint64(29))) * _MIX ^ np.uint64(0x5DEECE66D)
    plain = whole.copy()
    told: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for r in readings:
        key, fixed_words, fixed, kind = r.keys(h, back)
        good = whole & (fixed_words >= anchors)
        plain &= ~good
        told.append((good, key, fixed, kind))
    told.append((plain, exact, np.ones(len(h), bool), np.zeros(len(h), np.int64)))
    met: set[tuple[int, int]] = set()
    for good, key, fixed, kind in told:
        if bits is not None:
            good = good & bits[key >> np.uint64(64 - MAP_BITS)]
        for p in np.nonzero(good)[0].tolist():
            # Both readings may agree.
            if (p, k := int(key[p].astype(np.int64))) in met:
                continue
            met.add((p, k))
            d = int(doc[p])
            out["id"].append(ids[d])
            out["start"].append(p - int(ends[d]) + len(texts[d]))
            out["key"].append(k)
            out["words"].append(b" ".join(flat[p : p + size]))
            out["template"].append(b" ".join(flat[q] if fixed[q] else _TYPES[_NAME if q == p and kind[q] == _UNIT else kind[q]] for q in range(p, p + size)))
    return out


_WINDOW = "id long, start int, key long, words string, template string"


def _batches(shared, anchors: int, window: int):
    """Windows of the rows (id, text) of Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, at = shared.value
        own = [Reading(k, window) for k in sets]
        bits = None if at is None else np.unpackbits(at).view(bool)

        def told(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            got = _windows(ids, texts, own, anchors, bits)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string())
            return pa.record_batch([pa.array(c, pa.binary()).cast(k) if k == pa.string() else pa.array(c, k) for c, k in zip(got.values(), kinds)], names=list(got))

        for b in batches:
            ids, texts, total = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                if (s := t.as_py()) is None:
                    continue
                ids.append(i)
                texts.append(words(s))
                total += len(s)
                if total > 1_000_000:
                    yield told(ids, texts)
                    ids, texts, total = [], [], 0
            yield told(ids, texts)

    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each item by hash, and whether it writes them in small letters."""
    for b in batches:
        hs: list[int] = []
        small: list[bool] = []
        for t in b.column(0):
            text = t.as_py()
            seen = dict.fromkeys(words(text), False)
            # Words as written; a word is small if all its letters are.
            seen |= {w.lower(): True for w in _split(text) if w.islower() and w.lower() in seen}
            hs += [int(np.uint64(_hash(w)).astype(np.int64)) for w in seen if w[0] >= 58]
            small += [s for w, s in seen.items() if w[0] >= 58]
        yield pa.record_batch([pa.array(hs, pa.int64()), pa.array(small, pa.bool_())], names=["h", "small"])


def template_words(items: DataFrame, template_items: int = TEMPLATE_ITEMS) -> list[np.ndarray]:
    """Sorted hashes of the template words of the items (text) in the strict and in the loose reading."""
    seen = items.select("text").mapInArrow(_item_words, "h long, small boolean").groupBy("h").agg(F.count("*").alias("n"), F.max("small").alias("small"))
    rows = seen.where((F.col("n") >= template_items) | F.col("small")).select("h", (F.col("n") >= template_items).alias("often")).limit(MOST_WORDS + 1).toArrow()
    if len(rows) > MOST_WORDS:
        raise ValueError("more template words than can be sent to each task; pass the items in parts")
    h, often = rows["h"].to_numpy().astype(np.int64).view(np.uint64), rows["often"].to_numpy(zero_copy_only=False).astype(bool)
    return [np.sort(h[often]), np.sort(h)]


def slot_verdict(a: Column, b: Column, template_a: Column, template_b: Column) -> Column:
    """``verbatim``, ``reparameterised`` or null for two windows: words and canonical templates as strings.

    The slots agree if renaming the one's words gives the other's: then the pairs of words that stand at the same place
    are as many as the words of either.
    """
    x, y = F.split(a, " "), F.split(b, " ")
    kinds = F.size(F.array_distinct(F.arrays_zip(x, y)))
    one_to_one = (kinds == F.size(F.array_distinct(x))) & (kinds == F.size(F.array_distinct(y)))
    return F.when(a == b, "verbatim").when((template_a == template_b) & one_to_one, "reparameterised")


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, verbatim: bool = False, anchors: int = ANCHORS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, n_windows, n_verbatim: documents (doc_id, text) that repeat windows of items (item_id, text).

    ``n_windows`` counts the document's windows that match any window of the item, ``n_verbatim`` those that do so word
    by word. With ``verbatim`` re-parameterised matches are left out.
    """
    spark = documents.sparkSession
    texts = items.where("text is not null").selectExpr("cast(item_id as long) item_id", "text")
    sets = template_words(texts)
    known = spark.sparkContext.broadcast((sets, None))
    own = texts.mapInArrow(_batches(known, anchors, window), _WINDOW)
    own = materialise(own.select(F.col("id").alias("item_id"), "key", F.col("words").alias("item_words"), F.col("template").alias("item_template")).distinct())
    # At most one row for each bit of the map.
    places = own.select(F.shiftrightunsigned("key", 64 - MAP_BITS).alias("at")).distinct().toArrow()["at"].to_numpy()
    bits = np.zeros(1 << MAP_BITS, bool)
    bits[places] = True
    shared = spark.sparkContext.broadcast((sets, np.packbits(bits)))
    size = own.agg(F.coalesce(F.sum(F.length("item_words") + F.length("item_template") + 64), F.lit(0))).first()[0]
    met = documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_batches(shared, anchors, window), _WINDOW)
    hits = met.withColumnRenamed("id", "doc_id").join(F.broadcast(own) if size <= broadcast_bytes else own, "key")
    if verbatim:
        rows = hits.where(F.col("words") == F.col("item_words")).select("doc_id", "item_id", "start", F.lit(True).alias("same"))
    else:
        verdict = slot_verdict(F.col("words"), F.col("item_words"), F.col("template"), F.col("item_template"))
        rows = hits.withColumn("verdict", verdict).where("verdict is not null").select("doc_id", "item_id", "start", (F.col("verdict") == "verbatim").alias("same"))
    each = rows.groupBy("doc_id", "item_id", "start").agg(F.max("same").alias("same"))
    return each.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_windows"), F.count_if("same").alias("n_verbatim"))
